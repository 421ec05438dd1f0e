"""Latency and request metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..settings import Settings
from ..sources.scratch import written


SHARES = (0.5, 0.95, 0.99)


def ranked_percentiles(rows: DataFrame, *keys: str, value: str, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """_key (the keys as JSON) and p, the exact percentiles of each group with linear interpolation, in bounded memory however
    many values a group has: distinct values are counted, dealt to ranges in order and written; sums of the ranges tell in
    which of them a rank lies, and only within those do running sums find its value. Null values are left out."""
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("{}")
    counts = rows.where(F.col(value).isNotNull()).groupBy(key.alias("_key"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ranges = written(counts.repartitionByRange("_key", "_v").withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = ranges.groupBy("_key", "_range").agg(F.sum("_n").alias("_held")).withColumn("_base", F.coalesce(F.sum("_held").over(before), F.lit(0)))
    total = F.sum("_held").over(Window.partitionBy("_key"))
    place = F.transform(F.array(*map(F.lit, shares)), lambda s: s * (F.col("_total") - 1))
    both = F.array_distinct(F.flatten(F.transform(place, lambda x: F.array(F.floor(x), F.ceil(x)))))
    asked = sums.withColumn("_total", total).withColumn("_rank", F.explode(both)).where((F.col("_rank") >= F.col("_base")) & (F.col("_rank") < F.col("_base") + F.col("_held")))
    wanted = asked.groupBy("_key", "_range").agg(F.first("_base").alias("_base"), F.first("_total").alias("_total"), F.collect_list("_rank").alias("_ranks"))  # two ranks a share
    running = Window.partitionBy("_key", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    within = ranges.join(wanted, ["_key", "_range"]).withColumn("_end", F.col("_base") + F.sum("_n").over(running))
    hit = within.withColumn("_rank", F.explode(F.filter("_ranks", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_n")))))
    values = hit.groupBy("_key").agg(F.first("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def between(x):
        low, high = F.try_element_at("_at", F.floor(x)), F.try_element_at("_at", F.ceil(x))
        return low + (high - low) * (x - F.floor(x))

    return values.select("_key", F.transform(place, between).alias("p"))


def latency_summary(rows: DataFrame, *keys: str, value: str = "latency", accuracy: int | None = None) -> DataFrame:
    """count, min, max, mean, p50, p95, p99 (linear interpolation), 0 where there are no rows. Percentiles are exact, by rank
    selection; with an accuracy they are approximate and take one pass."""
    sums = [F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean")]
    if accuracy is None:
        key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("{}")
        out = rows.groupBy(*keys).agg(*sums).withColumn("_key", key).join(ranked_percentiles(rows, *keys, value=value), "_key", "left")
    else:
        out = rows.groupBy(*keys).agg(*sums, F.percentile_approx(value, list(SHARES), accuracy).alias("p"))
    names = [("min", F.col("min")), ("max", F.col("max")), ("mean", F.col("mean")), *((f"p{n}", F.col("p")[i]) for i, n in enumerate((50, 95, 99)))]
    return out.select(*keys, "count", *(F.round(F.coalesce(c, F.lit(0.0)), 4).alias(n) for n, c in names))


def last_n(rows: DataFrame, n: int = Settings.latency_window, order: str = "seq") -> DataFrame:
    """The newest n rows, as a distributed top-n."""
    return rows.orderBy(F.col(order).desc()).limit(n)


def requests_by_mode(rows: DataFrame) -> DataFrame:
    return rows.groupBy("mode").agg(F.count("*").alias("requests"))


def benchmark_summary(rows: DataFrame, *keys: str, requests: str, hits: str, seconds: str, searches: str, upserts: str) -> DataFrame:
    """Throughput, hit rate, writes avoided and write reduction of each row of sums; 0 where there is nothing to divide by."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n, u = F.col(searches).cast("double"), F.col(upserts).cast("double")
    return rows.select(
        *keys,
        F.round(ratio(F.col(requests).cast("double"), F.col(seconds)), 2).alias("throughput"),
        F.round(ratio(F.col(hits).cast("double"), F.col(requests)), 4).alias("hit_rate"),
        F.round(ratio(100 * (n - u), n), 2).alias("writes_avoided_pct"),
        F.round(ratio(n, u), 2).alias("reduction"),
    )


def newest_per(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key (of responses only the newest counts), by partial aggregates."""
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_row"))
    return newest.select("_row.*")


def debounced(rows: DataFrame, session: str, ts: str, seconds: float, order: str) -> DataFrame:
    """Keystrokes that none of the same session follows within the time."""
    following = F.lead(ts).over(Window.partitionBy(session).orderBy(ts, order))
    return rows.withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next") - F.col(ts) >= seconds)).drop("_next")
