"""Search submissions to counts: deltas, merges, recovery and invalidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key, prefixes
from ..settings import MODES


def deltas(submissions: DataFrame, *keys: str, increment: int = 1) -> DataFrame:
    """delta by query (and further keys, such as the flush); empty queries are dropped."""
    return submissions.where(F.length("query") > 0).groupBy(*keys, "query").agg((F.count("*") * increment).alias("delta"))


def upsert(counts: DataFrame, changes: DataFrame, at: Column | float | None = None) -> DataFrame:
    """query, count, last_searched after the changes (query, delta): a full outer join, so each side shuffles once."""
    at = at if isinstance(at, Column) else F.lit(at).cast("double")
    base = counts.select("query", F.col("count").alias("old"), "last_searched") if "last_searched" in counts.columns else counts.select("query", F.col("count").alias("old"), F.lit(None).cast("double").alias("last_searched"))
    both = base.join(changes.select("query", "delta"), "query", "full_outer")
    return both.select("query", (F.coalesce("old", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("count"), F.when(F.col("delta").isNotNull(), at).otherwise(F.col("last_searched")).alias("last_searched"))


def read_back(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows of the queries that changed."""
    return counts.join(changes.select("query"), "query", "left_semi")


def write_reduction(submissions: DataFrame, flush: str) -> DataFrame:
    """searches, upserts (distinct queries of each flush), flushes and searches / upserts (0 if there are none)."""
    each = deltas(submissions, flush)
    return each.groupBy(flush).agg(F.sum("delta").alias("s"), F.count("*").alias("u")).agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("searches"),
        F.coalesce(F.sum("u"), F.lit(0)).alias("upserts"),
        F.count("*").alias("flushes"),
        F.round(F.coalesce(F.try_divide(F.sum("s"), F.sum("u")), F.lit(0.0)), 3).alias("reduction"),
    )


def replayed(segments: DataFrame, watermark: int) -> DataFrame:
    """Lines that recovery applies: those of segments after the watermark and of the live log (seq null)."""
    return segments.where((F.col("seq").isNull() | (F.col("seq") > watermark)) & (F.length("query") > 0))


def recovery_seq(segments: DataFrame, watermark: int) -> DataFrame:
    """lines replayed, and the sequence number under which they are applied."""
    highest = segments.agg(F.greatest(F.coalesce(F.max("seq"), F.lit(watermark)), F.lit(watermark)).alias("m"))
    return replayed(segments, watermark).agg(F.count("*").alias("lines")).crossJoin(highest).select("lines", (F.col("m") + 1).cast("bigint").alias("seq"))


def stale_keys(changed: DataFrame) -> DataFrame:
    """Cache keys of all prefixes of changed queries in both modes."""
    rows = changed.select(F.explode(prefixes(F.col("query"))).alias("prefix")).distinct()
    return rows.withColumn("mode", F.explode(F.array(*map(F.lit, MODES)))).select("prefix", "mode", cache_key(F.col("mode"), F.col("prefix")).alias("cache_key"))


def still_cached(cached: DataFrame, stale: DataFrame) -> DataFrame:
    return cached.join(stale.select("cache_key"), "cache_key", "left_anti")
