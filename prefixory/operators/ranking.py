"""The trending order: a blend of log-count and recency within each prefix's pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize
from ..settings import Settings
from ..sources.scratch import written
from .index import asked_topk, candidates, checked
from .recency import by_prefix


def pool(basic: DataFrame, asked: DataFrame, scores: DataFrame, counts: DataFrame) -> DataFrame:
    """prefix, query, count, recency: the basic pool (prefix, query, count) and the trending queries of the asked prefixes
    (normalised) that are not in it."""
    with_score = basic.join(scores.select("query", "score"), "query", "left").select("prefix", "query", "count", F.coalesce("score", F.lit(0.0)).alias("recency"))
    more = by_prefix(scores, asked).join(basic.select("prefix", "query"), ["prefix", "query"], "left_anti")
    more = more.join(counts.select("query", "count"), "query", "left").select("prefix", "query", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"), F.col("score").alias("recency"))
    return with_score.unionByName(more)


def blend(pools: DataFrame, history_weight: float = Settings.history_weight, recency_weight: float = Settings.recency_weight, keep: int = Settings.trie_node_capacity) -> DataFrame:
    """Pools ranked by history_weight * log1p(count) / max + recency_weight * recency / max, maxima of 0 taken as 1.
    Values are rounded after ranking."""
    own = Window.partitionBy("prefix")

    def largest(c):
        m = F.max(c).over(own)
        return F.when(m == 0, F.lit(1.0)).otherwise(m)

    logs = pools.withColumn("log", F.log1p(F.col("count").cast("double")))
    scored = logs.withColumn("score", F.lit(history_weight) * F.col("log") / largest(F.col("log")) + F.lit(recency_weight) * F.col("recency") / largest(F.col("recency")))
    rank = F.row_number().over(own.orderBy(F.col("score").desc(), F.col("count").desc(), "query"))
    ranked = scored.withColumn("rank", rank).where(F.col("rank") <= keep)
    return ranked.select("prefix", "rank", "query", "count", F.round("score", 6).alias("score"), F.round("recency", 4).alias("recency"))


def suggest_trending(requests: DataFrame, index: DataFrame | None, scores: DataFrame, counts: DataFrame, limit: int = Settings.suggest_limit, **weights) -> DataFrame:
    """prefix, rank, query, count, score, recency. Without an index the pools of the asked prefixes are ranked from the
    counts. Pools are written once, as they are read twice."""
    asked = requests.select(normalize(F.col("prefix")).alias("prefix")).where("prefix <> ''").distinct()
    basic = asked_topk(asked, counts) if index is None else candidates(asked, index)
    basic = written(basic.select("prefix", "query", "count"), "pools")
    return blend(pool(basic, asked, scores, counts), **weights).where(F.col("rank") <= checked(limit, 1, 50, "limit"))
