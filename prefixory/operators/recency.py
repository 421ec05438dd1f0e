"""Exponentially decayed scores of search submissions (query, t in epoch seconds, optional weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import decay
from ..functions.text import prefixes
from ..settings import MIN_RECENCY, TRENDING_POOL, Settings


def recency_scores(events: DataFrame, now: Column | float, half_life: float = Settings.recency_half_life, weight: Column | None = None) -> DataFrame:
    """query, score, updated: the sum of weights decayed to now, in one aggregate with partial sums. Equal to decaying
    lazily event by event when times do not go back; an event after now counts as new."""
    now = now if isinstance(now, Column) else F.lit(float(now))
    weight = F.lit(1.0) if weight is None else weight
    return events.groupBy("query").agg(F.sum(weight * decay(now - F.col("t"), half_life)).alias("score"), F.max("t").alias("updated"))


def recency_fold(events: DataFrame, now: float, half_life: float = Settings.recency_half_life, segment: float = 3600.0) -> DataFrame:
    """query, score by lazy decay in steps: events decay to the last event of their segment of time, segments then decay to
    now. Scores of segments can be kept and merged, and a hot query is spread over its segments."""
    cut = events.withColumn("segment", F.floor(F.col("t") / F.lit(float(segment))))
    last = cut.groupBy("query", "segment").agg(F.max("t").alias("end"))
    held = cut.join(last, ["query", "segment"]).groupBy("query", "segment", "end").agg(F.sum(decay(F.col("end") - F.col("t"), half_life)).alias("held"))
    return held.groupBy("query").agg(F.sum(F.col("held") * decay(F.lit(float(now)) - F.col("end"), half_life)).alias("score"))


def trending(scores: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """The n best by score, without a least score, and their counts (0 if not indexed)."""
    top = scores.orderBy(F.col("score").desc(), "query").limit(n)
    return top.join(counts.select("query", "count"), "query", "left").select("query", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"), F.round("score", 4).alias("score"))


def by_prefix(scores: DataFrame, requests: DataFrame, n: int = TRENDING_POOL, least: float = MIN_RECENCY) -> DataFrame:
    """prefix, query, score: the n best of each asked prefix whose score exceeds the least. Prefixes are exploded, so the
    match is an equi join."""
    live = scores.where(F.col("score") > least).select("query", "score", F.explode(prefixes(F.col("query"))).alias("prefix"))
    hits = live.join(requests.select("prefix").distinct(), "prefix", "left_semi")
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(F.col("score").desc(), "query"))
    return hits.withColumn("r", rank).where(F.col("r") <= n).select("prefix", "query", "score")


def pruned(scores: DataFrame, capacity: int = Settings.trending_capacity) -> DataFrame:
    """The best `capacity` by score; of equal scores those first seen stay. Needs a first_seen column."""
    return scores.orderBy(F.col("score").desc(), "first_seen", "query").limit(capacity)
