"""The prefix index: for every prefix of every query its top K by count, and what is read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize, prefixes
from ..settings import Settings


def by_popularity() -> tuple[Column, Column]:
    """A total order: the count, most first, then the query by code points."""
    return F.col("count").desc(), F.col("query").asc()


def top_per_prefix(rows: DataFrame, k: int) -> DataFrame:
    """prefix, rank, query, count: the first k of each prefix. The filter on the rank becomes a group limit before the
    exchange, so a task sends at most k rows of a prefix, however common it is."""
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(*by_popularity()))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("prefix", "rank", "query", "count")


def global_top(counts: DataFrame, k: int) -> DataFrame:
    """The root's rows: a distributed top-k, not a group of all rows."""
    top = counts.select("query", "count").orderBy(*by_popularity()).limit(k)
    return top.withColumn("prefix", F.lit("")).withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy(*by_popularity()))).select("prefix", "rank", "query", "count")


def prefix_topk(counts: DataFrame, k: int = Settings.trie_node_capacity) -> DataFrame:
    """The whole index of query counts (query unique)."""
    counts = counts.where(F.length("query") > 0)
    exploded = counts.select(F.explode(prefixes(F.col("query"))).alias("prefix"), "query", "count")
    return global_top(counts, k).unionByName(top_per_prefix(exploded, k))


def candidates(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Pools of the normalised prefixes of requests. Empty ones are bypassed. An equi join: the index may be of any size."""
    asked = requests.select(normalize(F.col("prefix")).alias("prefix")).where("prefix <> ''").distinct()
    return asked.join(index, "prefix")


def suggest_basic(requests: DataFrame, index: DataFrame, limit: int = Settings.suggest_limit) -> DataFrame:
    """prefix, rank, query, count, score."""
    return candidates(requests, index).where(F.col("rank") <= checked(limit, 1, 50, "limit")).select("prefix", "rank", "query", "count", F.col("count").cast("double").alias("score"))


def checked(value: int, low: int, high: int, name: str) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")
    return value


def lookup(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """The count of each asked query, null where it is not indexed."""
    return requests.join(counts.select("query", "count"), "query", "left")


def contains(requests: DataFrame, counts: DataFrame) -> DataFrame:
    return requests.join(counts.select("query"), "query", "left_semi")


def index_stats(counts: DataFrame) -> DataFrame:
    """Distinct queries and index nodes (distinct prefixes and the root)."""
    queries = counts.where(F.length("query") > 0)
    nodes = queries.select(F.explode(prefixes(F.col("query"))).alias("prefix")).distinct().agg((F.count("*") + 1).alias("nodes"))
    return queries.agg(F.count("*").alias("queries")).crossJoin(nodes)  # one row each


def sketches(queries: DataFrame, *keys: str, bits: int = 14) -> DataFrame:
    """A row (of each key, such as the flush) with sketches of the distinct queries and of their prefixes, which `merged_stats`
    puts together whatever flushes they come from. Sketches have a fixed size, so a row does."""
    each = queries.where(F.length("query") > 0).groupBy(*keys).agg(F.hll_sketch_agg("query", bits).alias("queries"))
    nodes = queries.where(F.length("query") > 0).select(*keys, F.explode(prefixes(F.col("query"))).alias("prefix")).groupBy(*keys).agg(F.hll_sketch_agg("prefix", bits).alias("nodes"))
    return each.join(nodes, list(keys)) if keys else each.crossJoin(nodes)  # one row each without keys


def merged_stats(rows: DataFrame) -> DataFrame:
    """queries and nodes as `index_stats` has them, estimated from sketches of any number of flushes."""
    return rows.agg(F.hll_sketch_estimate(F.hll_union_agg("queries")).alias("queries"), (F.hll_sketch_estimate(F.hll_union_agg("nodes")) + 1).alias("nodes"))


def suggest_from_counts(requests: DataFrame, counts: DataFrame, limit: int = Settings.suggest_limit, k: int = Settings.trie_node_capacity) -> DataFrame:
    """As suggest_basic, without an index: only the asked prefixes are ranked."""
    rows = asked_topk(requests, counts, min(k, checked(limit, 1, 50, "limit")))
    return rows.select("prefix", "rank", "query", "count", F.col("count").cast("double").alias("score"))


def asked_topk(requests: DataFrame, counts: DataFrame, k: int = Settings.trie_node_capacity) -> DataFrame:
    """The index's rows of the asked prefixes alone, without an index: exploded prefixes meet the requests before they are
    ranked."""
    asked = requests.select(normalize(F.col("prefix")).alias("prefix")).where("prefix <> ''").distinct()
    exploded = counts.where(F.length("query") > 0).select(F.explode(prefixes(F.col("query"))).alias("prefix"), "query", "count")
    return top_per_prefix(exploded.join(asked, "prefix", "left_semi"), k)


def updated(index: DataFrame, changed: DataFrame, k: int = Settings.trie_node_capacity) -> DataFrame:
    """The index after counts grew. changed: query and its new count, which is not below the old one; then the new top of
    a touched prefix is within its old top and the changed queries, so nothing else is read. The root is a distributed top-k."""
    changed = changed.where(F.length("query") > 0).select("query", "count")
    rows = changed.select(F.explode(prefixes(F.col("query"))).alias("prefix"), "query", "count")
    old = index.join(changed.select("query"), "query", "left_anti").select("prefix", "query", "count")
    root = global_top(old.where("prefix = ''").select("query", "count").unionByName(changed.orderBy(*by_popularity()).limit(k)), k)
    below, touched = index.where("prefix <> ''"), rows.select("prefix").distinct()
    kept = below.join(touched, "prefix", "left_anti").select("prefix", "rank", "query", "count")
    return root.unionByName(kept).unionByName(top_per_prefix(old.where("prefix <> ''").join(touched, "prefix", "left_semi").unionByName(rows), k))
