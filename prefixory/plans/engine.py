"""The engine as one object: what a client could ask, answered with DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key, normalize
from ..operators import index, ranking, recency, routing
from ..settings import MODES, Settings


class Suggestions:
    """counts: query, count (and last_searched); events: query, t (epoch seconds) of searches."""

    def __init__(self, counts: DataFrame, events: DataFrame | None = None, settings: Settings | None = None, prefix_index: DataFrame | None = None):
        self.settings = settings or Settings()
        self.counts, self.events = counts, events
        self.index = prefix_index if prefix_index is not None else index.prefix_topk(counts, self.settings.trie_node_capacity)
        self.spark = counts.sparkSession

    def scores(self, now: float) -> DataFrame:
        if self.events is None:
            return self.spark.createDataFrame([], "query string, score double, updated double")
        return recency.recency_scores(self.events, now, self.settings.recency_half_life)

    def suggest(self, requests: DataFrame, mode: str | None = None, limit: int | None = None, now: float = 0.0) -> DataFrame:
        """prefix, rank, query, count, score (and recency) of each distinct normalised prefix. An unknown mode is the default
        one, a limit of 0 or none the default limit."""
        mode = mode if mode in MODES else self.settings.default_ranking_mode
        limit = index.checked(limit or self.settings.suggest_limit, 1, 50, "limit")
        asked = requests.select(normalize(F.col("prefix")).alias("prefix")).distinct()
        if mode == "basic":
            return index.suggest_basic(asked, self.index, limit)
        s = self.settings
        return ranking.suggest_trending(asked, self.index, self.scores(now), self.counts, limit, history_weight=s.history_weight, recency_weight=s.recency_weight, keep=s.trie_node_capacity)

    def responses(self, requests: DataFrame, mode: str | None = None, limit: int | None = None, now: float = 0.0) -> DataFrame:
        """One row for each request's normalised prefix: mode, the number of suggestions and the suggestions as JSON; the
        empty prefix is bypassed with none."""
        mode = mode if mode in MODES else self.settings.default_ranking_mode
        rows = self.suggest(requests, mode, limit, now)
        fields = ["query", "count", "score", *(["recency"] if mode == "trending" else [])]
        lists = rows.groupBy("prefix").agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("s"))  # at most 50 rows a prefix
        asked = requests.select(normalize(F.col("prefix")).alias("prefix")).distinct()
        own = F.coalesce(F.transform("s", lambda x: F.struct(*(x[f].alias(f) for f in fields))), F.array())
        return asked.join(lists, "prefix", "left").select("prefix", F.lit(mode).alias("mode"), F.size(own).alias("count"), F.to_json(own).alias("suggestions"), F.when(F.col("prefix") == "", "bypass").otherwise("miss").alias("cache"))

    def search(self, submissions: DataFrame, at: float) -> Suggestions:
        """The engine after the submissions (query): counts and index grown, recency with their events."""
        from ..operators.writes import deltas, read_back, upsert

        lines = submissions.select(normalize(F.col("query")).alias("query")).where("query <> ''")
        changes = deltas(lines, increment=self.settings.new_query_initial_count)
        counts = upsert(self.counts, changes, at)
        grown = read_back(counts.select("query", "count"), changes)
        more = lines.withColumn("t", F.lit(float(at)))
        events = more if self.events is None else self.events.select("query", "t").unionByName(more)
        return Suggestions(counts, events, self.settings, index.updated(self.index, grown, self.settings.trie_node_capacity))

    def trending(self, n: int = 10, now: float = 0.0) -> DataFrame:
        return recency.trending(self.scores(now), self.counts, index.checked(n, 1, 100, "n"))

    def ring(self) -> DataFrame:
        s = self.settings
        return routing.ring(self.spark, [f"cache-{i}" for i in range(s.cache_nodes)], s.cache_vnodes)

    def ring_distribution(self, sample: int = 20_000, keys: DataFrame | None = None) -> DataFrame:
        """How keys (a table of key; by default prefix-0, prefix-1, ...) spread over the nodes."""
        if keys is None:
            keys = self.spark.range(index.checked(sample, 100, 100_000, "sample")).select(F.concat(F.lit("prefix-"), F.col("id").cast("string")).alias("key"))
        points = self.ring()
        return routing.distribution(routing.locate(keys, points), points)

    def cache_debug(self, requests: DataFrame, cached: DataFrame) -> DataFrame:
        """Owner, point, presence and remaining time of each prefix's entry. cached: key, ttl_remaining."""
        keys = requests.select("prefix", "mode", cache_key(F.col("mode"), F.col("prefix")).alias("key"))
        routed = routing.locate(keys, self.ring())
        return routed.join(cached.select("key", "ttl_remaining"), "key", "left").select("prefix", "mode", "key", "key_hash", "node", "label", F.col("ttl_remaining").isNotNull().alias("present"), "ttl_remaining")

    def health(self) -> DataFrame:
        return index.index_stats(self.counts).withColumn("status", F.lit("ok"))
