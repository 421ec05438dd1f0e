"""The stored prefix index: a Parquet table partitioned by a bucket of the prefix, of which a flush rewrites the touched buckets.

The new rows of the touched buckets are staged as one partition (path/staged/flush=<n>, there whole or not at all) and then
put over the buckets of path/table. When a writer dies on the way the flush comes again and only the second step is repeated,
so what the table held meanwhile doesn't matter. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize, prefixes
from ..operators.index import checked, prefix_topk, updated
from ..settings import Settings
from .store import numbers, put, remove

_TABLE = "prefix string, rank int, query string, count long, bucket int"
_STAGED = f"{_TABLE}, flush long"


class IndexTable:
    def __init__(self, spark: SparkSession, path: str, k: int = Settings.trie_node_capacity, buckets: int = 64):
        self.spark, self.k, self.buckets = spark, k, buckets
        self.table, self.staged = f"{path.rstrip('/')}/table", f"{path.rstrip('/')}/staged"

    def bucket(self, prefix: Column) -> Column:
        """The root's is one of its own, as every flush touches it."""
        return F.when(prefix == "", self.buckets).otherwise(F.pmod(F.xxhash64(prefix), F.lit(self.buckets))).cast("int")

    def last(self) -> int:
        """The last flush that was staged, -1 before the table is there."""
        return max((n for (n,) in numbers(self.spark, self.staged, _STAGED, "flush")), default=-1)

    def _through(self, rows: DataFrame, flush: int) -> None:
        mark = self.spark.range(1).select(F.lit("").alias("prefix"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("query"), F.lit(0).cast("long").alias("count"))
        rows = rows.unionByName(mark)  # a row without a query, as an empty index is one too
        put(rows.withColumn("bucket", self.bucket(F.col("prefix"))).withColumn("flush", F.lit(flush).cast("long")), self.staged, "flush")
        self._finish(flush)

    def _finish(self, flush: int) -> None:
        """Puts the staged buckets into the table; it may be done again."""
        rows = self.spark.read.schema(_STAGED).parquet(self.staged).where(F.col("flush") == flush).drop("flush")
        put(rows.repartition("bucket"), self.table, "bucket")
        for (n,) in numbers(self.spark, self.staged, _STAGED, "flush"):
            if n < flush:
                remove(self.spark, f"{self.staged}/flush={n}")

    def begin(self, counts: DataFrame, flush: int) -> None:
        """The index of the counts after a flush (0: before the first), if no table is there."""
        if (last := self.last()) < 0:
            self._through(prefix_topk(counts.select("query", "count"), self.k), flush)
        elif last == flush:
            self._finish(flush)

    def grow(self, changed: DataFrame, flush: int) -> None:
        """The index after a flush. changed: query and count, not below the old one. A flush that comes again changes nothing."""
        last = self.last()
        if flush < last:
            return
        if flush > last:
            touched = changed.where(F.length("query") > 0).select(F.explode(prefixes(F.col("query"))).alias("prefix"))
            own = [r.b for r in touched.select(self.bucket(F.col("prefix")).alias("b")).distinct().collect()]  # at most `buckets` numbers
            old = self.rows().where(F.col("bucket").isin([*own, self.buckets])).drop("bucket")
            self._through(updated(old, changed, self.k), flush)
        else:
            self._finish(flush)

    def rows(self) -> DataFrame:
        """prefix, rank, query, count, bucket; empty before the table is there."""
        if self.last() < 0:
            return self.spark.createDataFrame([], _TABLE)
        return self.spark.read.schema(_TABLE).parquet(self.table).where("rank > 0")

    def index(self) -> DataFrame:
        return self.rows().drop("bucket")

    def suggest(self, requests: DataFrame, limit: int = Settings.suggest_limit) -> DataFrame:
        """Each request (prefix and any further columns, a stream or not) with rank, query, count and score of its suggestions.
        The bucket is a key of the join, so buckets that are not asked for can be left out."""
        asked = requests.withColumn("prefix", normalize(F.col("prefix"))).where("prefix <> ''").withColumn("bucket", self.bucket(F.col("prefix")))
        found = self.rows().where(F.col("rank") <= checked(limit, 1, 50, "limit"))
        return asked.join(found, ["bucket", "prefix"]).drop("bucket").withColumn("score", F.col("count").cast("double"))
