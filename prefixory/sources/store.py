"""Query counts as a Parquet table of numbered partitions, and meta values.

root/counts/version=0/flush=<n> holds the deltas of flush n, version=<v>/flush=<n> with v above 0 a snapshot of all counts up
to flush n. Each write is one partition by dynamic partition overwrite, which Spark brings into place by one rename: a
reader meets it whole or not at all. Every partition has a row without a query, so an empty flush is one too.

One writer at a time writes to a table (a second one's flush under a number in use is refused unless its content is the
same); readers may be many.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_int

_COUNTS = "query string, delta long, at double, version int, flush long"
_META = "value string, key string"


def put(rows: DataFrame, path: str, *parts: str) -> None:
    """Writes the partitions that occur in rows, in place of those that were there; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def numbers(spark: SparkSession, path: str, schema: str, *parts: str) -> list[tuple[int, ...]]:
    """The partitions of a table, by their numbers."""
    try:
        files = spark.read.schema(schema).parquet(path).inputFiles()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    name = re.compile("/" + "/".join(f"{p}=(\\d+)" for p in parts) + "/[^/]*$")
    return sorted({tuple(map(int, m.groups())) for f in files if (m := name.search(f))})


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Store:
    """A flush is applied once however often it is sent, also after it was folded into a snapshot."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = f"{self.root}/counts"

    def _partitions(self) -> tuple[int, int, list[int]]:
        """The newest snapshot's version and the last flush it holds, and the flushes that are there."""
        found = numbers(self.spark, self.path, _COUNTS, "version", "flush")
        version, folded = max((x for x in found if x[0]), default=(0, 0))
        return version, folded, [n for v, n in found if not v]

    def _read(self) -> DataFrame:
        return self.spark.read.schema(_COUNTS).parquet(self.path)

    def _put(self, rows: DataFrame, version: int, flush: int) -> None:
        mark = self.spark.range(1).select(F.lit(None).cast("string").alias("query"), F.lit(0).cast("long").alias("delta"), F.lit(None).cast("double").alias("at"))
        whole = rows.select("query", F.col("delta").cast("long").alias("delta"), F.col("at").cast("double").alias("at")).unionByName(mark)
        put(whole.withColumn("version", F.lit(version)).withColumn("flush", F.lit(flush).cast("long")), self.path, "version", "flush")

    def bulk_replace(self, items: DataFrame) -> int:
        """Replaces all counts (query, count). Of queries that occur again the last in `ord` counts; without such a column
        they are refused. Returns the number of input rows."""
        ordered = "ord" in items.columns
        each = items.groupBy("query").agg(F.count("*").alias("n"), (F.max_by("count", "ord") if ordered else F.first("count")).alias("delta"))
        rows, again = items.count(), 0 if ordered else each.where("n > 1").count()
        if again:
            raise ValueError(f"{again} queries occur more than once; give their order in a column ord")
        version = self._partitions()[0]
        self._put(each.where(F.length("query") > 0).withColumn("at", F.lit(None)), version + 1, self.watermark())
        return rows

    def apply_batch(self, changes: DataFrame, seq: int, at: float) -> bool:
        """A flush's deltas (query, delta) under its number, from 1 on; whether it was new. One that is there or folded already
        changes nothing; another one under a number in use is an error."""
        if seq < 1:
            raise ValueError("flushes are numbered from 1")
        _, folded, flushes = self._partitions()
        if seq <= folded:
            return False
        if seq in flushes:
            self._same(changes, self.flush(seq), seq)
            return False
        self._put(changes.withColumn("at", F.lit(float(at))), 0, seq)
        return True

    @staticmethod
    def _same(sent: DataFrame, there: DataFrame, seq: int) -> None:
        sums = [F.count("*"), F.sum("delta"), F.bit_xor(F.xxhash64("query", F.col("delta").cast("long")))]
        if sent.agg(*sums).first() != there.agg(*sums).first():
            raise ValueError(f"flush {seq} exists with other content")

    def flush(self, seq: int) -> DataFrame:
        """query, delta, at of a flush that isn't folded."""
        return self._read().where((F.col("version") == 0) & (F.col("flush") == seq) & F.col("query").isNotNull()).select("query", "delta", "at")

    def flush_sizes(self) -> DataFrame:
        """flush, upserts of the flushes that aren't folded."""
        return self._read().where("version = 0").groupBy("flush").agg(F.count("query").alias("upserts"))

    def watermark(self) -> int:
        """The last applied number, in a delta or in a snapshot."""
        _, folded, flushes = self._partitions()
        return max([folded, *flushes])

    def load_all(self, upto: int | None = None, among: DataFrame | None = None) -> DataFrame:
        """query, count, last_searched: the newest snapshot and all flushes after it (up to a number, which a snapshot must not
        have passed), of all queries or those of `among`. One exchange, of partial sums."""
        version, folded, flushes = self._partitions()
        if upto is not None and upto < folded:
            raise ValueError(f"flushes up to {folded} are folded")
        if not version and not flushes:
            return self.spark.createDataFrame([], "query string, count long, last_searched double")
        last = max([folded, *flushes]) if upto is None else upto
        rows = self._read().where((F.col("version") == version) & (F.col("flush") == folded) if version else F.lit(False))
        rows = rows.unionByName(self._read().where((F.col("version") == 0) & (F.col("flush") > folded) & (F.col("flush") <= last))).where("query IS NOT NULL")
        if among is not None:
            rows = rows.join(among.select("query"), "query", "left_semi")
        return rows.groupBy("query").agg(F.sum("delta").alias("count"), F.max("at").alias("last_searched"))

    def compact(self) -> None:
        """Folds the flushes that are there now into a new snapshot; one that comes meanwhile stays."""
        version, folded, flushes = self._partitions()
        done = max([folded, *flushes])
        if done > folded:
            self._put(self.load_all(done).select("query", F.col("count").alias("delta"), F.col("last_searched").alias("at")), version + 1, done)

    def vacuum(self) -> None:
        """Deletes folded flushes and all snapshots but the newest. For times without readers."""
        version, folded, _ = self._partitions()
        for v, n in numbers(self.spark, self.path, _COUNTS, "version", "flush"):
            if 0 < v < version or (v == 0 and n <= folded):
                remove(self.spark, f"{self.path}/version={v}/flush={n}")

    def get_count(self, query: str) -> int | None:
        """Snapshot and flushes are filtered before they meet."""
        one = self.spark.range(1).select(F.lit(query).alias("query"))
        row = self.load_all(among=one).select("count").first()
        return row[0] if row else None

    def count_rows(self) -> int:
        return self.load_all().count()

    def set_meta(self, key: str, value: str) -> None:
        put(self.spark.range(1).select(F.lit(value).alias("value"), F.lit(key).alias("key")), f"{self.root}/meta", "key")

    def get_meta_int(self, key: str, default: int) -> int:
        try:
            rows = self.spark.read.schema(_META).parquet(f"{self.root}/meta")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return default
        row = rows.where(F.col("key") == key).select(safe_int(F.col("value"), default)).first()
        return row[0] if row else default


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """seq, query of log segments (files `<name>.seg.<n>`, or files below folders `seq=<n>`) and of the live log (seq null);
    blank lines and segments without a number are left out."""
    rows = spark.read.option("recursiveFileLookup", "true").text(folder).withColumn("file", F.input_file_name())
    seq = F.regexp_extract("file", r"(?:\.seg\.([0-9]+)|/seq=([0-9]+)/[^/]*)$", 0)
    number = F.regexp_extract(seq, "(?:seg\\.|seq=)([0-9]+)", 1)
    named = F.element_at(F.split("file", "/"), -1).contains(".seg.")
    return rows.where((F.col("value") != "") & (~named | (number != ""))).select(F.when(number != "", number.cast("bigint")).alias("seq"), F.col("value").alias("query"))
