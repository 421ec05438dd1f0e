"""Operator 8: line de-duplication over levelled sorted runs of line hashes.

A run holds, for each key of one batch of documents, a 128-bit hash, the number of documents with it and the largest
doc_id, bucketed and sorted by the hash; a level that has `fanout` runs is compacted into one run of the next. Batches come
in falling order of doc_id. Each new batch is merge-anti-joined with the runs, bucket by bucket without a shuffle: what is
left are the keys that no larger doc_id holds, and for these the batch's largest doc_id is the holder that keeps the line.
All other lines of the batch are repeats (found by an anti-join with these holders, on key and doc_id, so a common line is no
hot key); then the batch's own run is added. When all batches are in, the repeats whose key the runs have in enough documents
are dropped. Lines that occur once, most of them, never meet the counts.

Only the last join, of repeats with frequent keys, has a row for each document of a frequent line, on its left side; the
right side has one row for each key, so adaptive execution may split a hot key. Counts are summed before they are shuffled.

Defined results: a null or empty text is one empty line and keeps it; a text of any length is split whole; each row is a
document of its own, repeated rows and repeated doc_ids too, and a key stays in all rows of its largest doc_id; a null doc_id
is smaller than all others; an empty table gives no rows; columns other than doc_id and text are carried by `dedup_lines` and
may have any names but those two.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import delete_on_exit, scratch_path
from .common import prepare, prepared, record, table, texts, written

BLANK = b" \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 40, 5
_LINES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])


def line_hash(line: bytes, least: int = LEAST_CHARS) -> bytes | None:
    """The 128-bit hash of a line's key; none for keys of fewer than `least` code points."""
    key = line.strip(BLANK).lower()  # of bytes: only A-Z changes
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    return xxhash.xxh3_128_digest(key)


@prepared
def line_hashes(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text_hash (with doc_id: what row it is) and the hash of each of its distinct keys."""

    def run(batches):
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(texts(batch)):
                own = {h for line in text.encode().split(b"\n") if (h := line_hash(line, least))}
                rows += [k] * len(own)
                found += own
            h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            yield record(_LINES, doc_id=batch.column("doc_id").take(at), text_hash=batch.column("text_hash").take(at), h1=np.ascontiguousarray(h[:, 0]), h2=np.ascontiguousarray(h[:, 1]))

    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, h1 long, h2 long")


class Run(NamedTuple):
    """A run as a table bucketed and sorted by the hash, and as the files it consists of."""

    sorted: DataFrame
    files: DataFrame


class LineRuns:
    """Runs of (h1, h2, docs, last), each a table bucketed and sorted by h1, h2; levels[0] has the newest."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[Run]] = [[]]
        self.names: list[str] = []

    def _run(self, entries: DataFrame) -> Run:
        name = f"line_run_{uuid.uuid4().hex}"
        path = scratch_path(self.spark, name)
        entries.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        delete_on_exit(self.spark, path)
        self.names.append(name)
        return Run(self.spark.table(name), self.spark.read.schema(entries.schema).parquet(path))

    @property
    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    @staticmethod
    def _summed(runs: list[Run]) -> DataFrame:
        """Sums over runs. They are read as plain files: the planner may take a union of bucketed tables for bucketed and
        then read it unbucketed, which would leave a key's parts apart."""
        rows = runs[0].files
        for run in runs[1:]:
            rows = rows.unionByName(run.files)
        return rows.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The rows whose key no run has: merge-anti-joins with one run after the other."""
        for run in self.runs:
            lines = lines.join(run.sorted.hint("merge"), ["h1", "h2"], "left_anti")
        return lines

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds a batch (of `line_hashes`) whose doc_ids are below those of all batches before. Returns (written) its repeats:
        the lines that a larger doc_id holds, in this batch or one before."""
        run = self._run(lines.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")))
        holders = self.unseen(run.sorted).select(F.col("h1").alias("x1"), F.col("h2").alias("x2"), F.col("last").alias("holder"))
        same = (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2")) & F.col("doc_id").eqNullSafe(F.col("holder"))
        repeats = written(self.spark, lines.join(holders, same, "left_anti"), "repeats")
        self.levels[0].append(run)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if len(self.levels) == level + 1:
                self.levels.append([])
            old, self.levels[level] = self.levels[level], []
            self.levels[level + 1].append(self._run(self._summed(old)))
            level += 1
        return repeats

    def frequent(self, docs: int = LEAST_DOCS) -> DataFrame:
        """h1, h2 of the keys that at least so many documents hold."""
        return self._summed(self.runs).where(F.col("docs") >= docs).select("h1", "h2")

    def close(self) -> None:
        """Forgets the runs' tables; their files go when the driver ends."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


@prepared
def dropped_lines(docs: DataFrame, batches: int = 4, least: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, text_hash and `gone`, the hashes of the keys that the row loses; rows that lose none are left out."""
    spark = docs.sparkSession
    cuts = sorted(set(docs.select(F.col("doc_id").alias("i")).approxQuantile("i", [k / batches for k in range(1, batches)], 0.01)))
    batch = sum((F.when(F.col("doc_id") < F.lit(int(c)), 1).otherwise(0) for c in cuts), F.lit(0))
    batch = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(batch).cast("int")  # by falling doc_id, nulls at the end
    lines = written(spark, line_hashes(docs, least).withColumn("batch", batch), "lines", "batch")
    runs = LineRuns(spark)
    repeats = [runs.add(lines.where(F.col("batch") == b).drop("batch")) for b in range(len(cuts) + 1)]
    every = repeats[0]
    for more in repeats[1:]:
        every = every.unionByName(more)
    # Written, so that both sides of the join come straight from an exchange and a hot key can be split.
    gone = written(spark, every.join(written(spark, runs.frequent(least_docs), "frequent"), ["h1", "h2"], "left_semi"), "gone")
    runs.close()
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))


def kept_text(raw: bytes, gone: set[bytes], least: int) -> tuple[bytes, int]:
    lines = raw.split(b"\n")
    kept = [line for line in lines if line_hash(line, least) not in gone]
    return b"\n".join(kept), len(lines) - len(kept)


def _joined(docs: DataFrame, **limits) -> tuple[DataFrame, list[str]]:
    """The rows of docs, their columns renamed (the names are returned), with _h1 and _h2, the hashes of what they lose."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # the input may have any names
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    plain = docs.toDF(*names)
    gone = dropped_lines(plain.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), **limits)
    left = plain.withColumn("_row_hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    right = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"), F.transform("gone", lambda g: g.h1).alias("_h1"), F.transform("gone", lambda g: g.h2).alias("_h2"))
    both = left.join(right, F.col(doc_id).eqNullSafe(F.col("_gone_id")) & (F.col("_row_hash") == F.col("_gone_hash")), "left")
    return both.select(*names, "_h1", "_h2"), names


def _sets(batch: pa.RecordBatch) -> list[set[bytes]]:
    return [{np.array(x, "<i8").tobytes() for x in zip(a, b, strict=True)} if a else set() for a, b in zip(batch.column("_h1").to_pylist(), batch.column("_h2").to_pylist(), strict=True)]


@prepared
def dedup_lines(docs: DataFrame, least: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with the text without its dropped lines; other columns unchanged. Rows without any dropped line are as they were."""
    joined, names = _joined(docs, least=least, least_docs=least_docs)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            columns = [batch.column(c) for c in names]
            columns[at] = pa.array([kept_text(t.encode(), g, least)[0].decode() if g and t else t for t, g in zip(columns[at].to_pylist(), _sets(batch), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.toDF(*names).schema).toDF(*docs.columns)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    joined, (doc_id, text_name) = _joined(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def run(batches):
        for batch in batches:
            n, dropped, sha = [], [], []
            for text, gone in zip(texts(batch, text_name), _sets(batch), strict=True):
                raw = text.encode()
                kept, lost = kept_text(raw, gone, LEAST_CHARS) if gone else (raw, 0)
                n.append(raw.count(b"\n") + 1)
                dropped.append(lost)
                sha.append(hashlib.sha256(kept).hexdigest())
            yield record(_DIGEST, doc_id=batch.column(doc_id), n_lines=n, n_dropped=dropped, kept_sha256=sha)

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP8_SQL = r"""
WITH line AS (
  SELECT row_id, doc_id, i, l, translate(trim(l, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT row_id, doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i
        FROM (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
hot AS (SELECT k, max(doc_id) AS last FROM line WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT row_id) >= 5),
marked AS (SELECT line.*, hot.last IS NOT NULL AND (doc_id IS NULL OR doc_id < hot.last) AS gone FROM line LEFT JOIN hot USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_id
"""
