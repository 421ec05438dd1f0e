"""Operator 9: SpotSigs document fingerprints.

After each common word (an anchor) a chain of the next two content words, anchors between them skipped, makes a spot
signature; a text's fingerprint is its set of signatures. The likeness of two fingerprints is the Jaccard similarity of
the sets. `near_classes` finds what is linked by at least a given likeness: sets are partitioned by length so that only
partitions whose lengths allow it meet, a set is listed under its rarest signatures only (as many as any similar set must
share one of), pairs are pruned by their lengths before their sets are merged, and a group of near copies is tested against
its head, so pairs of its members are never rows.

Defined results: a null text is the empty text; a text without spots has one signature, the hash of the whole text, so
equal texts have equal fingerprints and likeness 1 and others 0; repeated rows, and rows of equal doc_id (in order of
their text), are documents each; a null doc_id comes before all others; a single row is its own next; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, prepared, record, table, texts, written
from .minhash import classed, linked
from .shingles import mix

#: Common words of the four languages of the corpus. Fixed values.
ANCHORS = frozenset(
    "the of and to in a is that it for on was be with as this by are at from or an not "
    "de la le les des et un une du que qui dans pour par sur est au en il elle "
    "der die und den von zu das mit sich auf ist im dem nicht ein eine als auch es für "
    "el los las y del se por con una su al lo como más".split()
)
CHAIN = 2
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def _code(token: str) -> int:
    """An odd number for an anchor, an even one for a content word, 0 for neither."""
    word = _EDGES.sub("", token)
    return (xxhash.xxh3_64_intdigest(word) | 1) ^ (word not in ANCHORS) if word else 0


_CODES: Cache = Cache(_code)


def spots(text: str, chain: int = CHAIN) -> np.ndarray:
    """The sorted distinct signatures, 32 bits each."""
    words = text.lower().split()
    code = np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))
    code = code[code != 0]
    anchor = (code & np.uint64(1)).astype(bool)
    content = code[~anchor]
    after = np.cumsum(~anchor)[anchor]  # content words up to the anchor
    lead = code[anchor][after + chain <= len(content)]
    after = after[after + chain <= len(content)]
    if not len(after):
        return np.array([xxhash.xxh3_64_intdigest(text.encode()) & 0xFFFFFFFF], np.uint32)
    sig = mix(lead)
    with np.errstate(over="ignore"):
        for i in range(chain):
            sig = mix(sig * np.uint64(0x9E3779B97F4A7C15) + content[after + i])
    return np.unique((sig >> np.uint64(32)).astype(np.uint32))


def encoded(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype("<u4").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    both = np.concatenate([a, b])
    both.sort()
    n = int((both[1:] == both[:-1]).sum())
    return n / (len(both) - n)


def edited(text: str, other: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + other[:n]


#: Runs that the texts are cut into at most: one number and one row of each are on the driver. A run is read as a stream.
MOST_RUNS = 10_000


def with_next(docs: DataFrame, per_part: int = 5000) -> DataFrame:
    """doc_id, text in runs (part) sorted by doc_id and then text, kind 0; each run ends with rows of kind 1, the first
    rows of the next run (the last run's next is the first). One exchange of the texts; runs are cut at quantiles. Rows of
    one doc_id lie in one run."""
    spark = docs.sparkSession
    ids = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))
    n = ids.count()
    parts = max(1, min(n // per_part, MOST_RUNS))
    cuts = np.array(sorted(set(ids.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else [])
    cuts = cuts.astype(np.int64)  # one number for each run

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), "right").astype(np.int32))

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("id")).withColumn("part", part_of("id"))
    heads = sorted((r.part, r.id) for r in ids.withColumn("part", part_of("id")).groupBy("part").agg(F.min("id").alias("id")).collect())
    before = [(heads[k - 1][0], first) for k, (_, first) in enumerate(heads)]  # k = 0: the last run
    ends = spark.createDataFrame(before, "part int, id long")
    first = rows.drop("part").join(F.broadcast(ends), "id").select("doc_id", "text", "id", "part", F.lit(1).alias("kind"))  # one row for each run
    both = rows.withColumn("kind", F.lit(0)).unionByName(first)
    return both.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "kind", "id", "text").drop("id")


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


@prepared
def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next document's."""

    def run(batches):
        last = None
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _OUT}
            for part, kind, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "doc_id", "text")), strict=True):
                if kind and last is None:
                    continue  # a second row of the next run
                own = spots(text)
                if last is not None:
                    _, id_, before, sig = last
                    mixed = edited(before, text)
                    other = spots(mixed)
                    values = (id_, len(before), hashlib.sha256(mixed.encode()).hexdigest(), encoded(sig), encoded(other), likeness(sig, other), likeness(sig, own))
                    for name, value in zip(out, values, strict=True):
                        out[name].append(value)
                last = None if kind else (part, doc_id, text, own)
            yield record(_OUT, **out)

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _bucket(length, least: float):
    """Lengths in one bucket differ by a factor of at most 1 / least, so similar sets lie in the same or the next."""
    return F.floor(F.log(length.cast("double")) / F.lit(float(-np.log(least)))).cast("int")


_MEMBERS = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("marks", pa.binary())])
_ITEMS = pa.schema([("node", pa.binary()), ("n", pa.int32()), ("s", pa.int64())])


@prepared
def members(docs: DataFrame) -> DataFrame:
    """doc_id, node (a 128-bit hash of the fingerprint) and marks (its signatures, sorted, as even numbers) of each document."""

    def run(batches):
        for batch in batches:
            sigs = [spots(t) for t in texts(batch)]
            yield record(_MEMBERS, doc_id=batch.column("doc_id"), node=[hashlib.md5(s.tobytes()).digest() for s in sigs], marks=[np.unique(s.astype(np.uint64) << np.uint64(1)).tobytes() for s in sigs])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node binary, marks binary")


def _listed(prints: DataFrame, least: float) -> DataFrame:
    """node, key: each fingerprint under its rarest signatures with the bucket of its length and the next one."""

    def run(batches):
        for batch in batches:
            for node, marks in zip(batch.column("node").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                s = np.frombuffer(marks, np.int64)
                yield record(_ITEMS, node=[node] * len(s), n=np.full(len(s), len(s), np.int32), s=s)

    items = written(prints.sparkSession, prints.mapInArrow(run, "node binary, n int, s long"), "items")  # so that a common signature can be split in the join
    frequency = items.groupBy("s").agg(F.count("*").alias("f"))
    ordered = items.join(frequency, "s").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("o"))  # of one text
    # Of a set of n, any set of likeness t shares one of the first n - ceil(t n) + 1 in a common order.
    prefix = F.expr(f"slice(o, 1, cast(n - ceil({least} * n) + 1 as int))")
    own = ordered.select("node", _bucket(F.col("n"), least).alias("bucket"), F.explode(prefix).alias("p"))
    return own.select("node", F.explode(F.array(*(F.xxhash64("p.s", F.col("bucket") + i) for i in (0, 1)))).alias("key"))


@prepared
def near_classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, class_id of every row: the least doc_id of the class of what links of at least that likeness connect (null
    only if all are null). Equal fingerprints are in one class."""
    spark = docs.sparkSession
    rows = written(spark, members(docs), "members")
    prints = written(spark, rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("marks").alias("marks")), "prints")
    sets = prints.select("node", "marks")
    labels = linked(_listed(sets, least), lambda wanted: sets.join(wanted, "node", "left_semi"), least)
    by_node = written(spark, classed(prints.select("node", "rep"), labels), "classes")
    return rows.select("doc_id", "node").join(by_node.select("node", "class_id"), "node").select("doc_id", "class_id")


def op9_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
