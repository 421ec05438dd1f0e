"""Operator 6: a uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

For each partition the number of its rows that go to each shard is drawn exactly from the multivariate hypergeometric
law on what the shards take (one row of the matrix, which its task draws by halving the range of partitions), so shard sizes differ by at most one row and every
assignment of rows to shards is equally likely. A partition permutes its labels locally; rows are exchanged by shard and
a bucket of a random key; within a bucket they are permuted again by that key, and buckets are laid end to end. Bucket
sizes follow from the seeds alone, so they are counted without reading the data again.

Rows come with their place (partition, position), so the input must have the same partitions each time it is computed: a
table scan or a checkpointed frame. A partition that comes with another count than before ends the job with an error.

Defined results: null or empty texts have size 1; nulls in any column and repeated rows are rows like others; an empty
table gives no rows; all columns of the input are carried, whatever they are called, in front of shard and slot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import prepared, record, table

#: numpy draws from populations below this; larger ones are drawn from the mode outwards.
NUMPY_LIMIT = 10**9


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows taken from good + bad are good."""
    low, high = max(0, n - bad), min(n, good)
    if low >= high:
        return low
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    width = 40 + int(12 * (n * (good / (good + bad)) * (bad / (good + bad))) ** 0.5)  # mass outside is below 1e-30
    up = np.arange(mode, min(high, mode + width), dtype=float)
    down = np.arange(mode, max(low, mode - width), -1, dtype=float)
    rise = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    fall = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    weights = np.concatenate([fall[::-1], [1.0], rise])
    total = np.cumsum(weights)
    return int(mode - len(fall) + np.searchsorted(total, rng.random() * total[-1], "right"))


def matrix_row(sums: np.ndarray, part: int, shards: int, seed: int) -> np.ndarray:
    """One partition's row of the matrix. sums: the running sums of the partitions' counts, from 0. All partitions share the
    shards' sizes; the share of the left half of a range of partitions is drawn from what the range has, with a generator
    that depends on the seed and the range alone, so any task finds the same numbers by halving from the top."""
    low, high, total = 0, len(sums) - 1, int(sums[-1])
    left = [total // shards + (s < total % shards) for s in range(shards)]
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, 0, low, high]))
        n, rest, half = int(sums[middle] - sums[low]), sum(left), []
        for size in left:
            rest -= size
            half.append(draw(rng, size, rest, n))
            n -= half[-1]
        if part < middle:
            left, high = half, middle
        else:
            left, low = [a - b for a, b in zip(left, half, strict=True)], middle
    return np.array(left, np.int64)


def labels(row: np.ndarray, part: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards of a partition's rows, locally permuted, and the random keys for the second permutation."""
    rng = np.random.Generator(np.random.PCG64([seed, 1, part]))
    shard = rng.permutation(np.repeat(np.arange(len(row), dtype=np.int32), row))
    return shard, rng.integers(0, 1 << 62, len(shard))


def _row(plan: tuple[np.ndarray, dict[int, int]], part: int, shards: int, seed: int) -> np.ndarray | None:
    sums, at = plan
    return matrix_row(sums, at[part], shards, seed) if part in at else None


@prepared
def shuffle_shards(df: DataFrame, shards: int = 16, seed: int = 1, bucket_rows: int = 1 << 16) -> DataFrame:
    """df with shard int and slot long (gapless from 0 in each shard), uniformly shuffled."""
    spark = df.sparkSession
    # One row for each partition of the input, never for its rows.
    counted = {r.p: r["n"] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    parts = sorted(counted)
    sums = np.concatenate([[0], np.cumsum([counted[p] for p in parts], dtype=np.int64)])  # one number for each partition
    at = {p: k for k, p in enumerate(parts)}
    bits = max(0, (sum(counted.values()) // shards // bucket_rows).bit_length())
    plan = spark.sparkContext.broadcast((sums, at))
    hidden = T.StructType([T.StructField("_hg_shard", T.IntegerType()), T.StructField("_hg_key", T.LongType()), T.StructField("_hg_row", T.LongType())])
    names = [f"c{i}" for i in range(len(df.columns))]  # the input's names may repeat or clash
    plain = df.toDF(*names)

    def label(batches):
        part, at = TaskContext.get().partitionId(), 0
        row = _row(plan.value, part, shards, seed)
        if row is not None:
            shard, key = labels(row, part, seed)
        for batch in batches:
            n = batch.num_rows
            if n and (row is None or at + n > len(shard)):
                raise RuntimeError(f"partition {part} has more rows than when it was counted")
            columns = [pa.array(shard[at : at + n]), pa.array(key[at : at + n]), pa.array(np.arange(at, at + n) + (part << 40))] if n else [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64())]
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *hidden.names])
        if row is not None and at != len(shard):
            raise RuntimeError(f"partition {part} has {at} rows, not the {len(shard)} counted")

    cell_schema = pa.schema([("shard", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64())])

    def cells(batches):
        for batch in batches:
            for part in batch.column("part").to_pylist():
                shard, key = labels(_row(plan.value, part, shards, seed), part, seed)
                cell, n = np.unique((shard.astype(np.int64) << 40) + (key >> (62 - bits)), return_counts=True)
                yield record(cell_schema, shard=(cell >> 40).astype(np.int32), bucket=cell & ((1 << 40) - 1), n=n)

    labelled = plain.mapInArrow(label, T.StructType([*plain.schema.fields, *hidden.fields])).withColumn("_hg_bucket", F.shiftright("_hg_key", 62 - bits))
    own = Window.partitionBy("_hg_shard", "_hg_bucket").orderBy("_hg_key", "_hg_row")
    placed = labelled.withColumn("_hg_nth", F.row_number().over(own).cast("long") - 1)
    if bits:
        before = Window.partitionBy("_hg_shard").orderBy("_hg_bucket").rowsBetween(Window.unboundedPreceding, -1)
        tasks = max(1, min(len(parts), 1000))
        ids = spark.createDataFrame([(p,) for p in parts], "part int").repartition(tasks)
        base = ids.mapInArrow(cells, "shard int, bucket long, n long").groupBy(F.col("shard").alias("_hg_shard"), F.col("bucket").alias("_hg_bucket")).agg(F.sum("n").alias("n"))
        base = base.withColumn("_hg_base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        placed = placed.join(base, ["_hg_shard", "_hg_bucket"]).withColumn("_hg_nth", F.col("_hg_nth") + F.col("_hg_base"))
    return placed.select(*names, F.col("_hg_shard").alias("shard"), F.col("_hg_nth").alias("slot")).toDF(*df.columns, "shard", "slot")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law `rows`; only what the result shows of a row is exchanged."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_shards(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
