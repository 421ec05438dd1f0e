"""Operator 4: approximate nearest neighbours by additive quantisation.

A vector is its norm times a direction, and a direction is approximated by the sum of one word from each of several
full-dimensional codebooks. Codebooks are fitted by k-means on the residuals of a bounded sample (`SAMPLE` vectors, those of
least hash); every vector is encoded by beam search over the codebooks and stored as its codes, its norm and the squared norm
of its approximated direction. With s a vector's norm, u the approximation, q a query and m the larger of s and |q|, their
distance is about m sqrt((|q|/m)^2 - 2 (s/m) (looked-up products of q/|q| with the words) (|q|/m) + (s/m)^2 |u|^2), in double
precision, so scoring needs one table a query, and vectors of any finite size are encoded and compared equally well.

Queries are a stated hundredth of the rows and meet all of them, in blocks: queries are cut into chunks of at most
`CHUNK_BYTES`, each broadcast in blocks; codes come in blocks of packed rows, and a task keeps the `KEPT` best of each query
over all its blocks, ties to the smaller vec_id. The best of all tasks are ranked again by exact distance on the original
vectors. So a task sends a bounded number of rows for a query, whatever number of blocks it reads.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, neither do rows
without vec_id; vectors of each dimension are searched among themselves, as there is no distance between others; rows of
one vec_id are candidates each, but never of their own vec_id's query, and one of them (the least vector) is the query;
equal distances are ranked by vec_id; a distance above the largest double is infinite; with fewer than ten candidates all are returned; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepared, record, table, written

BOOKS, WORDS, BEAM = 32, 256, 3
SAMPLE, KEPT, TOP = 8192, 200, 10
CODE_BLOCK, QUERY_BLOCK = 8192, 256
#: Binary exponent of the unit of norms.
SCALE = 20
#: Of the queries' vectors that are broadcast at once, and the code blocks that a task reads in a row.
CHUNK_BYTES, TASK_BLOCKS = 16 << 20, 64


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """Codebooks (books, words, dimension) by k-means on residuals."""
    rng = np.random.default_rng(seed)
    rest = sample.astype(np.float32)
    words = min(words, len(rest))
    out = []
    for _ in range(books):
        centres = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(rounds):
            own = _nearest(rest, centres)
            size = np.bincount(own, minlength=words)
            order = np.argsort(own, kind="stable")
            full = np.flatnonzero(size)
            sums = np.add.reduceat(rest[order], (np.cumsum(size) - size)[full], 0)
            centres[full] = sums / size[full, None]
        rest = rest - centres[_nearest(rest, centres)]
        out.append(centres)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) and the squared norms of the approximations: of each codebook in turn the `beam` best partial sums live."""
    n, words = len(x), books.shape[1]
    x = x.astype(np.float32)
    codes = np.zeros((n, 1, 0), np.uint8)
    rest = x[:, None, :]
    for book in books:
        cost = (rest**2).sum(2)[:, :, None] - 2 * rest @ book.T + (book**2).sum(1)
        cost = cost.reshape(n, -1)
        keep = min(beam, cost.shape[1])
        best = np.argpartition(cost, keep - 1, 1)[:, :keep]
        from_, word = best // words, best % words
        rest = np.take_along_axis(rest, from_[:, :, None], 1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, from_[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    best = (rest**2).sum(2).argmin(1)
    at = np.arange(n)
    approximation = x - rest[at, best]
    return codes[at, best], (approximation**2).sum(1)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull() & fine & F.exists(e, lambda v: v != 0))


_CODES = pa.schema([("vec_id", pa.int64()), ("code", pa.binary()), ("size", pa.float64()), ("norm", pa.float32())])
_CODE_BLOCK = pa.schema([("ids", pa.binary()), ("codes", pa.binary()), ("sizes", pa.binary()), ("norms", pa.binary())])
_QUERY_BLOCK = pa.schema([("query_ids", pa.binary()), ("vectors", pa.binary())])
#: Blocks in an Arrow batch.
BATCH_BLOCKS = 8
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("near", pa.float64())])
_EXACT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _blocks(batches, rows: int):
    """Tables of so many rows (the last may have fewer)."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d).astype(np.float64)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, in units of 2^SCALE so that none overflows, and unit vectors of rows that aren't zero."""
    top = np.abs(x).max(1, keepdims=True)  # first, so that no square under- or overflows
    size = np.sqrt(((x / top) ** 2).sum(1, keepdims=True))
    return (top * np.ldexp(size, -SCALE))[:, 0], (x / top / size).astype(np.float32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows; where squares over- or underflow, of scaled rows."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.sqrt(((a - b) ** 2).sum(1))
        odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-140))
        part = np.where(out[odd] > 1, 0.5, 1.0)[:, None]  # a difference of two large numbers may overflow too
        rest = a[odd] * part - b[odd] * part
        top = np.abs(rest).max(1, keepdims=True, initial=0.0)
        unit = rest / np.where(top > 0, top, 1.0)
        out[odd] = ((top * np.sqrt((unit**2).sum(1, keepdims=True))) / part)[:, 0]
    return out


def _best(ids: np.ndarray, near: np.ndarray, kept: int) -> np.ndarray:
    """Positions of the least, ties to the smaller id."""
    if len(near) > kept:
        at = np.flatnonzero(near <= np.partition(near, kept - 1)[kept - 1])  # with all ties
        return at[np.lexsort((ids[at], near[at]))[:kept]]
    return np.arange(len(near))


class Nearest:
    """The best of each query over the code blocks of one task."""

    def __init__(self, books: np.ndarray, kept: int):
        self.flat = books.reshape(-1, books.shape[2]).astype(np.float64)
        self.step = np.arange(len(books), dtype=np.int64) * books.shape[1]
        self.kept = kept
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, row: dict[str, bytes]) -> None:
        ids, sizes, norms = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.float64), np.frombuffer(row["norms"], np.float32)
        words = np.frombuffer(row["codes"], np.uint8).reshape(-1, len(self.step)) + self.step
        queries, vectors = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(-1, self.flat.shape[1])
        for q, v in zip(queries.tolist(), vectors, strict=True):
            (size,), (unit,) = directions(v[None])
            most = np.maximum(sizes, size)
            s, t = sizes / most, size / most
            products = (self.flat @ unit.astype(np.float64)).take(words).sum(1)
            near = most * np.sqrt(np.maximum(t * t - 2 * s * t * products + s * s * norms, 0.0))
            near[ids == q] = np.inf
            if q in self.held:  # only what is better than the worst kept can come in
                old_ids, old = self.held[q]
                at = np.flatnonzero(near <= old.max()) if len(old) >= self.kept else np.flatnonzero(near < np.inf)
                both_ids, both = np.concatenate([old_ids, ids[at]]), np.concatenate([old, near[at]])
            else:
                at = np.flatnonzero(near < np.inf)
                both_ids, both = ids[at], near[at]
            at = _best(both_ids, both, self.kept)
            self.held[q] = both_ids[at], both[at]

    def rows(self):
        for q, (ids, near) in self.held.items():
            yield record(_FOUND, query_id=np.full(len(ids), q), vec_id=ids, near=near)


@prepared
def search(rows: DataFrame, every: int = 100, top: int = TOP, kept: int = KEPT) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of each query (vec_id divisible by `every`) by Euclidean distance, each
    dimension searched by itself."""
    rows = usable(rows)
    sizes = sorted(r.d for r in rows.select(F.size("embedding").alias("d")).distinct().collect())  # a number for each dimension
    found = [_search(rows.where(F.size("embedding") == d), d, every, top, kept) for d in sizes or [1]]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search(rows: DataFrame, d: int, every: int, top: int, kept: int) -> DataFrame:
    spark = rows.sparkSession
    learned = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()["embedding"].tolist()  # at most SAMPLE vectors
    books = fit(directions(np.array(learned, np.float64))[1]) if learned else np.zeros((BOOKS, 1, d), np.float32)
    shared = spark.sparkContext.broadcast(books)  # BOOKS * WORDS vectors

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                size, unit = directions(_vectors(batch.column("embedding"), d))
                codes, norms = encode(unit, shared.value)
                yield record(_CODES, vec_id=batch.column("vec_id"), code=[c.tobytes() for c in codes], size=size, norm=norms.astype(np.float32))

    def code_blocks(batches):
        for t in _blocks(batches, CODE_BLOCK):
            yield record(_CODE_BLOCK, ids=[t["vec_id"].to_numpy().tobytes()], codes=[b"".join(t["code"].to_pylist())], sizes=[t["size"].to_numpy().tobytes()], norms=[t["norm"].to_numpy().tobytes()])

    def query_blocks(batches):
        for t in _blocks(batches, QUERY_BLOCK):
            yield record(_QUERY_BLOCK, query_ids=[t["query_id"].to_numpy().tobytes()], vectors=[_vectors(t["vector"].combine_chunks(), d).tobytes()])

    def meet(batches):
        nearest = Nearest(shared.value, kept)
        for batch in batches:
            for row in batch.to_pylist():
                nearest.add(row)
        yield from nearest.rows()

    def exact(batches):
        for batch in batches:
            a, b = (_vectors(batch.column(c), d) for c in ("vector", "embedding"))
            yield record(_EXACT, query_id=batch.column("query_id"), vec_id=batch.column("vec_id"), score=distances(a, b))

    coded = written(spark, rows.mapInArrow(code, "vec_id long, code binary, size double, norm float"), "codes")
    asked = written(spark, rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("vector")), "queries")
    n_blocks = coded.count() // CODE_BLOCK + 1
    tasks = max(min(n_blocks, spark.sparkContext.defaultParallelism), n_blocks // TASK_BLOCKS)
    packed = written(spark, coded.repartition(int(tasks)).mapInArrow(code_blocks, "ids binary, codes binary, sizes binary, norms binary"), "code-blocks")
    chunks = asked.count() * d * 8 // CHUNK_BYTES + 1
    rows_a_batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = None
    for k in range(chunks):  # each chunk of queries meets all codes
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(chunks)) == k)
        blocks = own.coalesce(1).mapInArrow(query_blocks, "query_ids binary, vectors binary")  # about CHUNK_BYTES
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_BLOCKS))
        try:
            more = written(spark, packed.crossJoin(F.broadcast(blocks)).mapInArrow(meet, "query_id long, vec_id long, near double"), "found")
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
        found = more if found is None else found.unionByName(more)
    by_near = Window.partitionBy("query_id").orderBy("near", "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.min("near").alias("near")).withColumn("r", F.row_number().over(by_near)).where(F.col("r") <= kept).drop("r", "near")
    scored = best.join(asked, "query_id").join(rows, "vec_id").select("query_id", "vec_id", "vector", "embedding").mapInArrow(exact, "query_id long, vec_id long, score double")
    by_score = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
