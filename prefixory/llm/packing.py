"""Operator 1: vector best-fit packing of tokenised documents into fixed-size sequences.

A piece asks for three capacities of a sequence: tokens, one document, and its attention cost (length squared). Pieces
go in decreasing length to the sequence whose weighted residual norm (or residual dot product with the piece) is least
among those that satisfy every constraint, else to a new one. What a piece asks for depends on its length alone, so the
placement is worked out on the length histogram (at most `capacity` rows, whatever the corpus): equal sequences are one
state with a count, and a whole run of equal pieces goes to a state at once. The result equals best-fit on the single
pieces. Pieces then find their place by their rank among those of the same length, which is counted in salted buckets,
by a hash of the row's place in the written table, so that a length that a third of all pieces share, or very many copies
of one row, are spread over tasks. Pieces of equal length are ranked by that place.

Defined results: a null or empty text is the end id alone, one piece of length 1; a text of any length is cut only at
`capacity`; repeated rows are packed each; null doc_ids are kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Cache, prepared, record, table, texts, written

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PLACED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


#: Characters for which the tokenizer's normalisation is str.lower() and its byte map that of UTF-8: printable ASCII
#: without the apostrophe (it begins contractions), and Latin letters with one lower case that need no composition.
_PLAIN = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_PRETOKENS = re.compile("[a-z\u00df-\u017f]+|[0-9]|[^a-z\u00df-\u017f0-9]+")


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + other.index(b)) for b in range(256)]


class Words:
    """Token ids of whole texts, word by word: the tokenizer never joins tokens over a space or a line end, so words
    between them are encoded alone and kept. Words of plain characters go to the tokenizer's model in the pieces that its
    own splitting makes; all others take the tokenizer as a whole."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes = dict(enumerate(_byte_characters()))
        self.known = Cache(self._one, 300_000)
        self.parts = Cache(self._part, 300_000)

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.bytes)
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _one(self, word: str) -> bytes:
        if not word:
            return b""
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self.parts.__getitem__, _PRETOKENS.findall(word.lower())))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


@prepared
def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document: its ids and then end_id, cut into pieces of `capacity`."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words, step = _words(path), capacity * 4
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(texts(batch)):
                raw = words.ids(text) + end
                for i in range(0, len(raw), step):
                    part = raw[i : i + step]
                    rows.append(k)
                    piece.append(i // step)
                    start.append(i // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield record(_PIECES, doc_id=batch.column("doc_id").take(pa.array(rows, pa.int64())), piece=piece, start=start, length=length, ids_crc32=crc)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def place(histogram: dict[int, int], tokens: int, documents: int, attention: int, weights=(1.0, 1.0, 1.0), rule: str = "norm") -> tuple[np.ndarray, int]:
    """Vector best-fit on counts. Returns rows (length, first rank, pieces per sequence, sequences, first sequence,
    offset) and the number of sequences. `norm` takes the least weighted norm of what would remain, `dot` the least
    weighted dot product of the residual with the piece."""
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    caps = np.array([tokens, documents, attention], float)
    w = np.array(weights, float)
    keys: list[tuple[int, int, int]] = []
    residual = np.empty((0, 3))
    spans: dict[tuple[int, int, int], list[list[int]]] = {}
    rows: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def fits(state, need) -> int:
        return min(r // n for r, n in zip(state, need, strict=True))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        need = (length, 1, length * length)
        if fits((tokens, documents, attention), need) < 1:
            raise ValueError(f"a piece of {length} tokens exceeds a sequence's capacities")
        while left:
            at = None
            if len(keys):
                after = residual - need
                score = (w * (after / caps) ** 2).sum(1) if rule == "norm" else (w * (residual / caps) * (need / caps)).sum(1)
                score[(after < 0).any(1)] = math.inf
                if math.isfinite(score[i := int(score.argmin())]):
                    at = i
            if at is None:
                state = (tokens, documents, attention)
                k = min(fits(state, need), left)
                first, n = opened, left // k
                opened += n
            else:
                state = keys[at]
                k = min(fits(state, need), left)
                span = spans[state][-1]
                n = min(span[1], left // k)
                first = span[0]
                span[0] += n
                span[1] -= n
                if not span[1]:
                    spans[state].pop()
                if not spans[state]:
                    del spans[state]
                    keys.pop(at)
                    residual = np.delete(residual, at, 0)
            rows.append((length, rank, k, n, first, tokens - state[0]))
            rank += k * n
            left -= k * n
            new = tuple(r - k * x for r, x in zip(state, need, strict=True))
            if new[0] and new[1] and new[2]:
                if new not in spans:
                    spans[new] = []
                    keys.append(new)
                    residual = np.vstack([residual, new])
                spans[new].append([first, n])
    return np.array(rows, np.int64).reshape(-1, 6), opened


@prepared
def pack(pieces: DataFrame, tokens: int = CAPACITY, documents: int = CAPACITY, attention: int = CAPACITY**2, weights=(1.0, 1.0, 1.0), rule: str = "norm", bucket_rows: int = 1 << 10) -> DataFrame:
    """pieces (as of `tokenised`) with sequence_id and offset, gapless from 0 in each sequence. No sequence exceeds any
    of the three capacities; by default only that of tokens can bind."""
    spark = pieces.sparkSession
    pieces = written(spark, pieces.select(*_PIECES.names, F.monotonically_increasing_id().alias("row")), "pieces")
    histogram = {r.length: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `tokens` rows
    plan, _ = place(histogram, tokens, documents, attention, weights, rule)
    # Common lengths are dealt to more buckets: one row for each length, at most `tokens` of them.
    shares = spark.createDataFrame([(n, c // bucket_rows + 1) for n, c in histogram.items()], "length long, buckets long")
    salted = pieces.join(F.broadcast(shares), "length").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets")))
    own = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = salted.withColumn("rank", F.row_number().over(own).cast("long") - 1)
    if max(histogram.values(), default=0) >= bucket_rows:
        before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        base = salted.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        ranked = ranked.join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
    # The plan has some rows for each of at most `tokens` lengths, so its size doesn't grow with the corpus.
    shared = spark.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])

    def run(batches):
        rows = shared.value
        marks = (rows[:, 0] << 44) + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            hit = rows[np.searchsorted(marks, (length << 44) + rank, "right") - 1] if len(length) else rows[:0]
            nth = rank - hit[:, 1]
            yield record(_PLACED, **{f.name: batch.column(f.name) for f in _PIECES}, sequence_id=hit[:, 4] + nth // np.maximum(hit[:, 2], 1), offset=hit[:, 5] + nth % np.maximum(hit[:, 2], 1) * length)

    return ranked.select(*_PIECES.names, "rank").mapInArrow(run, PIECES + ", sequence_id long, offset long")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(tokenised(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
