"""Operator 2: language-model scoring with a hashed maximum-entropy model.

The softmax over tokens is factored into classes of classes: the most frequent tokens and one leaf for all others (the tail)
are cut into at most `WIDE` groups of equal mass, each group again, and so on, so a token is a path of softmaxes whose
length follows its surprise. Every softmax on the path, down to the token, has the same features of the history: its bias,
the last token (bigram), the last two together (trigram), the last but one (skip), and the last very frequent token however
far back (a long skip). A feature and the softmax's node are hashed together to a row of `WIDE` weights; in histories a word of the
tail stands for all of its kind. The tail is one more softmax over `WIDE` kinds of words (a hash of a word's end), within
which a token has its add-one share of the counts; one unseen token counts for each kind. So the probabilities of all tokens
sum to one.

Training: counts of all tokens are summed in Spark; they make the paths and the biases that training starts from. Weights
are then trained by gradient updates: in each round workers run minibatch Adagrad over their share of the training
documents (each document once over all rounds) from the same weights, and a row's changes are averaged over workers by the
squared gradients that each of them saw in that row (sent in half precision). Head, hashed rows and workers grow with the tokens; the dictionary,
the head and the rows have bounds (`DICTIONARY`, `MOST_HEAD`, `MOST_ROWS`), as they are broadcast.

Counts: those of the most frequent tokens, `DICTIONARY` at most, are broadcast; the others are joined by hash, so every
token has its exact count. Tokens are known by 60-bit hashes and the 4 bits of their kind.

Defined results: a null or empty text is its end token; null doc_ids count as held in (they have no remainder); repeated
rows are documents each; tokens of equal count are ranked by their hash; a text of any length is scored whole; an empty
table gives no rows; other columns are not read. Without training documents the counts are 0.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepared, record, table, texts, written
from .hashtable import HashTable
from .shingles import mix

WIDE, ANCHORS = 16, 64
DICTIONARY = 1 << 20
#: Tokens of training text for each head token and for each hashed row, and the most of both.
TOKENS_A_HEAD, MOST_HEAD = 512, 1 << 16
TOKENS_A_ROW, LEAST_ROWS, MOST_ROWS = 16, 1 << 14, 1 << 19
WORKER_TOKENS, LEAST_WORKERS, ROUNDS, BATCH = 4_000_000, 6, 2, 16384
#: Of biases, of bigrams and trigrams, of the skip and of the long skip.
RATES = (0.3, 0.8, 0.8, 0.8)
GOLD = np.uint64(0x9E3779B97F4A7C15)
KIND = np.uint64(WIDE - 1)
DOCS = 100
FLUSH = 300_000
#: Blocks of rows, and workers whose blocks are summed at once.
SUM_BLOCKS, SUMMED = 16, 16


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


#: A word is hashed by the sum of its bytes' random numbers, each times an odd number to the power of its place.
_BASE = 0x9FB21C651E98DF25
_RANDOM = mix(np.arange(1, 257, dtype=np.uint64) * GOLD) | np.uint64(1)
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
PART = 1 << 18
_UP, _DOWN = _powers(_BASE, PART), _powers(pow(_BASE, -1, 1 << 64), PART)
_CUT = re.compile(rb"[ \t-\r]")


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word."""
    b = np.frombuffer(raw, np.uint8)
    up, down = (_UP, _DOWN) if len(b) < len(_UP) else (_powers(_BASE, len(b)), _powers(pow(_BASE, -1, 1 << 64), len(b)))
    blank = np.concatenate([[True], _BLANK.take(b), [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.cumsum(np.concatenate([np.zeros(1, np.uint64), _RANDOM.take(b) * up[: len(b)]]))
        h = mix((sums.take(end) - sums.take(start)) * down.take(start))
        tail = b.take(end - 1).astype(np.uint64)
        for k in (2, 3):
            tail = (tail << np.uint64(8)) | np.where(end - k >= start, b.take(np.maximum(end - k, 0)), 0).astype(np.uint64)
    return (h & ~KIND) | (mix(tail) >> np.uint64(60)), start


def _parts(raw: bytes) -> list[bytes]:
    """raw in pieces of about PART bytes at most, cut at blanks: longer only where one word is."""
    out, at = [], 0
    while len(raw) - at > PART:
        cuts = [raw.rfind(bytes([c]), at + 1, at + PART) for c in (32, 10)]
        cut = max(cuts)
        if cut < 0:
            found = _CUT.search(raw, at + 1)
            cut = found.start() if found else len(raw)
        out.append(raw[at:cut])
        at = cut
    return [*out, raw[at:]]


def token_hash(token: bytes) -> int:
    return int(_words(token)[0][0])


END = int(mix(np.array([7], np.uint64))[0])


def tokens(text: str) -> np.ndarray:
    """60 bits of each word's hash and 4 of its kind, a hash of its last three bytes."""
    return _batch_tokens([text])[0][:-1]


def _batch_tokens(all_texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a batch, and the number of tokens of each text."""
    hashes: list[np.ndarray] = []
    sizes: list[np.ndarray] = []

    def hashed(group: list[bytes]) -> None:
        h, start = _words(b" ".join(group))
        bounds = np.cumsum([len(x) + 1 for x in group])
        n = np.diff(np.searchsorted(start, bounds), prepend=0)
        hashes.append(np.insert(h, np.cumsum(n), np.uint64(END)))
        sizes.append(n + 1)

    group, size = [], 0  # texts that are hashed together
    for t in all_texts:
        raw = t.encode().lower()  # of bytes: only A-Z changes
        if size + len(raw) + 1 > PART and group:
            hashed(group)
            group, size = [], 0
        if len(raw) > PART:
            own = [_words(x)[0] for x in _parts(raw)]
            hashes += [*own, np.array([END], np.uint64)]
            sizes.append(np.array([sum(map(len, own)) + 1]))
        else:
            group.append(raw)
            size += len(raw) + 1
    if group:
        hashed(group)
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), (np.concatenate(sizes) if sizes else np.empty(0, np.int64)).astype(np.int64)


_COUNTS = pa.schema([("h", pa.int64()), ("c", pa.int64())])


@prepared
def token_counts(docs: DataFrame) -> DataFrame:
    """h, c of all tokens; each task sends sums of bounded tables."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed():
            h = np.concatenate([x for x, _ in held])
            c = np.concatenate([x for _, x in held])
            keys, at = np.unique(h, return_inverse=True)
            return keys, np.bincount(at, c, len(keys)).astype(np.int64)

        for batch in batches:
            all_texts = texts(batch)
            for i in range(0, len(all_texts), DOCS):
                keys, n = np.unique(_batch_tokens(all_texts[i : i + DOCS])[0], return_counts=True)
                held.append((keys, n))
                size += len(keys)
                if size > 4 * FLUSH:
                    held = [summed()]
                    size = len(held[0][0])
                    if size > FLUSH:
                        yield record(_COUNTS, h=held[0][0].view(np.int64), c=held[0][1])
                        held, size = [], 0
        if held:
            keys, n = summed()
            yield record(_COUNTS, h=keys.view(np.int64), c=n)

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def paths(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of classes of leaves of falling mass. Returns node and slot by (level, leaf), node -1 below a leaf's last,
    and the mass by (node, slot)."""
    node, slot = [np.full(len(mass), -1, np.int32)], [np.zeros(len(mass), np.int8)]
    masses: list[np.ndarray] = []
    total = np.concatenate([[0.0], np.cumsum(mass)])
    todo = [(0, len(mass), 0)]
    while todo:
        a, b, level = todo.pop()
        if level == len(node):
            node.append(np.full(len(mass), -1, np.int32))
            slot.append(np.zeros(len(mass), np.int8))
        if b - a <= WIDE:
            cut = np.arange(a, b + 1)
        else:
            even = np.searchsorted(total[a : b + 1], np.linspace(total[a], total[b], WIDE + 1)[1:-1]) + a
            cut = np.concatenate([[a], np.unique(np.clip(even, a + 1, b - 1)), [b]])
        own = np.zeros(WIDE)
        for k, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            node[level][x:y], slot[level][x:y], own[k] = len(masses), k, total[y] - total[x]
            if y - x > 1:
                todo.append((x, y, level + 1))
        masses.append(own)
    return np.stack(node), np.stack(slot), np.stack(masses)


class Vocabulary:
    """Counts of the most frequent tokens, the paths of the head and of the tail, and the counts of the tail by kind."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, kinds: np.ndarray):
        """kinds: (tokens, types) of all training tokens by kind."""
        order = np.lexsort((hashes, -counts))
        hashes, self.counts = hashes[order], counts[order]
        self.hashes, self.table = hashes, HashTable(hashes)
        self.total, self.types = (int(x) for x in kinds.sum(0))
        self.head = min(max(self.total // TOKENS_A_HEAD, 1024), MOST_HEAD, len(hashes))
        self.rows = min(max(1 << (self.total // TOKENS_A_ROW).bit_length(), LEAST_ROWS), MOST_ROWS)
        top, kind = self.counts[: self.head].astype(float), (hashes[: self.head] & KIND).astype(int)
        self.tail = kinds - np.stack([np.bincount(kind, top, WIDE), np.bincount(kind, minlength=WIDE)], 1)  # (tokens, types) by kind
        leaf = np.concatenate([top, [self.tail[:, 0].sum() + WIDE]])
        rank = np.argsort(-leaf, kind="stable")  # the tail has its place by mass
        node, slot, masses = paths(leaf[rank])
        self.node, self.slot = np.empty_like(node), np.empty_like(slot)
        self.node[:, rank], self.slot[:, rank] = node, slot
        self.masses = np.concatenate([masses, [self.tail.sum(1) + 1]])
        self.tail_node = len(masses)
        self.log_tail = np.log10(self.tail.sum(1) + 1)

    def __getstate__(self):
        """What is broadcast: workers build the hash table anew."""
        return {**self.__dict__, "table": None}

    def __setstate__(self, state: dict):
        self.__dict__ |= state
        self.table = HashTable(self.hashes)

    def biases(self) -> np.ndarray:
        """The log shares of the counts; a slot without tokens has no probability."""
        own = self.masses / self.masses.sum(1, keepdims=True)
        return np.where(own > 0, np.log(np.maximum(own, 1e-12)), -1e4).astype(np.float32)

    def steps(self, h: np.ndarray, sizes: np.ndarray):
        """Each token's row in the dictionary (-1: not there) and whether it is in the head; and the softmaxes on all
        tokens' paths: position, slot, and the rows of weights of its features."""
        row = self.table.find(h).astype(np.int64)
        head = (row >= 0) & (row < self.head)
        leaf = np.where(head, row, self.head)
        starts = np.cumsum(sizes) - sizes
        own = np.repeat(starts, sizes)
        at = np.arange(len(h))
        word = np.where(head, h, (h & KIND) + np.uint64(1))  # in histories a word of the tail is one of its kind
        one = np.where(at > own, np.roll(word, 1), np.uint64(0))
        two = np.where(at > own + 1, np.roll(word, 2), np.uint64(0))
        last = np.concatenate([[-1], np.maximum.accumulate(np.where((row >= 0) & (row < ANCHORS), at, -1))[:-1]]) if len(h) else at
        anchor = np.where(last >= own, row[np.maximum(last, 0)] + 1, 0).astype(np.uint64)
        with np.errstate(over="ignore"):
            first = mix(one + np.uint64(1))
            histories = [first, mix(first * GOLD + two), mix(two + np.uint64(2)), mix(anchor + np.uint64(3))]
            where, nodes, slots = [], [], []
            for node, slot in zip(self.node, self.slot, strict=True):
                n = node.take(leaf)
                live = np.flatnonzero(n >= 0)
                where.append(live)
                nodes.append(n.take(live))
                slots.append(slot.take(leaf.take(live)))
            tail = np.flatnonzero(~head)
            pos = np.concatenate([*where, tail])
            node = np.concatenate([*nodes, np.full(len(tail), self.tail_node, np.int32)]).astype(np.int64)
            slot = np.concatenate([*slots, (h[tail] & KIND).astype(np.int8)]).astype(np.int64)
            salt = node.astype(np.uint64) * GOLD
            shift = np.uint64(65 - self.rows.bit_length())
            rows = [node] + [((x.take(pos) ^ salt) * np.uint64(0xBF58476D1CE4E5B9) >> shift).astype(np.int64) + len(self.masses) for x in histories]
        return row, head, pos, slot, rows


_ONES = np.ones(WIDE, np.float32)


def _shares(features: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The softmaxes' probabilities from each feature's weights and rows, but for a factor for each (its inverse is the
    second result)."""
    (weights, rows), *others = features
    z = weights.take(rows, 0)
    for weights, rows in others:
        z += weights.take(rows, 0)
    if z.size and z.max() > 60:  # far from what training makes
        np.minimum(z, 60, out=z)
    np.exp(z, out=z)
    return z, z @ _ONES


def _sorting(keys: np.ndarray, bits: int) -> np.ndarray:
    """The order that sorts non-negative keys of so many bits, by 16 at a time."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")  # numpy sorts these by radix
    for k in range(16, bits, 16):
        order = order.take(np.argsort((keys >> k & 0xFFFF).astype(np.uint16).take(order), kind="stable"))
    return order


class Distinct:
    """The distinct rows of weights that one feature touches in a minibatch, read once and in order."""

    def __init__(self, weights: np.ndarray, order: np.ndarray, rows: np.ndarray, outer: np.ndarray | None = None):
        """rows are sorted by order (within outer ones: a row that two of those share is read for each)."""
        own = rows.take(order)
        change = own[1:] != own[:-1]
        if outer is not None:
            change |= outer[1:] != outer[:-1]
        self.sorted, self.last = own, np.flatnonzero(np.append(change, True))
        self.at = own.take(self.last)
        self.values = weights.take(self.at, 0)
        self.of = np.empty(len(rows), np.int64)  # which of them each place has
        self.of[order] = np.cumsum(np.append(0, change))

    def step(self, weights: np.ndarray, seen: np.ndarray, running: np.ndarray, rate: float) -> None:
        """Adagrad on the rows' sums of gradients, with a rate for each row. running: the running sums in order."""
        sums = running.take(self.last, 0).view(np.float32)
        sums[1:] -= sums[:-1].copy()
        more = seen.take(self.at) + np.einsum("ij,ij->i", sums, sums)
        seen[self.at] = more
        sums *= (np.float32(rate) / np.sqrt(more + np.float32(1e-2)))[:, None]
        sums += self.values
        weights[self.at] = sums


def _minibatch(weights: np.ndarray, seen: np.ndarray, rows: list[np.ndarray], slot: np.ndarray) -> None:
    """One update. Trigram rows refine bigram rows and need no sort of their own (a row that two bigram rows share in one
    minibatch takes the step of one of them)."""
    bias, bigram, trigram, skip, anchor = rows
    bits = len(weights).bit_length()
    orders = [_sorting(bias, bits), _sorting(bigram << bits | trigram, 2 * bits), _sorting(skip, bits), _sorting(anchor, bits)]
    features = [Distinct(weights, o, r) for o, r in zip(orders, (bias, bigram, skip, anchor), strict=True)]
    finer = Distinct(weights, orders[1], trigram, features[1].sorted)
    g, total = _shares([(f.values, f.of) for f in (*features, finer)])
    g *= (-1 / total)[:, None]
    g[np.arange(len(g)), slot] += 1
    for k, (order, f) in enumerate(zip(orders, features, strict=True)):
        running = np.cumsum(g.take(order, 0).view(np.complex64), 0)  # two sums at once
        f.step(weights, seen, running, RATES[k])
        if k == 1:
            finer.step(weights, seen, running, RATES[k])


def _trained(batches, vocabulary: Vocabulary, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Local updates over one worker's documents. Returns the weights and the squared gradients that each row saw."""
    weights, seen = weights.copy(), np.zeros(len(weights), np.float32)
    for batch in batches:
        all_texts = texts(batch)
        for i in range(0, len(all_texts), DOCS):
            _, _, pos, slot, rows = vocabulary.steps(*_batch_tokens(all_texts[i : i + DOCS]))
            for a in range(0, len(pos), BATCH):
                s = slice(a, a + BATCH)
                _minibatch(weights, seen, [r[s] for r in rows], slot[s])
    return weights, seen


_SUMS = "block int, salt int, at binary, mass binary, change binary"
_BLOCK = pa.schema([("block", pa.int32()), ("salt", pa.int32()), ("at", pa.binary()), ("mass", pa.binary()), ("change", pa.binary())])


def _changes(start: np.ndarray, weights: np.ndarray, seen: np.ndarray, salt: int):
    """The changed rows in blocks (row, mass, change in half precision), so that no task sums the whole of them."""
    for b, at in enumerate(np.array_split(np.arange(len(seen)), SUM_BLOCKS)):
        at = at[seen[at] > 0]
        yield record(_BLOCK, block=[b], salt=[salt], at=[at.astype(np.int32).tobytes()], mass=[seen[at].tobytes()], change=[(weights[at] - start[at]).astype(np.float16).tobytes()])


def _summed(rows: DataFrame, levels: int) -> DataFrame:
    """The blocks' changes averaged by mass over workers, by salts first if there are many workers."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.frombuffer(a, np.int32), np.frombuffer(m, np.float32), np.frombuffer(c, np.float16).reshape(-1, WIDE)) for a, m, c in zip(frame["at"], frame["mass"], frame["change"], strict=True)]
        at = np.unique(np.concatenate([a for a, _, _ in parts]))
        mass, change = np.zeros(len(at)), np.zeros((len(at), WIDE))
        for a, m, c in parts:  # rows of one part are distinct
            k = np.searchsorted(at, a)
            mass[k] += m
            change[k] += c * m[:, None]
        change /= mass[:, None]
        return pd.DataFrame({"block": frame["block"][:1], "salt": [0], "at": [at.tobytes()], "mass": [mass.astype(np.float32).tobytes()], "change": [change.astype(np.float16).tobytes()]})

    if levels > 1:
        rows = rows.groupBy("block", "salt").applyInPandas(add, _SUMS)
    return rows.groupBy("block").applyInPandas(add, _SUMS)


class Model:
    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray):
        self.vocabulary, self.weights = vocabulary, weights
        self.shared = None  # the vocabulary as it was broadcast

    def score(self, h: np.ndarray, sizes: np.ndarray):
        """For each text: known tokens, sums of log10 for base and model without the tokens outside the dictionary's own
        counts, and those tokens' hashes with the number of them."""
        v = self.vocabulary
        row, head, pos, slot, rows = v.steps(h, sizes)
        at = np.repeat(np.arange(len(sizes)), sizes)
        scored = np.zeros(len(sizes))
        for a in range(0, len(pos), BATCH):
            s = slice(a, a + BATCH)
            p, total = _shares([(self.weights, r[s]) for r in rows])
            p = p[np.arange(len(p)), slot[s]].astype(np.float64) / total
            scored += np.bincount(at.take(pos[s]), np.log10(np.maximum(p, 1e-300)), len(sizes))
        known = row >= 0
        plus = np.log10(np.where(known, v.counts[np.where(known, row, 0)] if len(v.counts) else 0, 0) + 1.0)
        add = lambda x: np.bincount(at, x, len(sizes))
        base = plus - math.log10(v.total + v.types + 1)
        within = np.where(head, 0.0, plus - v.log_tail[(h & KIND).astype(np.int64)])
        outside = np.flatnonzero(~known)
        return add(known.astype(float)).astype(np.int64), add(base), scored + add(within), h[outside].view(np.int64), np.bincount(at[outside], minlength=len(sizes))


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """From (h, c) of all tokens. Collects the dictionary, a row for each kind and one for each size of counts."""
    kinds = np.zeros((WIDE, 2))
    for r in counts.groupBy(F.col("h").bitwiseAND(WIDE - 1).alias("kind")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        kinds[r.kind] = r.c, r["n"]
    size = F.floor(F.log2(F.col("c").cast("double")) * 64).cast("int")  # counts up to 1 % apart
    least, room = 0, DICTIONARY
    for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.col("size").desc()).collect():
        if r["n"] > room:
            break
        least, room = r.c, room - r["n"]
    top = counts.where(F.col("c") >= least).toArrow().to_pandas() if least else pd.DataFrame({"h": [], "c": []}, dtype=np.int64)
    return Vocabulary(top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), kinds)


@prepared
def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all the documents, and their token counts (h, c)."""
    spark = docs.sparkSession
    counts = written(spark, token_counts(docs), "token-counts")
    vocabulary = vocabulary_of(counts)
    weights = np.concatenate([vocabulary.biases(), np.zeros((vocabulary.rows, WIDE), np.float32)])
    workers = int(max(LEAST_WORKERS, vocabulary.total // ROUNDS // WORKER_TOKENS))
    salts = -(-workers // SUMMED)
    shared = spark.sparkContext.broadcast(vocabulary)  # at most DICTIONARY tokens
    for k in range(ROUNDS):
        used = np.flatnonzero(weights.any(1))
        sent = spark.sparkContext.broadcast((len(weights), used, weights[used]))  # at most MOST_ROWS rows and those of the head

        def run(batches, sent=sent):
            from pyspark import TaskContext

            size, at, values = sent.value
            start = np.zeros((size, WIDE), np.float32)
            start[at] = values
            w, seen = _trained(batches, shared.value, start)
            if seen.any():
                yield from _changes(start, w, seen, TaskContext.get().partitionId() % salts)

        share = docs.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == k).select("text").coalesce(workers)
        weights = weights.copy()
        for r in _summed(share.mapInArrow(run, _SUMS), 1 + (salts > 1)).collect():  # the size of the model
            weights[np.frombuffer(r.at, np.int32)] += np.frombuffer(r.change, np.float16).reshape(-1, WIDE)
        sent.destroy()
    model = Model(vocabulary, weights)
    model.shared = shared
    return model, counts


_SCORED = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("rare", pa.list_(pa.int64()))])


@prepared
def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """docs (doc_id, text, held_out) with token counts, base score and model score."""
    spark = docs.sparkSession
    v = model.vocabulary
    shared = model.shared or spark.sparkContext.broadcast(v)
    weights = spark.sparkContext.broadcast(model.weights)  # of bounded size, as the vocabulary is

    def run(batches):
        own = Model(shared.value, weights.value)
        for batch in batches:
            all_texts = texts(batch)
            for i in range(0, len(all_texts), DOCS):
                part = batch.slice(i, DOCS)
                h, sizes = _batch_tokens(all_texts[i : i + DOCS])
                known, base, scored, rare, each = own.score(h, sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), pa.array(rare))
                yield record(_SCORED, rid=part.column("rid"), doc_id=part.column("doc_id"), held_out=part.column("held_out"), n_tokens=sizes, n_known=known, base=base, model=scored, rare=lists)

    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text")
    rows = written(spark, numbered.mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<long>"), "scored")
    rare = rows.select("rid", F.explode("rare").alias("h")).groupBy("rid", "h").agg(F.count("*").alias("n"))
    exact = rare.join(counts, "h").groupBy("rid").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("plus"))
    plus = F.coalesce("plus", F.lit(0.0))
    return rows.drop("rare").join(exact, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + plus).alias("base_score"),
        (F.col("model") + plus).alias("score"),
    )


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    model, counts = train(docs.where("not held_out"))
    return score(docs, model, counts)
