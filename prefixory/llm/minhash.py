"""Operator 10: near duplicates by DartMinHash signatures, banded joining and an exact check.

Each element (a shingle of five words) of weight x owns the region [0, x) of a weight axis. Hashed darts fall on its
weight-rank plane as a Poisson process that depends on the element alone; those below x hit. A dart bears one of k
coordinates, and a signature keeps the earliest hit of each coordinate, so two sets agree on a coordinate with the
probability of their weighted Jaccard similarity. Only ranks up to about (k ln k + 2k) / total weight need be looked at,
so the work is in proportion to elements + k log k. A shingle weighs as much as a text has it. Two texts are alike as
their shingles with counts are (weighted Jaccard) or as the sets of them are, whichever is more: a copy that repeats its
paragraphs has the same set, and two texts of one long refrain nearly the same counts. So a text that repeats a shingle has
the bands of both signatures, by counts and by ones; for others the two are one.

Equal texts are one node. Nodes that share a band are candidates; a candidate becomes a link if that likeness, computed in
full, is at least 0.8; classes are the connected components of the links. A bucket is
not expanded into pairs: its head, the member that most others resemble, is tested against the others; only groups whose
members then remain in different components are looked at again, whole, in cells of bounded size, where each member
outside the largest component is compared with all others through an inverted index. So no link within a bucket is
lost, a bucket of copies costs one test a member, and pairs are never rows.

Defined results: a null text is the empty text; texts without words are only equal to equal texts; repeated rows and
equal texts are in one class; class_id is the class's least doc_id (null only if all are null); an empty table gives no
rows; a text of any length gives all its shingles; columns other than doc_id and text are not read by `near_classes` and are
kept by `keep_one`, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepared, record, table, texts, written
from .shingles import mix, shingles

K, BANDS, ROWS = 64, 16, 4
WORDS, THRESHOLD = 5, 0.8
#: Members, and bytes of their sets, in one part of a group.
CELL_ROWS, CELL_BYTES = 512, 16 << 20
GOLD, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _darts(sets: list[tuple[np.ndarray, np.ndarray]], k: int, spread: float) -> np.ndarray:
    """Signatures of (elements, weights); 0 where no dart came early enough."""
    sizes = np.array([len(h) for h, _ in sets])
    own = np.repeat(np.arange(len(sets)), sizes)
    h = np.concatenate([h for h, _ in sets])
    x = np.concatenate([w for _, w in sets])
    limit = spread / np.array([w.sum() for _, w in sets])
    cells = [(h, own, x, 0.0, 1.0)]  # the weight axis is cut at 1, 2, 4, 8, ...
    low = 1.0
    while (more := x > low).any():
        cells.append((h[more], own[more], x[more], low, low))
        low *= 2
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    with np.errstate(over="ignore"):
        for e, o, w, start, width in cells:
            e = mix(e + np.uint64(int(start) + 1) * GOLD)
            rank = np.zeros(len(e))
            while len(e):
                e = mix(e + GOLD)
                rank = rank - np.log(_unit(mix(e ^ np.uint64(1)))) / width
                live = rank <= limit[o]
                e, o, w, rank = e[live], o[live], w[live], rank[live]
                hit = start + width * _unit(mix(e ^ np.uint64(2))) < w
                mark = mix(e[hit] ^ np.uint64(3))
                found.append((o[hit] * k + (mark % np.uint64(k)).astype(np.int64), rank[hit], mark))
    at, rank, mark = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((rank, at))
    at, mark = at[order], mark[order]
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    out = np.zeros(len(sets) * k, np.uint64)
    out[at[first]] = mark[first] | np.uint64(1)
    return out.reshape(len(sets), k)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> np.ndarray:
    """One row of k marks for each (distinct element hashes, weights); the sets aren't empty."""
    out = np.zeros((len(sets), k), np.uint64)
    todo, spread = np.arange(len(sets)), k * math.log(k) + 2 * k
    while len(todo):
        out[todo] = _darts([sets[i] for i in todo], k, spread)
        todo, spread = todo[(out[todo] == 0).any(1)], spread * 2
    return out


def weighted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, made even, and how often each occurs."""
    e, n = np.unique(hashes & ~ODD, return_counts=True)
    return e, n.astype(np.float64)


def marks_of(hashes: np.ndarray) -> np.ndarray:
    """What two texts are compared by: their distinct hashes, even, and an odd mark for each further occurrence of one. So the
    Jaccard similarity of the even marks is that of the sets, and that of all marks the weighted one."""
    e, n = np.unique(hashes & ~ODD, return_counts=True)
    again = n - 1
    if not again.any():
        return e
    nth = np.arange(1, again.sum() + 1) - np.repeat(np.cumsum(again) - again, again)
    with np.errstate(over="ignore"):
        more = mix(np.repeat(e, again) + nth.astype(np.uint64) * GOLD) | ODD
    return np.sort(np.concatenate([e, more]))


def alike(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether two texts' marks are similar enough, with counts or as sets."""
    if min(len(x), len(y)) == 0:
        return False
    odd = [int((m & ODD).sum()) for m in (x, y)]
    sizes = [(len(x), len(y)), (len(x) - odd[0], len(y) - odd[1])]
    if all(min(s) < threshold * max(s) for s in sizes):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = both[1:][both[1:] == both[:-1]]
    shared = (len(common), len(common) - int((common & ODD).sum()))
    return any(n >= threshold * (a + b - n) for n, (a, b) in zip(shared, sizes, strict=True))


def band_keys(marks: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * GOLD, (len(marks), 1))
        for r in range(rows):
            key = mix(key + marks[:, r : bands * rows : rows] * GOLD)
    return key.view(np.int64)


_BANDS = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])


@prepared
def banded(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, node (a 128-bit hash of the text) and the keys of its bands."""

    def run(batches):
        for batch in batches:
            all_texts, nodes, keys = texts(batch), batch.column("node").to_pylist(), [[] for _ in range(batch.num_rows)]
            for i in range(0, len(all_texts), 64):
                sets = [(j, *weighted(s)) for j in range(i, min(i + 64, len(all_texts))) if len(s := shingles(all_texts[j], words))]
                sets += [(j, e, np.ones(len(e))) for j, e, n in sets if n.max() > 1]
                if sets:
                    for (j, *_), row in zip(sets, band_keys(signatures([(e, n) for _, e, n in sets])).tolist(), strict=True):
                        keys[j] = list(dict.fromkeys(keys[j] + row))
            yield record(_BANDS, doc_id=batch.column("doc_id"), node=nodes, bands=keys)

    return with_node(docs).mapInArrow(run, "doc_id long, node binary, bands array<long>")


def with_node(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("node"))


_SETS = pa.schema([("node", pa.binary()), ("marks", pa.binary())])


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and its marks (sorted, 64 bits each) for the wanted (node, doc_id), one row of each node."""
    have = with_node(docs)
    hit = have.join(wanted.select(F.col("node").alias("_n"), F.col("rep").alias("_r")), (F.col("node") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("_r")), "left_semi")

    def run(batches):
        for batch in batches:
            yield record(_SETS, node=batch.column("node"), marks=[marks_of(shingles(t, words)).tobytes() for t in texts(batch)])

    return hit.mapInArrow(run, "node binary, marks binary").dropDuplicates(["node"])


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a: tested member, b: others) whose marks are similar enough."""

    def run(batches):
        for batch in batches:
            pairs_of = zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist(), strict=True)
            keep = [alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), threshold) for a, b in pairs_of]
            yield record(_LINKS, a=batch.column("a"), b=batch.column("b")).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("marks").alias("mb")), "b")
    return with_b.join(sets.select(F.col("node").alias("a"), F.col("marks").alias("ma")), "a").select("a", "b", "ma", "mb").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of all nodes with links: least labels of neighbours and labels of
    labels in turn, so the rounds grow with the logarithm of the longest path. Each round is a written table."""
    spark = links.sparkSession
    edges = written(spark, links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct(), "edges")
    labels = written(spark, edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = written(spark, low.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        labels = new.drop("old")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return labels


_CELL = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _cell_links(nodes: list[bytes], labels: list[bytes], marks: list[bytes], threshold: float) -> list[tuple[bytes, bytes]]:
    """Links between members of different components, one for each pair of a member and a component. Members of the
    largest component need not be looked at: every such pair has a member outside it."""
    names, label = np.unique(np.array(labels, object), return_inverse=True)
    if len(names) < 2:
        return []
    sets = [np.frombuffer(m, np.uint64) for m in marks]
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate(sets)
    even = every & ODD == 0
    plain = np.bincount(owner[even], minlength=len(sets))
    element = np.unique(every, return_inverse=True)[1]
    order = np.argsort(element, kind="stable")
    posting = owner[order]
    bounds = np.searchsorted(element[order], np.arange(element.max(initial=-1) + 2))
    starts = np.cumsum(sizes) - sizes
    largest = np.bincount(label).argmax()

    def shared(own: np.ndarray) -> np.ndarray:
        return np.bincount(np.concatenate([posting[bounds[e] : bounds[e + 1]] for e in own] or [posting[:0]]), minlength=len(sets))

    out = []
    for r in np.flatnonzero(label != largest):
        own, of_set = (v[starts[r] : starts[r] + sizes[r]] for v in (element, even))
        n = shared(own)
        near = n >= threshold * (sizes + sizes[r] - n)
        if plain[r] < sizes[r]:
            n = shared(own[of_set])
        near |= n >= threshold * (plain + plain[r] - n)
        hit = np.flatnonzero(near & (label != label[r]) & (sizes > 0))
        for m in hit[np.unique(label[hit], return_index=True)[1]]:
            out.append((nodes[r], nodes[m]))
    return out


def _open_links(groups: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links that the first test left open. groups: (head, node) of all members. A group whose members are in several
    components is read whole, in one cell of a task; a group that is too large for one is cut into parts, and each two parts
    meet in a cell of their own, so a member goes to as many cells as there are parts and pairs are never rows."""
    placed = groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_heads = placed.groupBy("head").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x <> y and n > 2").select("head")
    spark = groups.sparkSession  # what is joined by head is written first, so that a large group can be split
    rows = written(spark, placed.join(written(spark, open_heads, "heads"), "head", "left_semi").join(sets, "node"), "open")
    parts = rows.groupBy("head").agg(F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum(F.octet_length("marks")) / CELL_BYTES)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cells = rows.join(written(spark, parts, "parts"), "head").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    cells = cells.select("head", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "label", "marks")

    def run(batches):
        cell, held = None, ([], [], [])
        for batch in batches:
            out = []
            for *key, node, label, marks in zip(*(batch.column(c).to_pylist() for c in ("head", "i", "j", "node", "label", "marks")), strict=True):
                if key != cell:
                    out += _cell_links(*held, threshold)
                    cell, held = key, ([], [], [])
                for column, value in zip(held, (node, label, marks), strict=True):
                    column.append(value)
            yield record(_CELL, a=[x for x, _ in out], b=[x for _, x in out])
        out = _cell_links(*held, threshold)
        yield record(_CELL, a=[x for x, _ in out], b=[x for _, x in out])

    return cells.repartition(F.col("head"), F.col("i"), F.col("j")).sortWithinPartitions("head", "i", "j").mapInArrow(run, "a binary, b binary")


def linked(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """node, label of all nodes that are linked to another one: those that share a key and whose sets are similar enough, and
    what such links connect. members: (node, key); sets_of gives the marks (node, marks) of the nodes of its argument, as `marks_of` makes them."""
    spark = members.sparkSession
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = written(spark, members.join(sizes, "key"), "sized")
    # The head of a bucket is its member with the fullest buckets: the text that most others are copies of.
    rank = sized.groupBy("node").agg(F.struct(F.sum("n").alias("n"), F.xxhash64("node").alias("h")).alias("rank"))
    ranked = sized.select("node", "key").join(rank, "node")
    heads = ranked.groupBy("key").agg(F.max_by("node", "rank").alias("head"))
    groups = written(spark, ranked.select("node", "key").join(heads, "key").select("head", "node").distinct(), "groups")
    sets = written(spark, sets_of(groups.select("node").distinct()), "sets")
    links = written(spark, _links(groups.where("head <> node").toDF("a", "b"), sets, threshold), "links")
    labels = components(links)
    more = written(spark, _open_links(groups, labels, sets, threshold), "links")
    return labels if more.isEmpty() else components(links.unionByName(more))


@prepared
def near_classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node (of its text), label (of its class) and class_id of every row."""
    spark = docs.sparkSession
    rows = written(spark, banded(docs, words), "bands")
    nodes = written(spark, rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return _sets(docs, nodes.join(wanted, "node", "left_semi").select("node", "rep"), words)

    labels = linked(nodes.select("node", F.explode("bands").alias("key")), sets_of, threshold)
    by_node = written(spark, classed(nodes.select("node", "rep"), labels), "classes")  # so that a text with very many copies can be split in the join
    return rows.select("doc_id", "node").join(by_node, "node")


def classed(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label, class_id (the least rep of its class) of all nodes (node, rep); those without a label are alone."""
    own = nodes.join(labels, "node")
    least = own.groupBy("label").agg(F.min("rep").alias("class_id"))
    found = own.join(least, "label").select("node", "label", "class_id")
    return nodes.join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.coalesce("class_id", "rep").alias("class_id"))


@prepared
def keep_one(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class: of its least doc_id (null only if all are null), of the least text hash among rows with that."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # the input may have any names
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    plain = docs.toDF(*names)
    classes = near_classes(plain.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words, threshold)
    kept = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("kept"))
    stays = kept.select(F.col("kept.doc_id").alias("_id"), F.col("kept.node").alias("_node"))
    own = plain.withColumn("_own", F.unhex(F.md5(F.coalesce(text, F.lit("")))))
    rows = own.join(stays, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_node")), "left_semi")
    return rows.dropDuplicates([doc_id, "_own"]).select(*names).toDF(*docs.columns)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
