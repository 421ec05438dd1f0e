"""Operator 3: a quality classifier by perplexity under an interpolated modified Kneser-Ney n-gram model.

The model of each language is trained on trusted text: half of the documents labelled good and not toxic, at most
`PER_LANGUAGE` of a language (those of least hash; the bound of the sample). Symbols are the words that the sample has at
least `LEAST` times; other words are their shape (kinds of letters, digits, signs), so text of unusual make is improbable.
Trigrams, continuation counts, the discounts for counts of one, two and more, and the interpolated probabilities are all
worked out in Spark, by aggregates and joins on hashed keys, to one table (key, probability, back-off weight; the two in
single precision, whichever way they are read; what is made of them is in double).

The table is sharded by the hash of the key. Scoring joins the n-grams of each document with the shards: through hash
tables broadcast to the workers while the table is within `BROADCAST_BYTES` (its rows are counted first; the sample bounds
them), else by a shuffle join on the key. A document is rejected if its perplexity exceeds its language's threshold: the
`QUANTILE` of the trusted documents of that language that are held out (half of them, none trained on).

Defined results: a null or empty text has the end symbol alone and is kept, as it has no word to judge; a text of any length
is judged whole; a language (null is one) without trusted documents has no model, perplexity null, and its documents are kept
(as are those of one without held-out ones); several labels of a document count as the worst; documents of equal hash are
sampled by doc_id; a perplexity equal to the threshold is kept; repeated rows are judged each; an empty table gives no rows;
`filtered` keeps all columns, whatever they are called; `judged` reads doc_id, lang and text alone.
"""

from __future__ import annotations

import math
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Cache, prepared, record, table, texts, written
from .hashtable import HashTable
from .shingles import mix

PER_LANGUAGE, LEAST, SHARDS, PARTS = 500, 3, 8, 16
#: Of a row of the model's table, and of a table that is broadcast.
ROW_BYTES, BROADCAST_BYTES = 16, 64 << 20
QUANTILE = 0.99
GOLD = np.uint64(0x9E3779B97F4A7C15)
START, END = np.uint64(1), np.uint64(2)
NO_LANGUAGE = ""


def _kind(c: str) -> str:
    return "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c


def shape(word: str) -> str:
    """Its kinds of characters, runs as one: 'Haus7%%' is 'Aa0%'."""
    return "".join(k for k, _ in groupby(map(_kind, word)))


def _hash(symbol: str) -> int:
    return xxhash.xxh3_64_intdigest(symbol) | 4  # apart from START and END


class Symbols:
    """Symbols of one language's texts, given the hashes of its known words."""

    def __init__(self, known: frozenset[int]):
        self.known = known
        self.cache = Cache(self._one, 80_000)

    def _one(self, word: str) -> int:
        h = _hash("w" + word)
        return h if h in self.known else _hash("s" + shape(word))

    def of(self, text: str) -> np.ndarray:
        words = text.split()
        return np.concatenate([np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words)), [END]]).astype(np.uint64)


def _keys(language: str, symbols: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Keys of the n-grams at each position: k3, k2, k1 end there, c2 and c1 are their contexts."""
    w = np.concatenate(symbols)
    sizes = np.array([len(s) for s in symbols])
    own = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(w))
    p1 = np.where(at > own, np.roll(w, 1), START)
    p2 = np.where(at > own + 1, np.roll(w, 2), START)
    with np.errstate(over="ignore"):
        seed = np.uint64(xxhash.xxh3_64_intdigest(language))
        one, two = (lambda a: mix(a + seed)), (lambda a, b: mix(mix(a + seed) * GOLD + b))
        k2 = two(p1, w)
        return {"k3": mix(two(p2, p1) * GOLD + w + np.uint64(3)), "k2": k2, "k1": one(w), "c2": two(p2, p1), "c1": one(p1)}


def _level(grams: DataFrame, context: str, count: str) -> DataFrame:
    """One level of the model from n-grams with their counts: the n-grams with `share`, their discounted share of their
    context, and `g`, the context's weight of what lies below. The discounts of a language are one row."""
    n = F.col(count)
    of = [F.count_if(n == i).cast("double") for i in (1, 2, 3, 4)]
    y = F.when(of[0] > 0, of[0] / (of[0] + 2 * of[1])).otherwise(0.5)
    cut = [F.when(of[i] > 0, F.least(F.greatest((i + 1) - (i + 2) * y * of[i + 1] / F.greatest(of[i], F.lit(1.0)), F.lit(0.05)), F.lit(i + 0.95))).otherwise(0.5 * (i + 1)) for i in range(3)]
    discounts = grams.groupBy("lang").agg(*(c.alias(f"d{i + 1}") for i, c in enumerate(cut)))
    cut_of = grams.join(F.broadcast(discounts), "lang").withColumn("cut", F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))).drop("d1", "d2", "d3")
    own = Window.partitionBy("lang", context)  # of a bounded sample
    every = F.sum(n).over(own)
    return cut_of.select(*(c for c in cut_of.columns if c != "cut"), ((n - F.col("cut")) / every).alias("share"), (F.sum("cut").over(own) / every).alias("g"))


def kneser_ney(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From the trigrams (lang, k3, k2, k1, c2, c1, n): the table (key, p, g) of probabilities of n-grams (null for keys that
    are contexts alone) and back-off weights of contexts (1 for others), and for each language the probability of a symbol
    that was never seen (lang, unseen). Keys are seeded by the language, so they tell it."""
    three = _level(grams.select("lang", "k3", "k2", "c2", "n"), "c2", "n")
    two = _level(grams.groupBy("k2").agg(F.max("lang").alias("lang"), F.max("k1").alias("k1"), F.max("c1").alias("c1"), F.count("*").alias("n")), "c1", "n")
    one = _level(two.groupBy("lang", "k1").agg(F.count("*").alias("n")).withColumn("c0", F.lit(0)), "c0", "n")
    unseen = one.groupBy("lang").agg((F.max("g") / (F.count("*") + 1)).alias("unseen"))
    p1 = one.join(F.broadcast(unseen), "lang").select("k1", (F.col("share") + F.col("unseen")).alias("p1"))  # one row a language
    p2 = two.join(p1, "k1").select("k2", (F.col("share") + F.col("g") * F.col("p1")).alias("p2"))
    p3 = three.join(p2, "k2").select("k3", (F.col("share") + F.col("g") * F.col("p2")).alias("p"))
    context2, context1 = (x.groupBy(c).agg(F.max("g").alias("g")) for x, c in ((three, "c2"), (two, "c1")))
    none = F.lit(None).cast("double")
    rows = p3.select(F.col("k3").alias("key"), "p", none.alias("g"))
    rows = rows.union(p2.select("k2", "p2", none)).union(p1.select("k1", "p1", none))
    rows = rows.union(context2.select("c2", none, "g")).union(context1.select("c1", none, "g"))
    return rows.groupBy("key").agg(F.max("p").cast("float").alias("p"), F.coalesce(F.max("g"), F.lit(1.0)).cast("float").alias("g")), unseen


class Shards:
    """The model's table in shards by the last bits of the key."""

    def __init__(self, keys: np.ndarray, p: np.ndarray, g: np.ndarray):
        self.shards = []
        for s in range(SHARDS):
            own = keys % np.uint64(SHARDS) == s
            self.shards.append((HashTable(keys[own]), p[own].astype(np.float32), g[own].astype(np.float32)))

    def join(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability (nan where there is none) and back-off weight of each key: single as in the table, for double sums."""
        p, g = np.full(len(keys), np.nan), np.ones(len(keys))
        shard = keys % np.uint64(SHARDS)
        for s, (find, ps, gs) in enumerate(self.shards):
            at = np.flatnonzero(shard == s)
            row = find.find(keys[at])
            at, row = at[row >= 0], row[row >= 0]
            p[at], g[at] = ps[row], gs[row]
        return p, g


class Model:
    """known: the words of each language; unseen: the probability of a symbol never seen; table: (key, p, g), written, of
    `size` rows; columns: its three columns where they are within bounds."""

    def __init__(self, known: dict[str, frozenset[int]], unseen: dict[str, float], table: DataFrame | None = None, size: int = 0, columns: list[np.ndarray] | None = None):
        self.known, self.unseen, self.table, self.size, self.columns = known, unseen, table, size, columns
        self.shards: Shards | None = None
        self.symbols: dict[str, Symbols] = {}

    def __getstate__(self):
        """What is broadcast: words and columns. Workers build the shards."""
        return {"known": self.known, "unseen": self.unseen, "columns": self.columns, "table": None, "size": self.size, "shards": None, "symbols": {}}

    def ready(self) -> Shards:
        if self.shards is None:
            self.shards = Shards(*self.columns)
        return self.shards

    def of(self, language: str, text: str) -> np.ndarray:
        if language not in self.symbols:
            self.symbols[language] = Symbols(self.known[language])
        return self.symbols[language].of(text)

    def perplexities(self, languages: list[str], all_texts: list[str]) -> list[float | None]:
        out: list[float | None] = [None] * len(all_texts)
        self.ready()
        for language in {x for x in languages if x in self.unseen}:
            rows = [i for i, x in enumerate(languages) if x == language]
            for a in range(0, len(rows), 100):
                part = rows[a : a + 100]
                symbols = [self.of(language, all_texts[i]) for i in part]
                k = _keys(language, symbols)
                p = self.shards.join(k["k3"])[0]
                miss = np.flatnonzero(np.isnan(p))
                low, g1 = self._lower(k, miss, self.unseen[language])
                p[miss] = self.shards.join(k["c2"][miss])[1] * low
                at = np.repeat(np.arange(len(part)), [len(s) for s in symbols])
                sums = np.bincount(at, np.log(p), len(part))
                for i, s, total in zip(part, symbols, sums.tolist(), strict=True):
                    out[i] = math.exp(-total / len(s))
        return out

    def _lower(self, k: dict[str, np.ndarray], at: np.ndarray, unseen: float):
        p = self.shards.join(k["k2"][at])[0]
        miss = np.flatnonzero(np.isnan(p))
        one = self.shards.join(k["k1"][at[miss]])[0]
        g1 = self.shards.join(k["c1"][at[miss]])[1]
        p[miss] = g1 * np.where(np.isnan(one), unseen, one)
        return p, g1


_GRAMS = pa.schema([("lang", pa.string()), *((c, pa.int64()) for c in ("k3", "k2", "k1", "c2", "c1"))])


def trusted_ids(labels: DataFrame, held_out: bool) -> DataFrame:
    """doc_id of the documents whose labels all say good and not toxic: one half to train on, one held out for thresholds."""
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == int(held_out)
    return judged.where("q = 1 and t = 0").where(half).select("doc_id")


def _collected(table: DataFrame, size: int) -> list[np.ndarray]:
    """The columns of a table within bounds, a part at a time, so that the driver holds them once. p is nan where null."""
    columns = [np.empty(size, np.uint64), np.empty(size, np.float32), np.empty(size, np.float32)]
    at = 0
    for k in range(PARTS):
        own = table.where(F.col("part") == k).select("key", "p", "g").toArrow()
        to = at + own.num_rows
        columns[0][at:to] = own["key"].to_numpy().view(np.uint64)
        columns[1][at:to], columns[2][at:to] = own["p"].to_numpy(), own["g"].to_numpy()
        at = to
    return columns


@prepared
def train(docs: DataFrame, labels: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """docs: doc_id, text, lang."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"))
    by_hash = Window.partitionBy("lang").orderBy("h", "doc_id")
    trusted = written(spark, docs.select("doc_id", "lang").join(trusted_ids(labels, False), "doc_id").distinct().withColumn("h", F.xxhash64("doc_id", F.lit("order"))), "ids")
    # The hashes' range is cut so that about twice the wanted number of a language is ranked, whatever its size.
    sizes = trusted.groupBy("lang").agg(F.count("*").alias("n"))
    cut = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(2.0 * per_language + 100) / F.col("n"))
    near = trusted.join(sizes, "lang").where(F.col("h") <= cut)
    ids = near.withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= per_language).select("doc_id").distinct()
    sample = written(spark, docs.join(F.broadcast(ids), "doc_id"), "trusted")  # at most per_language ids a language
    words = sample.select("lang", F.explode(F.split(F.trim(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", " ")), " ")).alias("w"))
    common = words.where("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).select("lang", "w").toArrow()  # of the bounded sample
    known: dict[str, set[int]] = {}
    for language, w in zip(common["lang"].to_pylist(), common["w"].to_pylist(), strict=True):
        known.setdefault(language, set()).add(_hash("w" + w))
    languages = [r.lang for r in sample.select("lang").distinct().collect()]
    model = Model({x: frozenset(known.get(x, ())) for x in languages}, {})
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            all_texts, langs = texts(batch), batch.column("lang").to_pylist()
            for language in set(langs):
                k = _keys(language, [shared.value.of(language, t) for t, x in zip(all_texts, langs, strict=True) if x == language])
                yield record(_GRAMS, lang=[language] * len(k["k3"]), **{n: v.view(np.int64) for n, v in k.items()})

    grams = sample.mapInArrow(run, "lang string, k3 long, k2 long, k1 long, c2 long, c1 long").groupBy("lang", "k3", "k2", "k1", "c2", "c1").agg(F.count("*").alias("n"))
    rows, unseen = kneser_ney(written(spark, grams, "grams"))
    model.table = written(spark, rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")), "model", "part")
    model.unseen = {r.lang: r.unseen for r in unseen.collect()}  # one row for each language
    model.size = model.table.count()
    if model.size * ROW_BYTES <= BROADCAST_BYTES:
        model.columns = _collected(model.table, model.size)
    return model


_NGRAMS = pa.schema([("rid", pa.int64()), *((c, pa.int64()) for c in ("k3", "k2", "k1", "c2", "c1")), ("unseen", pa.float64())])


def perplexity_by_join(docs: DataFrame, model: Model) -> DataFrame:
    """rid, perplexity by joining each n-gram with the model's table by a shuffle: for tables too large to broadcast."""
    spark = docs.sparkSession
    rows, small = model.table, Model(model.known, model.unseen)
    shared = spark.sparkContext.broadcast(small)

    def run(batches):
        for batch in batches:
            for rid, language, text in zip(batch.column("rid").to_pylist(), batch.column("lang").to_pylist(), texts(batch), strict=True):
                if language in shared.value.unseen:
                    k = _keys(language, [shared.value.of(language, text)])
                    n = len(k["k3"])
                    yield record(_NGRAMS, rid=[rid] * n, unseen=[shared.value.unseen[language]] * n, **{c: v.view(np.int64) for c, v in k.items()})

    grams = docs.select("rid", F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text").mapInArrow(run, "rid long, k3 long, k2 long, k1 long, c2 long, c1 long, unseen double")
    for c, value in (("k3", "p"), ("k2", "p"), ("k1", "p"), ("c2", "g"), ("c1", "g")):
        grams = grams.join(rows.select(F.col("key").alias(c), F.col(value).cast("double").alias("v" + c)), c, "left")
    low = F.coalesce("vk2", F.coalesce("vc1", F.lit(1.0)) * F.coalesce("vk1", "unseen"))
    return grams.withColumn("p", F.coalesce("vk3", F.coalesce("vc2", F.lit(1.0)) * low)).groupBy("rid").agg(F.exp(-F.avg(F.log("p"))).alias("perplexity"))


def _with_perplexity(docs: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """The named columns and _ppl, null without a model. docs has _lang and _text."""
    spark = docs.sparkSession
    if model.columns is None:
        numbered = written(spark, docs.withColumn("rid", F.monotonically_increasing_id()), "numbered")
        found = perplexity_by_join(numbered.select("rid", F.col("_text").alias("text"), F.col("_lang").alias("lang")), model)
        return numbered.join(found.withColumnRenamed("perplexity", "_ppl"), "rid", "left").select(*names, "_ppl")
    shared = spark.sparkContext.broadcast(model)  # at most BROADCAST_BYTES

    def run(batches):
        for batch in batches:
            ppl = shared.value.perplexities(batch.column("_lang").to_pylist(), texts(batch, "_text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(ppl, pa.float64())], names=[*names, "_ppl"])

    kept = docs.select(*names)
    return docs.mapInArrow(run, kept.withColumn("_ppl", F.lit(None).cast("double")).schema)


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_lang": F.coalesce("lang", F.lit(NO_LANGUAGE)), "_text": F.coalesce("text", F.lit(""))})


@prepared
def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE):
    """doc_id, lang, perplexity of every row (written), the model, and the threshold of each language."""
    model = train(docs, labels)
    scores = written(docs.sparkSession, _with_perplexity(_prepared(docs.select("doc_id", "lang", "text")), model, ["doc_id", "_lang"]), "perplexity")
    ranked = scores.join(trusted_ids(labels, True), "doc_id").where("_ppl is not null").groupBy("_lang").agg(F.percentile_approx("_ppl", F.lit(quantile), F.lit(10000)).alias("q"))
    return scores, model, {r["_lang"]: r["q"] for r in ranked.collect()}  # one row for each language


@prepared
def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    _, model, limits = judged(docs, labels)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    ready = plain.withColumns({"_lang": F.coalesce(names[docs.columns.index("lang")], F.lit(NO_LANGUAGE)), "_text": F.coalesce(names[docs.columns.index("text")], F.lit(""))})
    limit = F.lit(None).cast("double")
    for language, value in limits.items():
        limit = F.when(F.col("_lang") == language, value).otherwise(limit)
    return _with_perplexity(ready, model, [*names, "_lang"]).where(F.coalesce(F.col("_ppl") <= limit, F.lit(True))).select(*names).toDF(*docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, perplexity, its language's threshold and whether the document is kept."""
    scores, _, limits = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    limit = F.lit(None).cast("double")
    for language, value in limits.items():
        limit = F.when(F.col("_lang") == language, value).otherwise(limit)
    ppl = F.col("_ppl")
    return scores.select("doc_id", F.col("_lang").alias("lang"), ppl.alias("perplexity"), limit.alias("threshold"), F.coalesce(ppl <= limit, F.lit(True)).alias("kept"))
