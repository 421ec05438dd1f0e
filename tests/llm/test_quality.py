import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixory.llm import quality
from prefixory.llm.common import table, written
from prefixory.llm.hashtable import HashTable

WORDS = "the cat sat on mat dog ran far away home".split()


def good(r, n=40):
    return " ".join(r.choices(WORDS, k=n)) + "."


def corpus(make, spark, n=120):
    r = random.Random(2)
    docs = [(i, good(r)) for i in range(n)] + [(n + i, " ".join(w + "%%%" for w in r.choices(WORDS, k=40))) for i in range(20)]
    labels = [(i, int(i < n), 0) for i in range(n + 20) if i % 2 or i < 60] + [(0, 0, 0), (3, 1, 1), (None, 1, 0)]
    return make(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_probabilities_sum_to_one(make, spark):
    """Over all symbols and one never seen, in seen and unseen contexts."""
    docs, labels = corpus(make, spark)
    model = quality.train(docs, labels)
    model.ready()
    seen = sorted(set(model.known["en"]) | {quality._hash("s" + quality.shape(w)) for w in ("mat.", "home.", "dog.")})
    for context in ([], [quality._hash("wthe")], [quality._hash("wthe"), quality._hash("wcat")], [99999, 99997]):
        total = 0.0
        for symbol in [*seen, int(quality.END), 123456]:
            k = quality._keys("en", [np.array([*context, symbol], np.uint64)])
            k = {n: v[-1:] for n, v in k.items()}
            p = model.shards.join(k["k3"])[0]
            if np.isnan(p[0]):
                p = model.shards.join(k["c2"])[1] * model._lower(k, np.array([0]), model.unseen["en"])[0]
            total += float(p[0])
        assert total == pytest.approx(1.0, abs=0.02)


def test_join_equals_broadcast(make, spark):
    docs, labels = corpus(make, spark)
    model = quality.train(docs, labels)
    numbered = written(spark, docs.withColumn("rid", F.col("doc_id")), "numbered")
    joined = {r.rid: r.perplexity for r in quality.perplexity_by_join(numbered, model).collect()}
    scores = quality._with_perplexity(quality._prepared(docs.select("doc_id", "lang", "text")), model, ["doc_id"])
    assert joined == pytest.approx({r.doc_id: r["_ppl"] for r in scores.collect()}, rel=1e-4)


def test_both_ways_have_one_precision(make, spark):
    """What a table is read through bears on no decision: perplexities differ by the order of their sums alone."""
    docs, labels = corpus(make, spark)
    model = quality.train(docs, labels)
    numbered = written(spark, docs.withColumn("rid", F.col("doc_id")), "numbered")
    joined = {r.rid: r.perplexity for r in quality.perplexity_by_join(numbered, model).collect()}
    scores = quality._with_perplexity(quality._prepared(docs.select("doc_id", "lang", "text")), model, ["doc_id"])
    assert joined == pytest.approx({r.doc_id: r["_ppl"] for r in scores.collect()}, rel=1e-12)


def test_shapes_are_of_whole_words():
    assert quality.shape("Haus7%%") == "Aa0%"
    assert quality.shape("a" * 100 + "7") == "a0"
    assert quality.shape("a1" * 10) == "a0" * 10


def plain_perplexities(sample, judged):
    """Interpolated modified Kneser-Ney by the definition, on symbols as strings, in dictionaries."""
    words = Counter(w for t in sample for w in t.split())
    symbols = lambda t: ["<s>", "<s>", *(w if words[w] >= quality.LEAST else "*" + quality.shape(w) for w in t.split()), "</s>"]
    three = Counter(tuple(x[i - 2 : i + 1]) for x in map(symbols, sample) for i in range(2, len(x)))
    two = Counter(g[1:] for g in three)
    one = Counter(g[1:] for g in two)

    def level(grams):
        of = [sum(n == i for n in grams.values()) for i in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.5
        d = [min(max(i + 1 - (i + 2) * y * of[i + 1] / of[i], 0.05), i + 0.95) if of[i] else 0.5 * (i + 1) for i in range(3)]
        total, cut = Counter(), Counter()
        for g, n in grams.items():
            total[g[:-1]] += n
            cut[g[:-1]] += d[min(n, 3) - 1]
        share = {g: (n - d[min(n, 3) - 1]) / total[g[:-1]] for g, n in grams.items()}
        return lambda g: share.get(g, 0.0), lambda c: cut[c] / total[c] if total[c] else 1.0

    levels = [level(g) for g in (one, two, three)]

    def p(g):
        if not g:
            return 1 / (len(one) + 1)
        share, rest = levels[len(g) - 1]
        return share(g) + rest(g[:-1]) * p(g[1:])

    out = []
    for t in judged:
        x = symbols(t)
        logs = [math.log(p(tuple(x[i - 2 : i + 1]))) for i in range(2, len(x))]
        out.append(math.exp(-sum(logs) / len(logs)))
    return out


@pytest.mark.parametrize("n", [2, 120])
def test_perplexity_equals_the_definition(make, spark, n):
    docs, labels = corpus(make, spark, n)
    model = quality.train(docs, labels)
    trusted = {r.doc_id for r in quality.trusted_ids(labels, False).collect()}
    rows = docs.collect()
    sample = [r.text for r in rows if r.doc_id in trusted]
    if not sample:
        labels = labels.where("doc_id = 1").withColumn("quality", F.lit(1))
        sample = [r.text for r in rows if r.doc_id in {x.doc_id for x in quality.trusted_ids(labels, False).collect()}]
        model = quality.train(docs, labels)
    judged = [r.text for r in rows] + ["the the cat zebra99 %% dog.", ""]
    if sample:
        assert model.perplexities(["en"] * len(judged), judged) == pytest.approx(plain_perplexities(sample, judged), rel=1e-4)


def test_keeps_good_and_rejects_junk(make, spark):
    docs, labels = corpus(make, spark)
    kept = {r.doc_id for r in quality.filtered(docs, labels).collect()}
    assert len([i for i in kept if i < 120]) >= 116
    assert not [i for i in kept if i >= 120]


def test_hard_rows(make, spark, hard):
    _, labels = corpus(make, spark)
    out = quality.filtered(hard, labels)
    assert out.columns == hard.columns
    everything = quality.filtered(hard.withColumn("lang", F.lit(None).cast("string")), labels.where("false"))
    assert everything.count() == hard.count()
    assert quality.filtered(make([]), labels).count() == 0
    scores, model, limits = quality.judged(hard, labels.where("false"))
    assert limits == {} and scores.count() == hard.count()
    assert model.perplexities(["en"], ["x"]) == [None]


def test_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.op3_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert np.mean(clean) > 0.98
    assert np.mean(junk) < 0.2
    assert all(math.isfinite(r.perplexity) for r in rows)


def test_hash_table():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    keys = np.unique(np.concatenate([keys, np.arange(100, dtype=np.uint64)]))
    t = HashTable(keys)
    assert (t.find(keys) == np.arange(len(keys))).all()
    assert (t.find(keys[:50] + np.uint64(1 << 63)) == -1).all()
    assert (HashTable(keys[:0]).find(keys[:3]) == -1).all()
