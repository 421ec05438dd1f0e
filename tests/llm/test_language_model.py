import math
import zlib
from collections import Counter

import numpy as np
import pytest

from prefixory.llm import language_model as lm


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def check(rows, docs):
    counts = Counter()
    for i, t in docs:
        if not held(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, t in docs:
        own = tokens(t)
        expected.append((str(i), held(i), len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 4)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == sorted(expected)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in rows)


def run(docs):
    from pyspark.sql import functions as F

    flagged = docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out"))
    model, counts = lm.train(flagged.where("not held_out"))
    return lm.score(flagged, model, counts), model


def test_hard_rows(make, hard, monkeypatch):
    from .conftest import HARD

    docs = [*HARD, *((i, f"tok{i} Common ÀB words w{i % 5}") for i in range(20, 60))]
    rows, _ = run(make(docs, extra=True))
    check(rows.collect(), docs)
    monkeypatch.setattr(lm, "DICTIONARY", 10)  # most tokens are joined
    rows, _ = run(make(docs))
    check(rows.collect(), docs)


def test_empty_and_all_held_out(make):
    assert run(make([]))[0].count() == 0
    one = next(i for i in range(50) if held(i))
    rows = run(make([(one, "a b")]))[0].collect()
    check(rows, [(one, "a b")])


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = lm.op2_language_model(spark, sf).collect()
    check(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > 0.975 * sum(r.base_score for r in out)


def test_gain_grows_with_the_table(spark):
    out = [r for r in lm.op2_language_model(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in out) > 0.92 * sum(r.base_score for r in out)


MASK = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_score(model, text):
    """The score by the definition: token by token, softmax by softmax, in Python numbers."""
    v, w = model.vocabulary, model.weights.astype(float)
    rank = {int(k): int(r) for k, r in zip(v.table.keys, v.table.rows, strict=True) if r >= 0}
    h = [int(x) for x in lm.tokens(text)] + [lm.END]
    gold, bits = int(lm.GOLD), v.rows.bit_length() - 1
    word = [x if rank.get(x, v.head) < v.head else x % 16 + 1 for x in h]
    total = 0.0
    for i, x in enumerate(h):
        one, two = (word[i - k] if i >= k else 0 for k in (1, 2))
        anchors = [rank[y] + 1 for y in h[:i] if rank.get(y, lm.ANCHORS) < lm.ANCHORS]
        first = plain_mix(one + 1)
        histories = [first, plain_mix((first * gold + two) & MASK), plain_mix(two + 2), plain_mix((anchors[-1] if anchors else 0) + 3)]
        leaf = min(rank.get(x, v.head), v.head)
        steps = [(int(n), int(s)) for n, s in zip(v.node[:, leaf], v.slot[:, leaf], strict=True) if n >= 0]
        if leaf == v.head:
            steps.append((v.tail_node, x % 16))
            count = int(v.counts[rank[x]]) if x in rank else 0
            total += math.log10((count + 1) / (v.tail[x % 16].sum() + 1))
        for node, slot in steps:
            z = w[node].copy()
            for f in histories:
                z += w[len(v.masses) + ((f ^ (node * gold & MASK)) * 0xBF58476D1CE4E5B9 & MASK) // 2 ** (64 - bits)]
            total += math.log10(math.exp(z[slot]) / sum(math.exp(y) for y in z))
    return total


@pytest.mark.parametrize("head", [5, 1024])
def test_score_equals_the_definition(make, head, monkeypatch):
    monkeypatch.setattr(lm, "MOST_HEAD", head)
    docs = [(i, " ".join(f"w{(i * k * k) % 23} the Cat{k % 3}" for k in range(1, 40)) + f" only{i}") for i in range(40)]
    rows, model = run(make(docs))
    assert len(model.vocabulary.node) > (head > 20)
    assert model.vocabulary.head == min(head, model.vocabulary.types)
    assert abs(model.weights[len(model.vocabulary.masses) :]).sum() > 0  # something was learnt
    for r in rows.collect():
        assert r.score == pytest.approx(plain_score(model, dict(docs)[r.doc_id]), rel=1e-4)


def test_training_learns_what_follows(make):
    """Every word is told by the one before: a bigram model is nearly certain, the counts aren't."""
    docs = [(i, " ".join(f"w{(i + k * 7) % 50}" for k in range(200))) for i in range(300)]
    rows = [r for r in run(make(docs))[0].collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.35 * sum(r.base_score for r in rows)


def test_words_of_all_lengths_and_cuts(monkeypatch):
    """Cut anywhere, grouped anyhow, a text has the same words; different words differ."""
    r = np.random.default_rng(4)
    all_texts = [" ".join("".join(r.choice(list("abé")) for _ in range(r.integers(1, 9))) for _ in range(r.integers(0, 60))) + r.choice(["", " ", "\n", "\t x"]) for _ in range(50)]
    h, sizes = lm._batch_tokens(all_texts)
    words = [w for t in all_texts for w in tokens(t)]
    assert sizes.tolist() == [len(tokens(t)) for t in all_texts]
    assert len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))
    monkeypatch.setattr(lm, "PART", 64)
    again, sizes = lm._batch_tokens(all_texts)
    assert (again == h).all() and sizes.tolist() == [len(tokens(t)) for t in all_texts]
    monkeypatch.setattr(lm, "PART", 1 << 18)
    long = "x" * 600_000  # longer than a part, yet one word
    assert len(lm.tokens(long)) == 1 and len(lm.tokens(f"a {long} b {long}\tb")) == 5
    assert lm.tokens(f"a {long}")[1] == lm.tokens(f"{long}\n")[0] != lm.tokens(long + "x")[0]


def test_probabilities_sum_to_one(make):
    """Over the head, the other known tokens and one unseen, after some histories."""
    docs = make([(i, f"the cat sat on w{i % 7} mat and the dog") for i in range(40)])
    _, model = run(docs)
    v = model.vocabulary
    every = [h for h in v.table.keys[v.table.rows >= 0]]
    unseen = [np.uint64(16 * 987654321 + kind) for kind in range(16)]  # one for each kind
    for history in ([], ["the"], ["the", "cat"], ["zzz", "yyy"]):
        before = lm.tokens(" ".join(history))
        total = 0.0
        for h in [*every, *unseen]:
            seq = np.concatenate([before, [h]]).astype(np.uint64)
            whole = model.score(seq, np.array([len(seq)]))[2][0]
            rest = model.score(before, np.array([len(before)]))[2][0] if len(before) else 0.0
            total += 10 ** (whole - rest)
        assert total == pytest.approx(1.0, abs=1e-3)
