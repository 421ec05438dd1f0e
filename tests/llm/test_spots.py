import hashlib
import random

import pytest

from prefixory.llm import minhash, spots


def jaccard(a, b):
    x, y = set(spots.decoded(a).tolist()), set(spots.decoded(b).tolist())
    return len(x & y) / len(x | y)


def test_signatures_follow_anchors():
    a = spots.spots("the cat sat on a mat")  # the: cat sat; on: needs two content words
    assert len(a) == 1
    assert (a == spots.spots("The, cat; SAT!")).all()
    assert len(spots.spots("the cat sat and the dog ran")) == 3
    assert (spots.spots("no spot here x") == spots.spots("no spot here x")).all()
    assert spots.likeness(spots.spots(""), spots.spots("zzz")) == 0.0


@pytest.mark.parametrize("per_part", [2, 10_000])
def test_brute_force(make, per_part, monkeypatch):
    from .conftest import HARD

    monkeypatch.setattr(spots.with_next, "__defaults__", (per_part,))
    r = random.Random(4)
    rows = [*HARD, *((i, " ".join(r.choices("the of and alpha beta gamma delta la de und".split(), k=r.randint(0, 60)))) for i in range(10, 40))]
    order = sorted(((i is not None, i or 0, t or ""), i) for i, t in rows)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in spots.compared(make(rows, extra=True)).collect())
    expected = []
    for k, ((_, _, text), i) in enumerate(order):
        other = order[(k + 1) % len(order)][0][2]
        n = len(text) // 2
        edited = text[: len(text) - n] + other[:n]
        own = spots.encoded(spots.spots(text))
        expected.append(((i is not None, i or 0), len(text), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(own, spots.encoded(spots.spots(edited))), 9), round(jaccard(own, spots.encoded(spots.spots(other))), 9)))
    assert got == sorted(expected)


def test_one_and_no_row(make):
    assert spots.compared(make([])).count() == 0
    r = spots.compared(make([(1, "the big cat sat")])).first()
    assert r.near_next == 1.0


def test_equal_texts_have_equal_fingerprints(spark):
    rows = spots.op9_spots(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    seen = {}
    for r in rows:
        assert seen.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(rows) == len(texts)


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_classes_are_those_of_all_pairs(make, least):
    r = random.Random(8)
    docs = []
    for i in range(12):
        base = r.choices("the of and alpha beta gamma delta epsilon zeta eta theta la de und".split(), k=60)
        for j in range(3):
            own = list(base)
            for _ in range(j * 2):
                own[r.randrange(60)] = f"x{i}{j}"
            docs.append((i * 3 + j, " ".join(own)))
    docs.append((99, docs[0][1]))
    assert _check_classes(make, docs, least) >= 5


def test_classes_of_a_large_group_and_a_chain(make, monkeypatch):
    """A group of near copies that share their signatures, and a chain whose ends are unlike, found in cells of few rows."""
    monkeypatch.setattr(minhash, "CELL_ROWS", 16)
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**6)}"
    base = [x for _ in range(60) for x in ("the", word(), word())]
    docs = []
    for i in range(80):  # each differs in one place of its own
        own = list(base)
        own[3 * (i % 60) + 1] = f"own{i}"
        docs.append((i, " ".join(own)))
    chain = [x for _ in range(60) for x in ("of", word(), word())]
    for i in range(25):
        docs.append((200 + i, " ".join(chain)))
        for k in (3 * i + 1, 3 * i + 91):
            chain[k] = f"turn{i}k{k}"
    assert _check_classes(make, docs, 0.8) > 500


def test_classes_of_hard_rows(make):
    from .conftest import HARD

    assert spots.near_classes(make([], extra=True)).count() == 0
    _check_classes(make, HARD, 0.8, extra=True)


def _check_classes(make, docs, least, extra=False):
    """Compares with the components of all pairs; gives the number of linked pairs."""
    sets = [set(spots.spots(t or "").tolist()) for _, t in docs]
    label = list(range(len(docs)))
    links = 0
    for a in range(len(docs)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                links += 1
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    lowest = {x: min((docs[i][0] for i, y in enumerate(label) if y == x and docs[i][0] is not None), default=None) for x in label}
    expected = sorted((str(i), str(lowest[x])) for (i, _), x in zip(docs, label, strict=True))
    got = sorted((str(x.doc_id), str(x.class_id)) for x in spots.near_classes(make(docs, extra=extra), least).collect())
    assert got == expected
    return links


def test_runs_are_bounded(make, monkeypatch):
    monkeypatch.setattr(spots.with_next, "__defaults__", (2,))
    monkeypatch.setattr(spots, "MOST_RUNS", 3)
    docs = [(i, f"the big cat number {i}") for i in range(40)]
    assert spots.with_next(make(docs)).select("part").distinct().count() <= 3
    assert [(r.doc_id, r.n_chars) for r in spots.compared(make(docs)).orderBy("doc_id").collect()] == [(i, len(t)) for i, t in docs]
