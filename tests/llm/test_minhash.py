import math
import random
from collections import Counter

import numpy as np
import pytest

from prefixory.llm import minhash
from prefixory.llm.common import table
from prefixory.llm.shingles import shingles


def brute(rows):
    """Classes by all pairs: {index: least doc_id}."""
    sets = [frozenset(shingles(t or "").tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            same = (rows[a][1] or "") == (rows[b][1] or "")
            x, y = sets[a], sets[b]
            if same or x and y and len(x & y) >= 0.8 * len(x | y):
                parent[find(a)] = find(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted((str(rows[i][0]), str(least[find(i)])) for i in range(len(rows)))


def words(r, n):
    return ["".join(r.choices("abcdefgh", k=5)) for _ in range(n)]


def corpus():
    r = random.Random(5)
    rows, i = [], 10
    for _ in range(6):
        base = words(r, 200)
        for _ in range(r.randint(2, 9)):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 12])):
                own[r.randrange(200)] = "changed" + str(i)
            rows.append((i, " ".join(own)))
            i += 1
    # A chain: each like the next, the ends unlike.
    base = words(r, 200)
    for k in range(6):
        for j in range(3):
            base[k * 30 + j * 9] = f"link{k}{j}"
        rows.append((i, " ".join(base)))
        i += 1
    rows += [(i + k, "few words") for k in range(3)] + [(i + 9, "Few, words!"), (i + 10, "...")]
    return rows


def test_brute_force(make):
    from .conftest import HARD

    rows = [*corpus(), *HARD]
    got = sorted((str(r.doc_id), str(r.class_id)) for r in minhash.near_classes(make(rows, extra=True)).collect())
    assert got == brute(rows)


def test_repeated_paragraphs(make):
    """Copies that repeat paragraphs, or lines here and there, have nearly the same set of shingles."""
    r = random.Random(8)
    rows = []
    for k, times in enumerate((2, 3, 4, 8, 8, 16, 16, 32)):
        parts = [" ".join(words(r, 80)) for _ in range(3)]
        rows += [(10 * k, "\n".join(parts)), (10 * k + 1, "\n".join(parts * times))]
        rows += [(10 * k + 2, "\n".join([parts[0]] * times + parts[1:])), (10 * k + 3, "\n".join(p for p in parts for _ in range(times)))]
    got = sorted((str(r.doc_id), str(r.class_id)) for r in minhash.near_classes(make(rows)).collect())
    assert got == brute(rows)
    assert len({c for _, c in got}) == 8
    assert minhash.keep_one(make(rows)).count() == 8


def likeness(a, b):
    """The larger of two texts' Jaccard similarities, of their shingles with counts and as sets, by the definition."""
    x, y = (Counter((shingles(t) & ~np.uint64(1)).tolist()) for t in (a, b))
    counts, sets = (x & y).total() / max((x | y).total(), 1), len(x.keys() & y.keys()) / max(len(x.keys() | y.keys()), 1)
    return max(counts, sets)


def refrains(r):
    """Texts that repeat a refrain, with endings of their own: alike by counts alone where it is repeated often."""
    rows = []
    for k in range(4):
        refrain = " ".join(words(r, 30))
        for j, times in enumerate((1, 2, 12, 14, 40, 44)):
            rows.append((100 * k + j, "\n".join([refrain] * times + [" ".join(words(r, 60))])))
    return rows


@pytest.mark.parametrize("cell", [512, 5])
def test_counts_bear_on_links(make, monkeypatch, cell):
    """Classes of all pairs whose likeness is at least 0.8, where only counts, or only sets, tell that they are alike."""
    monkeypatch.setattr(minhash, "CELL_ROWS", cell)
    r = random.Random(11)
    rows = refrains(r)
    parts = [" ".join(words(r, 80)) for _ in range(3)]
    rows += [(1000 + n, "\n".join(parts * n)) for n in (1, 2, 5, 9)]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_counts = 0
    for i, a in rows:
        for j, b in rows:
            if j < i and likeness(a, b) >= 0.8:
                by_counts += len(set(shingles(a)) & set(shingles(b))) < 0.8 * len(set(shingles(a)) | set(shingles(b)))
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert by_counts >= 4
    got = {r.doc_id: r.class_id for r in minhash.near_classes(make(rows)).collect()}
    assert got == {i: find(i) for i, _ in rows}


def test_marks_tell_both_similarities():
    r = random.Random(3)
    for _ in range(300):
        a, b = (" ".join(r.choices("abc", k=r.randint(1, 40))) for _ in range(2))
        x, y = (minhash.marks_of(shingles(t)) for t in (a, b))
        assert len(x) == len(shingles(a)) and (np.diff(x.astype(object)) > 0).all()
        for t in (0.1, 0.3, 0.5, 0.8):
            assert minhash.alike(x, y, t) == (likeness(a, b) >= t)


def test_no_link_of_a_table_is_lost(spark):
    """Recall against all pairs at sf0.1: an exact prefix-filtered join in plain Python, by counts and by sets."""
    rows = {r.doc_id: r.text or "" for r in table(spark, "/root/testdata/sf0.1", "documents").collect()}
    marks = {i: minhash.marks_of(shingles(t)) for i, t in rows.items()}
    distinct = {m.tobytes(): i for i, m in marks.items() if len(m)}
    pairs = set()
    for kind in (0, 1):
        sets = {i: (m if kind else m[m & minhash.ODD == 0]) for i, m in ((i, marks[i]) for i in distinct.values())}
        every, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        posting = {}
        for i in sorted(sets, key=lambda i: len(sets[i])):
            own = sets[i]
            order = own[np.lexsort((own, n[np.searchsorted(every, own)]))]
            prefix = order[: len(own) - math.ceil(0.8 * len(own)) + 1].tolist()
            pairs |= {(j, i) for e in prefix for j in posting.get(e, ()) if len(sets[j]) >= 0.8 * len(own)}
            for e in prefix:
                posting.setdefault(e, []).append(i)
    true = [(a, b) for a, b in pairs if minhash.alike(marks[a], marks[b], 0.8)]
    assert len(true) > 30
    got = {r.doc_id: r.class_id for r in minhash.op10_near_duplicates(spark, "/root/testdata/sf0.1").collect()}
    assert sum(got[a] == got[b] for a, b in true) >= 0.9 * len(true)


def test_keep_one(make):
    from .conftest import HARD

    rows = [*corpus(), *HARD, (None, "no id at all"), (None, "another without id")]
    df = make(rows, extra=True)
    out = minhash.keep_one(df)
    assert out.columns == df.columns
    kept = sorted(str(r.doc_id) for r in out.collect())
    classes = {(c, r) for r, c in brute(rows)}
    by_class = {c for c, _ in classes if c != "None"}
    assert kept == sorted([*by_class, "None", "None"])


def test_empty(make):
    assert minhash.near_classes(make([])).count() == 0
    assert minhash.keep_one(make([])).count() == 0


@pytest.mark.parametrize("cell", [1024, 7])
def test_every_pair_of_a_bucket_is_tested(spark, make, monkeypatch, cell):
    """One bucket for all: links between members that the head is not like are found too, in one cell or many."""
    monkeypatch.setattr(minhash, "CELL_ROWS", cell)
    monkeypatch.setattr(minhash, "band_keys", lambda marks: np.zeros((len(marks), 1), np.int64))
    rows = [x for x in corpus() if x[1]]
    got = sorted((str(r.doc_id), str(r.class_id)) for r in minhash.near_classes(make(rows)).collect())
    assert got == brute(rows)


def test_collision_rate_is_the_weighted_similarity():
    rng = np.random.default_rng(2)
    e = rng.integers(1, 2**62, 60).astype(np.uint64)
    x, y = rng.uniform(0.2, 9, 50), rng.uniform(0.2, 9, 50)
    wa, wb = dict(zip(e[:50].tolist(), x, strict=True)), dict(zip(e[10:].tolist(), y, strict=True))
    keys = wa.keys() | wb.keys()
    exact = sum(min(wa.get(k, 0), wb.get(k, 0)) for k in keys) / sum(max(wa.get(k, 0), wb.get(k, 0)) for k in keys)
    a, b = minhash.signatures([(e[:50], x), (e[10:], y)], 4096)
    assert abs((a == b).mean() - exact) < 0.03


def test_signature_does_not_depend_on_the_batch():
    r = random.Random(1)
    sets = [minhash.weighted(shingles(" ".join(words(r, n)))) for n in (1, 5, 6, 30, 700)]
    together = minhash.signatures(sets)
    for s, row in zip(sets, together, strict=True):
        assert (minhash.signatures([s])[0] == row).all()


def test_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted((str(r.doc_id), str(r.class_id)) for r in minhash.op10_near_duplicates(spark, "/root/testdata/sf0.001").collect())
    assert got == brute(rows)
