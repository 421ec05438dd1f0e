import math

import numpy as np
import pytest

from prefixory.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, top=10):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, x in rows:
        if q % every == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in rows if i != q)
            out[q] = near[:top]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_the_table(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = [(r.vec_id, r.embedding) for r in nb.usable(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()]
        exact, found = brute(rows), got(nb.op4_neighbours(spark, sf))
        assert exact.keys() == found.keys()
        hits = sum(len({i for _, i in exact[q]} & {i for _, i in found[q]}) for q in exact)
        assert hits >= 0.9 * sum(map(len, exact.values()))
        for q, near in found.items():
            own = {i: d for d, i in brute([r for r in rows if r[0] == q or r[0] in {i for _, i in near}])[q]}
            assert all(d == pytest.approx(own[i], abs=1e-12) for d, i in near)


def test_hard_rows(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=6).astype(np.float32).tolist()) for i in range(0, 360, 3)]
    bad = [(1000, None), (1100, [0.0] * 6), (1200, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1300, [float("nan")] * 6), (1400, [float("inf")] + [1.0] * 5), (1500, []), (None, [1.0] * 6)]
    same = [(i, rows[0][1]) for i in range(400, 430)]  # ties go to the smaller vec_id
    df = spark.createDataFrame([(i, v, 1) for i, v in [*rows, *bad, *same]], SCHEMA).withColumnRenamed("label", "rank")
    exact, found = brute([*rows, *same]), got(nb.search(df))
    assert exact.keys() == found.keys()
    for q in exact:
        assert [i for _, i in found[q]] == [i for _, i in exact[q]]
        assert [d for d, _ in found[q]] == pytest.approx([d for d, _ in exact[q]])


@pytest.mark.parametrize("chunk", [1, 16 << 20])
def test_vectors_of_all_sizes(spark, monkeypatch, chunk):
    """Very long and very short vectors among others take part, and spoil nothing; queries in one chunk or many."""
    monkeypatch.setattr(nb, "CHUNK_BYTES", chunk * 8 * 8 * 2 if chunk == 1 else chunk)
    monkeypatch.setattr(nb, "CODE_BLOCK", 64)
    r = np.random.default_rng(7)
    rows = [(i, r.normal(size=8).astype(np.float32)) for i in range(300)]
    rows += [(400 + i, (r.normal(size=8) * 1e20).astype(np.float32)) for i in range(3)]
    rows += [(500 + i, (r.normal(size=8) * 1e-25).astype(np.float32)) for i in range(3)]
    rows += [(600, np.full(8, 3e38, np.float32)), (700, np.full(8, 1e-44, np.float32))]
    exact, found = brute(rows), got(nb.search(spark.createDataFrame([(i, v.tolist(), 1) for i, v in rows], SCHEMA)))
    assert exact.keys() == found.keys()
    for q in exact:
        assert len(found[q]) == 10
        assert len({i for _, i in found[q]} & {i for _, i in exact[q]}) >= 9
        assert [d for d, _ in found[q]] == pytest.approx([d for d, _ in exact[q]], rel=0.2)


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [2.0, 2.0], 1), (1, [1.0, 2.5], 1)], SCHEMA)
    assert got(nb.search(df)) == {0: [(0.5, 1), (1.0, 1)]}
    assert nb.search(df.where("vec_id = 0")).count() == 0
    assert nb.search(df.where("false")).count() == 0


def test_beam_search_is_no_worse_than_greedy():
    x = np.random.default_rng(5).normal(size=(500, 8)).astype(np.float32)
    books = nb.fit(x, 4, 16)

    def error(beam):
        codes, norms = nb.encode(x, books, beam)
        a = sum(books[k][codes[:, k]] for k in range(4))
        assert norms == pytest.approx((a**2).sum(1), rel=1e-3, abs=1e-4)
        return ((x - a) ** 2).sum()

    assert error(8) < error(1)


def test_vectors_near_the_limits_of_doubles(spark):
    """Components whose squares over- or underflow lose no row, and no query."""
    r = np.random.default_rng(9)
    make = lambda i, size: (i, (r.normal(size=4) * size).tolist(), 1)
    rows = [make(i, 1.0) for i in range(1, 40)] + [make(i, 1e200) for i in (100, 101, 102, 200)] + [make(i, 1e-250) for i in (300, 301, 400)] + [(500, [1.7e308] * 4, 1), (600, [-1.7e308] * 4, 1)]
    out = got(nb.search(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))))
    assert sorted(out) == [100, 200, 300, 400, 500, 600] and all(len(x) == 10 for x in out.values())
    for q, x, _ in rows:
        if q in out:
            exact = sorted((math.dist(x, y), i) for i, y, _ in rows if i != q)[:10]
            assert [i for _, i in out[q]] == [i for _, i in exact]
            assert [d for d, _ in out[q]] == pytest.approx([d for d, _ in exact], rel=1e-12)


def test_each_dimension_is_searched_by_itself(spark):
    r = np.random.default_rng(11)
    rows = [(i, r.normal(size=3 if i % 4 else 5).astype(np.float32).tolist()) for i in range(0, 500, 2)] + [(700, [1.0]), (1, [2.0]), (2, [1.5])]
    out = got(nb.search(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)))
    for d in (1, 3, 5):
        exact = brute([x for x in rows if len(x[1]) == d])
        for q, near in exact.items():
            assert [i for _, i in out[q]] == [i for _, i in near]
    assert [i for _, i in out[700]] == [2, 1]
