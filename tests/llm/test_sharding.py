from collections import Counter

import numpy as np
import pytest

from prefixory.llm import sharding


def test_matrix_margins():
    counts = [5, 0, 7, 100]
    sums = np.cumsum([0, *counts])
    m = np.stack([sharding.matrix_row(sums, p, 16, 3) for p in range(4)])
    assert m.sum(1).tolist() == [5, 0, 7, 100]
    assert m.sum(0).max() - m.sum(0).min() <= 1


def test_rows_have_the_hypergeometric_law():
    """Of 3 partitions, each cell has the mean and the variance of its marginal."""
    sums = np.cumsum([0, 20, 30, 50])
    got = np.array([[sharding.matrix_row(sums, p, 4, seed) for p in range(3)] for seed in range(3000)])
    for p, n in enumerate((20, 30, 50)):
        assert got[:, p].mean(0) == pytest.approx([n / 4] * 4, abs=0.2)
        variance = n * 0.25 * 0.75 * (100 - n) / 99
        assert got[:, p].var(0) == pytest.approx([variance] * 4, rel=0.12)


def test_large_populations_have_the_same_law():
    rng = np.random.default_rng(1)
    got = np.array([sharding.draw(rng, 3 * 10**9, 7 * 10**9, 1000) for _ in range(4000)])
    assert abs(got.mean() - 300) < 1.5
    assert abs(got.var() - 210) < 25
    assert sharding.draw(rng, 10**10, 10**10, 0) == 0
    assert sharding.draw(rng, 10**10, 0, 5) == 5


def check(rows, n, shards=16):
    by = Counter(r.shard for r in rows)
    assert len(rows) == n
    sizes = [by.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(by.get(s, 0)))


@pytest.mark.parametrize("bucket_rows", [3, 1 << 16])
def test_exact_sizes_and_slots(make, bucket_rows):
    df = make([(i, f"t{i % 3}") for i in range(500)]).repartition(7).checkpoint()
    rows = sharding.shuffle_shards(df, 16, 5, bucket_rows).collect()
    check(rows, 500)
    assert sorted(r.doc_id for r in rows) == list(range(500))
    again = sharding.shuffle_shards(df, 16, 5, bucket_rows).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_uniform(make):
    """Each row meets each shard about equally often over seeds, and neighbours separate."""
    df = make([(i, "x") for i in range(64)]).repartition(4).checkpoint()
    shard_of = np.array([[r.shard for r in sorted(sharding.shuffle_shards(df, 4, seed).collect(), key=lambda r: r.doc_id)] for seed in range(40)])
    share = np.stack([(shard_of == s).mean(0) for s in range(4)])
    assert share.mean(1) == pytest.approx([0.25] * 4)
    assert share.max() < 0.65
    assert abs((shard_of[:, 0] == shard_of[:, 1]).mean() - 15 / 63) < 0.25


def test_hard_rows(make, hard):
    df = hard.checkpoint()
    out = sharding.shuffle_shards(df, 4)
    assert out.columns == [*hard.columns, "shard", "slot"]
    rows = out.select(*[out[c] for c in ("doc_id", "text")]).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, hard.select("doc_id", "text").collect()))
    assert sharding.shuffle_shards(make([]).checkpoint(), 4).count() == 0


def test_query(spark):
    rows = sharding.op6_sharding(spark, "/root/testdata/sf0.001").collect()
    check(rows, 200)
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)
