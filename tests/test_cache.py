import random
import uuid
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from prefixory.operators import cache


def run(spark, ops, capacity=100, ttl=30.0):
    rows = [("n", i, op, k, float(t)) for i, (op, k, t) in enumerate(ops)]
    df = spark.createDataFrame(rows, "node string, seq long, op string, key string, t double")
    return cache.replay(df, capacity, ttl)


def hits(df):
    return [r.hit for r in df.orderBy("seq").collect()]


def test_ttl(spark):
    df = run(spark, [("set", "a", 1000), ("get", "a", 1029), ("get", "a", 1030), ("get", "a", 1031)])
    rows = df.orderBy("seq").collect()
    assert [r.hit for r in rows] == [False, True, False, False]
    assert [r.expired for r in rows] == [False, False, True, False]


def test_get_does_not_refresh_ttl_set_does(spark):
    assert hits(run(spark, [("set", "a", 0), ("get", "a", 20), ("get", "a", 31)]))[2] is False
    assert hits(run(spark, [("set", "a", 0), ("set", "a", 20), ("get", "a", 31)]))[2] is True


def test_lru_order(spark):
    ops = [("set", "a", 0), ("set", "b", 0), ("get", "a", 0), ("set", "c", 0), ("get", "b", 0), ("get", "a", 0), ("get", "c", 0)]
    rows = run(spark, ops, capacity=2).orderBy("seq").collect()
    assert [r.hit for r in rows[4:]] == [False, True, True]
    assert sum(r.evicted for r in rows) == 1


def test_invalidate_clear_and_stats(spark):
    df = run(spark, [("set", "a", 0), ("invalidate", "a", 0), ("get", "a", 0), ("request", "b", 0), ("get", "b", 0), ("clear", "", 0), ("get", "b", 0), ("request", "c", 0), ("get", "c", 1)])
    total = cache.stats(df).where("node is null").first()
    assert (total.hits, total.misses) == (2, 4)
    empty = cache.stats(run(spark, [("set", "a", 0)])).where("node is null").first()
    assert empty.hit_rate == 0.0


def test_live_entries(spark):
    df = run(spark, [("set", "a", 0), ("set", "b", 10), ("invalidate", "b", 11), ("request", "c", 20)])
    assert {r.key: r.ttl_remaining for r in cache.live_entries(df, 35.0).collect()} == {"a": 0.0, "c": 15.0}


def plainly(rows, capacity, ttl):
    """The rows by node and seq, each node's operations one after the other."""
    out, node, name = [], None, None
    for own, seq, op, key, t in sorted(rows):
        if own != name:
            node, name = cache.Node(capacity, ttl), own
        out.append((own, seq, op, key, t, *node.apply(op, key, t), len(node.entries)))
    return out


def drawn(seed, n, ops, keys, back):
    """n operations on two nodes; times go on, now and then back."""
    r, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        t = t + r.random() * 4 if r.random() > back else t - 30 * r.random()
        rows.append((r.choice("aab"), i, r.choice(ops), f"k{int(keys * r.random() ** 2)}", t))
    return rows


REQUESTS, ALL_BUT_GET = ["request"], ["request"] * 6 + ["set", "invalidate"]


@pytest.mark.parametrize("ops", [REQUESTS, ALL_BUT_GET, ALL_BUT_GET * 20 + ["clear"], ALL_BUT_GET * 8 + ["get"]])
@pytest.mark.parametrize("capacity, ttl", [(4, 30.0), (8, 1e12), (10**9, 25.0)])
def test_parts_equal_one_sequence(spark, monkeypatch, ops, capacity, ttl):
    monkeypatch.setattr(cache, "PART", 40)
    rows = drawn(len(ops), 1200, ops, 12, 0.02)
    df = spark.createDataFrame(rows, "node string, seq long, op string, key string, t double")
    got = sorted(map(tuple, cache.replay(df, capacity, ttl).collect()))
    assert got == plainly(rows, capacity, ttl)


@pytest.mark.parametrize("seed", range(200))
def test_expiries_equal_replay(seed):
    r = random.Random(seed)
    times = [float(r.randrange(40)) for _ in range(r.randrange(1, 12))]
    times = sorted(times) if seed % 2 else times
    limits, untils = cache.expiries(times, 9.0)
    for first in range(-5, 60):
        node = cache.Node(1, 9.0)
        node.entries["k"] = float(first)
        for t in times:
            node.apply("request", "k", t)
        i = bisect_left(limits, first)
        assert node.entries["k"] == (untils[i] if i < len(untils) else first)


def test_no_task_holds_a_whole_node(spark, monkeypatch):
    monkeypatch.setattr(cache, "PART", 100, raising=False)
    df = spark.range(1000).select(F.lit("n").alias("node"), F.col("id").alias("seq"), F.lit("request").alias("op"), (F.col("id") % 7).cast("string").alias("key"), F.col("id").cast("double").alias("t"))
    met = cache.replay(df, 5, 30.0).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert max(r.n for r in met) < 600


def test_lru_ttl_query_in_parts_equals_sql(spark, monkeypatch):
    from prefixory.plans.queries import QUERIES, SQL

    from .oracle import differing

    monkeypatch.setattr(cache, "PART", 200, raising=False)
    sf = "/root/testdata/sf0.001"
    met = QUERIES["cache_lru_ttl"](spark, sf)
    shares = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert max(shares) < sum(shares)
    assert differing(met, SQL["cache_lru_ttl"], sf) == []


@pytest.mark.parametrize("ops", [REQUESTS, ALL_BUT_GET * 20 + ["clear"], ALL_BUT_GET * 8 + ["get"]])
@pytest.mark.parametrize("capacity, ttl", [(4, 30.0), (8, 400.0), (10**9, 25.0)])
def test_turns_equal_one_sequence(spark, monkeypatch, ops, capacity, ttl):
    monkeypatch.setattr(cache, "PART", 60)
    monkeypatch.setattr(cache, "TURN", 5, raising=False)
    rows = drawn(capacity, 1200, ops, 12, 0.02)
    df = spark.createDataFrame(rows, "node string, seq long, op string, key string, t double")
    got = sorted(map(tuple, cache.replay(df, capacity, ttl).collect()))
    assert got == plainly(rows, capacity, ttl)


def test_no_task_is_told_all_times_of_a_frequent_key(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(cache, "PART", 100)
    monkeypatch.setattr(cache, "TURN", 2, raising=False)
    rows = [("n", i, "request", "often" if i % 10 else f"k{i % 7}", float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "node string, seq long, op string, key string, t double")
    plain = type(df).mapInPandas

    def counted(self, fold, schema):
        def counting(frames):
            told = 0

            def seen():
                nonlocal told
                for frame in frames:
                    told += sum(map(len, frame["limits"].dropna())) if "limits" in frame else 0
                    yield frame

            yield from fold(seen())
            (tmp_path / uuid.uuid4().hex).write_text(str(told))

        return plain(self, counting, schema)

    monkeypatch.setattr(type(df), "mapInPandas", counted)
    got = sorted(map(tuple, cache.replay(df, 4, 300.0).collect()))
    monkeypatch.undo()
    assert got == plainly(rows, 4, 300.0)
    told = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert sum(told) > 1000 and max(told) < 500
