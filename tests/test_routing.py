import bisect
import hashlib

import pytest
from pyspark.sql import functions as F

from prefixory.operators import routing

NODES = [f"cache-{i}" for i in range(4)]


def keys(spark, n, name):
    return spark.range(n).select(F.concat(F.lit(name), F.col("id").cast("string")).alias("key"))


def test_golden_route(spark):
    df = spark.createDataFrame([("suggest:basic:java",)], "key string")
    r = routing.locate(df, routing.ring(spark, NODES)).first()
    assert (r.key_hash, r.node, r.label) == (2514721547, "cache-1", "cache-1#88")


def test_golden_distribution(spark):
    points = routing.ring(spark, NODES)
    got = sorted((r["keys"] for r in routing.distribution(routing.locate(keys(spark, 20000, "prefix-"), points), points).collect()), reverse=True)
    assert got == [5682, 4997, 4762, 4559]


def test_equals_bisect(spark):
    points = routing.ring(spark, ["x", "y", "z"], 7)
    ring = sorted((r.hash, r.node) for r in points.collect())
    h = [x for x, _ in ring]
    for r in routing.locate(keys(spark, 2000, "k"), points).collect():
        own = int(hashlib.md5(r.key.encode()).hexdigest()[:8], 16)
        assert r.node == ring[bisect.bisect_right(h, own) % len(ring)][1]


def test_skew_and_remap(spark):
    five = [f"n{i}" for i in range(5)]
    points = routing.ring(spark, five, 200)
    k = keys(spark, 50000, "prefix-")
    routed = routing.locate(k, points)
    shares = [r["keys"] / 10000 for r in routing.distribution(routed, points).collect()]
    assert max(abs(s - 1) for s in shares) <= 0.25
    less = routing.locate(k, routing.without_node(points, "n3"))
    assert routing.remapped(routed, less).first().fraction < 0.30
    moved = routed.join(less.select("key", F.col("node").alias("b")), "key").where("node <> b")
    assert {r.node for r in moved.select("node").distinct().collect()} == {"n3"}
    more = routing.remapped(routed, routing.locate(k, routing.with_node(points, "n5", 200))).first().fraction
    assert 0.10 < more < 0.30


def test_idempotent_add_single_and_empty(spark):
    points = routing.ring(spark, NODES, 5)
    assert routing.with_node(points, "cache-1", 5).count() == points.count()
    one = routing.locate(keys(spark, 100, "k"), routing.ring(spark, ["only"], 1))
    assert one.where("node = 'only'").count() == 100
    with pytest.raises(ValueError):
        routing.ring(spark, [])
    with pytest.raises(ValueError):
        routing.locate(keys(spark, 1, "k"), points.where("false"))
