"""Consistent-hash routing: keys to the owner of the next point of a ring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import ring_hash
from ..settings import Settings

SPACE = 1 << 32
#: Points that a ring may have to be broadcast; larger rings are joined by a shuffle on the bucket.
BROADCAST_POINTS = 1_000_000


def ring(spark: SparkSession, nodes: list[str] | DataFrame, vnodes: int = Settings.cache_vnodes) -> DataFrame:
    """node, label, hash of every point. nodes: their names, or a table of node and pos (their order, from 0). A label whose hash is taken gets a '~' (as often as need be), the first in the
    order of nodes keeping its own."""
    if isinstance(nodes, list) and not nodes:
        raise ValueError("a ring needs at least one node")
    names = nodes.groupBy("node").agg(F.min("pos").alias("pos")) if isinstance(nodes, DataFrame) else spark.createDataFrame([(n, i) for i, n in enumerate(dict.fromkeys(nodes))], "node string, pos int")
    points = names.select("node", "pos", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("replica"))
    points = points.withColumn("label", F.concat("node", F.lit("#"), F.col("replica").cast("string"))).withColumn("hash", ring_hash(F.col("label")))
    first = F.row_number().over(Window.partitionBy("hash").orderBy("pos", "replica"))
    label = F.when(first == 1, F.col("label")).otherwise(F.concat("label", F.lit("~")))
    return points.withColumn("label", label).withColumn("hash", ring_hash(F.col("label"))).select("node", "label", "hash")


def without_node(points: DataFrame, node: str) -> DataFrame:
    return points.where(F.col("node") != node)


def with_node(points: DataFrame, node: str, vnodes: int = Settings.cache_vnodes) -> DataFrame:
    """Adding a node that is there changes nothing."""
    return points.unionByName(ring(points.sparkSession, [node], vnodes)).distinct()


def intervals(points: DataFrame) -> DataFrame:
    """Half-open key ranges [low, high) with their owner, cut at buckets of the top 8 bits so that routing is an equi
    join. The last point's successor is the first."""
    order = Window.partitionBy(F.lit(0)).orderBy("hash")  # the ring's points only, nodes * vnodes
    low = F.coalesce(F.lag("hash").over(order), F.lit(0))
    spans = points.select("node", "label", "hash", low.alias("low"), F.col("hash").alias("high"))
    ends = points.agg(F.max("hash").alias("low"), F.min(F.struct("hash", "node", "label")).alias("f")).select(F.col("f.node").alias("node"), F.col("f.label").alias("label"), F.col("f.hash").alias("hash"), "low", F.lit(SPACE).alias("high"))
    both = spans.unionByName(ends).where("low < high")
    return both.withColumn("bucket", F.explode(F.sequence(F.shiftright("low", 24), F.shiftright(F.col("high") - 1, 24))))


def locate(keys: DataFrame, points: DataFrame) -> DataFrame:
    """keys (with a key column) and key_hash, node, label, point_hash of the first point strictly after it. The ring's points
    are counted; a ring within BROADCAST_POINTS is broadcast."""
    own = intervals(points).select("node", "label", F.col("hash").alias("point_hash"), "low", "high", "bucket")
    n = points.count()
    if n == 0:
        raise ValueError("the ring has no points")
    hashed = keys.withColumn("key_hash", ring_hash(F.col("key"))).withColumn("bucket", F.shiftright("key_hash", 24))
    hit = hashed.join(F.broadcast(own) if n <= BROADCAST_POINTS else own, "bucket")
    return hit.where((F.col("key_hash") >= F.col("low")) & (F.col("key_hash") < F.col("high"))).drop("bucket", "low", "high")


def distribution(routed: DataFrame, points: DataFrame) -> DataFrame:
    """node, keys, load_factor (against an even share); nodes without keys count 0."""
    counted = points.select("node").distinct().join(routed.groupBy("node").agg(F.count("*").alias("keys")), "node", "left").select("node", F.coalesce("keys", F.lit(0)).alias("keys"))
    total = counted.agg(F.sum("keys").alias("total"), F.count("*").alias("nodes"))
    return counted.crossJoin(total).select("node", "keys", F.round(F.coalesce(F.try_divide(F.col("keys") * F.col("nodes"), "total"), F.lit(0.0)), 3).alias("load_factor"))


def remapped(before: DataFrame, after: DataFrame) -> DataFrame:
    """keys, moved, fraction of keys whose node differs."""
    both = before.select("key", F.col("node").alias("a")).join(after.select("key", F.col("node").alias("b")), "key")
    moved = F.sum(F.when(F.col("a") != F.col("b"), 1).otherwise(0))
    return both.agg(F.count("*").alias("keys"), F.coalesce(moved, F.lit(0)).alias("moved"), F.round(F.coalesce(F.try_divide(moved, F.count("*")), F.lit(0.0)), 6).alias("fraction"))


def modulo(keys: DataFrame, n: int) -> DataFrame:
    return keys.select("key", (ring_hash(F.col("key")) % n).alias("node"))


def membership(points: DataFrame) -> DataFrame:
    """The nodes and how many points each has."""
    return points.groupBy("node").agg(F.count("*").alias("points"))
