"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

QUERY_COUNTS = T.StructType(
    [T.StructField("query", T.StringType(), False), T.StructField("count", T.LongType(), False), T.StructField("last_searched", T.DoubleType())]
)
META = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType(), False)])
SUBMISSIONS = T.StructType([T.StructField("query", T.StringType()), T.StructField("ts", T.TimestampType())])
PREFIX_TOPK = T.StructType(
    [T.StructField("prefix", T.StringType(), False), T.StructField("rank", T.IntegerType(), False), T.StructField("query", T.StringType(), False), T.StructField("count", T.LongType(), False)]
)
SEARCH_BODY = T.StructType([T.StructField("query", T.StringType())])
