"""Tables written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder set otherwise. Where none is set, a temporary folder if all runs on this
    machine (tests), else an error: executors would not see the driver's folders."""
    if known := spark.conf.get("spark.checkpoint.dir", None):
        return known.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="prefixory-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """The driver deletes the folder when it ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """df written once as Parquet and read back: lineage ends here, and a lost executor costs a reread only."""
    path = scratch_path(df.sparkSession, label)
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    delete_on_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
