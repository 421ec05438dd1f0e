"""What the operators share: reading tables, shared scratch tables and per-worker caches."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from functools import lru_cache, wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources import scratch

#: Rows in an Arrow batch; texts may be long, so batches stay short.
BATCH_ROWS = 200


@lru_cache(maxsize=8)
def _ship(application: str, spark: SparkSession) -> None:
    """Sends this package to the executors, unless the Python path that they inherit has it."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    name, folder = Path(__file__).resolve().parents[1].name, tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # Spark serves the file as long as the driver lives
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{name}", "zip", root, name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark whatever store it lies in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """What workers need for the functions of this subpackage: the package itself, and batches of few rows, as a text may
    be of any length."""
    _ship(spark.sparkContext.applicationId, spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def prepared(f):
    """For functions whose first argument is a DataFrame that they map in Python."""

    @wraps(f)
    def call(df: DataFrame, *args, **kwargs):
        prepare(df.sparkSession)
        return f(df, *args, **kwargs)

    return call


def written(spark: SparkSession, df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back."""
    return scratch.written(df, label, *partition_by)


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


class Cache(dict):
    """A dict that makes missing values by a function and starts anew at a fixed number of entries."""

    def __init__(self, make, limit: int = 200_000, longest: int = 48):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value
