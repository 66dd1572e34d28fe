"""Intermediate tables in the folder that all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``; where that is unset, a temporary one
serves a local session (tests, a laptop), and anything else is an error. Tables written there cut the lineage and
survive the loss of executors.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tallyspark-")


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local_dir()


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Deletes everything that any run has left; no result may be in use any more."""
    _delete(spark, f"{shared_dir(spark)}/tallyspark")


class Scratch:
    """One run's own folder; ``table`` writes a DataFrame there and reads it back."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/tallyspark/{name}-{uuid.uuid4().hex}"
        self.labels: list[str] = []

    def table(self, label: str, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{label}"
        df.write.mode("overwrite").parquet(path)
        self.labels.append(label)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, label: str = "") -> None:
        _delete(self.spark, f"{self.path}/{label}" if label else self.path)

    def keep(self, *labels: str) -> None:
        """Deletes all tables but these, which the result still reads."""
        for label in self.labels:
            if label not in labels:
                self.drop(label)
        self.labels = [x for x in self.labels if x in labels]
