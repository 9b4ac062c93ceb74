"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a fresh temporary folder where a local session has none."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """``df`` written in ranges of ``order``, ``parts`` or as many as the session shuffles to, with the number
    of each row's range as ``_range``: equal keys are in one range, and later ranges have larger ones."""
    return written(df.repartitionByRange(*([] if parts is None else [parts]), *order).withColumn("_range", F.spark_partition_id()), "ranges")


class Grown:
    """A written table that grows by appending; its columns and types stay those of the first rows."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def add(self, df: DataFrame) -> DataFrame:
        df.write.mode("append").parquet(self.path)
        return self.table()
