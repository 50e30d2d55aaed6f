"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir. Where it names none, a temporary
    folder in local mode, as in tests; on a cluster, whose machines don't share one, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kairograph-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """`df` written once to the shared folder and read back; by: an int column whose values get folders of their own."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write if by is None else df.repartition(by).write.partitionBy(by)
    writer.parquet(path)
    schema = df.schema if by is None else StructType([*(f for f in df.schema if f.name != by), df.schema[by]])
    return df.sparkSession.read.schema(schema).parquet(path)


class Steps:
    """Rows written step by step to one folder of the shared one; `all` reads the steps so far as one table, with their number as
    `hop`, so a plan over them stays the same however many there are."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n, self.schema = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Write `df` as the next step and read it back."""
        step, self.schema = f"{self.path}/hop={self.n}", df.schema
        df.write.parquet(step)
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(step)

    def all(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("hop", IntegerType())])).parquet(self.path)
