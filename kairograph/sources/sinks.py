"""Writing nodes, edges, snapshots and results as tables of Parquet files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upserted(existing: DataFrame | None, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of `existing` whose key isn't in `new`, and of `new` one row a key: the last by `order`, else any of equal ones."""
    if order is None:
        latest = new.dropDuplicates(list(keys))
    else:
        latest = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
    return latest if existing is None else existing.join(latest, list(keys), "left_anti").unionByName(latest, allowMissingColumns=True)


def conflicts(new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys for which a batch has two values of one property."""
    return new.groupBy(*keys).agg(*(F.count_distinct(c).alias(c) for c in columns)).where(" OR ".join(f"{c} > 1" for c in columns))


def with_ends(edges: DataFrame, sources: DataFrame, targets: DataFrame, src: str = "src", dst: str = "dst", key: str = "urn") -> tuple[DataFrame, DataFrame]:
    """Edges both of whose ends exist, and those that drop because one doesn't."""
    a, b = sources.select(F.col(key).alias(src)).distinct(), targets.select(F.col(key).alias(dst)).distinct()
    kept = edges.join(a, src, "left_semi").join(b, dst, "left_semi")
    lost = edges.join(a, src, "left_anti").unionByName(edges.join(a, src, "left_semi").join(b, dst, "left_anti"))
    return kept, lost


def write_epochs(df: DataFrame, path: str) -> None:
    """Overwrite only the epochs that `df` has."""
    df.write.partitionBy("epoch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def pending(names: DataFrame, spark: SparkSession, done_path: str) -> DataFrame:
    """Names that no earlier run has recorded as done."""
    try:
        done = spark.read.schema("name string").parquet(done_path)
    except Exception as error:  # a first run has no record yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return names
    return names.join(done, "name", "left_anti")


def record_done(names: DataFrame, done_path: str) -> None:
    """Call after the data of `names` is written."""
    names.select("name").write.mode("append").parquet(done_path)


def recorded(files: DataFrame, pins: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Project rows and lock rows of lock files: locked at the file's time, identified by its digest. A file without a project
    name raises an error."""
    named = files.join(projects, "path", "left").withColumn("project", F.coalesce("project", F.raise_error(F.concat(F.lit("no project name in "), F.col("path"))).cast("string")))
    rows = named.select("path", F.concat(F.lit("prj:local/"), "project").alias("urn"), F.col("project").alias("name"), F.col("sha256").alias("lockfile_sha"), F.col("modified").alias("locked_at"))
    locks = pins.join(rows, "path").select(F.col("urn").alias("src"), F.concat(F.lit("pkg:npm/"), pins["name"], F.lit("@"), "version").alias("dst"), "locked_at", "direct", "dev")
    return rows.drop("path"), locks


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
