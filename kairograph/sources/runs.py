"""Tables that grow run by run, of which readers see whole runs or nothing.

A run writes a folder `run=<n>` for each of its tables and then one row to the ledger. Tables are read through the
ledger, so a run that fails, or is still being written, isn't there, however many of its tables are; a run that is tried again
writes over its own folders, and one that the ledger has is not written twice. Rows are counted as they are
written, without a second job, and the counts are kept in the ledger.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LEDGER = "counts map<string,long>, run long"


class Runs:
    """The runs below one folder, which all machines share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def ledger(self) -> DataFrame:
        """(run, counts): the finished runs, and of each table the rows written."""
        try:
            return self.spark.read.schema(_LEDGER).parquet(f"{self.root}/ledger").select("run", "counts")
        except Exception as error:  # before the first run
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], "run long, counts map<string,long>")

    def write(self, run: int, tables: dict[str, DataFrame], counters: dict[str, dict[str, str]] | None = None) -> dict[str, int]:
        """Write the tables of a run unless it is finished; the rows of each. counters: further aggregates of a table's rows as SQL, by
        table and name, counted in the same pass."""
        held = self.ledger().where(F.col("run") == run).select("counts").first()
        if held is not None:
            return dict(held["counts"])
        counts: dict[str, int] = {}
        for name, df in tables.items():
            seen, more = Observation(), (counters or {}).get(name, {})
            df.observe(seen, F.count(F.lit(1)).alias(name), *(F.expr(x).cast("long").alias(f"{name}.{k}") for k, x in more.items())).write.mode("overwrite").parquet(f"{self.root}/{name}/run={run}")
            counts |= {k: v or 0 for k, v in seen.get.items()}
        row = self.spark.range(1).select(F.lit(None).cast("map<string,long>").alias("counts")) if not counts else self.spark.createDataFrame([(counts,)], "counts map<string,long>")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/ledger/run={run}")
        return counts

    def read(self, name: str) -> DataFrame:
        """A table's rows of all finished runs, with `run`."""
        return self.spark.read.parquet(f"{self.root}/{name}").join(self.ledger().select(F.col("run").alias("__run")), F.col("run") == F.col("__run"), "left_semi")

    def latest(self, name: str, keys: Sequence[str]) -> DataFrame:
        """Of each key the row of the last run that has it; of several in one run the one that is greatest, column by column."""
        rows = self.read(name)
        value = F.struct(*(F.col(c) for c in rows.columns if c not in (*keys, "run")))
        return rows.groupBy(*keys).agg(F.max(F.struct("run", value.alias("value"))).alias("last")).select(*keys, "last.value.*")
