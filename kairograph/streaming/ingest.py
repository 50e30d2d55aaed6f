"""Registry documents from a stream into tables, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kairograph.sources import feeds
from kairograph.sources.runs import Runs

#: What is counted of each table besides its rows.
COUNTERS = {"versions": {"undated": "count_if(published_at = 0)", "deprecated": "count_if(deprecated)"}}
KEYS = {"packages": ("urn",), "versions": ("urn",)}


def registry_tables(batch: DataFrame) -> dict[str, DataFrame]:
    """Nodes of packages and of their versions from timeline documents (package, content)."""
    versions = feeds.timeline(batch).where("coalesce(version, '') <> ''")
    package = F.concat(F.lit("pkg:npm/"), "package")
    return {
        "packages": versions.select(package.alias("urn"), F.col("package").alias("name")).distinct(),
        "versions": versions.select(F.concat(package, F.lit("@"), "version").alias("urn"), package.alias("package"), "version", "published_at", "deprecated").distinct(),
    }


def ingest(documents: DataFrame, root: str, checkpoint: str, tables: Callable[[DataFrame], dict[str, DataFrame]] = registry_tables, once: bool = False) -> StreamingQuery:
    """Start to write every batch of a stream as a run of the tables at `root`. A batch that was cut off, by a lost driver too, is
    written again whole when the query is started with the same checkpoint, and none is written twice, so restarts
    change nothing; `Runs(spark, root).latest(name, KEYS[name])` is a table's newest state. once: stop when all that is there is
    written."""

    def one(batch: DataFrame, run: int) -> None:
        batch.persist()
        try:
            Runs(batch.sparkSession, root).write(run, tables(batch), COUNTERS)
        finally:
            batch.unpersist()

    writer = documents.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
