"""What a lock file's requirements resolve to, and whether the ranges' own windows agree."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Files that are looked up at once.
FILES = 512


def nearest_scope(requirements: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, place, name, range, resolved_place, version): the entry that each requirement gets, as module lookup walks up from the
    requiring place: the nearest folder above it, itself first, whose node_modules has the name; null where none has.

    requirements: (path, place, name, range); entries: (path, place, version), places as folders below the project, '' being its
    own. Every folder above is a row, an equi-join finds those that hold the name, and the deepest counts. Both joins shuffle: rows
    out of parsed files are far more than the files' statistics let Spark expect, and it would send them to every machine.
    """
    parts = F.split("place", "/")
    depths = F.when(F.col("place") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))
    up = requirements.select("path", "place", "name", "range", parts.alias("parts"), F.explode(depths).alias("depth")).where("depth = 0 OR parts[depth - 1] <> 'node_modules'")
    scope = F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/")
    asked = up.withColumn("at", F.concat(scope, F.when(F.col("depth") > 0, "/").otherwise(""), F.lit("node_modules/"), "name"))
    held = entries.select("path", F.col("place").alias("at"), "version")
    keys = ["path", "place", "name", "range"]
    found = asked.join(held.hint("merge"), ["path", "at"]).groupBy(*keys).agg(F.max(F.struct("depth", F.col("at").alias("resolved_place"), "version")).alias("best"))
    return requirements.select(*keys).distinct().join(found.hint("merge"), keys, "left").select(*keys, "best.resolved_place", "best.version")


def nearest_scope_in_files(scoped: DataFrame) -> DataFrame:
    """`nearest_scope` of files that each are one row, (path, needs, held), as `lockfiles.scoped` has them: a requirement looks only at
    entries of its own file, so nothing is shuffled and a file is looked up in a table of its own places. Of a place that a file has
    again the highest version counts; rows with equal paths are files of their own."""

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(start, FILES) for start in range(0, whole.num_rows, FILES)):
                needs, held = batch.column("needs"), batch.column("held")
                asked, own = needs.flatten(), held.flatten()
                place, name, range_ = (asked.field(c) for c in ("place", "name", "range"))
                rows = enumerate(zip(place.to_pylist(), name.to_pylist(), range_.to_pylist(), strict=True))
                entries = zip(own.field("place").to_pylist(), own.field("version").to_pylist(), strict=True)
                file, kept, at, version = [], [], [], []
                for i, (n_needs, n_held) in enumerate(zip(needs.value_lengths().to_pylist(), held.value_lengths().to_pylist(), strict=True)):
                    table: dict[str, str | None] = {}
                    for p, v in islice(entries, n_held):
                        table[p] = max(table.get(p) or "", v) if v is not None else table.get(p)
                    seen = set()
                    for row, need in islice(rows, n_needs):
                        if need not in seen:
                            seen.add(need)
                            found = _nearest(need[0], need[1], table)
                            file.append(i)
                            kept.append(row)
                            at.append(found)
                            version.append(None if found is None else table[found])
                some = pa.array(kept, pa.int64())
                columns = [batch.column("path").take(pa.array(file, pa.int64())), *(c.take(some) for c in (place, name, range_)), pa.array(at, pa.string()), pa.array(version, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "place", "name", "range", "resolved_place", "version"])

    return scoped.mapInArrow(looked_up, "path string, place string, name string, range string, resolved_place string, version string")


def _nearest(place: str, name: str, table: dict[str, str | None]) -> str | None:
    """The deepest folder of the name among those that lookup asks for from a place."""
    parts = place.split("/") if place else []
    for depth in range(len(parts), 0, -1):
        if parts[depth - 1] != "node_modules" and (at := "/".join(parts[:depth]) + f"/node_modules/{name}") in table:
            return at
    return at if (at := f"node_modules/{name}") in table else None


def agreement(locked: DataFrame, windows: DataFrame) -> DataFrame:
    """(verdict, locks, rate): locks by whether the version that a declaration resolved to at the time is the locked one: agree,
    disagree, or no window; rate is the share of agreeing ones among the first two, the same in all rows.
    locked: (declaration, version, locked_at); windows: (declaration, version, vf, vt), of which one a declaration at a time."""
    w = windows.select("declaration", F.col("version").alias("expected"), "vf", "vt")
    inside = (F.col("locked_at") >= F.col("vf")) & (F.col("locked_at") < F.col("vt"))
    numbered = locked.select("declaration", "version", "locked_at").groupBy("declaration", "version", "locked_at").agg(F.count("*").alias("n"))
    judged = numbered.join(w, (numbered["declaration"] == w["declaration"]) & inside, "left")
    verdict = F.when(F.col("expected").isNull(), "no window").when(F.col("expected") == F.col("version"), "agree").otherwise("disagree")
    counts = judged.groupBy(verdict.alias("verdict")).agg(F.sum("n").alias("locks"))
    some = lambda v: F.sum(F.when(F.col("verdict").isin(v), F.col("locks")))
    rate = counts.agg(F.try_divide(F.coalesce(some(["agree"]), F.lit(0)), some(["agree", "disagree"])).alias("rate"))
    return counts.crossJoin(rate)  # one row
