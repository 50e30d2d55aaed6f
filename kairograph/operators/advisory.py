"""Advisory ranges applied to version timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.functions.semver import version_key

EVENTS = "array<struct<introduced:string,fixed:string,last_affected:string>>"


def boundaries(events: Column) -> Column:
    """Sorted boundaries of a range's events; an event counts by the first of its fields that is set, unparseable ones drop.
    The text 0 means the first version. Of equal versions introduced comes first, then last_affected, then fixed."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""

    def boundary(e: Column, place: Column) -> Column:
        text = F.when(given(e["introduced"]), F.when(e["introduced"] == "0", "0.0.0").otherwise(e["introduced"])).when(given(e["fixed"]), e["fixed"]).otherwise(e["last_affected"])
        kind = F.when(given(e["introduced"]), 0).when(given(e["fixed"]), 2).otherwise(1)
        return F.struct(version_key(text).alias("key"), kind.alias("kind"), place.alias("place"))

    return F.array_sort(F.filter(F.transform(events, boundary), lambda b: b["key"].isNotNull()))


def is_affected(key: Column, bounds: Column) -> Column:
    """The state that the last boundary at or below the version leaves behind."""
    return F.aggregate(
        bounds,
        F.lit(False),
        lambda state, b: F.when(key < b["key"], state).when(b["kind"] == 0, F.lit(True)).when(b["kind"] == 2, F.lit(False)).when(key > b["key"], F.lit(False)).otherwise(state),
    )


def affected_versions(advisories: DataFrame, releases: DataFrame) -> DataFrame:
    """(osv_id, package, version, introduced, fixed): releases that an advisory affects; the first of its ranges that matches
    counts. Ranges go before listed versions, which count only for a block without ranges; GIT ranges match nothing.

    advisories: (osv_id, affected array<struct<package struct<ecosystem, name>, ranges array<struct<type, events>>, versions>>).
    """
    blocks = advisories.select("osv_id", F.posexplode("affected").alias("block", "a")).where("a.package.ecosystem = 'npm'").select("osv_id", "block", F.col("a.package.name").alias("package"), F.col("a.ranges").alias("ranges"), F.col("a.versions").alias("versions"))
    ranged = blocks.where("size(ranges) > 0").select("osv_id", "block", "package", F.posexplode("ranges").alias("place", "r")).where("r.type <> 'GIT'").withColumn("bounds", boundaries(F.col("r.events"))).where("size(bounds) > 0")
    timed = releases.select("package", "version", version_key(F.col("version")).alias("key")).where("key IS NOT NULL")
    events = F.col("r.events")
    some = lambda field: F.filter(F.transform(events, lambda e: e[field]), lambda v: F.coalesce(v, F.lit("")) != "")
    hits = ranged.join(timed, "package").where(is_affected(F.col("key"), F.col("bounds"))).select(
        "osv_id", "block", "place", "package", "version", F.coalesce(F.get(some("introduced"), F.lit(0)), F.lit("")).alias("introduced"), F.coalesce(F.try_element_at(some("fixed"), F.lit(-1)), F.lit("")).alias("fixed")
    )
    listed = blocks.where("coalesce(size(ranges), 0) <= 0").select("osv_id", "block", F.lit(0).alias("place"), "package", F.explode("versions").alias("version")).join(releases.select("package", "version"), ["package", "version"])
    listed = listed.select("osv_id", "block", "place", "package", "version", F.lit("").alias("introduced"), F.lit("").alias("fixed"))
    first = F.min_by(F.struct("introduced", "fixed"), F.struct("block", "place")).alias("f")
    return hits.unionByName(listed).groupBy("osv_id", "package", "version").agg(first).select("osv_id", "package", "version", "f.*")


def severity(record: DataFrame) -> DataFrame:
    """`record` with the label of its database (else the type of its first score) and its first plain numeric score, 0 without one."""
    label = F.coalesce(F.when(F.col("database_specific.severity") != "", F.col("database_specific.severity")), F.get("severity.type", F.lit(0)), F.lit(""))
    score = F.coalesce(F.get(F.filter(F.transform("severity", lambda s: s["score"].try_cast("double")), lambda x: x.isNotNull()), F.lit(0)), F.lit(0.0))
    return record.withColumns({"label": label, "cvss": score})
