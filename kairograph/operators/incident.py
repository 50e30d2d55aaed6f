"""What a compromised release touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.functions.intervals import coalesce, contains
from kairograph.functions.lineage import written
from kairograph.functions.text import severity_rank
from kairograph.operators.reach import DEPTH, always, coexistence_reach


def resolved_while_live(resolutions: DataFrame, locks: DataFrame) -> DataFrame:
    """(target, project, node, locked_at): projects that locked a dependent while it resolved to the target.
    resolutions: (src, dst, vf, vt); locks: (project, node, locked_at)."""
    r = resolutions.select(F.col("src").alias("node"), F.col("dst").alias("target"), "vf", "vt")
    return r.join(locks, "node").where(contains(F.col("locked_at"))).select("target", "project", "node", "locked_at").distinct()


def transitively_exposed(edges: DataFrame, locks: DataFrame, target: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(project, locked_at): projects from whose pins the target is reached at the instant they were locked. One search backwards
    from the target gives the instants at which each node reaches it; pins are then looked up there, so no pin searches."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "vf", "vt")
    spans = written(coexistence_reach(back, always(target.select("node").distinct()), depth=depth), "spans")
    return locks.join(spans, "node").where(contains(F.col("locked_at"))).select("project", "locked_at").distinct()


def exposure_timeline(spans: DataFrame, instants: DataFrame) -> DataFrame:
    """(instant, reached): nodes reached at each instant; membership may be read off the maximal intervals."""
    at = F.broadcast(instants.select("instant"))  # some dozens of instants
    hits = at.join(spans, contains(F.col("instant"))).groupBy("instant").agg(F.count_distinct("node").alias("reached"))
    return instants.select("instant").join(hits, "instant", "left").select("instant", F.coalesce("reached", F.lit(0)).cast("long").alias("reached"))


def _month_place(t: Column) -> Column:
    """Months since year 0 of the first start of a month that isn't before an instant."""
    start = F.timestamp_seconds(t)
    return F.year(start) * 12 + F.month(start) - 1 + F.when(F.date_trunc("month", start) == start, 0).otherwise(1)


def covered_months(spans: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """(place, n): how many keys cover the start of each month from place `first` to `last`. The ends of the keys' maximal intervals are
    added up by month, and the running sum goes over one row a month."""
    merged = coalesce(spans.select(key, "vf", "vt"), [key])
    clip = lambda c: F.greatest(F.lit(first), F.least(F.lit(last + 1), _month_place(F.col(c))))
    ends = F.explode(F.array(F.struct(clip("vf").alias("place"), F.lit(1).alias("d")), F.struct(clip("vt").alias("place"), F.lit(-1).alias("d"))))
    change = merged.select(ends.alias("e")).groupBy("e.place").agg(F.sum("e.d").alias("d"))
    months = spans.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("place"))
    return months.join(change, "place", "left").select("place", F.sum(F.coalesce("d", F.lit(0))).over(Window.orderBy("place")).alias("n"))


def audit_timeline(spans: DataFrame, held: DataFrame, union_publishers: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """(instant, reached, publishers, union_publishers): an audit at the start of each month from `first` to `last` (year, month): nodes
    reached then, accounts that held a reached package then, and the accounts of the graph without time. held: a roster.
    A node is reached at an instant as in a search at that instant, so one search serves all months."""
    a, b = (y * 12 + m - 1 for y, m in (first, last))
    reached, holding = covered_months(spans, "node", a, b).withColumnRenamed("n", "reached"), covered_months(held, "handle", a, b).withColumnRenamed("n", "publishers")
    start = F.unix_timestamp(F.make_timestamp(F.floor(F.col("place") / 12).cast("int"), (F.col("place") % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return reached.join(holding, "place").crossJoin(union_publishers).select(start.alias("instant"), "reached", "publishers", "union_publishers")  # one row of union_publishers


def live_holders(maintains: DataFrame, t: int) -> DataFrame:
    return maintains.where(contains(t)).select("package", "handle").distinct()


def shared_maintainers(maintains: DataFrame, package: DataFrame, t: int) -> DataFrame:
    """(handle, other): accounts that held the package at t, and the other packages they held then."""
    live = live_holders(maintains, t)
    own = live.join(package.select("package"), "package", "left_semi").select("handle", F.col("package").alias("own"))
    return own.join(live, "handle").where("package <> own").select("handle", F.col("package").alias("other")).distinct()


def orphaned(packages: DataFrame, maintains: DataFrame, t: int) -> DataFrame:
    """Packages nobody held at t."""
    return packages.select("package").distinct().join(live_holders(maintains, t), "package", "left_anti")


def advisories_reached(reached: DataFrame, affects: DataFrame) -> DataFrame:
    """(package, version, advisories): what is known against each reached version."""
    return reached.join(affects, ["package", "version"]).groupBy("package", "version").agg(F.array_sort(F.collect_set("osv_id")).alias("advisories"))


def by_severity(advisories: DataFrame) -> DataFrame:
    return advisories.orderBy(severity_rank(F.col("severity")), "osv_id")
