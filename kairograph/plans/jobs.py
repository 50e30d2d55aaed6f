"""Whole jobs: operators put together, their results written as one run of tables, with counters.

Each job's tables appear together or not at all (`kairograph.sources.runs`); a run that is finished isn't written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.functions.lineage import written
from kairograph.operators import advisory, observatory, publishers, reach, temporal, typosquat
from kairograph.sources.runs import Runs


def resolve(runs: Runs, run: int, declarations: DataFrame, releases: DataFrame) -> dict[str, int]:
    """Tables resolves (windows of all declarations) and outcomes (declarations by what became of them)."""
    windows = written(temporal.resolution_windows(declarations, releases), "windows")
    return runs.write(run, {"resolves": windows, "outcomes": temporal.resolution_counts(declarations, releases, windows)}, {"resolves": {"open": "count_if(vt = 4102444800)"}, "outcomes": {"declarations": "sum(declarations)"}})


def advisories(runs: Runs, run: int, records: DataFrame, releases: DataFrame) -> dict[str, int]:
    """Tables advisories (id, label, score) and affects (which releases each affects). A record that comes twice counts once."""
    once = records.dropDuplicates(["osv_id"])
    return runs.write(
        run,
        {"advisories": advisory.severity(once).select("osv_id", "published_at", F.col("label").alias("severity"), "cvss"), "affects": advisory.affected_versions(once, releases)},
        {"affects": {"unfixed": "count_if(fixed = '')"}},
    )


def typosquats(runs: Runs, run: int, names: DataFrame, distance: int = 1) -> dict[str, int]:
    """Table typosquats: pairs of look-alike names, within a number of edits."""
    return runs.write(run, {"typosquats": typosquat.candidates(names, distance)})


def observe(runs: Runs, run: int, releases: DataFrame, dependencies: DataFrame, epochs: DataFrame, maintains: DataFrame, sample: int = 0) -> dict[str, int]:
    """Tables snapshots (what the release current at each epoch depends on), kri_history (estimated index and whether orphaned, by
    epoch) and kri_latest; with a sample also validation, the estimates of so many nodes an epoch against exact counts."""
    edges = written(temporal.snapshots(releases, dependencies, epochs), "snapshots")
    kri = written(observatory.kri_estimated(observatory.kri_sketches(edges)), "kri")
    past = written(observatory.history(kri, maintains), "history")
    tables = {"snapshots": edges, "kri_history": past, "kri_latest": observatory.latest(past)}
    if sample:
        tables["validation"] = observatory.sampled_validation(edges, kri, sample)
    return runs.write(run, tables, {"kri_history": {"orphaned": "count_if(orphaned)"}} | ({"validation": {"outside": "count_if(NOT within)"}} if sample else {}))


def path(edges: DataFrame, sources: DataFrame, maintains: DataFrame, handle: str, package_of: Callable[[Column], Column], depth: int = reach.DEPTH, asked: DataFrame | None = None) -> DataFrame:
    """The proof for each package that an account held while the sources reached it: a chain, or none, by package name. asked: (asked),
    URNs or bare names, for proofs of these only; what of them isn't held has no row."""
    spans = reach.coexistence_reach(edges, sources, depth=depth).select(package_of(F.col("node")).alias("package"), "vf", "vt")
    held = publishers.roster(spans, maintains.where(F.col("handle") == handle))
    wanted = written(held.select("package").distinct(), "held")
    if asked is not None:
        wanted = written(publishers.held_package(wanted, asked).where("package IS NOT NULL").select("package").distinct(), "asked")
    return reach.package_chains(edges, sources, wanted, package_of, depth).orderBy("package")


def crosscheck(versions: DataFrame, timeline: DataFrame) -> DataFrame:
    """(package, held, dated, agrees) for each package of the source's timeline: versions that the tables hold and those that the source
    dates; undated ones aren't written and don't count. versions: (package, version); timeline: (package, version, published_at)."""
    held = versions.select("package", "version").distinct().groupBy("package").agg(F.count("*").alias("held"))
    dated = timeline.groupBy("package").agg(F.count_distinct(F.when(F.col("published_at") > 0, F.col("version"))).alias("dated"))
    both = dated.join(held, "package", "left").select("package", F.coalesce("held", F.lit(0)).cast("long").alias("held"), "dated")
    return both.withColumn("agrees", F.col("held") == F.col("dated"))


def verify(versions: DataFrame, timeline: DataFrame, maintains: DataFrame, names: DataFrame, sample: int = 20, top: int = 15) -> dict[str, DataFrame]:
    """Whether what was taken in is what the source lists: `counts`, the cross-check of the `sample` first names (name, rank);
    `agreement`, one row of it (agree, checked); `maintainers`, the accounts with most holdings."""
    first = names.where(F.col("rank") <= sample).select(F.col("name").alias("package"))
    counts = written(crosscheck(versions.join(first, "package", "left_semi"), timeline.join(first, "package", "left_semi")), "crosscheck")
    return {
        "counts": counts.orderBy("package"), "agreement": counts.agg(F.count_if("agrees").alias("agree"), F.count("*").alias("checked")),
        "maintainers": publishers.maintainer_rank(maintains, top),
    }
