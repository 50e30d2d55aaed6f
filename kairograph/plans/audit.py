"""End-user reports put together from the operators; each returns DataFrames by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.functions.intervals import OPEN
from kairograph.functions.lineage import written
from kairograph.operators import incident, publishers, reach, temporal


def known_pins(pins: DataFrame, versions: DataFrame) -> DataFrame:
    """Pinned versions that the graph knows, with the span in which they exist (always, where undated)."""
    dated = F.when(F.col("published_at") > 0, F.col("published_at")).otherwise(0)
    return pins.join(versions, ["name", "version"]).select(F.col("urn").alias("node"), F.col("name").alias("package"), dated.cast("long").alias("vf"), F.lit(OPEN).cast("long").alias("vt"))


def audit(edges: DataFrame, sources: DataFrame, maintains: DataFrame, sampled: DataFrame, package_of, now: int, depth: int = reach.DEPTH, within: tuple[int, int] = (0, OPEN)) -> dict[str, DataFrame]:
    """Who can publish into what the sources reach. package_of: column function from node to package."""
    spans = written(reach.coexistence_reach(edges, sources, depth=depth, within=within), "spans")
    union, _, _ = reach.union_reach(edges, sources, depth=depth)
    packages = spans.withColumn("package", package_of(F.col("node"))).select("package", "vf", "vt")
    held = written(publishers.roster(packages, maintains), "held")
    holders = publishers.holders_per_package(packages, held)
    seen = publishers.signals(held, holders, sampled)
    count = packages.select("package").distinct().count()
    score_at = within[0] if within != (0, OPEN) and within[0] > 0 else now
    risk = publishers.ranked(publishers.risk(seen, count, score_at).join(publishers.publishers(held), "handle"))
    return {
        "spans": spans, "union": union, "phantoms": reach.phantoms(union, spans), "roster": held, "holders": holders, "risk": risk,
        "union_publishers": publishers.union_holders(union.withColumn("package", package_of(F.col("node"))), maintains),
    }


def who(edges: DataFrame, holdings: DataFrame, versions: DataFrame, **options) -> DataFrame:
    """What an account can reach: dependents of the versions it could publish, over spans in which they exist and it held them.
    holdings: (package, vf, vt); versions: (node, package, published_at)."""
    v = versions.select("node", "package", F.when(F.col("published_at") > 0, F.col("published_at")).otherwise(0).alias("p"))
    held = v.join(holdings, "package").select("node", F.greatest("p", "vf").cast("long").alias("vf"), "vt").where("vf < vt")
    return reach.reverse_reach(edges, held, **options)


def release_node(package: str, version: Column) -> Column:
    return F.concat(F.lit(f"pkg:npm/{package}@"), version)


def incident_report(
    package: str, releases: DataFrame, affects: DataFrame, declared: DataFrame, resolutions: DataFrame, locks: DataFrame, maintains: DataFrame, pairs: DataFrame, at: int,
    advisories: DataFrame | None = None, version: str | None = None, node_of=release_node,
) -> dict[str, DataFrame]:
    """What one compromised release did: the release (`version`, else the package's first affected one), what it changed, the
    advisories against it by severity, who locked a dependent while that resolved to it, who could reach it from their pins,
    accounts and look-alikes near it. node_of: node of a release in `resolutions`; advisories: (osv_id, severity)."""
    from kairograph.operators.typosquat import near_package

    own = affects.where(F.col("package") == package)
    named = own if version is None else releases.where((F.col("package") == package) & (F.col("version") == version)).select("package", "version")
    first = temporal.first_affected(releases.where(F.col("package") == package), named)
    change = lambda column: declared.join(first.select(F.col(column).alias("version")), "version", "left_semi").where(F.col("package") == package).select("name", "range")
    target = first.select(node_of(package, F.col("version")).alias("node"))
    against = own.join(first.select("version"), "version", "left_semi").select("osv_id").distinct()
    if advisories is not None:
        against = incident.by_severity(against.join(advisories, "osv_id"))
    spark = releases.sparkSession
    return {
        "first_affected": first, "dependency_changes": temporal.dependency_diff(change("version"), change("before")), "advisories": against,
        "resolved_while_live": incident.resolved_while_live(resolutions.join(target.select(F.col("node").alias("dst")), "dst", "left_semi"), locks),
        "transitively_exposed": incident.transitively_exposed(resolutions, locks, target),
        "shared_maintainers": incident.shared_maintainers(maintains, spark.createDataFrame([(package,)], "package string"), at), "lookalikes": near_package(pairs, package),
    }


def ci_check(head: dict[str, DataFrame], base: dict[str, DataFrame], reached_versions: DataFrame, affects: DataFrame) -> dict[str, DataFrame]:
    """What a change brings in: accounts that the base doesn't have, and advisories against what the head reaches."""
    return {"new_publishers": publishers.new_publishers(head["roster"], base["roster"]), "advisories": incident.advisories_reached(reached_versions, affects)}
