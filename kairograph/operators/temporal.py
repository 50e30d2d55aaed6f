"""From events to intervals: resolution windows, spells, versions as of an instant, snapshots, first affected releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.functions.intervals import OPEN
from kairograph.functions.semver import looks_prerelease, parse_ranges, satisfies, version_key


def resolution_windows(declarations: DataFrame, releases: DataFrame) -> DataFrame:
    """(declaration, version, vf, vt): which release of the target a declared range resolved to, and when.

    declarations: (declaration, package, range, declared_at); releases: (package, version, published_at), undated ones
    (published_at 0 or null) left out. In publish order (of equal times the higher version last) every release that
    satisfies the range and beats all earlier ones opens a window, which ends when the next opens. Windows are clamped to
    the declaration's own time if that is known.
    """
    known = releases.where("published_at > 0").select("package", "version", "published_at", version_key(F.col("version")).alias("key")).where("key IS NOT NULL")
    candidates = parse_ranges(declarations, "range").join(known, "package").where(satisfies(F.col("key"), F.col("parsed")))
    order = Window.partitionBy("declaration").orderBy("published_at", "key", "version")
    best = F.max("key").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rises = candidates.withColumn("best", best).where("best IS NULL OR key > best")
    opened = rises.select("declaration", "version", "declared_at", F.col("published_at").alias("vf"), F.lead("published_at", 1, OPEN).over(order).alias("vt"))
    start = F.when(F.col("declared_at") > 0, F.greatest("vf", "declared_at")).otherwise(F.col("vf"))
    return opened.select("declaration", "version", start.cast("long").alias("vf"), F.col("vt").cast("long").alias("vt")).where("vf < vt")


def resolution_counts(declarations: DataFrame, releases: DataFrame, windows: DataFrame) -> DataFrame:
    """Declarations by what became of them: resolved, unsatisfied, unparseable, no timeline."""
    timed = releases.select("package", F.lit(True).alias("timed")).distinct()
    done = windows.select("declaration", F.lit(True).alias("done")).distinct()
    status = F.when(F.col("timed").isNull(), "no timeline").when(F.col("parsed").isNull(), "unparseable").when(F.col("done").isNull(), "unsatisfied").otherwise("resolved")
    return parse_ranges(declarations, "range").join(timed, "package", "left").join(done, "declaration", "left").groupBy(status.alias("status")).agg(F.count("*").alias("declarations"))


def spells(observations: DataFrame) -> DataFrame:
    """(package, handle, vf, vt, observed): unbroken runs of observations of an account, to the first one without it.
    observations: (package, ob, handle), a row for each account seen at each time of observation."""
    seen = observations.select("package", "ob", "handle").distinct()
    times = seen.select("package", "ob").distinct()
    of_package = Window.partitionBy("package").orderBy("ob")
    numbered = times.select("package", "ob", F.row_number().over(of_package).alias("n"), F.lead("ob", 1, OPEN).over(of_package).alias("next"))
    of_account = Window.partitionBy("package", "handle").orderBy("n")
    runs = seen.join(numbered, ["package", "ob"]).withColumn("run", F.col("n") - F.row_number().over(of_account))
    return runs.groupBy("package", "handle", "run").agg(F.min("ob").cast("long").alias("vf"), F.max("next").cast("long").alias("vt"), F.count("*").alias("observed")).drop("run")


def versions_as_of(releases: DataFrame, epochs: DataFrame) -> DataFrame:
    """(package, epoch, version): the release current at each epoch: the latest dated one that is no prerelease; of equal
    times the higher. Aggregated, so packages with many releases cost no window."""
    usable = releases.where("published_at > 0").where(~looks_prerelease(F.col("version"))).withColumn("key", version_key(F.col("version")))
    joined = usable.join(F.broadcast(epochs.select("epoch")), F.col("published_at") <= F.col("epoch"))  # a few dozen epochs
    return joined.groupBy("package", "epoch").agg(F.max_by("version", F.struct("published_at", "key", "version")).alias("version"))


def snapshots(releases: DataFrame, dependencies: DataFrame, epochs: DataFrame) -> DataFrame:
    """(epoch, src, dst): what the version of each package that was current at each epoch depends on."""
    current = versions_as_of(releases, epochs)
    return current.join(dependencies.select("package", "version", "dep"), ["package", "version"]).select("epoch", F.col("package").alias("src"), F.col("dep").alias("dst")).distinct()


def epochs(spark, n: int, now: str) -> DataFrame:
    """The starts of the last n quarters at or before `now` (yyyy-MM-dd), as epoch seconds."""
    quarter = F.trunc(F.to_date(F.lit(now)), "quarter")
    return spark.range(1).select(F.explode(F.transform(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), lambda i: F.unix_timestamp(F.add_months(quarter, -3 * i).cast("timestamp")))).alias("epoch"))


def monthly(spark, months: int, now: str) -> DataFrame:
    """Instants a month apart that end at `now`."""
    day = F.to_date(F.lit(now))
    return spark.range(1).select(F.explode(F.transform(F.sequence(F.lit(months), F.lit(0), F.lit(-1)), lambda i: F.unix_timestamp(F.add_months(day, -i).cast("timestamp")))).alias("instant"))


def first_affected(releases: DataFrame, affected: DataFrame) -> DataFrame:
    """(package, version, published_at, before): the earliest published affected release of each package and the release just
    before it (null if it was the first)."""
    order = Window.partitionBy("package").orderBy("published_at", version_key(F.col("version")), "version")
    with_before = releases.withColumn("before", F.lag("version").over(order)).withColumn("place", F.row_number().over(order))
    hit = with_before.join(affected.select("package", "version").distinct(), ["package", "version"], "left_semi")
    return hit.groupBy("package").agg(F.min_by(F.struct("version", "published_at", "before"), "place").alias("first")).select("package", "first.*")


def dependency_diff(after: DataFrame, before: DataFrame) -> DataFrame:
    """(name, change, range_before, range_after): dependencies added, removed or declared otherwise."""
    a, b = after.select("name", F.col("range").alias("range_after"), F.lit(True).alias("a")), before.select("name", F.col("range").alias("range_before"), F.lit(True).alias("b"))
    change: Column = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("range_after") != F.col("range_before"), "changed")
    return a.join(b, "name", "full_outer").select("name", change.alias("change"), "range_before", "range_after").where("change IS NOT NULL")
