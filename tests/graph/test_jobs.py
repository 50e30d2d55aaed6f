"""Whole jobs on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairograph.functions.intervals import OPEN
from kairograph.operators import advisory, reach
from kairograph.plans import jobs
from kairograph.sources.runs import Runs

RELEASES = [("p", "1.0.0", 10), ("p", "1.1.0", 20), ("p", "2.0.0", 30), ("q", "1.0.0", 15), ("q", "1.0.1-rc.1", 16), ("r", "1.0.0", 0)]


def releases(spark):
    return spark.createDataFrame(RELEASES, "package string, version string, published_at long")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_resolving_writes_windows_and_outcomes(spark, tmp_path):
    runs = Runs(spark, f"file://{tmp_path}/r")
    declared = spark.createDataFrame([("a", "p", "^1.0.0", 12), ("b", "p", "git+x", 0), ("c", "p", "^9.0.0", 0), ("d", "none", "*", 0), ("e", "q", "*", 0)], "declaration string, package string, range string, declared_at long")
    counts = jobs.resolve(runs, 1, declared, releases(spark))
    assert counts == {"resolves": 3, "resolves.open": 2, "outcomes": 4, "outcomes.declarations": 5}
    assert rows(runs.read("resolves").drop("run")) == [("a", "1.0.0", 12, 20), ("a", "1.1.0", 20, OPEN), ("e", "1.0.0", 15, OPEN)]
    assert {r["status"]: r["declarations"] for r in runs.read("outcomes").collect()} == {"resolved": 2, "unparseable": 1, "unsatisfied": 1, "no timeline": 1}


def test_advisories_are_written_once(spark, tmp_path):
    runs = Runs(spark, f"file://{tmp_path}/a")
    kind = "osv_id string, published_at long, severity array<struct<type:string,score:string>>, database_specific struct<severity:string>, affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,events:" + advisory.EVENTS + ">>,versions:array<string>>>"
    record = ("A", 5, [("CVSS_V3", "7.1")], ("HIGH",), [(("npm", "p"), [("SEMVER", [("1.1.0", None, None)])], [])])
    counts = jobs.advisories(runs, 1, spark.createDataFrame([record, record], kind), releases(spark))
    assert counts == {"advisories": 1, "affects": 2, "affects.unfixed": 2}
    assert rows(runs.read("advisories").drop("run")) == [("A", 5, "HIGH", 7.1)]
    assert rows(runs.read("affects").select("version")) == [("1.1.0",), ("2.0.0",)]


def test_typosquats_are_written(spark, tmp_path):
    runs = Runs(spark, f"file://{tmp_path}/t")
    assert jobs.typosquats(runs, 1, spark.createDataFrame([("left-pad", 3), ("leftpad", 900), ("other", 1)], "name string, rank long")) == {"typosquats": 1}
    assert rows(runs.read("typosquats").select("popular", "lookalike")) == [("left-pad", "leftpad")]


def test_an_observatory_run(spark, tmp_path):
    runs = Runs(spark, f"file://{tmp_path}/o")
    deps = spark.createDataFrame([("p", "1.0.0", "q"), ("p", "2.0.0", "r"), ("q", "1.0.0", "s")], "package string, version string, dep string")
    epochs = spark.createDataFrame([(25,), (40,)], "epoch long")
    maintains = spark.createDataFrame([("una", "q", 0, 30), ("una", "s", 0, OPEN)], "handle string, package string, vf long, vt long")
    counts = jobs.observe(runs, 3, releases(spark), deps, epochs, maintains, sample=10)
    # at 25 the current p is 1.1.0, which has no dependencies
    assert rows(runs.read("snapshots").drop("run")) == [(25, "q", "s"), (40, "p", "r"), (40, "q", "s")]
    assert rows(runs.read("kri_history").drop("run")) == [(25, "q", 1, False), (25, "s", 2, False), (40, "p", 1, True), (40, "q", 1, True), (40, "r", 2, True), (40, "s", 2, False)]
    assert rows(runs.read("kri_latest").select("node", "kri", "kri_at")) == [("p", 1, 40), ("q", 1, 40), ("r", 2, 40), ("s", 2, 40)]
    assert counts == {"snapshots": 3, "kri_history": 6, "kri_history.orphaned": 3, "kri_latest": 4, "validation": 6, "validation.outside": 0}


def test_a_path_for_each_package_of_an_account(spark):
    edges = spark.createDataFrame([("app", "k@1", 0, 9), ("k@1", "l@1", 2, 5), ("app", "m@1", 0, 9)], "src string, dst string, vf long, vt long")
    sources = reach.always(spark.createDataFrame([("app",), ("n@1",)], "node string"))
    maintains = spark.createDataFrame([("una", "l", 3, 4), ("una", "m", 20, 30), ("una", "n", 0, 3), ("viv", "k", 0, 9)], "handle string, package string, vf long, vt long")
    got = jobs.path(edges, sources, maintains, "una", lambda c: F.split_part(c, F.lit("@"), F.lit(1))).collect()
    assert [(r["package"], r["found"], r["path"]) for r in got] == [("l", True, ["app", "k@1", "l@1"]), ("n", False, None)]
    urns = spark.createDataFrame([("l",), ("k",)], "asked string")
    asked = jobs.path(edges, sources, maintains.withColumn("package", F.concat(F.lit("pkg:npm/"), "package")), "una", lambda c: F.concat(F.lit("pkg:npm/"), F.split_part(c, F.lit("@"), F.lit(1))), asked=urns).collect()
    assert [(r["package"], r["path"]) for r in asked] == [("pkg:npm/l", ["app", "k@1", "l@1"])]
