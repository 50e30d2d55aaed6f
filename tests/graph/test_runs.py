"""Tables by runs, a stream that is cut off, and lookups in lock files."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from kairograph.operators import scopes
from kairograph.sources import lockfiles
from kairograph.sources.runs import Runs
from kairograph.streaming import ingest


def documents(seed, n):
    """Timeline documents, one a line; packages come again with more versions and changed ones."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        listed = [{"versionKey": {"version": f"1.{v}.0"}, "publishedAt": rng.choice(["2020-01-01T00:00:00Z", "2021-05-06T07:08:09Z", None]), "isDeprecated": rng.random() < 0.3} for v in range(rng.randint(1, 4))]
        out.append({"package": rng.choice(["k", "l", "@m/n"]), "content": json.dumps({"versions": listed})})
    return out


def stream(spark, folder):
    return spark.readStream.schema("package string, content string").option("maxFilesPerTrigger", 1).json(f"file://{folder}")


def state(spark, root):
    return {name: sorted(map(tuple, Runs(spark, root).latest(name, keys).collect())) for name, keys in ingest.KEYS.items()}


def test_a_stream_that_is_cut_off_ends_with_the_same_tables(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(4):
        (source / f"{i}.json").write_text("\n".join(map(json.dumps, documents(i, 6))))
    whole, broken = f"file://{tmp_path}/whole", f"file://{tmp_path}/broken"
    ingest.ingest(stream(spark, source), whole, f"file://{tmp_path}/c1", once=True).awaitTermination()
    left = {"failures": 2}

    def failing(batch):
        tables = ingest.registry_tables(batch)
        if left["failures"] and Runs(spark, broken).ledger().count() == 3 - left["failures"]:  # in its second and third batch, after one table
            left["failures"] -= 1
            tables["versions"] = tables["versions"].withColumn("deprecated", F.raise_error(F.lit("lost")).cast("boolean"))
        return tables

    seen = []
    for attempt in range(3):
        query = ingest.ingest(stream(spark, source), broken, f"file://{tmp_path}/c2", tables=failing, once=True)
        if attempt < 2:
            with pytest.raises(Exception, match="lost"):
                query.awaitTermination()
        else:
            query.awaitTermination()
        runs = {r["run"] for r in Runs(spark, broken).ledger().collect()}
        seen.append(sorted(runs))
        for name in ingest.KEYS:  # whole runs only, also of the table that was written
            assert {r["run"] for r in Runs(spark, broken).read(name).select("run").distinct().collect()} == runs
    assert seen == [[0], [0, 1], [0, 1, 2, 3]]
    assert state(spark, broken) == state(spark, whole)
    assert Runs(spark, broken).read("versions").count() == Runs(spark, whole).read("versions").count()


def test_counters_equal_recounts(spark, tmp_path):
    runs = Runs(spark, f"file://{tmp_path}/t")
    assert runs.ledger().count() == 0
    for run in range(2):
        batch = spark.createDataFrame([(d["package"], d["content"]) for d in documents(run + 9, 7)], "package string, content string")
        counts = runs.write(run, ingest.registry_tables(batch), ingest.COUNTERS)
        assert runs.write(run, {"versions": batch}) == counts  # finished, not written again
    for r in runs.ledger().collect():
        rows = runs.read("versions").where(F.col("run") == r["run"]).collect()
        assert r["counts"] == {
            "packages": runs.read("packages").where(F.col("run") == r["run"]).count(), "versions": len(rows),
            "versions.undated": sum(x["published_at"] == 0 for x in rows), "versions.deprecated": sum(x["deprecated"] for x in rows),
        }
    newest = {}
    for r in runs.read("versions").orderBy("run", "published_at", "deprecated").collect():
        newest[r["urn"]] = (r["urn"], r["package"], r["version"], r["published_at"], r["deprecated"])
    assert sorted(map(tuple, runs.latest("versions", ("urn",)).select("urn", "package", "version", "published_at", "deprecated").collect())) == sorted(newest.values())
    assert runs.write(7, {"versions": ingest.registry_tables(batch.where("false"))["versions"]}) == {"versions": 0}


def test_lookup_walks_up_like_a_loop(spark):
    rng = random.Random(4)
    names = ["a", "b", "@s/c", "d"]
    files, want = [], {}
    for f in range(12):
        places = {""}
        for _ in range(12):
            scope = rng.choice(sorted(places) + ["packages/w"])
            places.add((scope + "/" if scope else "") + "node_modules/" + rng.choice(names))
        packages = {p: {"version": f"1.{i}.0", "dependencies": {n: f"^{i}" for n in rng.sample(names, rng.randint(0, 3))}} for i, p in enumerate(sorted(places | {"packages/w"}))}
        packages[""]["devDependencies"] = {"d": "*"}
        path = f"{f}/package-lock.json"
        files.append((path, json.dumps({"packages": packages})))
        for place, entry in packages.items():
            for n, r in {**({"d": "*"} if place == "" else {}), **entry["dependencies"]}.items():
                folder, at = place, None
                while at is None:
                    tried = (folder + "/" if folder else "") + "node_modules/" + n
                    if tried in packages and not folder.endswith("node_modules"):
                        at = tried
                    elif not folder:
                        break
                    folder = folder.rpartition("/")[0]
                want[path, place, n] = (r, at, at and packages[at]["version"])
    table = spark.createDataFrame(files, "path string, content string")
    rows = scopes.nearest_scope(lockfiles.requirements(table), lockfiles.entries(table)).collect()
    assert len(rows) == len(want) and {(r["path"], r["place"], r["name"]): (r["range"], r["resolved_place"], r["version"]) for r in rows} == want


def test_agreement_counts(spark):
    windows = spark.createDataFrame([("p#1", "1.0.0", 10, 20), ("p#1", "1.1.0", 20, 30)], "declaration string, version string, vf long, vt long")
    locked = [("p#1", "1.0.0", 10), ("p#1", "1.0.0", 10), ("p#1", "1.0.0", 20), ("p#1", "1.1.0", 29), ("p#1", "1.1.0", 30), ("q#1", "1.0.0", 15)]
    got = scopes.agreement(spark.createDataFrame(locked, "declaration string, version string, locked_at long"), windows).collect()
    assert {(r["verdict"], r["locks"], r["rate"]) for r in got} == {("agree", 3, 0.75), ("disagree", 1, 0.75), ("no window", 2, 0.75)}
    assert scopes.agreement(spark.createDataFrame([], "declaration string, version string, locked_at long"), windows).count() == 0
