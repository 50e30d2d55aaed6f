"""Archives in splits, places in an order, name lists, resumption, streams of spells, and small reports."""

from __future__ import annotations

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from kairograph.functions import text
from kairograph.functions.order import numbered, spread
from kairograph.operators import observatory, publishers, reach, temporal
from kairograph.plans import jobs
from kairograph.sources import archives, feeds, sinks
from kairograph.streaming import frontiers
from kairograph.streaming import spells as spell_stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_one_archive_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(3)
    want = {}
    for name in ("a b.zip", "ü%20.zip"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("folder/", "")
            for i in range(60):
                data = rng.randbytes(rng.choice([0, 1, 700, 3000]))
                z.writestr(zipfile.ZipInfo(f"folder/{i}.bin"), data, compress_type=rng.choice([zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED]))
                want[name, f"folder/{i}.bin"] = data
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    (tmp_path / "nothing.zip").write_bytes(b"")
    found = archives.members(spark, f"file://{tmp_path}", "*.zip")
    assert found.count() == 120 and "content" not in found.columns
    got = archives.contents(found, split_bytes=4096).withColumn("task", F.spark_partition_id()).collect()
    assert {(r["path"].rsplit("/", 1)[1], r["entry"]): bytes(r["content"]) for r in got} == want and len(got) == 120
    assert all(len({r["task"] for r in got if r["path"].endswith(n)}) > 5 for n in ("a b.zip", "ü%20.zip"))
    # members that aren't chosen aren't read: one that is broken does no harm
    some = archives.contents(found.where("entry LIKE '%/7.bin'")).collect()
    assert [bytes(r["content"]) for r in some if r["path"].endswith("b.zip")] == [want["a b.zip", "folder/7.bin"]]


def test_texts_of_an_archive_are_made_valid(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("a.json", b'"\xc3\xa9\xff"')
        z.writestr("b.txt", b"no feed")
    assert rows(feeds.zipped(spark, f"file://{tmp_path}/t.zip")) == [("a.json", '"\u00e9\ufffd"')]


def test_archives_that_cannot_be_read(spark, tmp_path):
    data = bytes(random.Random(1).randbytes(500))
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("good", b"good")
        z.writestr("stored", data)
        z.writestr(zipfile.ZipInfo("odd"), b"o" * 100, compress_type=zipfile.ZIP_BZIP2)
    whole = (tmp_path / "x.zip").read_bytes()
    at = whole.index(data)
    (tmp_path / "x.zip").write_bytes(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
    found = archives.members(spark, f"file://{tmp_path}/x.zip")
    assert [bytes(r["content"]) for r in archives.contents(found.where("entry = 'good'")).collect()] == [b"good"]
    for entry, message in (("stored", "stored don't match"), ("odd", "odd is encrypted or packed by method 12")):
        with pytest.raises(Exception, match=message):
            archives.contents(found.where(F.col("entry") == entry)).collect()
    (tmp_path / "y.zip").write_bytes(b"no archive at all")
    with pytest.raises(Exception, match="y.zip"):
        archives.members(spark, f"file://{tmp_path}/y.zip").collect()


@pytest.mark.parametrize("seed", range(2))
def test_places_equal_a_sorted_list(spark, seed):
    rng = random.Random(seed)
    # one key with half of all rows, keys of one row and a null key
    data = [(rng.choice(["hot", "hot", "hot", None, f"k{rng.randrange(9)}"]), rng.randrange(20), i) for i in range(300)]
    df = spark.createDataFrame(data, "k string, v long, i long").repartition(7)
    want = {r: n for n, r in enumerate(sorted(data, key=lambda r: (-r[1], r[2])), 1)}
    assert {(r["k"], r["v"], r["i"]): r["place"] for r in numbered(df, [F.desc("v"), "i"]).collect()} == want
    inside = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        inside.setdefault(r[0], []).append(r)
    got = numbered(df, ["v", "i"], ["k"]).collect()
    assert {(r["k"], r["v"], r["i"]): r["place"] for r in got} == {r: n for own in inside.values() for n, r in enumerate(own, 1)} and len(got) == 300
    assert numbered(df.where("false"), ["v", "i"], ["k"]).count() == 0


def test_spread_samples_are_even(spark):
    for total in (0, 1, 2, 3, 10, 47):
        df = spark.range(total).select(F.col("id").alias("x"))
        for n in (0, 1, 2, 3, 7, 46, 47, 60):
            want = list(range(total)) if n >= total else sorted({i * (total - 1) // max(1, n - 1) for i in range(n)})
            if total <= 3 or n in (1, 7, 46):
                assert sorted(r["x"] for r in spread(df, n, ["x"]).collect()) == want, (total, n)


def test_ranked_pages_of_names(spark):
    pages = [(2, json.dumps([{"name": "d"}, {"name": "a"}, {"name": ""}])), (1, json.dumps([{"name": "b"}, {"name": "a"}, {"x": 1}, {"name": "c"}]))]
    df = spark.createDataFrame(pages, "page int, content string")
    assert rows(feeds.ranked_names(df)) == [("a", 2), ("b", 1), ("c", 3), ("d", 4)]
    assert rows(feeds.ranked_names(df, 2)) == [("a", 2), ("b", 1)]


def test_work_resumes_behind_what_is_done(spark, tmp_path):
    names, done = spark.createDataFrame([("a",), ("b",), ("c",)], "name string"), f"file://{tmp_path}/done"
    assert rows(sinks.pending(names, spark, done)) == [("a",), ("b",), ("c",)]
    sinks.record_done(names.where("name < 'b'"), done)
    sinks.record_done(names.where("name = 'c'"), done)
    assert rows(sinks.pending(names, spark, done)) == [("b",)]


def test_epochs_are_written_over_one_by_one(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    sinks.write_epochs(spark.createDataFrame([(1, "a"), (2, "b")], "epoch long, x string"), path)
    sinks.write_epochs(spark.createDataFrame([(2, "c"), (3, "d")], "epoch long, x string"), path)
    assert rows(spark.read.parquet(path).select("epoch", "x")) == [(1, "a"), (2, "c"), (3, "d")]


def test_spells_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rng = random.Random(8)
    seen = [(p, ob, sorted(h for h in "uvw" if rng.random() < 0.6)) for ob in range(1, 13) for p in ("k", "l")]
    seen = [s for s in seen if s[2]]
    (tmp_path / "in").mkdir()
    for i in range(3):  # four observations of each package a file
        part = [s for s in seen if (s[1] - 1) // 4 == i]
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"package": p, "ob": ob, "handles": hs}) for p, ob, hs in part))
    stream = spark.readStream.schema("package string, ob long, handles array<string>").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    out = spell_stream.spells(stream).writeStream.outputMode("append").format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c")
    out.trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.parquet(f"file://{tmp_path}/out")
    # of each spell the latest row: it is observed longest, and closed if it ever is
    last = updates.groupBy("package", "handle", "vf").agg(F.max("observed").alias("observed"), F.min("vt").alias("vt")).select("package", "handle", "vf", "vt", "observed")
    table = spark.createDataFrame([(p, ob, h) for p, ob, hs in seen for h in hs], "package string, ob long, handle string")
    assert rows(last) == rows(temporal.spells(table).select("package", "handle", "vf", "vt", "observed"))


def test_a_search_that_fails_says_so(spark):
    edges = spark.createDataFrame([("app", "K", 1, 5)], "src string, dst string, vf long, vt long")
    sources = reach.always(spark.createDataFrame([("app",)], "node string"))
    broken = edges.withColumn("vt", F.raise_error(F.lit("edges are gone")).cast("long"))
    frames = list(frontiers.events(broken, sources))
    assert frames[-1].startswith("event: error\ndata: ") and "edges are gone" in json.loads(frames[-1].split("data: ")[1])["error"]
    assert not any(f.startswith("event: done") for f in frames)


def test_counts_of_versions_and_packages(spark):
    live = spark.createDataFrame([("k@1", "k"), ("k@1", "k"), ("k@2", "k"), ("app", ""), ("x", None)], "node string, package string")
    timeless = live.unionByName(spark.createDataFrame([("l@1", "l"), ("k@3", "k")], "node string, package string"))
    assert tuple(reach.counts(live, timeless).first()) == (1, 4, 2, 6)
    assert tuple(reach.counts(live.where("false"), live.where("false")).first()) == (0, 0, 0, 0)


def test_what_is_asked_for_by_name_or_urn(spark):
    held = spark.createDataFrame([("pkg:npm/a",), ("pkg:npm/pkg:npm/a",), ("pkg:npm/@s/b",)], "package string")
    asked = spark.createDataFrame([("a",), ("pkg:npm/a",), ("@s/b",), ("b",), ("a",)], "asked string")
    assert rows(publishers.held_package(held, asked)) == [("@s/b", "pkg:npm/@s/b"), ("a", "pkg:npm/a"), ("b", None), ("pkg:npm/a", "pkg:npm/a")]


def test_orders_and_display(spark):
    accounts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "handle string, packages long")
    assert [r["handle"] for r in publishers.by_packages(accounts).collect()] == ["c", "a", "b"]
    assert [r["handle"] for r in publishers.by_cut(accounts.withColumnRenamed("packages", "controls")).collect()] == ["c", "a", "b"]
    past = spark.createDataFrame([(3, "k", 7), (1, "k", 8), (2, "l", 100)], "epoch long, node string, kri long")
    assert [r["epoch"] for r in observatory.history_of(past, "k").collect()] == [1, 3]
    assert [r["kri"] for r in observatory.by_exact(past).collect()] == [100, 8, 7]
    assert [r["band"] for r in observatory.with_band(past).orderBy("kri").collect()] == [0, 1, 7]  # 0.455, 0.52, 6.5
    assert spark.range(1).select(text.escaped(F.lit("@types/node"))).first()[0] == "%40types%2Fnode"


def test_verification_counts_dated_versions(spark):
    versions = spark.createDataFrame([("p", "1"), ("p", "1"), ("p", "2"), ("q", "1"), ("z", "1")], "package string, version string")
    timeline = spark.createDataFrame([("p", "1", 5), ("p", "2", 6), ("p", "3", 0), ("q", "1", 5), ("q", "2", 7), ("r", "1", None), ("z", "9", 1)], "package string, version string, published_at long")
    maintains = spark.createDataFrame([("una", "p", 0, 9), ("una", "q", 0, 9), ("viv", "p", 0, 9)], "handle string, package string, vf long, vt long")
    names = spark.createDataFrame([("p", 1), ("q", 2), ("none", 3), ("r", 4), ("z", 5)], "name string, rank long")
    got = jobs.verify(versions, timeline, maintains, names, sample=4, top=1)
    assert [tuple(r) for r in got["counts"].collect()] == [("p", 2, 2, True), ("q", 1, 2, False), ("r", 0, 0, True)]
    assert tuple(got["agreement"].first()) == (2, 3) and [r["handle"] for r in got["maintainers"].collect()] == ["una"]
