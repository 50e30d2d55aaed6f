"""Operators on pairs: components, n-gram joins, vector searches."""

from __future__ import annotations

import contextlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from kairograph.llm import jaccard_join, mtree, multi_index
from kairograph.llm.components import connected_components


def roots_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    chain = list(range(1000, 1040))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(5, i) for i in range(6, 60)] + [(7, 7), (3, 2), (2, 3), (2, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == roots_of(got, links)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2)) if len(words) >= 3 else frozenset([tuple(words)] if words else [])


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    root = roots_of({i for i, _ in rows}, links)
    return sorted((i, len(s), root[i]) for (i, _), s in zip(rows, sets, strict=True))


def corpus(seed, n):
    """Copies, chains of small changes, shared passages, short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("aeiou") + rng.choice("klmnopqrst")
    texts = [None, "", " \t", "One", "one", "One two", "one two three", "ONE two three", "é É x", "a b c d"]
    passage = [word() for _ in range(40)]
    for _ in range(n):
        base = [word() for _ in range(rng.choice((8, 11, 12, 30, 60, 150)))] + passage * rng.randint(0, 1)
        for _ in range(rng.choice((1, 1, 2, 6))):
            texts.append(" ".join(base))
            if rng.random() < 0.8:
                base = list(base)
                base[rng.choice((0, -1, rng.randrange(len(base))))] = word()
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 4)])
def test_join_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = corpus(seed, 60)
    got = jaccard_join.join(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, node int"))
    assert sorted(map(tuple, got.collect())) == brute_join(rows)


def test_join_of_one_large_drifting_group(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        rows.append((i, " ".join(base)))
        base = list(base)
        base[rng.randrange(80)] = f"n{i}"
    assert sorted(map(tuple, jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute_join(rows)


def test_frequent_tokens_are_indexed_in_pairs():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(10, 120))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        most = len(x) // 9
        gone = int(rng.integers(0, min(most, len(x) // 10) + 1))
        new = int(rng.integers(0, most - gone + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 2**63, new).astype(np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if 100 * shared < 90 * (len(x) + len(y) - shared):
            continue
        for frequent in (0, 3, 5, 9):  # all tokens frequent, some, none
            keys = [jaccard_join.prefix_keys(s, (s % np.uint64(9)).astype(np.uint8), frequent, (90, 100)) for s in (x, y)]
            assert np.intersect1d(*keys).size, (len(x), len(y), shared, frequent)


def test_join_takes_odd_tables(spark):
    table = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (9, "w " * 100_000), (None, "q r s t")], "doc_id long, text string")
    rows = sorted(jaccard_join.join(table).collect(), key=str)
    assert [(r["doc_id"], r["component_id"]) for r in rows if r["n_shingles"] == 3] == [(4, 4), (4, 4), (None, 4)]
    assert jaccard_join.join(table.where("false")).count() == 0
    assert sorted(str(r["doc_id"]) for r in jaccard_join.keep_first(table).collect()) == ["4", "9", "None"]


def test_one_row_of_each_group_stays(spark):
    one, two, near = "a b c d e f g", "h i j k l m n", " ".join(f"w{i}" for i in range(60))
    rows = [(None, one), (None, one), (7, two), (7, one), (8, two), (3, near), (None, near + " x"), (5, ""), (5, ""), (None, None), (6, "lone words stand here")]
    table = spark.createDataFrame([(*r, f"clash{i}", i, 0) for i, r in enumerate(rows)], "doc_id long, text string, node string, n int, digest int")
    kept = jaccard_join.keep_first(table)
    assert kept.columns == table.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(7, one), (7, two), (3, near), (5, ""), (5, ""), (None, None), (6, "lone words stand here")], key=str)
    assert jaccard_join.keep_first(table.where("false")).count() == 0
    assert jaccard_join.keep_first(table.where("doc_id IS NULL AND text LIKE 'a%'")).count() == 1


def vectors(seed, n, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, width)) * rng.choice([0.05, 0.2, 0.6], n)[:, None]
    x[n // 2] = x[0]
    return x.astype(np.float32)


ODD = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] + [1.0] * 15), (9005, [None] + [1.0] * 15), (9006, [float("inf")] * 16), (9007, [1.0, 2.0]), (9008, [1.0, 2.0])]


def table(spark, x, more=()):
    return spark.createDataFrame([(i, v.tolist(), 1, 7) for i, v in enumerate(x)] + [(i, v, 0, 7) for i, v in more], "vec_id long, embedding array<float>, label int, node int")


def test_multi_index_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "RESIDENTS", 64)
    monkeypatch.setattr(multi_index, "VISITORS", 50)
    x = vectors(1, 900)
    got = {r["vec_id"]: r for r in multi_index.near_duplicates(table(spark, x, ODD), recall=1.0).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found >= 0.9 * near.sum() and all(got[i]["n_links"] <= near[i].sum() for i in range(len(x)))
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(x)))
    assert [(got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i, _ in ODD[:6]] == [(0, i, True) for i, _ in ODD[:6]]
    assert (got[9007]["n_links"], got[9008]["component_id"], got[9008]["kept"]) == (1, 9007, False)


def test_multi_index_copies_and_empty_tables(spark):
    x = np.repeat(vectors(2, 3), 40, axis=0)
    rows = multi_index.near_duplicates(table(spark, x)).collect()
    assert all(r["n_links"] >= 39 for r in rows)
    assert multi_index.near_duplicates(table(spark, x).where("false")).count() == 0


def unit(y):
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def test_multi_index_recall_on_the_table(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    y = unit(np.stack(v.toPandas()["embedding"]).astype(float))
    y[1::2] = (y[::2] * 0.92 + y[1::2] * np.sqrt(1 - 0.92**2))[: len(y[1::2])]  # partners near the threshold
    y = unit(y)
    near = y @ y.T >= 0.9
    grid = multi_index.fitted(list(y), len(y), 0.9, multi_index.RECALL)[64]
    assert grid.words**2 >= 100 and grid.visits < grid.words**2 / 4
    got = multi_index.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vec_id long, embedding array<double>"))
    assert got.agg(F.sum("n_links")).first()[0] >= 0.9 * (near.sum() - len(y))


@pytest.mark.parametrize("length,size", [(64, 50_000_000), (768, 500_000), (768, 5_000_000)])
def test_recall_on_vectors_that_the_grid_does_not_know(length, size):
    rng = np.random.default_rng(length + size)
    words = multi_index.words_for(size)
    grid = multi_index.Grid(unit(rng.normal(size=(max(multi_index.SAMPLE, 32 * words), length))), words, 0.9, multi_index.RECALL)
    u = unit(rng.normal(size=(2000, length)))
    g = rng.normal(size=u.shape)
    v = 0.9 * u + np.sqrt(1 - 0.81) * unit(g - (g * u).sum(1, keepdims=True) * u)
    a, b, from_u, from_v = grid.home(u), grid.home(v), grid.nearest(u), grid.nearest(v)
    met = [x == y or (y in from_u[i] if x < y else x in from_v[i]) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    assert np.mean(met) >= 0.98 and grid.visits < words**2 / 8


def test_multi_index_recall_at_a_larger_size(spark, tmp_path):
    rng = np.random.default_rng(6)
    y = unit(rng.normal(size=(50_000, 64)))
    g = rng.normal(size=(500, 64))
    g = unit(g - (g * y[:500]).sum(1, keepdims=True) * y[:500])
    cos = rng.uniform(0.905, 0.95, 500)[:, None]
    y[500:1000] = cos * y[:500] + np.sqrt(1 - cos**2) * g  # 500 planted pairs; no other pair is near
    grid = multi_index.fitted(list(y[rng.permutation(len(y))[: multi_index.SAMPLE]]), len(y), 0.9, multi_index.RECALL)[64]
    assert grid.visits < grid.words**2 / 4
    pq.write_table(pa.table({"vec_id": np.arange(len(y)), "embedding": pa.FixedSizeListArray.from_arrays(y.astype(np.float32).ravel(), 64).cast(pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    table_ = spark.read.parquet(f"file://{tmp_path}/v.parquet")
    linked = {r["vec_id"]: r["component_id"] for r in multi_index.near_duplicates(table_).where("n_links > 0").collect()}
    assert set(linked) <= set(range(1000)) and all(c == i % 500 for i, c in linked.items())
    assert len(linked) >= 0.9 * 1000


def brute_top(ids, x, chosen, k):
    out = []
    for q in chosen:
        scores = x @ x[q]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k]
        out += [(int(ids[q]), r + 1, int(ids[i]), int(scores[i])) for r, i in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("page,queries,scale", [(2048, 4096, 64), (40, 16, 2)])
def test_tree_search_equals_brute_force(spark, monkeypatch, page, queries, scale):
    monkeypatch.setattr(mtree, "PAGE", page)
    monkeypatch.setattr(mtree, "QUERIES", queries)
    x = vectors(3, 1500)
    got = mtree.search(table(spark, x, ODD[:6]), F.col("vec_id") % 20 == 0, k=20, scale=scale, sample=256)
    whole = np.floor(scale * x.astype(float)).astype(np.int64)
    assert sorted(map(tuple, got.collect())) == brute_top(np.arange(len(x)), whole, range(0, len(x), 20), 20)


def test_tree_search_passes_over_most_distances_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 400)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(0, 60, 3000)] + 0.05 * rng.normal(size=(3000, 16))).astype(np.float32)
    rows = mtree.search(table(spark, x), F.col("vec_id") % 20 == 0, counted=True).collect()
    whole = np.floor(64 * x.astype(float)).astype(np.int64)
    assert sorted(tuple(r)[:4] for r in rows) == brute_top(np.arange(len(x)), whole, range(0, len(x), 20), 20)
    taken = {r["query_id"]: r["computed"] for r in rows}
    assert len(taken) == 150 and sum(taken.values()) < 0.5 * len(taken) * len(x)


def test_split_keeps_the_bounds_of_a_metric_tree():
    x = np.concatenate([np.floor(64 * vectors(5, 700)).astype(np.int64), np.zeros((90, 16), np.int64)])
    largest = int((x**2).sum(1).max())
    t = mtree.split(x, largest, 10)
    far = mtree.apart(x, x, largest)
    assert sorted(t.order) == list(range(len(x))) and (t.stop - t.start).max() <= 10
    below = {}
    for node in reversed(range(len(t.pivot))):
        kids = range(t.first[node], t.last[node])
        below[node] = [r for c in kids for r in below[c]] or t.order[t.start[node] : t.stop[node]].tolist()
        assert len(kids) <= mtree.FAN_OUT and far[t.pivot[node], below[node]].max() <= t.radius[node] + 1e-6
        assert all(abs(far[t.pivot[node], t.pivot[c]] - t.parent_distance[c]) < 1e-6 for c in kids)


def test_tree_search_takes_odd_tables(spark):
    few = table(spark, vectors(4, 5), [*ODD, (None, [1.0] * 16), (3, [0.5] * 16)])
    rows = sorted(map(tuple, mtree.search(few.union(few), F.col("vec_id") >= 0, k=20).collect()))
    held = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in [*enumerate(vectors(4, 5).astype(float)), *ODD, (3, [0.5] * 16)] if v is not None and len(v) and None not in list(v) and np.isfinite(list(v)).all()] * 2
    want = []
    for a, (q, v) in enumerate(held):  # every row but the query's own, also rows of its id
        others = sorted((-int(v @ w), i) for b, (i, w) in enumerate(held) if b != a and len(w) == len(v))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(others[:20])]
    assert rows == sorted(want)
    assert mtree.search(few.where("false"), F.col("vec_id") >= 0).count() == 0


def test_tree_search_sends_no_task_s_own_sample_to_the_driver_and_no_vectors_to_every_machine(spark):
    """Each task's lowest `sample` rows would grow with the tasks; files of small numbers look small enough to broadcast."""
    held = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "64k"}
    before = {n: spark.conf.get(n) for n in held}
    store, sql = spark.sparkContext._jsc.sc().statusStore(), spark._jsparkSession.sharedState().statusStore()
    done = sql.executionsCount()
    x = vectors(6, 40 * 80, 256)
    try:
        for n, v in held.items():
            spark.conf.set(n, v)
        spark.sparkContext.setJobGroup("sampled", "sampled")
        got = mtree.search(table(spark, x).repartition(40), F.col("vec_id") % 20 == 0, k=3, sample=64).collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    whole = np.floor(64 * x.astype(float)).astype(np.int64)
    assert sorted(map(tuple, got)) == brute_top(np.arange(len(x)), whole, range(0, len(x), 20), 3)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    sent = []
    for job in spark.sparkContext.statusTracker().getJobIdsForGroup("sampled"):
        for stage in spark.sparkContext.statusTracker().getJobInfo(job).stageIds:
            with contextlib.suppress(Py4JJavaError):  # stages that were skipped have no attempt
                sent.append(store.lastStageAttempt(stage).resultSize())
    assert 64 * 256 * 8 < max(sent) < 4 * 64 * 256 * 8  # 64 vectors of 256 numbers, not those of 40 tasks
    plans = [sql.executionsList(done, 1000).apply(i).physicalPlanDescription() for i in range(sql.executionsCount() - done)]
    sends = [p for plan in plans for p in re.findall(r"BroadcastExchange\nInput \[\d+\]: \[(.*)\]", plan)]
    assert sends and not [p for p in sends if re.search(r"\bx#", p)]
