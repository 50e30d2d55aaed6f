"""What keeps a task's and the driver's memory small on large tables, seen on small ones."""

from __future__ import annotations

import contextlib
import io
import json
import random

import duckdb
import pytest

from kairograph.functions import intervals
from kairograph.functions.lineage import written
from kairograph.operators import scopes
from kairograph.plans import queries, views
from kairograph.sources import lockfiles


def plan_of(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain()
    return out.getvalue()


def test_nearest_scope_sends_no_parsed_rows_to_every_machine(spark):
    # ranges, whose estimated size is small, as that of rows out of parsed files is
    needs = spark.range(3).selectExpr("'f' AS path", "concat('node_modules/p', id) AS place", "concat('p', id + 1) AS name", "'*' AS range")
    entries = spark.range(3).selectExpr("'f' AS path", "concat('node_modules/p', id) AS place", "concat('1.', id, '.0') AS version")
    found = scopes.nearest_scope(needs, entries)
    assert "Broadcast" not in plan_of(found)
    assert sorted((r["name"], r["resolved_place"], r["version"]) for r in found.collect()) == [("p1", "node_modules/p1", "1.1.0"), ("p2", "node_modules/p2", "1.2.0"), ("p3", None, None)]


def test_scopes_are_looked_up_within_the_task_that_has_the_file(spark):
    """Lines are shuffled once by order; what is parsed, several times as much, isn't."""
    plan = plan_of(queries.nearest_scope(spark, "/root/testdata/sf0.001"))
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_scopes_in_files_equal_those_of_rows(spark, monkeypatch):
    """Workspaces, links, entries without a version, ranges for development only, and files with nothing to look up."""
    monkeypatch.setattr(scopes, "FILES", 3)  # 40 files in several turns
    rng = random.Random(4)
    files = [(f"x{i}/package-lock.json", c) for i, c in enumerate([None, "", "[]", "{}", '{"packages":{}}', '{"packages":{"":{"dependencies":{"a":"1"}}}}', '{"dependencies":{"a":{"version":"1.0.0"}}}'])]
    files.append(("yarn.lock", '{"packages":{"":{"dependencies":{"a":"1"}}}}'))
    for i in range(40):
        packages = {"": {"dependencies": {n: "*" for n in rng.sample("abcd", 2)}, "devDependencies": {n: "^1" for n in rng.sample("abcd", 2)}}}
        for _ in range(rng.randrange(12)):
            place = rng.choice(["", "packages/w", "packages/node_modules"]) + "".join(f"/node_modules/{rng.choice('abcd')}" for _ in range(rng.randrange(1, 4)))
            entry = {"version": f"{rng.randrange(9)}.0.0"} if rng.random() < 0.8 else {}
            packages[place.lstrip("/") if rng.random() < 0.9 else place] = entry | rng.choice([{}, {"link": True}, {"dependencies": {n: f"~{n}" for n in rng.sample("abcde", 2)}}])
        files.append((f"d{i}/package-lock.json", json.dumps({"packages": packages})))
    table = spark.createDataFrame(files, "path string, content string")
    want = scopes.nearest_scope(lockfiles.requirements(table), lockfiles.entries(table))
    found = scopes.nearest_scope_in_files(lockfiles.scoped(table))
    assert found.columns == want.columns and found.dtypes == want.dtypes
    rows = sorted(map(tuple, found.collect()), key=str)
    assert rows == sorted(map(tuple, want.collect()), key=str)
    assert any(r[4] is None for r in rows) and any(r[4] and r[5] is None for r in rows) and any(r[4] and r[4].count("node_modules") > 1 for r in rows)
    again = spark.createDataFrame([("package-lock.json", '{"packages":{"":{"dependencies":{"a":"1"}},"node_modules/a":{"version":"1.0.0"},"node_modules/a":{"version":"2.0.0"},"node_modules/a":{}}}')], "path string, content string")
    assert [tuple(r) for r in scopes.nearest_scope_in_files(lockfiles.scoped(again)).collect()] == [("package-lock.json", "", "a", "1", "node_modules/a", "2.0.0")]


@pytest.fixture(scope="module")
def odd_tables(tmp_path_factory):
    """Repeated lines and orders, lines without a part or an order, orders of one part, orders without a date."""
    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT * FROM (VALUES (1, 5), (1, 5), (1, 3), (1, 9), (2, 5), (2, NULL), (2, 8), (3, 4), (4, 1), (4, 2), (NULL, 7), (NULL, 6), (5, 3), (5, 5), (5, 9), (6, 1), (6, 2)) v(l_orderkey, l_partkey)")
    con.execute("CREATE TABLE orders AS SELECT k AS o_orderkey, k % 2 AS o_custkey, CAST(t AS TIMESTAMP) AS o_orderdate FROM (VALUES (1, '1996-01-01'), (1, '1996-01-01'), (2, '1996-01-02'), (3, '1996-01-03'), (4, NULL), (5, '1996-01-01'), (NULL, '1996-01-01')) v(k, t)")
    for t in ("lineitem", "orders"):
        con.execute(f"COPY (SELECT * REPLACE (CAST({'l_orderkey' if t == 'lineitem' else 'o_orderkey'} AS BIGINT) AS {'l_orderkey' if t == 'lineitem' else 'o_orderkey'}) FROM {t}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder), con


@pytest.mark.parametrize("name", ["dep_edges", "locks"])
def test_made_views_equal_their_text(spark, odd_tables, name):
    folder, con = odd_tables
    made = views.view(spark, folder, name)
    columns = ", ".join(made.columns)
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, con.execute(views.with_views([name], f" SELECT {columns} FROM {name}")).fetchall()))


@pytest.mark.parametrize("name", ["dep_edges", "locks"])
def test_a_task_of_the_views_has_a_share_of_all_rows(spark, odd_tables, name):
    plan = plan_of(views.view(spark, odd_tables[0], name))
    assert plan.count("REPARTITION_BY_NUM") == 2  # by order, then by what is distinct
    # what a task holds before the shuffle are no distinct rows of its own
    last = plan.index("REPARTITION_BY_NUM")
    assert plan[:last].count("HashAggregate") == 2 and "HashAggregate" not in plan[last : plan.rindex("REPARTITION_BY_NUM")]


def test_intervals_merge_by_one_sort_and_no_table(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 1, 2), ("a", 5, 6), ("a", 8, 9), ("a", 7, 7), ("b", 3, 4), (None, 1, 3), (None, 2, 9)], "node string, vf long, vt long")
    merged = intervals.coalesce(rows)
    plan = plan_of(merged)  # before it runs, or it is there twice
    assert plan.count("Sort ") == 1 and "Aggregate" not in plan
    assert sorted(map(tuple, merged.collect()), key=str) == [("a", 0, 6), ("a", 8, 9), ("b", 3, 4), (None, 1, 9)]


@pytest.mark.parametrize("name", ["dep_edges", "locks"])
def test_tasks_of_the_views_follow_the_lines(spark, odd_tables, name, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    assert f", {cores})" in plan_of(views.view(spark, odd_tables[0], name)).split("REPARTITION_BY_NUM")[0].rsplit("hashpartitioning", 1)[1]
    monkeypatch.setattr(views, "LINES", 1)
    assert views.view(spark, odd_tables[0], name).rdd.getNumPartitions() == max(cores, 17)


def test_a_sweep_holds_no_table_of_what_is_known(spark):
    """Known spans are sorted only, and all ends of an instant count at once, whichever side they come from."""
    new = spark.createDataFrame([("a", 0, 5), ("a", 0, 5), ("a", 7, 9), ("b", 1, 2)], "node string, vf long, vt long")
    known = spark.createDataFrame([("a", 2, 5), ("a", 5, 7), ("b", 1, 2), ("c", 0, 1)], "node string, vf long, vt long")
    left = intervals.minus(new, known)
    assert plan_of(left).count("HashAggregate") == 2  # ends of the new ones, before and after their shuffle
    assert "keys=[node" in plan_of(left) and plan_of(left).index("HashAggregate") > plan_of(left).index("Union")
    branches = plan_of(left)[plan_of(left).index("Union") :]
    assert branches.rindex("HashAggregate") < branches.rindex("Generate")
    assert "HashAggregate" not in branches[branches.index("Generate") :]  # the second branch has none
    assert sorted(map(tuple, left.collect())) == [("a", 0, 2), ("a", 7, 9)]


@pytest.fixture(scope="module")
def odd_lines(tmp_path_factory):
    """Lines again, lines of one second but two instants, and lines without an account, a part, a date, a number or a quantity."""
    folder = tmp_path_factory.mktemp("lines")
    con = duckdb.connect()
    con.execute("""CREATE TABLE lineitem AS SELECT CAST(s AS BIGINT) AS l_suppkey, CAST(p AS BIGINT) AS l_partkey, CAST(t AS TIMESTAMP) AS l_shipdate, n AS l_linenumber, CAST(q AS DOUBLE) AS l_quantity FROM (VALUES
      (1, 5, '1996-01-01', 1, 41), (1, 5, '1996-01-01', 1, 41), (1, 5, '1996-02-01', 2, 40), (1, 6, '1996-01-01', 3, 7), (1, 6, '1996-01-01', 4, 7), (2, 5, '1996-01-01 00:00:00.2', 1, 1), (2, 5, '1996-01-01 00:00:00.7', 1, 1),
      (2, 6, '1996-01-01', 1, 1), (2, 6, NULL, 1, 1), (3, 6, NULL, NULL, NULL), (NULL, 5, '1996-01-01', 2, 50), (NULL, 5, '1996-01-03', 2, 50), (4, NULL, '1996-01-01', 5, 2), (4, NULL, '1996-01-05', 5, 2)) v(s, p, t, n, q)""")
    con.execute(f"COPY lineitem TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    return str(folder), con


@pytest.mark.parametrize("name", ["holds", "sampled"])
def test_views_of_lines_equal_their_text_and_hold_a_share(spark, odd_lines, name):
    folder, con = odd_lines
    made = views.view(spark, folder, name)
    plan, columns = plan_of(made), ", ".join(made.columns)
    assert plan.count("Exchange ") == 1 and "Aggregate" not in plan[plan.index("Exchange ") :]  # no table of all lines before the shuffle
    # epoch() of duckdb has fractions, which its cast rounds and Spark's unix_timestamp cuts off: whole seconds are asked for
    text = views.with_views([name], f" SELECT {columns} FROM {name}").replace("epoch(l_shipdate)", "floor(epoch(l_shipdate))")
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, con.execute(text).fetchall()))


def test_steps_after_the_views_have_as_many_tasks_as_the_lines_ask_for(spark, odd_tables, monkeypatch):
    """Spark never cuts a shuffle partition, so a session's fixed number of them must not be all that a search has."""
    name, monkey = "spark.sql.shuffle.partitions", monkeypatch.setattr
    before = spark.conf.get(name)
    try:
        monkey(views, "LINES", 1)
        spark.conf.set(name, "2")
        edges = views.view(spark, odd_tables[0], "dep_edges")
        merged = intervals.coalesce(edges.select("dst", "vf", "vt"), ["dst"])
        asked = max(spark.sparkContext.defaultParallelism, 17)
        assert f"hashpartitioning(dst#{plan_of(merged).split('hashpartitioning(dst#')[1].split(',')[0]}, {asked})" in plan_of(merged)
        spark.conf.set(name, "300")  # a session that has more keeps them
        assert views.view(spark, odd_tables[0], "locks").columns and spark.conf.get(name) == "300"
    finally:
        spark.conf.set(name, before)


def test_reads_of_steps_have_as_many_tasks_as_the_lines_ask_for(spark, odd_tables, monkeypatch):
    """A step's files are not dealt to one task a core, whose tables would grow with the lines."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.files.minPartitionNum")
    before, cores = {n: spark.conf.get(n, None) for n in names}, spark.sparkContext.defaultParallelism
    try:
        spark.conf.unset(names[1])
        files = written(spark.range(0, 17, 1, 17))
        assert files.rdd.getNumPartitions() <= cores + 1
        views.view(spark, odd_tables[0], "dep_edges")
        assert spark.conf.get(names[1]) == str(cores)  # few lines, as Spark has it
        monkeypatch.setattr(views, "LINES", 1)
        views.view(spark, odd_tables[0], "dep_edges")
        again = spark.read.parquet(*files.inputFiles())
        assert again.rdd.getNumPartitions() == 17 and again.count() == 17
        spark.conf.set(names[1], "300")  # a session that has more keeps them
        assert views.view(spark, odd_tables[0], "locks").columns and spark.conf.get(names[1]) == "300"
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_views_let_spark_merge_small_shares_only(spark, odd_tables):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    try:
        for size, then in (("64MB", "16777216b"), ("1g", "16777216b"), ("17000000", "16777216b"), ("16m", "16m"), ("4096k", "4096k"), ("1000b", "1000b")):
            spark.conf.set(name, size)
            views.view(spark, odd_tables[0], "dep_edges")
            assert spark.conf.get(name) == then  # a session that has less keeps it
    finally:
        spark.conf.set(name, before)
