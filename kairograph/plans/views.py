"""The graph's input views over the star-schema tables, for Spark and, as text, for SQL elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: {seconds:x} is the epoch second of a timestamp.
VIEWS = {
    # in every order each part depends on the next one for ninety days
    "dep_edges": """
        SELECT DISTINCT src, dst, vf, vf + 7776000 AS vt FROM (
          SELECT p AS src, lead(p) OVER (PARTITION BY o ORDER BY p) AS dst, vf FROM (
            SELECT DISTINCT o_orderkey AS o, l_partkey AS p, {seconds:o_orderdate} AS vf FROM orders JOIN lineitem ON l_orderkey = o_orderkey) x) y WHERE dst IS NOT NULL""",
    "holds": """
        SELECT l_suppkey AS handle, l_partkey AS package, min({seconds:l_shipdate}) AS vf, max({seconds:l_shipdate}) AS vt FROM lineitem
        GROUP BY l_suppkey, l_partkey HAVING count(DISTINCT l_shipdate) >= 2""",
    # one project's own dependencies: the parts of a brand
    "sources": "SELECT p_partkey AS node, CAST(0 AS BIGINT) AS vf, CAST(4102444800 AS BIGINT) AS vt FROM part WHERE p_brand = 'Brand#1'",
    "shipped": "SELECT l_partkey, min({seconds:l_shipdate}) AS published_at FROM lineitem GROUP BY l_partkey",
    "releases": """
        SELECT p_brand AS package, concat(CAST(p_size % 4 AS VARCHAR(9)), '.', CAST(CAST(floor(p_partkey / 25.0) AS BIGINT) AS VARCHAR(19)), '.', CAST(p_partkey % 25 AS VARCHAR(9))) AS version,
               CAST(p_size % 4 AS BIGINT) AS major, CAST(floor(p_partkey / 25.0) AS BIGINT) AS minor, CAST(p_partkey % 25 AS BIGINT) AS patch, published_at, p_partkey AS part
        FROM part JOIN shipped ON l_partkey = p_partkey""",
    "observations": "SELECT DISTINCT event_type AS package, {seconds:date_trunc('day', ts)} AS ob, user_id AS handle FROM events",
    "locks": "SELECT DISTINCT o_custkey AS project, l_partkey AS node, {seconds:o_orderdate} AS locked_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    # popularity: place among the customers of a nation by account balance
    "names": "SELECT c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) * 25 + c_nationkey AS rank FROM customer",
    "sampled": """
        SELECT DISTINCT l_partkey AS package, {seconds:l_shipdate} AS published_at, l_suppkey AS published_by,
               CASE l_linenumber % 3 WHEN 1 THEN true WHEN 2 THEN false END AS has_provenance, l_quantity > 40 AS has_install_script FROM lineitem""",
    "epoch_list": "SELECT CAST(t AS BIGINT) AS epoch FROM (VALUES (851990400), (883612800), (915148800)) v(t)",
    "epoch_edges": "SELECT DISTINCT epoch, src, dst FROM dep_edges JOIN epoch_list ON vf <= epoch AND epoch < vt",
}
#: Views that a view reads.
NEEDS = {"releases": ["shipped"], "epoch_edges": ["dep_edges", "epoch_list"]}
TABLES = ("lineitem", "orders", "part", "events", "customer")


def _filled(text: str, seconds: str) -> str:
    import re

    def one(m):
        return seconds.format(m[1])

    return re.sub(r"\{seconds:((?:[^{}()]|\([^()]*\))+)\}", one, text)


#: Lines that a task of a view takes.
LINES = 500_000
#: Bytes up to which Spark merges shuffle partitions to one task; rows of a search take about seven times that in a task's memory.
MERGED = 16 << 20


def _bytes(size: str) -> int:
    """A size as the session's settings write it: 64MB, 1g, 67108864b."""
    import re

    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)(?:i?b)?", size.strip().lower()).groups()
    return int(number) << 10 * "_kmgtp".index(unit or "_")


def _tasks(lines: DataFrame) -> int:
    """As many tasks as the lines ask for, and one a core at least. Given as a number, Spark doesn't merge them to fewer, so what a task
    holds stays the same however many lines there are; small tables are not cut into small files.

    The joins, sorts and supersteps that follow leave their tasks to Spark, which merges the session's shuffle partitions but never cuts
    one: a number of them that is fixed would let each grow with the lines. So the session gets as many, unless it has more already.
    Likewise Spark deals the files of a step to one task a core until a task has 128 MB, and a table of distinct rows that it fills before
    their shuffle grows with its share: the session's reads get as many tasks too. And what Spark merges to one task it merges to a
    share of all, up to 64 MB by default: the session's limit is lowered, so that the share stops growing earlier."""
    spark = lines.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES))
    for name in ("spark.sql.shuffle.partitions", "spark.sql.files.minPartitionNum"):
        if int(spark.conf.get(name, None) or 0) < tasks:
            spark.conf.set(name, tasks)
    if _bytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) > MERGED:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", f"{MERGED}b")
    return tasks


def _once(rows: DataFrame, tasks: int, *by: str) -> DataFrame:
    """Distinct rows, told apart after one shuffle by some of their columns. Nearly all of them differ, so a table of those that a task
    has seen before the shuffle would hold them all and save nothing."""
    return rows.repartition(tasks, *by).distinct()


def _locks(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """The view locks."""
    tasks = _tasks(lines)
    dated = orders.select("o_orderkey", F.col("o_custkey").alias("project"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("locked_at"))
    pins = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("node")).repartition(tasks, "o_orderkey").join(dated, "o_orderkey")
    return _once(pins.select("project", "node", "locked_at"), tasks, "project", "node")


def _neighbours(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """The view dep_edges: each order's parts are sorted once, the sort serves the join with its date as well, and a part that an order
    has again is told by its neighbour, not by a table of all lines."""
    tasks = _tasks(lines)
    parts = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("src")).where("o IS NOT NULL AND src IS NOT NULL").repartition(tasks, "o")
    pairs = parts.withColumn("dst", F.lead("src").over(Window.partitionBy("o").orderBy("src"))).where("src <> dst")
    dated = orders.select(F.col("o_orderkey").alias("o"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("vf")).distinct()
    return _once(pairs.join(dated, "o").select("src", "dst", "vf", (F.col("vf") + 7_776_000).alias("vt")), tasks, "src", "dst")


def _holds(lines: DataFrame) -> DataFrame:
    """The view holds: two dates or more is a first one before the last, so dates need not be told apart."""
    spans = lines.select(F.col("l_suppkey").alias("handle"), F.col("l_partkey").alias("package"), "l_shipdate").repartition(_tasks(lines), "handle", "package")
    seen = spans.groupBy("handle", "package").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last")).where("first < last")
    return seen.select("handle", "package", *(F.unix_timestamp(F.col(c).cast("timestamp")).alias(n) for c, n in (("first", "vf"), ("last", "vt"))))


def _sampled(lines: DataFrame) -> DataFrame:
    """The view sampled."""
    third, number = F.col("l_linenumber") % 3, F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    rows = lines.select(
        F.col("l_partkey").alias("package"), number.alias("published_at"), F.col("l_suppkey").alias("published_by"),
        F.when(third == 1, True).when(third == 2, False).alias("has_provenance"), (F.col("l_quantity") > 40).alias("has_install_script"),
    )
    return _once(rows, _tasks(lines), "package", "published_at", "published_by")


#: Views made otherwise than by their text, with the same rows, and the tables they read.
MADE = {"dep_edges": (_neighbours, "lineitem", "orders"), "locks": (_locks, "lineitem", "orders"), "holds": (_holds, "lineitem"), "sampled": (_sampled, "lineitem")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view; only the tables and views it reads are opened."""
    import re

    if name in MADE:
        made, *tables = MADE[name]
        return made(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))
    text = _filled(VIEWS[name], "unix_timestamp(CAST({} AS TIMESTAMP))").replace("VARCHAR(9)", "STRING").replace("VARCHAR(19)", "STRING")
    inputs = {n: view(spark, sf_dir, n) for n in NEEDS.get(name, [])} | {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", text)}
    for n in inputs:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **inputs)


def with_views(names: list[str], query: str, recursive: bool = False) -> str:
    """SQL text with the views as common table expressions before `query`, which may go on with further ones."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({_filled(VIEWS[n], 'CAST(epoch({}) AS BIGINT)')})" for n in order)
    return f"WITH {'RECURSIVE ' * recursive}{ctes}{query}"
