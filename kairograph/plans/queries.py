"""Registered queries over the star-schema views, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairograph.functions import intervals, semver, text
from kairograph.functions.intervals import OPEN
from kairograph.functions.lineage import written
from kairograph.functions.order import numbered, spread
from kairograph.operators import advisory, incident, publishers, observatory, reach, scopes, temporal, typosquat
from kairograph.plans import jobs
from kairograph.plans.views import _tasks, view, with_views
from kairograph.sources import feeds, lockfiles

NOW = 946_684_800
INSTANT = 883_612_800

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


REACHED = """,
walk(node, vf, vt, d) AS (
  SELECT node, vf, vt, 0 FROM sources UNION
  SELECT e.dst, greatest(w.vf, e.vf), least(w.vt, e.vt), w.d + 1 FROM walk w JOIN dep_edges e ON e.src = w.node WHERE w.d < 12 AND greatest(w.vf, e.vf) < least(w.vt, e.vt)),
layers(node, d) AS (SELECT node, 0 FROM sources UNION SELECT e.dst, l.d + 1 FROM layers l JOIN dep_edges e ON e.src = l.node WHERE l.d < 12),
union_nodes AS (SELECT node, min(d) AS layer FROM layers GROUP BY node),
marked AS (SELECT node, vf, vt, max(vt) OVER (PARTITION BY node ORDER BY vf, vt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT DISTINCT node, vf, vt FROM walk)),
islands AS (SELECT *, sum(CASE WHEN vf > top THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY vf, vt ROWS UNBOUNDED PRECEDING) AS g FROM marked),
spans AS (SELECT node, min(vf) AS vf, max(vt) AS vt FROM islands GROUP BY node, g)
"""
HELD = REACHED + """,
held AS (SELECT handle, package, greatest(s.vf, h.vf) AS vf, least(s.vt, h.vt) AS vt, h.vf AS valid_from FROM spans s JOIN holds h ON h.package = s.node WHERE greatest(s.vf, h.vf) < least(s.vt, h.vt))
"""
SIGNALS = HELD + """,
through AS (SELECT DISTINCT handle, package FROM held),
holders AS (SELECT node AS package, count(DISTINCT handle) AS holders FROM (SELECT DISTINCT node FROM spans) LEFT JOIN held ON package = node GROUP BY node),
solo AS (SELECT handle, count(*) FILTER (WHERE holders = 1) AS solo_count, count(*) AS solo_of FROM through JOIN holders USING (package) GROUP BY handle),
seen AS (SELECT t.handle, count(*) FILTER (WHERE NOT has_provenance) AS unproven_count, count(has_provenance) AS looked_of, count(*) FILTER (WHERE has_provenance IS NOT NULL AND has_install_script) AS install_count,
    max(published_at) FILTER (WHERE published_by = t.handle) AS last_publish, max(published_at) AS last_release FROM through t JOIN sampled s USING (package) GROUP BY t.handle),
signals AS (SELECT handle, solo_count, solo_of, coalesce(unproven_count, 0) AS unproven_count, coalesce(looked_of, 0) AS looked_of, coalesce(install_count, 0) AS install_count,
    coalesce(last_publish, 0) AS last_publish, coalesce(last_release, 0) AS last_release FROM solo LEFT JOIN seen USING (handle))
"""
GRAPH = ["dep_edges", "sources"]


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = written(view(spark, sf_dir, "dep_edges"), "dep-edges")
    return edges, view(spark, sf_dir, "sources")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(reach.coexistence_reach(*_graph(spark, sf_dir)), "spans")


def _held(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    reached = _spans(spark, sf_dir).withColumnRenamed("node", "package")
    return reached, written(publishers.roster(reached, view(spark, sf_dir, "holds")), "held")


@query(with_views(GRAPH, REACHED + "SELECT node, vf, vt FROM spans", True))
def coexistence_reach(spark, sf_dir):
    return reach.coexistence_reach(*_graph(spark, sf_dir))


@query(with_views(GRAPH, REACHED + "SELECT node, CAST(layer AS BIGINT) AS layer FROM union_nodes", True))
def union_reach(spark, sf_dir):
    return reach.union_reach(*_graph(spark, sf_dir))[0]


@query(with_views(GRAPH, REACHED + "SELECT node FROM union_nodes WHERE node NOT IN (SELECT node FROM spans)", True))
def phantom_nodes(spark, sf_dir):
    edges, sources = _graph(spark, sf_dir)
    return reach.phantoms(reach.union_reach(edges, sources)[0], reach.coexistence_reach(edges, sources))


@query(with_views(GRAPH, REACHED + f"SELECT DISTINCT node FROM spans WHERE vf <= {INSTANT} AND {INSTANT} < vt", True))
def reach_at_instant(spark, sf_dir):
    edges, sources = _graph(spark, sf_dir)
    return reach.reached_at(reach.coexistence_reach(edges, sources, within=intervals.at(INSTANT)), INSTANT)


@query(with_views(GRAPH, REACHED + """, u AS (SELECT count(*) AS n, max(layer) AS deep FROM union_nodes), s AS (SELECT count(DISTINCT node) AS n, count(*) AS spans FROM spans)
SELECT u.n AS n_union, s.n AS n_coexistence, u.n - s.n AS n_phantom, round(s.spans / s.n, 6) AS kappa, CAST(least(12, deep + 1) AS BIGINT) AS depth, deep = 12 AS truncated FROM u, s""", True))
def reach_summary(spark, sf_dir):
    return reach.summary(*_graph(spark, sf_dir))


@query(with_views(GRAPH, REACHED + """SELECT (SELECT count(DISTINCT p_brand) FROM spans JOIN part ON p_partkey = node) AS coexistence_packages, (SELECT count(DISTINCT node) FROM spans) AS coexistence_versions,
  (SELECT count(DISTINCT p_brand) FROM union_nodes JOIN part ON p_partkey = node) AS union_packages, (SELECT count(*) FROM union_nodes) AS union_versions""", True))
def reach_counts(spark, sf_dir):
    # parts are the versions of a brand
    edges, sources = _graph(spark, sf_dir)
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("package"))
    return reach.counts(reach.coexistence_reach(edges, sources).join(brands, "node", "left"), reach.union_reach(edges, sources)[0].join(brands, "node", "left"))


EDGE_SPANS = """, m AS (SELECT dst AS node, vf, vt, max(vt) OVER (PARTITION BY dst ORDER BY vf, vt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT DISTINCT dst, vf, vt FROM dep_edges)),
i AS (SELECT *, sum(CASE WHEN vf > top THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY vf, vt ROWS UNBOUNDED PRECEDING) AS g FROM m),
spans AS (SELECT node, min(vf) AS vf, max(vt) AS vt FROM i GROUP BY node, g)
"""


def _edge_spans(spark, sf_dir):
    return view(spark, sf_dir, "dep_edges").select(F.col("dst").alias("node"), "vf", "vt")


@query(with_views(["dep_edges"], EDGE_SPANS + "SELECT node, vf, vt FROM spans"))
def interval_coalesce(spark, sf_dir):
    return intervals.coalesce(_edge_spans(spark, sf_dir))


@query(with_views(["dep_edges"], EDGE_SPANS + "SELECT node, CAST(sum(vt - vf) AS BIGINT) AS width, min(vf) AS earliest FROM spans GROUP BY node"))
def interval_width_earliest(spark, sf_dir):
    return intervals.width_and_earliest(_edge_spans(spark, sf_dir))


@query(with_views(["dep_edges"], EDGE_SPANS + """, tests AS (SELECT DISTINCT dst AS node, vf + 7776000 AS a, vf + 23328000 AS b FROM dep_edges)
SELECT t.node, a, b, EXISTS (SELECT 1 FROM spans s WHERE s.node = t.node AND s.vf <= a AND s.vt >= b) AS covered FROM tests t"""))
def interval_covers(spark, sf_dir):
    rows = _edge_spans(spark, sf_dir)
    tests = rows.select("node", (F.col("vf") + 7776000).alias("a"), (F.col("vf") + 23328000).alias("b")).distinct()
    return tests.join(intervals.as_set(rows), "node").select("node", "a", "b", intervals.covers(F.col("spans"), F.col("a"), F.col("b")).alias("covered"))


@query(with_views(["holds"], f"SELECT DISTINCT package, handle FROM holds WHERE vf <= {INSTANT} AND {INSTANT} < vt"))
def live_holders_at(spark, sf_dir):
    return incident.live_holders(view(spark, sf_dir, "holds"), INSTANT)


@query(with_views(["holds"], f""", live AS (SELECT DISTINCT package, handle FROM holds WHERE vf <= {INSTANT} AND {INSTANT} < vt)
SELECT DISTINCT b.handle, b.package AS other FROM live a JOIN live b USING (handle) WHERE b.package <> a.package"""))
def shared_maintainers(spark, sf_dir):
    own = view(spark, sf_dir, "shipped").select(F.col("l_partkey").alias("package"))
    return incident.shared_maintainers(view(spark, sf_dir, "holds"), own, INSTANT)


@query(with_views(["holds", "shipped"], f"SELECT l_partkey AS package FROM shipped WHERE l_partkey NOT IN (SELECT package FROM holds WHERE vf <= {INSTANT} AND {INSTANT} < vt)"))
def orphaned_parts(spark, sf_dir):
    return incident.orphaned(view(spark, sf_dir, "shipped").select(F.col("l_partkey").alias("package")), view(spark, sf_dir, "holds"), INSTANT)


@query(with_views(["holds"], "SELECT handle, count(*) AS spells, count(DISTINCT package) AS packages FROM holds GROUP BY handle ORDER BY spells DESC, handle LIMIT 20"))
def maintainer_rank(spark, sf_dir):
    return publishers.maintainer_rank(view(spark, sf_dir, "holds"), 20)


@query(with_views([*GRAPH, "holds"], HELD + "SELECT handle, count(DISTINCT package) AS packages, min(valid_from) AS since FROM held GROUP BY handle", True))
def publisher_roster(spark, sf_dir):
    return publishers.publishers(_held(spark, sf_dir)[1])


@query(with_views([*GRAPH, "holds"], HELD + "SELECT node AS package, count(DISTINCT handle) AS holders FROM (SELECT DISTINCT node FROM spans) LEFT JOIN held ON package = node GROUP BY node", True))
def holders_per_package(spark, sf_dir):
    return publishers.holders_per_package(*_held(spark, sf_dir))


@query(with_views([*GRAPH, "holds"], REACHED + "SELECT count(DISTINCT handle) AS union_publishers FROM holds WHERE package IN (SELECT node FROM union_nodes)", True))
def union_publishers(spark, sf_dir):
    union = reach.union_reach(*_graph(spark, sf_dir))[0]
    return publishers.union_holders(union.withColumnRenamed("node", "package"), view(spark, sf_dir, "holds"))


@query(with_views([*GRAPH, "holds"], HELD + """SELECT *, row_number() OVER (ORDER BY packages DESC, handle) AS place FROM (
  SELECT handle, count(DISTINCT package) AS packages, min(valid_from) AS since FROM held GROUP BY handle)""", True))
def publisher_board(spark, sf_dir):
    return numbered(publishers.publishers(_held(spark, sf_dir)[1]), [F.desc("packages"), "handle"])


@query(with_views(["holds"], """, held AS (SELECT DISTINCT 'pkg:npm/part-' || CAST(package AS VARCHAR) AS package FROM holds),
asked AS (SELECT DISTINCT CASE WHEN l_returnflag = 'N' THEN 'pkg:npm/' ELSE '' END || 'part-' || CAST(l_partkey AS VARCHAR) AS asked FROM lineitem)
SELECT asked, package FROM asked LEFT JOIN held ON package = asked OR package = 'pkg:npm/' || asked"""))
def held_lookup(spark, sf_dir):
    # every part asked for by its URN, its bare name, or both
    name = F.concat(F.lit("part-"), F.col("l_partkey"))
    asked = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.when(F.col("l_returnflag") == "N", text.package_urn(name)).otherwise(name).alias("asked"))
    held = view(spark, sf_dir, "holds").select(text.package_urn(F.concat(F.lit("part-"), "package")).alias("package"))
    return publishers.held_package(held, asked)


@query(with_views(["sampled"], """ SELECT *, row_number() OVER (PARTITION BY package ORDER BY published_at, published_by) AS place
FROM (SELECT DISTINCT package, published_at, published_by FROM sampled)"""))
def sampled_order(spark, sf_dir):
    once = view(spark, sf_dir, "sampled").select("package", "published_at", "published_by").distinct()
    return numbered(once, ["published_at", "published_by"], ["package"])


@query(with_views(["releases"], """, o AS (SELECT part, published_at, row_number() OVER (ORDER BY published_at, part) - 1 AS spot, count(*) OVER () AS n FROM releases)
SELECT part, published_at FROM o WHERE n <= 500 OR spot IN (SELECT (i * (SELECT max(n) - 1 FROM o)) // 499 FROM range(500) t(i))"""))
def spread_releases(spark, sf_dir):
    # a sampling operator: 500 releases over all of time
    return spread(view(spark, sf_dir, "releases").select("part", "published_at"), 500, ["published_at", "part"])


@query(with_views(["holds"], """, a AS (SELECT p_brand AS package, count(DISTINCT package) AS held FROM holds JOIN part ON p_partkey = package GROUP BY 1),
b AS (SELECT p_brand AS package, count(DISTINCT CASE WHEN l_shipdate IS NOT NULL THEN p_partkey END) AS dated FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)
SELECT package, coalesce(held, 0) AS held, dated, coalesce(held, 0) = dated AS agrees FROM b LEFT JOIN a USING (package)"""))
def verify_counts(spark, sf_dir):
    # parts as versions of a brand: those that somebody holds against those ever shipped
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("package"), F.col("p_partkey").alias("version"))
    held = parts.join(view(spark, sf_dir, "holds").select(F.col("package").alias("version")), "version", "left_semi")
    return jobs.crosscheck(held, parts.join(view(spark, sf_dir, "shipped").withColumnRenamed("l_partkey", "version"), "version", "left"))


def _signals(spark, sf_dir):
    reached, held = _held(spark, sf_dir)
    return reached, publishers.signals(held, publishers.holders_per_package(reached, held), view(spark, sf_dir, "sampled"))


@query(with_views([*GRAPH, "holds", "sampled"], SIGNALS + "SELECT * FROM signals", True))
def publisher_signals(spark, sf_dir):
    return _signals(spark, sf_dir)[1]


@query(with_views([*GRAPH, "holds", "sampled"], SIGNALS + f""", n AS (SELECT count(DISTINCT node) AS n FROM spans),
t AS (SELECT handle, 0.4 AS wr, least(1.0, ln(1 + solo_of) / ln(1 + n)) AS r, CASE WHEN last_publish > 0 THEN greatest(0.0, least(1.0, ({NOW} - last_publish) / 157680000.0)) END AS st,
  solo_count / solo_of AS so, CASE WHEN looked_of > 0 THEN unproven_count / looked_of END AS np, CASE WHEN looked_of > 0 THEN install_count / looked_of END AS ins FROM signals, n)
SELECT handle, round((0.4 * r + coalesce(0.15 * st, 0) + 0.2 * so + coalesce(0.15 * np, 0) + coalesce(0.1 * ins, 0)) / (0.6 + CASE WHEN st IS NULL THEN 0 ELSE 0.15 END + CASE WHEN np IS NULL THEN 0 ELSE 0.25 END), 6) AS risk FROM t""", True))
def risk_scores(spark, sf_dir):
    reached, seen = _signals(spark, sf_dir)
    return publishers.risk(seen, reached.agg(F.count_distinct("package").alias("n")), NOW).select("handle", F.round("risk", 6).alias("risk"))


@query(with_views([*GRAPH, "holds"], HELD + """, own AS (SELECT DISTINCT handle, package FROM held),
cw(handle, node, vf, vt, d) AS (
  SELECT h.handle, s.node, s.vf, s.vt, 0 FROM (SELECT DISTINCT handle FROM own) h, sources s WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.handle = h.handle AND o.package = s.node) UNION
  SELECT w.handle, e.dst, greatest(w.vf, e.vf), least(w.vt, e.vt), w.d + 1 FROM cw w JOIN dep_edges e ON e.src = w.node
  WHERE w.d < 12 AND greatest(w.vf, e.vf) < least(w.vt, e.vt) AND NOT EXISTS (SELECT 1 FROM own o WHERE o.handle = w.handle AND o.package = e.dst)),
total AS (SELECT count(DISTINCT node) AS n FROM spans), still AS (SELECT handle, count(DISTINCT node) AS n FROM cw GROUP BY handle)
SELECT handle, controls, total.n - coalesce(still.n, 0) AS lost, total.n - coalesce(still.n, 0) - controls AS beyond
FROM (SELECT handle, count(*) AS controls FROM own GROUP BY handle) c LEFT JOIN still USING (handle), total""", True))
def cuts(spark, sf_dir):
    edges, sources = _graph(spark, sf_dir)
    found = reach.layers(edges, sources)
    held = publishers.roster(found.withColumnRenamed("node", "package"), view(spark, sf_dir, "holds"))
    return publishers.cuts(edges, found, held)


@query(with_views([*GRAPH, "holds"], """,
p(node, vf, vt, hops, path) AS (
  SELECT node, vf, vt, 0, [node] FROM sources UNION
  SELECT e.dst, greatest(p.vf, e.vf), least(p.vt, e.vt), hops + 1, list_prepend(e.dst, path) FROM p JOIN dep_edges e ON e.src = p.node WHERE hops < 12 AND greatest(p.vf, e.vf) < least(p.vt, e.vt)),
w AS (SELECT DISTINCT package // 10 AS package FROM holds),
r AS (SELECT *, node // 10 AS package, dense_rank() OVER (PARTITION BY node // 10 ORDER BY hops, path) AS n FROM p WHERE hops > 0),
m AS (SELECT *, max(vt) OVER (PARTITION BY package ORDER BY vf, vt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r WHERE n = 1),
i AS (SELECT *, sum(CASE WHEN vf > top THEN 1 ELSE 0 END) OVER (PARTITION BY package ORDER BY vf, vt ROWS UNBOUNDED PRECEDING) AS g FROM m),
c AS (SELECT package, any_value(hops) AS hops, any_value(path) AS path, min(vf) AS vf, max(vt) AS vt FROM i WHERE g = 0 GROUP BY package)
SELECT w.package, hops IS NOT NULL AS found, CAST(hops AS BIGINT) AS hops, array_to_string(list_reverse(path), '>') AS path, vf, vt FROM w LEFT JOIN c USING (package)""", True))
def holder_chains(spark, sf_dir):
    # packages are tens of parts; every package that anyone ever held is asked for
    ten = lambda c: F.floor(c / 10)
    wanted = view(spark, sf_dir, "holds").select(ten(F.col("package")).alias("package"))
    edges, sources = _graph(spark, sf_dir)
    return reach.package_chains(edges, sources, wanted, ten).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query(with_views(GRAPH, """,
p(node, vf, vt, hops, path) AS (
  SELECT node, vf, vt, 0, [node] FROM sources UNION ALL
  SELECT e.dst, greatest(p.vf, e.vf), least(p.vt, e.vt), hops + 1, list_append(path, e.dst) FROM p JOIN dep_edges e ON e.src = p.node WHERE hops < 12 AND greatest(p.vf, e.vf) < least(p.vt, e.vt)),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hops, path, vf, vt) AS n FROM p WHERE hops > 0)
SELECT node, CAST(hops AS BIGINT) AS hops, array_to_string(path, '>') AS path, vf, vt FROM r WHERE n = 1""", True))
def proof_paths(spark, sf_dir):
    found = reach.proof_paths(*_graph(spark, sf_dir))
    return found.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">")).select("node", "hops", "path", "vf", "vt")


@query(with_views(["dep_edges", "holds"], """, mine AS (SELECT package AS node, vf, vt FROM holds WHERE handle = 1),
w(node, vf, vt, d) AS (SELECT node, vf, vt, 0 FROM mine UNION
  SELECT e.src, greatest(w.vf, e.vf), least(w.vt, e.vt), w.d + 1 FROM w JOIN dep_edges e ON e.dst = w.node WHERE w.d < 12 AND greatest(w.vf, e.vf) < least(w.vt, e.vt)),
m AS (SELECT *, max(vt) OVER (PARTITION BY node ORDER BY vf, vt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT DISTINCT node, vf, vt FROM w)),
i AS (SELECT *, sum(CASE WHEN vf > top THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY vf, vt ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT node, min(vf) AS vf, max(vt) AS vt FROM i WHERE node NOT IN (SELECT node FROM mine) GROUP BY node, g""", True))
def who_reverse_reach(spark, sf_dir):
    held = view(spark, sf_dir, "holds").where("handle = 1").select(F.col("package").alias("node"), "vf", "vt")
    return reach.reverse_reach(written(view(spark, sf_dir, "dep_edges"), "dep-edges"), written(held, "held"))


@query(with_views(GRAPH, REACHED + """, inside AS (SELECT DISTINCT node FROM spans), f AS (
  SELECT DISTINCT e.src // 10 AS a, e.dst // 10 AS b, e.src IN (SELECT node FROM inside) AND e.dst IN (SELECT node FROM inside) AS c,
    EXISTS (SELECT 1 FROM spans s WHERE s.node = e.src AND greatest(s.vf, e.vf) < least(s.vt, e.vt)) AS x FROM dep_edges e)
SELECT a AS from_package, b AS to_package, bool_or(c) AS coexistent, bool_or(x) AS coexistent_exact FROM f WHERE a <> b GROUP BY ALL""", True))
def package_graph(spark, sf_dir):
    edges, sources = _graph(spark, sf_dir)
    return reach.package_graph(edges, reach.coexistence_reach(edges, sources), "{node} div 10")


# Declarations: every project of the first hundred declares a caret range on each brand.
_DECLARED = """, declared AS (SELECT concat(b.package, '#', CAST(m.major AS VARCHAR), '#', CAST(t.ob AS VARCHAR)) AS declaration, b.package, m.major, t.ob AS declared_at FROM (SELECT DISTINCT package FROM releases) b,
  (SELECT CAST(major AS BIGINT) AS major FROM (VALUES (1), (2), (3)) v(major)) m, (SELECT CAST(t AS BIGINT) AS ob FROM (VALUES (0), (810000000), (883612800)) v(t)) t)
"""


def _declarations(spark, sf_dir):
    brands = view(spark, sf_dir, "releases").select("package").distinct()
    grid = [(m, t) for m in (1, 2, 3) for t in (0, 810_000_000, INSTANT)]
    rows = brands.withColumn("g", F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(t).alias("t")) for m, t in grid))))
    return rows.select(F.concat_ws("#", "package", "g.m", "g.t").alias("declaration"), "package", F.concat(F.lit("^"), F.col("g.m"), F.lit(".0.0")).alias("range"), F.col("g.t").cast("long").alias("declared_at"))


@query(with_views(["releases"], _DECLARED + f""", c AS (SELECT declaration, version, published_at, declared_at, minor * 100 + patch AS k FROM declared JOIN releases USING (package) WHERE releases.major = declared.major AND published_at > 0),
r AS (SELECT *, max(k) OVER (PARTITION BY declaration ORDER BY published_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM c),
o AS (SELECT declaration, version, declared_at, published_at AS vf, lead(published_at, 1, {OPEN}) OVER (PARTITION BY declaration ORDER BY published_at, k) AS vt FROM r WHERE best IS NULL OR k > best)
SELECT declaration, version, CASE WHEN declared_at > 0 THEN greatest(vf, declared_at) ELSE vf END AS vf, vt FROM o WHERE CASE WHEN declared_at > 0 THEN greatest(vf, declared_at) ELSE vf END < vt"""))
def resolution_windows(spark, sf_dir):
    return temporal.resolution_windows(_declarations(spark, sf_dir), view(spark, sf_dir, "releases"))


@query(with_views(["observations"], f""", days AS (SELECT package, ob, row_number() OVER (PARTITION BY package ORDER BY ob) AS n, lead(ob, 1, {OPEN}) OVER (PARTITION BY package ORDER BY ob) AS nx FROM (SELECT DISTINCT package, ob FROM observations)),
r AS (SELECT package, handle, ob, nx, n - row_number() OVER (PARTITION BY package, handle ORDER BY n) AS run FROM observations JOIN days USING (package, ob))
SELECT package, handle, min(ob) AS vf, max(nx) AS vt, count(*) AS observed FROM r GROUP BY package, handle, run"""))
def spells(spark, sf_dir):
    return temporal.spells(view(spark, sf_dir, "observations"))


ASOF = """, cur AS (SELECT package, epoch, arg_max(version, (published_at, major, minor, patch)) AS version, arg_max(part, (published_at, major, minor, patch)) AS part FROM releases JOIN epoch_list ON published_at <= epoch GROUP BY package, epoch)
"""


@query(with_views(["releases", "epoch_list"], ASOF + "SELECT package, epoch, version FROM cur"))
def asof_version(spark, sf_dir):
    return temporal.versions_as_of(view(spark, sf_dir, "releases"), view(spark, sf_dir, "epoch_list"))


@query(with_views(["releases", "epoch_list", "dep_edges"], ASOF + "SELECT DISTINCT epoch, package AS src, dst FROM cur JOIN dep_edges ON src = part"))
def pkg_snapshots(spark, sf_dir):
    releases = view(spark, sf_dir, "releases")
    deps = releases.join(view(spark, sf_dir, "dep_edges").select(F.col("src").alias("part"), F.col("dst").alias("dep")).distinct(), "part").select("package", "version", "dep")
    return temporal.snapshots(releases, deps, view(spark, sf_dir, "epoch_list"))


@query(with_views(["releases"], """, o AS (SELECT *, lag(version) OVER (PARTITION BY package ORDER BY published_at, major, minor, patch) AS before, row_number() OVER (PARTITION BY package ORDER BY published_at, major, minor, patch) AS n FROM releases)
SELECT package, version, published_at, before FROM o WHERE part % 7 = 3 QUALIFY row_number() OVER (PARTITION BY package ORDER BY n) = 1"""))
def bisect_first_affected(spark, sf_dir):
    releases = view(spark, sf_dir, "releases")
    return temporal.first_affected(releases.select("package", "version", "published_at"), releases.where("part % 7 = 3"))


@query("""WITH a AS (SELECT l_partkey AS name, CAST(max(l_linenumber) AS VARCHAR) AS r FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT l_partkey AS name, CAST(max(l_linenumber) AS VARCHAR) AS r FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1)
SELECT name, CASE WHEN b.r IS NULL THEN 'added' WHEN a.r IS NULL THEN 'removed' ELSE 'changed' END AS change, b.r AS range_before, a.r AS range_after FROM a FULL JOIN b USING (name) WHERE a.r IS DISTINCT FROM b.r""")
def dependency_diff(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    side = lambda k: lines.where(F.col("l_orderkey") % 2 == k).groupBy(F.col("l_partkey").alias("name")).agg(F.max("l_linenumber").cast("string").alias("range"))
    return temporal.dependency_diff(side(0), side(1))


@query(with_views(["releases"], """ SELECT concat('ADV-', package) AS osv_id, package, version, '1.2.0' AS introduced, '3.10.0' AS fixed FROM releases
WHERE ((major, minor, patch) >= (1, 2, 0) AND (major, minor, patch) < (2, 5, 0)) OR ((major, minor, patch) >= (3, 0, 0) AND (major, minor, patch) < (3, 10, 0))"""))
def affected_versions(spark, sf_dir):
    releases = view(spark, sf_dir, "releases")
    events = F.array(*(F.struct(F.lit(i).alias("introduced"), F.lit(f).alias("fixed"), F.lit(None).cast("string").alias("last_affected")) for i, f in (("1.2.0", None), (None, "2.5.0"), ("3.0.0", None), (None, "3.10.0"))))
    ranges = F.array(F.struct(F.lit("GIT").alias("type"), events.alias("events")), F.struct(F.lit("SEMVER").alias("type"), events.alias("events")))
    block = F.struct(F.struct(F.lit("npm").alias("ecosystem"), F.col("package").alias("name")).alias("package"), ranges.alias("ranges"), F.array().cast("array<string>").alias("versions"))
    return advisory.affected_versions(releases.select("package").distinct().select(F.concat(F.lit("ADV-"), "package").alias("osv_id"), F.array(block).alias("affected")), releases)


@query(with_views(["dep_edges", "locks"], "SELECT DISTINCT dst AS target, project, node, locked_at FROM dep_edges JOIN locks ON node = src WHERE vf <= locked_at AND locked_at < vt"))
def resolved_while_live(spark, sf_dir):
    return incident.resolved_while_live(view(spark, sf_dir, "dep_edges"), view(spark, sf_dir, "locks"))


@query(with_views(["dep_edges", "locks"], """, w(project, locked_at, node, d) AS (SELECT project, locked_at, node, 0 FROM locks UNION
  SELECT project, locked_at, e.dst, d + 1 FROM w JOIN dep_edges e ON e.src = w.node WHERE d < 12 AND e.vf <= locked_at AND locked_at < e.vt)
SELECT DISTINCT project, locked_at FROM w WHERE node % 50 = 7""", True))
def transitively_exposed(spark, sf_dir):
    edges = written(view(spark, sf_dir, "dep_edges"), "dep-edges")
    target = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 50 = 7").select(F.col("p_partkey").alias("node"))
    return incident.transitively_exposed(edges, view(spark, sf_dir, "locks"), target)


@query(with_views([*GRAPH, "epoch_list"], REACHED + "SELECT epoch AS instant, count(DISTINCT node) AS reached FROM epoch_list LEFT JOIN spans ON vf <= epoch AND epoch < vt GROUP BY epoch", True))
def exposure_timeline(spark, sf_dir):
    return incident.exposure_timeline(_spans(spark, sf_dir), view(spark, sf_dir, "epoch_list").withColumnRenamed("epoch", "instant"))


@query(with_views([*GRAPH, "holds"], HELD + """, h AS (SELECT handle, s.node, greatest(s.vf, h.vf) AS vf, least(s.vt, h.vt) AS vt FROM spans s JOIN holds h ON h.package = s.node WHERE greatest(s.vf, h.vf) < least(s.vt, h.vt)),
months AS (SELECT CAST(epoch(m) AS BIGINT) AS instant FROM (SELECT unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS m FROM (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders))),
x AS (SELECT instant, count(DISTINCT node) AS n FROM months JOIN spans ON vf <= instant AND instant < vt GROUP BY instant), y AS (SELECT instant, count(DISTINCT handle) AS n FROM months JOIN h ON vf <= instant AND instant < vt GROUP BY instant)
SELECT instant, coalesce(x.n, 0) AS reached, coalesce(y.n, 0) AS publishers, (SELECT count(DISTINCT handle) FROM holds WHERE package IN (SELECT node FROM union_nodes)) AS union_publishers
FROM months LEFT JOIN x USING (instant) LEFT JOIN y USING (instant)""", True))
def audit_timeline(spark, sf_dir):
    edges, sources = _graph(spark, sf_dir)
    holds = view(spark, sf_dir, "holds")
    both = reach.both_graphs(edges, sources)
    spans = written(intervals.coalesce(both.where("NOT timeless")), "spans")
    held = written(publishers.roster(spans.withColumnRenamed("node", "package"), holds), "held")
    union = publishers.union_holders(both.where("timeless").select(F.col("node").alias("package")), holds)
    ends = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(*(f(g("o_orderdate")) for f in (F.min, F.max) for g in (lambda c: F.year(c) * 12 + F.month(c) - 1,))).first()
    return incident.audit_timeline(spans, held, union, *((m // 12, m % 12 + 1) for m in ends))


#: The instant by which half of the accounts have begun to hold what is reached; the base audit is the one before it.
_BASE = """, begun AS (SELECT handle, min(vf) AS b FROM held GROUP BY handle), half AS (SELECT quantile_disc(b, 0.5) AS t FROM begun)
SELECT DISTINCT handle FROM held, half WHERE vt > t AND handle NOT IN (SELECT handle FROM held, half WHERE vf < t)"""


@query(with_views([*GRAPH, "holds"], HELD + _BASE, True))
def new_publishers(spark, sf_dir):
    held = _held(spark, sf_dir)[1]
    half = held.groupBy("handle").agg(F.min("vf").alias("b")).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY b)").cast("long").alias("t"))
    dated = written(held.crossJoin(half), "dated")  # one instant
    return publishers.new_publishers(dated.where("vt > t"), dated.where("vf < t"))


CLOSURE = """, c(epoch, node, member) AS (SELECT epoch, dst, src FROM epoch_edges UNION SELECT c.epoch, c.node, e.src FROM c JOIN epoch_edges e ON e.epoch = c.epoch AND e.dst = c.member),
n AS (SELECT DISTINCT epoch, unnest([src, dst]) AS node FROM epoch_edges), closure AS (SELECT * FROM c UNION SELECT epoch, node, node FROM n), kri AS (SELECT epoch, node, count(*) AS kri FROM closure GROUP BY ALL)
"""


def _closure(spark, sf_dir):
    return written(observatory.members(written(view(spark, sf_dir, "epoch_edges"), "epoch-edges")), "members")


@query(with_views(["epoch_edges"], CLOSURE + "SELECT epoch, node, kri FROM kri", True))
def kri_exact(spark, sf_dir):
    return observatory.kri_exact(_closure(spark, sf_dir))


@query(with_views(["epoch_edges"], CLOSURE + "SELECT epoch, node, kri, CAST(floor(kri * (CAST(1.04 AS DOUBLE) / 16) + 0.5) AS BIGINT) AS band FROM kri", True))
def kri_bands(spark, sf_dir):
    return observatory.with_band(observatory.kri_exact(_closure(spark, sf_dir)))


@query(with_views(["epoch_edges"], CLOSURE + "SELECT epoch, node, kri FROM kri WHERE epoch = 883612800 ORDER BY kri DESC, node LIMIT 25", True))
def kri_leaderboard(spark, sf_dir):
    return observatory.leaderboard(observatory.kri_exact(_closure(spark, sf_dir)).where(F.col("epoch") == INSTANT), 25)


@query(with_views(["epoch_edges", "holds"], CLOSURE + "SELECT c.epoch, h.handle, count(DISTINCT member) AS kri FROM closure c JOIN holds h ON h.package = c.node AND h.vf <= c.epoch AND c.epoch < h.vt GROUP BY ALL", True))
def kri_maintainers(spark, sf_dir):
    return observatory.holder_kri(_closure(spark, sf_dir), view(spark, sf_dir, "holds"))


@query(with_views(["epoch_edges", "holds"], CLOSURE + "SELECT k.*, NOT EXISTS (SELECT 1 FROM holds h WHERE h.package = k.node AND h.vf <= k.epoch AND k.epoch < h.vt) AS orphaned FROM kri k", True))
def kri_history(spark, sf_dir):
    return observatory.history(observatory.kri_exact(_closure(spark, sf_dir)), view(spark, sf_dir, "holds"))


@query(with_views(["epoch_edges", "holds"], CLOSURE + """SELECT k.*, true AS orphaned FROM kri k WHERE epoch = (SELECT max(epoch) FROM kri)
AND NOT EXISTS (SELECT 1 FROM holds h WHERE h.package = k.node AND h.vf <= k.epoch AND k.epoch < h.vt) ORDER BY kri DESC, node LIMIT 50""", True))
def kri_orphaned(spark, sf_dir):
    past = written(observatory.history(observatory.kri_exact(_closure(spark, sf_dir)), view(spark, sf_dir, "holds")), "history")
    return observatory.orphans_now(past)


@query(with_views(["epoch_edges"], CLOSURE + """, top AS (SELECT node FROM kri WHERE epoch = 915148800 ORDER BY kri DESC, node LIMIT 8)
SELECT node, max(kri) FILTER (WHERE epoch = 851990400) AS "851990400", max(kri) FILTER (WHERE epoch = 883612800) AS "883612800", max(kri) FILTER (WHERE epoch = 915148800) AS "915148800" FROM kri WHERE node IN (SELECT node FROM top) GROUP BY node""", True))
def kri_curve(spark, sf_dir):
    return observatory.curve(written(observatory.kri_exact(_closure(spark, sf_dir)), "kri"), [851990400, 883612800, 915148800])


@query()
def kri_hll(spark, sf_dir):
    return observatory.kri_estimated(observatory.kri_sketches(view(spark, sf_dir, "epoch_edges")))


@query()
def kri_validation(spark, sf_dir):
    exact = observatory.kri_exact(_closure(spark, sf_dir))
    return observatory.validation(exact, observatory.kri_estimated(observatory.kri_sketches(view(spark, sf_dir, "epoch_edges"))))


@query(with_views(["epoch_edges"], CLOSURE + """, s AS (SELECT epoch, node FROM (SELECT DISTINCT epoch, node FROM n) QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY md5(CAST(node AS VARCHAR)), node) <= 40)
SELECT epoch, node, kri, true AS within FROM kri JOIN s USING (epoch, node)""", True))
def kri_sampled_validation(spark, sf_dir):
    # the sketches' errors lie within their band; exact counts for forty nodes an epoch only
    edges = written(view(spark, sf_dir, "epoch_edges"), "epoch-edges")
    return observatory.sampled_validation(edges, observatory.kri_estimated(observatory.kri_sketches(edges)), 40).select("epoch", "node", "kri", "within")


@query(with_views(["names"], """, f AS (SELECT name, rank, replace(replace(replace(replace(replace(translate(lower(name), '013457', 'oleast'), 'rn', 'm'), 'vv', 'w'), '-', ''), '_', ''), '.', '') AS folded FROM names),
s AS (SELECT *, row_number() OVER (ORDER BY folded, name) AS place FROM f)
SELECT CASE WHEN a.rank <= b.rank THEN a.name ELSE b.name END AS popular, CASE WHEN a.rank <= b.rank THEN b.name ELSE a.name END AS lookalike, CAST(levenshtein(a.folded, b.folded) AS BIGINT) AS distance, CAST(greatest(a.rank, b.rank) AS DOUBLE) / least(a.rank, b.rank) AS popularity_ratio
FROM s a JOIN s b ON b.place BETWEEN a.place + 1 AND a.place + 20 WHERE levenshtein(a.folded, b.folded) <= 1"""))
def typosquat_pairs(spark, sf_dir):
    return typosquat.candidates(view(spark, sf_dir, "names"))


# Names as customers could spell them: a scope for every fifth, digits and letter pairs that look like others, separators.
_SPELT = "concat(CASE WHEN c_custkey % 5 = 0 THEN '@Shop_1/' ELSE '' END, c_mktsegment, '-', CAST(c_custkey AS {text}), '_vvarn.', CAST(c_nationkey AS {text}))"
_FOLDED = "replace(replace(replace(replace(replace(translate(lower({}), '013457', 'oleast'), 'rn', 'm'), 'vv', 'w'), '-', ''), '_', ''), '.', '')"


@query(f"""WITH n AS (SELECT {_SPELT.format(text="VARCHAR")} AS name FROM customer)
SELECT name, CASE WHEN contains(name, '/') THEN '@shop_1/' || {_FOLDED.format("split_part(name, '/', 2)")} ELSE {_FOLDED.format("name")} END AS folded FROM n""")
def name_normalize(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.expr(_SPELT.format(text="STRING")).alias("name"))
    return names.select("name", text.fold_name(F.col("name")).alias("folded"))


@query(with_views(["releases"], """, v AS (SELECT package, version, major, minor, patch, 1 AS final, 0 AS word, 0 AS n FROM releases
  UNION ALL SELECT package, version || '-rc.' || (part % 11), major, minor, patch, 0, 1, part % 11 FROM releases UNION ALL SELECT package, version || '-beta', major, minor, patch, 0, 0, 0 FROM releases)
SELECT package, version, row_number() OVER (PARTITION BY package ORDER BY major, minor, patch, final, word, n) AS place FROM v"""))
def semver_order(spark, sf_dir):
    releases = view(spark, sf_dir, "releases")
    spelt = F.explode(F.array("version", F.concat("version", F.lit("-rc."), F.col("part") % 11), F.concat("version", F.lit("-beta"))))
    place = F.row_number().over(Window.partitionBy("package").orderBy(semver.version_key(F.col("version"))))
    return releases.select("package", spelt.alias("version")).select("package", "version", place.cast("long").alias("place"))


#: Range texts made of a release's own numbers, and what they mean for another release in SQL.
_RANGES = {
    "^{a}.{b}.{c}": "(x.major, x.minor, x.patch) >= (r.major, r.minor, r.patch) AND x.major = r.major AND (r.major > 0 OR x.minor = r.minor) AND (r.major > 0 OR r.minor > 0 OR x.patch = r.patch)",
    "~{a}.{b}.{c}": "x.major = r.major AND x.minor = r.minor AND x.patch >= r.patch",
    ">{a}.{b}": "(x.major, x.minor) > (r.major, r.minor)",
    "<={a}.{b}.{c}": "(x.major, x.minor, x.patch) <= (r.major, r.minor, r.patch)",
    "{a}.x": "x.major = r.major",
    "<{a}.{b}.{c} || >={a}.{b}.{c} <{a}.{b}.99": "(x.major, x.minor, x.patch) < (r.major, r.minor, 99)",
    "0.{b}.{c} - {a}": "(x.major, x.minor, x.patch) >= (0, r.minor, r.patch) AND x.major <= r.major",
}


def _ranges(cut: str, shapes: dict = _RANGES) -> list[str]:
    """SQL for each range text; `cut` turns a number into text."""
    import re

    number = {"a": "major", "b": "minor", "c": "patch"}
    return ["concat(" + ", ".join(cut.format(number[m[1]]) if m[1] else f"'{m[0]}'" for m in re.finditer(r"\{(.)\}|[^{]+", t)) + ")" for t in shapes]


@query(with_views(["releases"], ", pair AS (SELECT *, lag(part) OVER (PARTITION BY package ORDER BY published_at, part) AS other FROM releases), "
    + "tried AS (" + " UNION ALL ".join(f"""SELECT {text_.replace("(major", "(r.major").replace("(minor", "(r.minor").replace("(patch", "(r.patch")} AS "range", x.version, {means} AS satisfied FROM pair x JOIN releases r ON r.part = x.other""" for text_, means in zip(_ranges("CAST({} AS VARCHAR)"), _RANGES.values(), strict=True)) + """)
SELECT DISTINCT "range", version, satisfied FROM tried"""))
def semver_satisfies(spark, sf_dir):
    releases = view(spark, sf_dir, "releases")
    texts = releases.select("part", F.explode(F.array(*map(F.expr, _ranges("CAST({} AS STRING)")))).alias("range"))
    earlier = F.lag("part").over(Window.partitionBy("package").orderBy("published_at", "part"))
    pairs = releases.select("version", earlier.alias("part")).join(texts, "part").select("range", "version").distinct()
    return semver.parse_ranges(pairs, "range").select("range", "version", semver.satisfies(semver.version_key(F.col("version")), F.col("parsed")).alias("satisfied"))


@query(with_views(["releases"], """, r AS (SELECT * FROM (VALUES ('^1.0.0'), ('~2.3'), ('<3.0.0'), ('*')) v(rng))
SELECT package, rng AS "range", arg_max(version, (major, minor, patch)) FILTER (WHERE CASE rng WHEN '^1.0.0' THEN major = 1 WHEN '~2.3' THEN major = 2 AND minor = 3 WHEN '<3.0.0' THEN major < 3 ELSE true END) AS version FROM releases, r GROUP BY ALL"""))
def semver_max(spark, sf_dir):
    ranges = spark.createDataFrame([("^1.0.0",), ("~2.3",), ("<3.0.0",), ("*",)], "range string")
    rows = view(spark, sf_dir, "releases").select("package", "version", semver.version_key(F.col("version")).alias("key")).crossJoin(F.broadcast(semver.parse_ranges(ranges, "range")))  # four ranges
    return rows.groupBy("package", "range").agg(semver.max_satisfying(F.col("key"), F.col("version"), F.col("parsed")).alias("version"))


# Every release also as a beta and as a release candidate of a number of its own, each a day earlier than the next form.
_FORMS = """, forms AS (SELECT package, version, major, minor, patch, 1 AS final, 0 AS word, 0 AS n, published_at, part FROM releases
  UNION ALL SELECT package, version || '-rc.' || (part % 11), major, minor, patch, 0, 1, part % 11, published_at - 86400, part FROM releases
  UNION ALL SELECT package, version || '-beta', major, minor, patch, 0, 0, 0, published_at - 172800, part FROM releases)
"""


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = lambda text, days: F.struct(text.alias("version"), (F.col("published_at") - 86400 * days).alias("published_at"))
    every = F.array(form(F.col("version"), 0), form(F.concat("version", F.lit("-rc."), F.col("part") % 11), 1), form(F.concat("version", F.lit("-beta")), 2))
    return view(spark, sf_dir, "releases").select("package", "part", F.explode(every).alias("f")).select("package", "part", "f.*")


#: Ranges with prereleases of a release's own numbers, and what they mean: of final versions, and of prereleases, which count
#: only with the very numbers that the range names with one.
_PRERELEASE_RANGES = {
    "^{a}.{b}.{c}-rc.2": (_RANGES["^{a}.{b}.{c}"], "x.word = 1 AND x.n >= 2"),
    ">={a}.{b}.{c}-beta": ("(x.major, x.minor, x.patch) >= (r.major, r.minor, r.patch)", "true"),
    "~{a}.{b}.{c}-rc.0": (_RANGES["~{a}.{b}.{c}"], "x.word = 1"),
    "<{a}.{b}.{c}": ("(x.major, x.minor, x.patch) < (r.major, r.minor, r.patch)", "false"),
    "<={a}.{b}.{c}-rc.5": ("(x.major, x.minor, x.patch) < (r.major, r.minor, r.patch)", "x.word = 0 OR x.n <= 5"),
}


@query(with_views(["releases"], _FORMS + ", pair AS (SELECT part AS x, part AS r FROM releases UNION ALL SELECT part, lag(part) OVER (PARTITION BY package ORDER BY published_at, part) FROM releases), tried AS ("
    + " UNION ALL ".join(f"""SELECT {text_.replace("(major", "(r.major").replace("(minor", "(r.minor").replace("(patch", "(r.patch")} AS "range", x.version,
      CASE WHEN x.final = 1 THEN {finals} ELSE (x.major, x.minor, x.patch) = (r.major, r.minor, r.patch) AND ({pres}) END AS satisfied
      FROM pair JOIN forms x ON x.part = pair.x JOIN releases r ON r.part = pair.r""" for text_, (finals, pres) in zip(_ranges("CAST({} AS VARCHAR)", _PRERELEASE_RANGES), _PRERELEASE_RANGES.values(), strict=True))
    + """) SELECT DISTINCT "range", version, satisfied FROM tried"""))
def semver_prereleases(spark, sf_dir):
    releases = view(spark, sf_dir, "releases")
    earlier = F.lag("part").over(Window.partitionBy("package").orderBy("published_at", "part"))
    pairs = releases.select("part", earlier.alias("before")).select("part", F.explode(F.array("part", "before")).alias("of")).where("of IS NOT NULL")
    texts = releases.select(F.col("part").alias("of"), F.explode(F.array(*map(F.expr, _ranges("CAST({} AS STRING)", _PRERELEASE_RANGES)))).alias("range"))
    tried = _forms(spark, sf_dir).join(pairs, "part").join(texts, "of").select("range", "version").distinct()
    return semver.parse_ranges(tried, "range").select("range", "version", semver.satisfies(semver.version_key(F.col("version")), F.col("parsed")).alias("satisfied"))


# In SQL a version is one number: major * 10^12 + minor * 10^7 + patch * 10^4, then final 1000, candidates 100 and their number.
@query(with_views(["releases"], _FORMS + """, k AS (SELECT *, major * 1000000000000 + minor * 10000000 + patch * 10000 + final * 1000 + word * 100 + n AS v FROM forms)
SELECT concat('A-', package) AS osv_id, package, version, '0' AS introduced, '1.5.0-rc.3' AS fixed FROM k WHERE v >= 1000 AND v < 1000050000103
UNION ALL SELECT concat('B-', package), package, version, '2.0.0-beta', '' FROM k WHERE v >= 2000000000000 AND v <= 2000400071000
UNION ALL SELECT concat('C-', package), package, version, '1.0.0', '3.2.0' FROM k WHERE (v >= 1000000001000 AND v < 1000090001000) OR (v >= 2000010000000 AND v < 3000020001000)
UNION ALL SELECT concat('D-', package), package, version, '', '' FROM k WHERE version IN ('1.3.1', '2.7.4-beta', '0.1.2')"""))
def advisory_event_lists(spark, sf_dir):
    # from the first version, 0.0.0, to a prerelease; up to a last affected one; two stretches in one list; listed versions only
    forms = _forms(spark, sf_dir)
    event = lambda kind, v: F.struct(*(F.lit(v if k == kind else None).cast("string").alias(k) for k in ("introduced", "fixed", "last_affected")))
    lists = {
        "A": [("introduced", "0"), ("fixed", "1.5.0-rc.3")], "B": [("introduced", "2.0.0-beta"), ("last_affected", "2.40.7")],
        "C": [("introduced", "1.0.0"), ("fixed", "1.9.0"), ("introduced", "2.1.0-beta"), ("fixed", "3.2.0")], "D": [],
    }
    ranges = lambda events: F.array(F.struct(F.lit("SEMVER").alias("type"), F.array(*(event(*e) for e in events)).alias("events"))) if events else F.array().cast(f"array<struct<type:string,events:{advisory.EVENTS}>>")
    listed = F.array(*map(F.lit, ("1.3.1", "2.7.4-beta", "0.1.2")))
    block = lambda events: F.struct(F.struct(F.lit("npm").alias("ecosystem"), F.col("package").alias("name")).alias("package"), ranges(events).alias("ranges"), listed.alias("versions"))
    record = F.explode(F.array(*(F.struct(F.concat(F.lit(f"{k}-"), "package").alias("osv_id"), F.array(block(events)).alias("affected")) for k, events in lists.items())))
    return advisory.affected_versions(forms.select("package").distinct().select(record.alias("r")).select("r.*"), forms)


#: Declared ranges, and which releases they mean; prereleases are meant by none of them.
_SHAPES = {
    "~1.3": "major = 1 AND minor = 3", ">=1.2.0 <2.5.0": "(major = 1 AND minor >= 2) OR (major = 2 AND minor < 5)", "1.x || 3.x": "major IN (1, 3)", "*": "true",
    "<=2.10.5": "major < 2 OR (major = 2 AND (minor < 10 OR (minor = 10 AND patch <= 5)))", "0.2 - 2": "major IN (1, 2) OR (major = 0 AND minor >= 2)",
}


@query(with_views(["releases"], ", c AS (" + " UNION ALL ".join(f"SELECT concat(package, ' {shape}') AS declaration, version, published_at, major * 1000000 + minor * 100 + patch AS k FROM releases WHERE published_at > 0 AND ({means})" for shape, means in _SHAPES.items())
    + f"""), r AS (SELECT *, max(k) OVER (PARTITION BY declaration ORDER BY published_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM c)
SELECT declaration, version, published_at AS vf, lead(published_at, 1, {OPEN}) OVER (PARTITION BY declaration ORDER BY published_at, k) AS vt FROM r WHERE best IS NULL OR k > best
QUALIFY vf < vt"""))  # fmt: skip
def resolution_shapes(spark, sf_dir):
    forms = _forms(spark, sf_dir)
    shapes = F.explode(F.array(*map(F.lit, _SHAPES))).alias("range")
    declared = forms.select("package").distinct().select("package", shapes).select(F.concat_ws(" ", "package", "range").alias("declaration"), "package", "range", F.lit(0).cast("long").alias("declared_at"))
    return temporal.resolution_windows(declared, forms)


@query(with_views(["releases", "epoch_list"], ASOF + "SELECT package, epoch, version FROM cur"))
def asof_among_prereleases(spark, sf_dir):
    # the newest of all forms is often a prerelease, which no epoch counts as current
    forms = _forms(spark, sf_dir).withColumn("published_at", F.when(F.col("version").contains("-"), F.col("published_at") + 400_000).otherwise(F.col("published_at")))
    return temporal.versions_as_of(forms, view(spark, sf_dir, "epoch_list"))


# A lock file for each order: its parts are the packages, their suppliers give the versions. Line 1 is declared by the
# project, even lines are for development.
_LOCKED = """WITH l AS (SELECT o_orderkey AS o, l_partkey AS p, min(l_linenumber) AS n, min(l_suppkey) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT concat('o', o, '/{}') AS path, concat({}, 'part-', p) AS name, concat(s, '.', n, '.0') AS version, {} AS direct, {} AS dev FROM l"""


def _lines(spark: SparkSession, sf_dir: str, by_order: bool = False) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if by_order:
        lines = lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey").repartition(_tasks(lines), "l_orderkey")
    return lines.groupBy(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).agg(F.min("l_linenumber").alias("n"), F.min("l_suppkey").alias("s")).withColumn("version", F.concat_ws(".", "s", "n", F.lit("0")))


def _files(lines: DataFrame, name: str, head: str, body: Column, tail: str = "") -> DataFrame:
    """A file for each order: a head, its lines in order, a tail."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "p", body.alias("text")))), lambda x: x["text"]), "")
    return lines.groupBy("o").agg(F.concat(F.lit(head), whole, F.lit(tail)).alias("content")).select(F.concat(F.lit("o"), "o", F.lit(f"/{name}")).alias("path"), "content")


@query(_LOCKED.format("package-lock.json", "''", "n = 1", "n % 2 = 0"))
def lockfile_npm(spark, sf_dir):
    # odd orders as flat maps with a root entry, even ones as nested trees, as old files have them
    lines = _lines(spark, sf_dir)
    name = F.concat(F.lit("part-"), "p")
    entry = F.struct("version", (F.col("n") % 2 == 0).alias("dev"))
    below = lambda top: F.map_from_entries(F.collect_list(F.when((F.col("n") == 1) == top, F.struct(name, entry))))
    flat = lines.where("o % 2 = 1").groupBy("o").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("node_modules/"), name), entry))).alias("all"), F.map_from_entries(F.collect_list(F.when(F.col("n") == 1, F.struct(name, F.lit("*").alias("range"))))).alias("declared")
    )
    packages = F.concat(F.lit('{"name":"x","packages":{"":{"dependencies":'), F.to_json("declared"), F.lit("},"), F.substr(F.to_json("all"), F.lit(2)), F.lit("}"))
    # everything but line 1 hangs under an entry without a version, which is no pin
    nested = lines.where("o % 2 = 0").groupBy("o").agg(below(True).alias("top"), below(False).alias("deep"))
    inner = F.concat(F.lit('"holder":{"dependencies":'), F.to_json("deep"), F.lit("}"))
    tree = F.concat(F.lit('{"name":"x","dependencies":{'), inner, F.when(F.size("top") > 0, F.concat(F.lit(","), F.substr(F.to_json("top"), F.lit(2)))).otherwise("}"), F.lit("}"))
    path = F.concat(F.lit("o"), "o", F.lit("/package-lock.json")).alias("path")
    return lockfiles.parse(flat.select(path, packages.alias("content")).unionByName(nested.select(path, tree.alias("content"))))


@query("""WITH l AS (SELECT o_orderkey AS o, l_partkey AS p, min(l_linenumber) AS n, min(l_suppkey) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
k AS (SELECT *, lead(p) OVER w AS q, lead(n) OVER w AS qn, lead(s) OVER w AS qs, lead(p, 2) OVER w AS r, lead(n, 2) OVER w AS rn, lead(s, 2) OVER w AS rs FROM l WINDOW w AS (PARTITION BY o ORDER BY n, p)),
a AS (SELECT o, concat('node_modules/part-', p) AS place, coalesce('part-' || q, 'gone') AS name, concat('^', n) AS "range",
    CASE WHEN q IS NULL THEN NULL WHEN n % 2 = 0 THEN concat('node_modules/part-', p, '/node_modules/part-', q) ELSE concat('node_modules/part-', q) END AS resolved_place,
    CASE WHEN q IS NULL THEN NULL WHEN n % 2 = 0 THEN concat('9.', n, '.0') ELSE concat(qs, '.', qn, '.0') END AS version FROM k
  UNION ALL SELECT o, concat('node_modules/part-', p, '/node_modules/part-', q), concat('part-', r), '*', concat('node_modules/part-', r), concat(rs, '.', rn, '.0') FROM k WHERE n % 2 = 0 AND r IS NOT NULL)
SELECT concat('o', o, '/package-lock.json') AS path, place, name, "range", resolved_place, version FROM a""")
def nearest_scope(spark, sf_dir):
    # in every order each part needs the next one; parts of even lines have an own copy of it below them, which needs the one after.
    # Lines are dealt by order once, and all that follows of an order stays in its task
    line = _lines(spark, sf_dir, by_order=True)
    by_line = Window.partitionBy("o").orderBy("n", "p")
    part = lambda c: F.concat(F.lit("part-"), c)
    k = line.select("o", "p", "n", "version", F.lead("p").over(by_line).alias("q"), F.lead("p", 2).over(by_line).alias("r"))
    need = lambda name, text: F.map_from_arrays(F.array(name), F.array(text))
    top = F.struct(F.concat(F.lit("node_modules/"), part("p")).alias("place"), F.struct("version", need(F.coalesce(part("q"), F.lit("gone")), F.concat(F.lit("^"), "n")).alias("dependencies")).alias("entry"))
    below = F.struct(
        F.concat(F.lit("node_modules/"), part("p"), F.lit("/node_modules/"), part("q")).alias("place"),
        F.struct(F.concat(F.lit("9."), "n", F.lit(".0")).alias("version"), F.when(F.col("r").isNotNull(), need(part("r"), F.lit("*"))).alias("dependencies")).alias("entry"),
    )
    placed = k.select("o", F.explode(F.when((F.col("n") % 2 == 0) & F.col("q").isNotNull(), F.array(top, below)).otherwise(F.array(top))).alias("x"))
    packages = placed.groupBy("o").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("x.place", "x.entry")))).alias("packages"))
    files = packages.select(F.concat(F.lit("o"), "o", F.lit("/package-lock.json")).alias("path"), F.concat(F.lit('{"name":"x","packages":{"":{},'), F.substr("packages", F.lit(2)), F.lit("}")).alias("content"))
    return scopes.nearest_scope_in_files(lockfiles.scoped(files))


# Every locked part is a release of its brand, asked for by the range of its own major version.
@query(with_views(["releases", "locks"], f""", r AS (SELECT *, max(minor * 100 + patch) OVER (PARTITION BY package, major ORDER BY published_at, minor * 100 + patch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM releases WHERE published_at > 0),
w AS (SELECT package, major, version, published_at AS vf, lead(published_at, 1, {OPEN}) OVER (PARTITION BY package, major ORDER BY published_at, minor * 100 + patch) AS vt FROM r WHERE best IS NULL OR minor * 100 + patch > best),
j AS (SELECT CASE WHEN w.version IS NULL THEN 'no window' WHEN w.version = x.version THEN 'agree' ELSE 'disagree' END AS verdict FROM locks JOIN releases x ON x.part = node LEFT JOIN w ON w.package = x.package AND w.major = x.major AND w.vf <= locked_at AND locked_at < w.vt)
SELECT verdict, count(*) AS locks, (SELECT count(*) FILTER (WHERE verdict = 'agree') / count(*) FILTER (WHERE verdict <> 'no window') FROM j) AS rate FROM j GROUP BY verdict"""))
def lock_agreement(spark, sf_dir):
    releases = view(spark, sf_dir, "releases")
    asked = F.concat("package", F.lit("#"), "major")
    declared = releases.select(asked.alias("declaration"), "package", F.concat("major", F.lit(".x")).alias("range"), F.lit(0).cast("long").alias("declared_at")).distinct()
    locked = view(spark, sf_dir, "locks").join(releases.select(F.col("part").alias("node"), asked.alias("declaration"), "version"), "node")
    return scopes.agreement(locked, temporal.resolution_windows(declared, releases))


@query(_LOCKED.format("pnpm-lock.yaml", "CASE WHEN p % 3 = 0 THEN '@shop/' ELSE '' END", "false", "false"))
def lockfile_pnpm(spark, sf_dir):
    # each key in one of the three forms, some with peers in brackets
    scope = F.when(F.col("p") % 3 == 0, "@shop/").otherwise("")
    name, v = F.concat(scope, F.lit("part-"), "p"), F.col("version")
    key = F.when(F.col("n") == 1, F.concat(F.lit("  /"), name, F.lit("/"), v)).when(F.col("n") == 2, F.concat(F.lit("  '"), name, F.lit("@"), v, F.lit("'"))).otherwise(F.concat(F.lit("  /"), name, F.lit("@"), v, F.lit("(peer@9.9.9)")))
    return lockfiles.parse(_files(_lines(spark, sf_dir), "pnpm-lock.yaml", "lockfileVersion: '6.0'\n\npackages:\n", F.concat(key, F.lit(":\n    resolution: {integrity: none}\n")), "\nsnapshots:\n  other@1.0.0:\n"))


@query(_LOCKED.format("yarn.lock", "''", "false", "false"))
def lockfile_yarn(spark, sf_dir):
    # classic entries, aliases, and entries of the workspace itself, which are no pins
    name, v = F.concat(F.lit("part-"), "p"), F.col("version")
    classic = F.concat(name, F.lit("@^1, "), name, F.lit("@*:\n  version \""), v, F.lit("\"\n  resolved none\n\n"))
    alias = F.concat(F.lit('"other-'), "p", F.lit("@npm:"), name, F.lit('@1":\n  version: '), v, F.lit("\n\n"))
    own = F.concat(F.lit('"here-'), "p", F.lit('@workspace:x":\n  version: 1.0.0\n\n'))
    return lockfiles.parse(_files(_lines(spark, sf_dir), "yarn.lock", "# lock file\n\n", F.when(F.col("n") % 2 == 0, F.concat(alias, own)).otherwise(classic)))


@query(with_views(["releases"], " SELECT package, version, CASE WHEN part % 4 = 0 THEN 0 ELSE published_at END AS published_at, part % 3 = 0 AS deprecated FROM releases"))
def timeline_feed(spark, sf_dir):
    listed = F.struct(F.struct("version").alias("versionKey"), F.when(F.col("part") % 4 != 0, F.concat(F.date_format(F.timestamp_seconds("published_at"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("publishedAt"), F.when(F.col("part") % 3 == 0, F.lit(True)).alias("isDeprecated"))
    return feeds.timeline(view(spark, sf_dir, "releases").groupBy("package").agg(F.to_json(F.struct(F.collect_list(listed).alias("versions"))).alias("content")))


@query("""WITH l AS (SELECT l_orderkey AS o, l_partkey AS p, min(l_linenumber) AS n FROM lineitem GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n, p) AS place, lag(p) OVER (PARTITION BY o ORDER BY n, p) AS before FROM l)
SELECT concat('order-', o) AS package, CASE WHEN place = 1 THEN concat('order-', o) ELSE concat('part-', before) END AS from_name, concat('part-', p) AS name, concat('1.', n, '.0') AS resolved, concat('^', n) AS "range", place = 1 AS direct FROM k""")
def dependency_feed(spark, sf_dir):
    # every order's parts as a chain below the order itself
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).agg(F.min("l_linenumber").alias("n"))
    chain = lines.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("n", "p"))).alias("parts"))
    node = lambda name, version, relation: F.struct(F.struct(name.alias("name"), version.alias("version")).alias("versionKey"), F.lit(relation).alias("relation"))
    own = F.array(node(F.concat(F.lit("order-"), "o"), F.lit("1.0.0"), "SELF"))
    nodes = F.concat(own, F.transform("parts", lambda x: node(F.concat(F.lit("part-"), x["p"]), F.concat(F.lit("1."), x["n"], F.lit(".0")), "DIRECT")))
    edges = F.transform("parts", lambda x, i: F.struct(i.alias("fromNode"), (i + 1).alias("toNode"), F.concat(F.lit("^"), x["n"]).alias("requirement")))
    docs = chain.select(F.concat(F.lit("order-"), "o").alias("package"), F.lit("1.0.0").alias("version"), F.to_json(F.struct(nodes.alias("nodes"), edges.alias("edges"))).alias("content"))
    return feeds.dependencies(docs).select("package", "from_name", "name", "resolved", "range", "direct")


@query("""SELECT concat('part-', p_partkey) AS name, concat('1.', p_size, '.0') AS version, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE lower(p_brand) END AS published_by,
  p_size % 2 = 0 AS has_provenance, p_size % 5 = 0 AS has_install_script FROM part""")
def version_document_feed(spark, sf_dir):
    # an approver counts before the account that published
    brand, kind, key = F.lower("p_brand"), F.lower("p_type"), F.col("p_partkey")
    user = F.when(key % 3 != 0, F.struct(F.when(key % 2 == 0, "a robot").otherwise(brand).alias("name"), F.when(key % 2 == 0, F.struct(kind.alias("name"))).alias("approver")))
    dist = F.struct(F.when(F.col("p_size") % 2 == 0, F.struct(F.struct(F.lit("built").alias("predicateType")).alias("provenance"))).alias("attestations"))
    scripts = F.when(F.col("p_size") % 5 == 0, F.create_map(F.element_at(F.array(*map(F.lit, ("preinstall", "install", "postinstall"))), (key % 3 + 1).cast("int")), F.lit("run"))).otherwise(F.create_map(F.lit("test"), F.lit("run")))
    doc = F.struct(F.concat(F.lit("part-"), key).alias("name"), F.concat(F.lit("1."), "p_size", F.lit(".0")).alias("version"), user.alias("_npmUser"), dist.alias("dist"), scripts.alias("scripts"))
    return feeds.version_documents(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.to_json(doc).alias("content"))).drop("maintainers")


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE epoch(o_orderdate) - CASE WHEN o_orderkey % 5 = 1 THEN 7200 WHEN o_orderkey % 5 = 2 THEN -19800 ELSE 0 END END AS BIGINT) AS seconds FROM orders""")
def rfc3339_parse(spark, sf_dir):
    # in UTC, with a fraction, east and west of it, and no such time at all
    bare, key = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.col("o_orderkey") % 5
    written_ = F.when(key == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(key == 1, F.concat(bare, F.lit("+02:00"))).when(key == 2, F.concat(bare, F.lit("-05:30"))).when(key == 3, F.concat(bare, F.lit(".000Z"))).otherwise(F.concat(bare, F.lit("Z")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.rfc3339_seconds(written_).alias("seconds"))


@query("SELECT CAST(epoch(date_trunc('quarter', m) - to_months(CAST(3 * i AS INTEGER))) AS BIGINT) AS epoch FROM (SELECT max(o_orderdate) AS m FROM orders), range(8) t(i)")
def epochs_quarterly(spark, sf_dir):
    last = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd")).first()[0]
    return temporal.epochs(spark, 8, last)


@query(with_views(["holds", "shipped"], """, a AS (SELECT package AS part, count(*) AS n FROM holds GROUP BY 1), b AS (SELECT l_partkey AS part, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)
SELECT part, coalesce(a.n, 0) AS held, coalesce(b.n, 0) AS shipped, coalesce(a.n, 0) <> coalesce(b.n, 0) AS differs FROM a FULL JOIN b USING (part)"""))
def count_crosscheck(spark, sf_dir):
    a = view(spark, sf_dir, "holds").groupBy(F.col("package").alias("part")).agg(F.count("*").alias("a"))
    b = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_partkey").alias("part")).agg(F.count_distinct("l_suppkey").alias("b"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return a.join(b, "part", "full_outer").select("part", n("a").alias("held"), n("b").alias("shipped"), (n("a") != n("b")).alias("differs"))
