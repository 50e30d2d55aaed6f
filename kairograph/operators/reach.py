"""Reachability over edges that hold only for a time.

`edges` are rows (src, dst, vf, vt). A node is reached at an instant if a path of at most `depth` edges
from a source holds whole at that instant. The search runs in supersteps on a frontier of (node, interval) rows. What
a superstep reaches is merged to maximal intervals, and only the instants at which the node wasn't reached before go on,
so a node has few rows however many paths lead to it, and every instant of it carries its least number of
hops. `keys` are columns that keep independent searches apart in one run (an account removed, a kind of graph): any
number of searches costs one loop; `tagged` says that edges carry these keys too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.functions.intervals import OPEN, coalesce, contains, minus
from kairograph.functions.lineage import Steps, written

DEPTH = 12


def always(nodes: DataFrame, *keys: str) -> DataFrame:
    """Sources that exist at all times."""
    return nodes.select(*keys, "node", F.lit(0).cast("long").alias("vf"), F.lit(OPEN).cast("long").alias("vt"))


def clipped(spans: DataFrame, within: tuple[int, int]) -> DataFrame:
    vf, vt = F.greatest("vf", F.lit(within[0])), F.least("vt", F.lit(within[1]))
    return spans.withColumns({"vf": vf.cast("long"), "vt": vt.cast("long")}).where("vf < vt")


def expanded(front: DataFrame, edges: DataFrame, keys: Sequence[str] = (), blocked: DataFrame | None = None, tagged: bool = False) -> DataFrame:
    """One hop on: an equi-join on the node, intervals intersected, empty ones dropped."""
    steps = edges.select(*(F.col(k).alias(f"__{k}") for k in keys if tagged), F.col("src").alias("__src"), F.col("dst").alias("__dst"), F.col("vf").alias("__vf"), F.col("vt").alias("__vt"))
    same = F.col("node") == F.col("__src")
    for k in keys if tagged else ():
        same = same & (F.col(k) == F.col(f"__{k}"))
    new = front.join(steps, same).select(*keys, F.col("__dst").alias("node"), F.greatest("vf", "__vf").alias("vf"), F.least("vt", "__vt").alias("vt")).where("vf < vt")
    return new if blocked is None else new.join(blocked, [*keys, "node"], "left_anti")


def _stepped(
    steps: Steps, edges: DataFrame, sources: DataFrame, keys: Sequence[str] = (), depth: int = DEPTH, within: tuple[int, int] = (0, OPEN), blocked: DataFrame | None = None, tagged: bool = False
) -> Iterator[DataFrame]:
    names = [*keys, "node"]
    first = clipped(sources.select(*names, "vf", "vt"), within)
    front = steps.add(coalesce(first if blocked is None else first.join(blocked, names, "left_anti"), names))
    yield front
    for _ in range(depth):
        front = steps.add(minus(expanded(front, edges, keys, blocked, tagged), steps.all(), names))
        if front.isEmpty():
            return
        yield front


def frontiers(edges: DataFrame, sources: DataFrame, keys: Sequence[str] = (), **options) -> Iterator[DataFrame]:
    """The rows (keys, node, vf, vt) that each superstep adds, the sources first. Options: depth; within, an interval that all
    happens in; blocked, (keys, node) never entered; tagged."""
    return _stepped(Steps(edges.sparkSession, "search"), edges, sources, keys, **options)


def layers(edges: DataFrame, sources: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    """Rows (keys, node, vf, vt, hop): the instants at which each node is reached, by the least number of edges that it takes then.
    No two rows of a node share an instant. They lie in the shared folder."""
    steps = Steps(edges.sparkSession, "search")
    for _ in _stepped(steps, edges, sources, keys, **options):
        pass
    return steps.all()


def coexistence_reach(edges: DataFrame, sources: DataFrame, keys: Sequence[str] = (), depth: int = DEPTH, within: tuple[int, int] = (0, OPEN), blocked: DataFrame | None = None) -> DataFrame:
    """Rows (keys, node, vf, vt): the maximal intervals at which each node is reached."""
    return coalesce(layers(edges, sources, keys, depth=depth, within=within, blocked=blocked), [*keys, "node"])


def timeless(edges: DataFrame) -> DataFrame:
    """Each pair of ends once, at all times."""
    return edges.select("src", "dst", F.lit(0).cast("long").alias("vf"), F.lit(OPEN).cast("long").alias("vt")).distinct()


def _rounds(last: int | None, depth: int) -> tuple[int, bool]:
    """Expansion rounds up to the layer `last`, the empty one included, and whether the depth ended the search."""
    return (0 if last is None else min(depth, last + 1)), last == depth


def union_reach(edges: DataFrame, sources: DataFrame, keys: Sequence[str] = (), depth: int = DEPTH) -> tuple[DataFrame, int, bool]:
    """Nodes reached when intervals are ignored, with their layer; the number of expansion rounds (the last, empty one
    included); and whether the frontier was not empty after the last."""
    names = [*keys, "node"]
    pairs, steps = written(edges.select(F.col("src").alias("node"), "dst").distinct(), "pairs"), Steps(edges.sparkSession, "layers")
    front = steps.add(sources.select(*names).distinct())
    last = None if front.isEmpty() else 0
    while last is not None and last < depth:
        front = steps.add(front.join(pairs, "node").select(*keys, F.col("dst").alias("node")).distinct().join(steps.all(), names, "left_anti"))
        if front.isEmpty():
            break
        last += 1
    return steps.all().select(*names, F.col("hop").cast("long").alias("layer")), *_rounds(last, depth)


def reached_at(spans: DataFrame, t: int) -> DataFrame:
    return spans.where(contains(t)).select("node").distinct()


def phantoms(union: DataFrame, spans: DataFrame) -> DataFrame:
    """Nodes that only the union graph reaches."""
    return union.select("node").distinct().join(spans.select("node"), "node", "left_anti")


def both_graphs(edges: DataFrame, sources: DataFrame, depth: int = DEPTH) -> DataFrame:
    """`layers` of the graph in time and of the union graph in one loop: rows carry `timeless`, which tells them apart."""
    tag = lambda df, kind: df.withColumn("timeless", F.lit(kind))
    steps = written(tag(edges.select("src", "dst", "vf", "vt"), False).unionByName(tag(timeless(edges), True)), "steps")
    starts = tag(sources.select("node", "vf", "vt"), False).unionByName(tag(always(sources.select("node").distinct()), True))
    return layers(steps, starts, ["timeless"], depth=depth, tagged=True)


def summary(edges: DataFrame, sources: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row: node counts of both graphs, phantoms, mean intervals a node, depth and truncation. No sources give zeros and a
    null mean."""
    found = both_graphs(edges, sources, depth)
    spans = coalesce(found.where("NOT timeless")).agg(F.count_distinct("node").alias("n_coexistence"), F.count("*").alias("n_spans"))
    union = found.where("timeless").agg(F.count("*").alias("n_union"), F.max("hop").alias("last"))
    return union.crossJoin(spans).select(  # one row each
        "n_union", "n_coexistence", (F.col("n_union") - F.col("n_coexistence")).alias("n_phantom"), F.round(F.try_divide(F.col("n_spans"), F.col("n_coexistence")), 6).alias("kappa"),
        F.when(F.col("last").isNull(), 0).otherwise(F.least(F.lit(depth), F.col("last") + 1)).cast("long").alias("depth"), F.coalesce(F.col("last") == depth, F.lit(False)).alias("truncated"),
    )


def counts(spans: DataFrame, union: DataFrame) -> DataFrame:
    """One row: distinct versions (nodes) and packages that are reached over coexisting edges and in the graph without time. Both inputs:
    (node, package); a node with no package, null or empty, counts as a version only."""
    nodes = spans.select("node", "package", F.lit(True).alias("live")).unionByName(union.select("node", "package", F.lit(False).alias("live")))
    # nodes first, so that packages are counted over one row a node
    once = nodes.groupBy("node").agg(F.max(F.nullif("package", F.lit(""))).alias("package"), F.bool_or("live").alias("live"), F.bool_or(~F.col("live")).alias("timeless"))
    packages = once.groupBy("package").agg(F.count_if("live").alias("l"), F.count_if("timeless").alias("t"))
    named = F.col("package").isNotNull()
    return packages.agg(
        F.count_if(named & (F.col("l") > 0)).alias("coexistence_packages"), F.coalesce(F.sum("l"), F.lit(0)).alias("coexistence_versions"),
        F.count_if(named & (F.col("t") > 0)).alias("union_packages"), F.coalesce(F.sum("t"), F.lit(0)).alias("union_versions"),
    )


def reverse_reach(edges: DataFrame, held: DataFrame, **options) -> DataFrame:
    """Dependents of the held nodes over the spans in which they were held; the held nodes themselves are left out."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "vf", "vt")
    return coexistence_reach(back, held, **options).join(held.select("node").distinct(), "node", "left_anti")


def back_pointers(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(hop, src, dst, vf, vt): the instants at which an edge is the last of a shortest path to `dst` of `hop` edges; found: `layers`.
    Sources have none: they are reached by no edge."""
    before = found.select(F.col("node").alias("src"), F.col("vf").alias("u_vf"), F.col("vt").alias("u_vt"), (F.col("hop") + 1).alias("hop"))
    after = found.select(F.col("node").alias("dst"), F.col("vf").alias("v_vf"), F.col("vt").alias("v_vt"), "hop")
    live = edges.select("src", "dst", "vf", "vt").join(before, "src").withColumns({"vf": F.greatest("vf", "u_vf"), "vt": F.least("vt", "u_vt")}).where("vf < vt")
    both = live.join(after, ["dst", "hop"]).withColumns({"vf": F.greatest("vf", "v_vf"), "vt": F.least("vt", "v_vt")}).where("vf < vt")
    return both.select("hop", "src", "dst", "vf", "vt")


def entering(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(hop, src, dst, vf, vt): every edge out of a reached node, with the number of edges of a shortest path that it ends; also
    edges into nodes that are reached in fewer, as sources are."""
    before = found.select(F.col("node").alias("src"), F.col("vf").alias("u_vf"), F.col("vt").alias("u_vt"), (F.col("hop") + 1).alias("hop"))
    return edges.select("src", "dst", "vf", "vt").join(before, "src").withColumns({"vf": F.greatest("vf", "u_vf"), "vt": F.least("vt", "u_vt")}).where("vf < vt").select("hop", "src", "dst", "vf", "vt")


def package_chains(edges: DataFrame, sources: DataFrame, wanted: DataFrame, package_of: Callable[[Column], Column], depth: int = DEPTH) -> DataFrame:
    """For each wanted package the shortest chain of one edge or more, all of whose edges hold at one instant, from a source to any of
    its nodes: (package, found, hops, path, vf, vt), vf to vt being the first unbroken span of the whole chain. A package
    without a chain stays, unfound.

    Of equally short chains the one counts whose node list, read from its end, comes first. The search keeps no paths: chains
    are read off backwards from the table of back pointers, all packages at once, one node a step; a step takes the least
    node that is still on a chain and the instants that are left.
    """
    steps = written(edges.select("src", "dst", "vf", "vt"), "steps")
    found = layers(steps, sources, depth=depth)
    last = entering(steps, found).withColumn("package", package_of(F.col("dst"))).join(wanted.select("package").distinct(), "package", "left_semi").where(F.col("hop") <= depth)
    best = last.groupBy("package").agg(F.min(F.struct("hop", "dst", "src")).alias("b")).select("package", "b.*")
    now = written(
        last.join(best, ["package", "hop", "dst", "src"]).select("package", F.col("hop").alias("hops"), (F.col("hop") - 1).alias("left"), F.array("src", "dst").alias("path"), F.col("src").alias("node"), "vf", "vt"), "chains"
    )
    pointers, done = written(back_pointers(steps, found).select(F.col("hop").alias("left"), F.col("dst").alias("node"), F.col("src").alias("before"), F.col("vf").alias("p_vf"), F.col("vt").alias("p_vt")), "pointers"), []
    for _ in range(depth):
        done.append(now.where("left = 0"))
        now = now.where("left > 0")
        if now.isEmpty():
            break
        back = now.join(pointers, ["left", "node"]).withColumns({"vf": F.greatest("vf", "p_vf"), "vt": F.least("vt", "p_vt")}).where("vf < vt")
        least = back.groupBy("package").agg(F.min("before").alias("before"))
        taken = back.join(least, ["package", "before"])
        now = written(taken.select("package", "hops", (F.col("left") - 1).alias("left"), F.concat(F.array("before"), "path").alias("path"), F.col("before").alias("node"), "vf", "vt").distinct(), "chains")
    whole = done[0]
    for rows in done[1:]:
        whole = whole.unionByName(rows)
    spans = coalesce(whole, ["package", "hops", "path"])
    first = spans.groupBy("package").agg(F.min_by(F.struct("hops", "path", "vf", "vt"), "vf").alias("c")).select("package", "c.*")
    return wanted.select("package").distinct().join(first, "package", "left").select("package", F.col("hops").isNotNull().alias("found"), F.col("hops").cast("long").alias("hops"), "path", "vf", "vt")


def proof_paths(edges: DataFrame, sources: DataFrame, longest: int = DEPTH, targets: DataFrame | None = None) -> DataFrame:
    """For each reached node the shortest path of one edge or more whose edges coexist: node, hops, path and its span.

    Exact, and of equally short paths the one whose node list comes first. Rows are (node, interval) states with their
    best path; a state inside a known one of fewer hops can't lead to a shorter path and is dropped.
    """
    steps = edges.select(F.col("src").alias("__src"), F.col("dst").alias("__dst"), F.col("vf").alias("__vf"), F.col("vt").alias("__vt"))
    front = sources.select("node", "vf", "vt", F.array("node").alias("path"), F.lit(0).cast("long").alias("hops")).where("vf < vt")
    known, found = front.select("node", "vf", "vt"), None
    for hop in range(1, longest + 1):
        new = (
            front.join(steps, front["node"] == steps["__src"])
            .select(F.col("__dst").alias("node"), F.greatest("vf", "__vf").alias("vf"), F.least("vt", "__vt").alias("vt"), F.concat("path", F.array("__dst")).alias("path"))
            .where("vf < vt")
            .groupBy("node", "vf", "vt")
            .agg(F.min("path").alias("path"))
            .withColumn("hops", F.lit(hop).cast("long"))
        )
        new = written(new, "paths")
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        k = known.select(*(F.col(c).alias(f"k_{c}") for c in ("node", "vf", "vt")))
        front = written(new.join(k, (F.col("node") == F.col("k_node")) & (F.col("k_vf") <= F.col("vf")) & (F.col("k_vt") >= F.col("vt")), "left_anti"), "front")
        known = known.unionByName(front.select("node", "vf", "vt"))
    if found is None:
        found = front.where("false")
    best = found.groupBy("node").agg(F.min(F.struct("hops", "path", "vf", "vt")).alias("best")).select("node", "best.*")
    return best if targets is None else targets.select("node").distinct().join(best, "node", "left").withColumn("found", F.col("hops").isNotNull())


def package_graph(edges: DataFrame, spans: DataFrame, package: str) -> DataFrame:
    """Edges between packages: self-edges dropped, coexistent where both ends are (an approximation), and where an edge's own
    interval meets the source's (exact). package: expression giving a node's package."""
    ends = edges.withColumns({"from_package": F.expr(package.format(node="src")), "to_package": F.expr(package.format(node="dst"))}).where("from_package <> to_package")
    inside = spans.select("node").distinct()
    live = spans.select(F.col("node").alias("src"), F.col("vf").alias("n_vf"), F.col("vt").alias("n_vt"))
    meets = edges.join(live, "src").where(F.greatest("vf", "n_vf") < F.least("vt", "n_vt")).select("src", "dst", F.lit(True).alias("m")).distinct()
    flagged = (
        ends.select("src", "dst", "from_package", "to_package").distinct()
        .join(inside.select(F.col("node").alias("src"), F.lit(True).alias("a")), "src", "left")
        .join(inside.select(F.col("node").alias("dst"), F.lit(True).alias("b")), "dst", "left")
        .join(meets, ["src", "dst"], "left")
    )
    return flagged.groupBy("from_package", "to_package").agg(
        F.bool_or(F.coalesce(F.col("a") & F.col("b"), F.lit(False))).alias("coexistent"), F.bool_or(F.coalesce("m", F.lit(False))).alias("coexistent_exact")
    )
