"""Exact top-k inner-product search over a paged M-tree.

Vectors become integers (floor of `scale` times each component). One added coordinate, the root of the
largest squared length less the own squared length, gives all entries one length; the query's is 0. The
Euclidean distance then falls exactly as the inner product rises, so a metric tree answers inner-product
queries.

Nodes hold a routing object, its distance to the parent's and a covering radius. The upper levels are split
recursively, FAN_OUT ways, from a bounded sample (`sample`), which bounds them; every vector descends to the
nearest routing object on each level, and the radii are taken from all vectors. Below each of their leaves lie
pages of at most PAGE vectors, each split recursively into a subtree of its own, down to leaves of
LEAF_ENTRIES, with parent distances and covering radii on every level and each entry's distance to its leaf.

The search is best first. A query visits the leaves of the upper levels in the order of their lower bounds, a
few at a time (wave by wave, four times as many each time), and ends when the next bound lies beyond its k-th
best score so far; inside a page it goes on in the same way. A subtree or an entry whose bound, by the triangle
inequality from stored distances alone, lies beyond is passed over without its distance being computed. All
bounds are safe, so the answer is exact, however little they rule out.

Defined cases: vectors that are null or empty or hold null or non-finite components take no part, nor do
rows without vec_id; every other row is a candidate, and a query if `queries` holds for it: repeated rows are
candidates of each other and queries of their own, so a repeated query id has its ranks once a row; vectors of
different lengths don't meet; ties go to the smaller vec_id; a query with fewer candidates returns all; an
empty table gives an empty table; other columns are not looked at, whatever their names. Inner products must
fit a signed 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.llm.common import bounded_batches, materialize, valid_vectors

SAMPLE = 4096
FAN_OUT = 8
PAGE = 4096
LEAF_ENTRIES = 32
QUERIES = 2048
GATHERED = 1 << 18
FIRST_WAVE, GROWTH = 1, 4
SLACK = 1e-6
NONE = np.iinfo(np.int64).min + 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exactly: in doubles where those hold every sum."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def apart(a: np.ndarray, b: np.ndarray, largest: int) -> np.ndarray:
    """Distances between entries, added coordinate included."""
    square = lambda v: (v.astype(float) ** 2).sum(1)
    lift = lambda v: np.sqrt(np.maximum(0, largest - square(v)))
    return np.sqrt(np.maximum(0, square(a)[:, None] + square(b) - 2.0 * products(a, b) + (lift(a)[:, None] - lift(b)) ** 2))


def apart_from(q: np.ndarray, x: np.ndarray, largest: int) -> np.ndarray:
    """Distances of queries to entries."""
    return np.sqrt(np.maximum(0, (q.astype(float) ** 2).sum(1)[:, None] + largest - 2.0 * products(q, x)))


@dataclass
class Tree:
    """Nodes in breadth-first order, children of a node side by side; node 0 is the root."""

    pivot: np.ndarray  # routing object of each node, as a row of the entries it was built from
    parent_distance: np.ndarray
    radius: np.ndarray
    first: np.ndarray  # children first..last; none for a leaf
    last: np.ndarray
    start: np.ndarray  # places start..stop of `order`
    stop: np.ndarray
    order: np.ndarray  # rows in the order of the leaves
    distance: np.ndarray  # of each row, in that order, to its leaf's routing object

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.first == self.last)


def split(x: np.ndarray, largest: int, most: int, to_root: np.ndarray | None = None) -> Tree:
    """A tree over the rows of `x` by recursive splits, FAN_OUT ways, into leaves of `most` rows or fewer.

    Routing objects are chosen far from each other, rows go to the nearest one. Rows that can't be told apart are cut
    evenly. to_root: distances to the root's routing object, which is none of the rows (else row 0 is it).
    """
    n = len(x)
    to_root = apart(x, x[:1], largest)[:, 0] if to_root is None else to_root
    nodes = [[0, 0.0, float(to_root.max(initial=0.0)), 0, 0, np.arange(n), to_root]]
    at = 0
    while at < len(nodes):
        rows, own = nodes[at][5], nodes[at][6]
        if len(rows) > most:
            chosen, near = [int(own.argmax())], None
            table = []
            while True:
                table.append(apart(x[rows], x[rows[chosen[-1:]]], largest)[:, 0])
                near = table[-1] if near is None else np.minimum(near, table[-1])
                if len(chosen) == FAN_OUT or not near.max() > 0:
                    break
                chosen.append(int(near.argmax()))
            group = np.array(table).argmin(0)
            if len(chosen) == 1 or np.bincount(group).max() == len(rows):
                group = np.arange(len(rows)) * FAN_OUT // len(rows)
                chosen, table = [chosen[0]] * FAN_OUT, [table[0]] * FAN_OUT
            nodes[at][3] = len(nodes)
            for g, (c, d) in enumerate(zip(chosen, table, strict=True)):
                held = np.flatnonzero(group == g)
                if len(held):
                    nodes.append([int(rows[c]), float(own[c]), float(d[held].max()), 0, 0, rows[held], d[held]])
            nodes[at][4] = len(nodes)
        at += 1
    start, stop = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    order, distance, done = [], [], 0
    for i, node in enumerate(nodes):
        if node[3] == node[4]:
            by = np.argsort(node[6], kind="stable")
            order.append(node[5][by])
            distance.append(node[6][by])
            start[i], done = done, done + len(by)
            stop[i] = done
    column = lambda k, t: np.array([v[k] for v in nodes], t)
    return Tree(column(0, np.int64), column(1, float), column(2, float), column(3, np.int64), column(4, np.int64), start, stop, np.concatenate(order), np.concatenate(distance))


def reach(q: np.ndarray, score: np.ndarray, largest: int) -> np.ndarray:
    """Distance at which an entry has the given score; infinite for none."""
    square = (q.astype(float) ** 2).sum(1) + largest
    return np.where(score == NONE, np.inf, np.sqrt(np.maximum(0, square - 2.0 * score)) * (1 + SLACK) + SLACK)


class Search:
    """One tree against some queries: lower bounds of all nodes, and how many distances it took."""

    def __init__(self, tree: Tree, pivots: np.ndarray, q: np.ndarray, most: np.ndarray, largest: int, to_root: np.ndarray):
        """pivots: routing object of each node; to_root: the queries' distances to the root's."""
        self.computed = np.zeros(len(q), np.int64)
        self.bound = np.full((len(q), len(tree.pivot)), np.inf)
        self.distance = np.zeros((len(q), len(tree.pivot)))
        self.bound[:, 0] = 0.0
        self.distance[:, 0] = to_root
        for node in np.flatnonzero(tree.first < tree.last):
            rows = np.flatnonzero(self.bound[:, node] <= most)
            for child in range(tree.first[node], tree.last[node]) if len(rows) else ():
                stored = np.maximum(self.bound[rows, node], np.abs(self.distance[rows, node] - tree.parent_distance[child]) - tree.radius[child])
                ok = stored <= most[rows]
                if own := int(ok.sum()):
                    asked = rows if own == len(rows) else rows[ok]
                    far = apart_from(q[asked], pivots[child : child + 1], largest)[:, 0]
                    self.computed[asked] += 1
                    self.distance[asked, child] = far
                    self.bound[asked, child] = np.maximum(stored[ok], far - tree.radius[child])


class Directory:
    """The upper levels for one vector length; without a sample the root is the only leaf."""

    def __init__(self, sample: np.ndarray, length: int, largest: int, most: int):
        self.largest = largest
        self.sample = sample if len(sample) else np.zeros((1, length), np.int64)
        self.tree = split(self.sample, largest, most)
        self.tree.radius = np.full(len(self.tree.pivot), 0.0 if len(sample) else np.inf)
        self.leaves = self.tree.leaves
        self.pivots = self.sample[self.tree.pivot]

    def descend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
        """Each row's leaf, its distance to the leaf's routing object, and the largest distance seen by each node on the way."""
        node, far, seen = np.zeros(len(x), np.int64), apart(x, self.pivots[:1], self.largest)[:, 0], {}
        work = [(0, np.arange(len(x)))]
        while work:
            at, rows = work.pop()
            seen[at] = float(far[rows].max())
            children = np.arange(self.tree.first[at], self.tree.last[at])
            if len(children):
                table = apart(x[rows], self.pivots[children], self.largest)
                best = table.argmin(1)
                node[rows], far[rows] = children[best], table[np.arange(len(rows)), best]
                work += [(int(c), rows[best == i]) for i, c in enumerate(children) if (best == i).any()]
        return node, far, seen


_TREE = [f.name for f in fields(Tree)]
_WHOLE = {"pivot", "first", "last", "start", "stop", "order"}
_PAGE_TYPE = ", ".join(f"{f} array<{'bigint' if f in _WHOLE else 'double'}>" for f in _TREE)


def _matrix(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), width)


def search(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, sample: int = SAMPLE, counted: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best other rows for every row where `queries` holds. `counted` adds
    computed: how many distances the query took in all."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def whole_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at, good = valid_vectors(batch.column("embedding"))
            flat = np.floor(scale * np.where(np.isfinite(flat), flat, 0)).astype(np.int64)
            lists = [flat[a:b] if g else None for a, b, g in zip(at[:-1], at[1:], good, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("query"), pa.array(lists, pa.list_(pa.int64()))], ["vec_id", "query", "x"])

    entries = materialize(
        vectors.where(F.col("vec_id").isNotNull()).select("vec_id", queries.alias("query"), "embedding").mapInArrow(whole_numbers, f"vec_id {id_type}, query boolean, x array<bigint>")
        .where("x IS NOT NULL").withColumn("row", F.monotonically_increasing_id()).withColumn("n", F.size("x")),
        "entries",
    )
    square = F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v * v)
    facts = entries.agg(F.max(square).alias("largest"), F.count("*").alias("count")).first()
    none = spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score long" + ", computed long" * counted)
    if not facts["count"]:
        return none
    largest = int(facts["largest"])
    # a bounded sample in the order of a hash; as many of its rows a leaf as stand for a page. Only rows whose hash is as low as the
    # sample's highest is likely to be are looked at, or each task would hand on `sample` rows
    share = min(1.0, (sample + 8 * sample**0.5 + 64) / facts["count"])
    low_hash = F.xxhash64("row") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))
    chosen = entries.where(low_hash).orderBy(F.xxhash64("row"), "row").limit(sample).select("n", "x").toArrow()
    most = max(1, len(chosen) * PAGE // facts["count"])
    lengths, drawn = chosen.column("n").to_numpy(), chosen.column("x").combine_chunks()
    directories = {n: Directory(_matrix(drawn, np.flatnonzero(lengths == n), n), n, largest, most) for n in dict.fromkeys(lengths.tolist())}
    bare = spark.sparkContext.broadcast(directories)  # bounded by the sample

    def of_length(held: dict[int, Directory], batch: pa.RecordBatch) -> Iterator[tuple[int, Directory, np.ndarray, np.ndarray]]:
        lengths = batch.column("n").to_numpy()
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            yield n, held.get(n) or Directory(np.zeros((0, n), np.int64), n, largest, 1), rows, _matrix(batch.column("x"), rows, n)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, d, rows, x in of_length(bare.value, batch):
                leaf, far, _ = d.descend(x)
                own = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([own.column("n"), pa.array(leaf), pa.array(far), *(own.column(c) for c in ("vec_id", "row", "query", "x"))], ["n", "leaf", "far", "vec_id", "row", "query", "x"])

    def widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, d, _, x in of_length(bare.value, batch):
                seen = d.descend(x)[2]
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(seen), pa.int32()), pa.array(seen, pa.int64()), pa.array(seen.values())], ["n", "node", "radius"])

    for r in entries.where(F.col("n").isin(*directories)).select("n", "x").mapInArrow(widths, "n int, node long, radius double").groupBy("n", "node").agg(F.max("radius").alias("radius")).collect():
        directories[r["n"]].tree.radius[r["node"]] = r["radius"]  # a row for each node of the bounded upper levels
    upper = spark.sparkContext.broadcast(directories)

    low = entries.select("n", "vec_id", "row", "query", "x").mapInArrow(placed, f"n int, leaf long, far double, vec_id {id_type}, row long, query boolean, x array<bigint>")
    low = materialize(low, "leaves")
    # a row for each leaf of the upper levels. Joins name what they broadcast: files of small numbers tell Spark a seventh of what their
    # vectors take in memory, or a thirtieth after visits are exploded, and it would send those to the driver and every machine
    shares = F.broadcast(low.groupBy("n", "leaf").agg(F.ceil(F.count("*") / PAGE).cast("int").alias("pages")))
    keys = ["n", "leaf", "page"]

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def page(table: pa.Table) -> pa.RecordBatch:
            n = table.column("n")[0].as_py()
            x = table.column("x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, n)
            tree = split(x, largest, LEAF_ENTRIES, table.column("far").to_numpy())
            one = lambda c: pa.array([table.column(c)[0].as_py()], table.schema.field(c).type)
            lists = [pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in ("vec_id", "row")]
            parts = [pa.array([getattr(tree, f)], pa.list_(pa.int64() if f in _WHOLE else pa.float64())) for f in _TREE]
            return pa.RecordBatch.from_arrays([*map(one, keys), *lists, pa.array([x.ravel()], pa.list_(pa.int64())), *parts], [*keys, "ids", "rows", "x", *_TREE])

        for batch in batches:
            for part in _runs(batch, keys):
                if held and not _same(held[-1], part, keys):
                    yield page(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield page(pa.Table.from_batches(held))

    # pages of a leaf are dealt by hash, so that no leaf is too large for a task
    dealt = low.join(shares, ["n", "leaf"]).withColumn("page", F.pmod(F.xxhash64("row", F.lit("page")), "pages").cast("int")).select(*keys, "far", "vec_id", "row", "x")
    pages = materialize(
        dealt.repartition(*keys).sortWithinPartitions(*keys, "row").mapInArrow(built, f"n int, leaf long, page int, ids array<{id_type}>, rows array<bigint>, x array<bigint>, {_PAGE_TYPE}"), "pages"
    )

    call_type = f"n int, row long, vec_id {id_type}, x array<bigint>, least long, seen int, took long, visits array<struct<leaf:bigint,far:double>>"

    def asked(wave: int):
        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    for _, d, rows, q in of_length(upper.value, batch.slice(start, 256)):
                        own = batch.slice(start, 256).take(pa.array(rows))
                        least = np.array([NONE if s is None else s for s in own.column("least").to_pylist()], np.int64)
                        limit, seen = reach(q, least, largest), own.column("seen").to_numpy()
                        root = apart_from(q, d.pivots[:1], largest)[:, 0]
                        found = Search(d.tree, d.pivots, q, limit, largest, root)
                        found.computed += 1
                        bound = found.bound[:, d.leaves]
                        order = np.argsort(bound, axis=1, kind="stable")
                        alive = (bound <= limit[:, None]).sum(1)  # the first of the order; those seen before are its beginning
                        step = FIRST_WAVE * GROWTH**wave
                        out = [[{"leaf": int(d.leaves[j]), "far": float(found.distance[i, d.leaves[j]])} for j in order[i, s : min(s + step, a)]] for i, (s, a) in enumerate(zip(seen, alive, strict=True))]
                        some = pa.array([bool(o) for o in out])
                        next_ = pa.array(seen + [len(o) for o in out], pa.int32())
                        took = pa.array(found.computed + own.column("took").to_numpy())
                        columns = [*(own.column(c) for c in ("n", "row", "vec_id", "x", "least")), next_, took, pa.array(out, pa.list_(pa.struct([("leaf", pa.int64()), ("far", pa.float64())])))]
                        yield pa.RecordBatch.from_arrays(columns, ["n", "row", "vec_id", "x", "least", "seen", "took", "visits"]).filter(some)

        return visits

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [*keys, "block"]
        page: pa.RecordBatch | None = None
        for batch in batches:
            for part in _runs(batch, groups):
                if page is None or not _same(page, part, groups):
                    page, part = part.slice(0, 1), part.slice(1)
                if part.num_rows:
                    yield from _answers(page, part, largest, k)

    def wave(calls: DataFrame) -> DataFrame:
        """Scores not below what each query has so far, k at most of each page, and the distances taken."""
        each = calls.select("n", "row", "x", "least", F.explode("visits").alias("v")).select("n", "v.leaf", "v.far", "row", "x", "least").join(shares, ["n", "leaf"])
        each = each.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1))).drop("pages")
        blocks = F.broadcast(each.groupBy(*keys).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")))  # a row a page
        nothing = {c: F.lit(None).cast(pages.schema[c].dataType) for c in ("ids", "rows", *_TREE)}
        asking = each.join(blocks, keys).withColumns({"block": F.pmod(F.xxhash64("row"), "blocks").cast("int"), "place": F.lit(1)} | nothing).drop("blocks")
        held = pages.join(blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        held = held.withColumns({"far": F.lit(None).cast("double"), "row": F.lit(None).cast("long"), "least": F.lit(None).cast("long"), "place": F.lit(0)})
        return held.unionByName(asking).repartition(*keys, "block").sortWithinPartitions(*keys, "block", "place").mapInArrow(answered, f"row long, vec_id {id_type}, other long, score long, took long")

    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "other")
    waiting = low.where("query").select("n", "row", "vec_id", "x", F.lit(None).cast("long").alias("least"), F.lit(0).alias("seen"), F.lit(0).cast("long").alias("took"))
    found = took = names = None
    turn = 0
    while True:
        calls = materialize(waiting.mapInArrow(asked(turn), call_type), "calls")
        if calls.isEmpty():
            break
        names = names if names is not None else calls.select("row", F.col("vec_id").alias("query_id"))
        new = materialize(wave(calls), "answers")
        spent = new.select("row", "took").where("took > 0").unionByName(calls.select("row", "took"))
        took = spent if took is None else took.unionByName(spent)
        new = new.where("vec_id IS NOT NULL").select("row", "vec_id", "other", "score")
        every = new if found is None else found.unionByName(new)
        found = materialize(every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "best")
        kth = found.groupBy("row").agg(F.count("*").alias("held"), F.min("score").alias("kth")).where(F.col("held") == k).select("row", "kth")
        waiting = calls.join(kth, "row", "left").select("n", "row", "vec_id", "x", F.coalesce("kth", "least").alias("least"), "seen", F.lit(0).cast("long").alias("took"))
        turn += 1
    if found is None:
        return none
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).join(names, "row")
    if not counted:
        return ranked.select("query_id", "rank", "vec_id", "score")
    return ranked.join(took.groupBy("row").agg(F.sum("took").alias("computed")), "row").select("query_id", "rank", "vec_id", "score", "computed")


def _runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch with equal keys."""
    new = np.zeros(batch.num_rows, bool)
    for c in keys:
        v = batch.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    cuts = [0, *np.flatnonzero(new), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return all(a.column(c)[0] == b.column(c)[0] for c in keys)


def _answers(page: pa.RecordBatch, asking: pa.RecordBatch, largest: int, k: int) -> Iterator[pa.RecordBatch]:
    """One page's subtree against some queries, best leaves first; rows of found entries, then one a query with what it took."""
    n = page.column("n")[0].as_py()
    tree = Tree(*(np.array(page.column(f)[0].values) for f in _TREE))
    ids, rows = page.column("ids")[0].values, np.array(page.column("rows")[0].values)
    names = ids.to_numpy()
    x = np.array(page.column("x")[0].values).reshape(-1, n)
    q = asking.column("x").flatten().to_numpy().reshape(asking.num_rows, n)
    own = asking.column("row").to_numpy()
    least = np.array([NONE if s is None else s for s in asking.column("least").to_pylist()], np.int64)
    limit = reach(q, least, largest)
    found = Search(tree, x[tree.pivot], q, limit, largest, asking.column("far").to_numpy())
    leaves = tree.leaves
    bound = found.bound[:, leaves]
    order = np.argsort(bound, axis=1, kind="stable")
    # k best so far of each query: score, id and place in the page; a candidate must reach what the query brought
    score, name, place = np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), -1)
    gathered: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query, score and place in the page

    def put_in_order() -> None:
        """The k best of what the queries had and what was gathered for them."""
        if gathered:
            asker, value, at = (np.concatenate(c) for c in zip(*gathered, strict=True))
            gathered.clear()
            who = np.unique(asker)
            asker, value = np.concatenate([np.repeat(who, k), asker]), np.concatenate([score[who].ravel(), value])
            named, at = np.concatenate([name[who].ravel(), names[at]]), np.concatenate([place[who].ravel(), at])
            by = np.lexsort((named, -value, asker))
            top = by[np.searchsorted(asker[by], who)[:, None] + np.arange(k)]
            score[who], name[who], place[who] = value[top], named[top], at[top]

    at, step = 0, 1
    while at < len(leaves):
        turn = order[:, at : at + step]
        at, step = at + step, step * 2
        live = np.take_along_axis(bound, turn, 1) <= limit[:, None]
        if not live.any():
            break
        # few candidates reach a query's k-th best; they are put in order once a turn, or earlier if there are many
        waiting = 0
        askers, visited = np.nonzero(live)[0], turn[live]
        by = np.argsort(visited, kind="stable")
        for same in np.split(by, np.flatnonzero(np.diff(visited[by])) + 1):
            who, node = askers[same], leaves[visited[same[0]]]
            a, b = tree.start[node], tree.stop[node]
            far, width = found.distance[who, node], limit[who]
            low = int(np.searchsorted(tree.distance[a:b], (far - width).min(), "left")) + a
            high = int(np.searchsorted(tree.distance[a:b], (far + width).max(), "right")) + a
            if low >= high:
                continue
            held = tree.order[low:high]
            scores = products(q[who], x[held])
            found.computed[who] += high - low
            i, j = np.nonzero((scores >= np.maximum(least[who], score[who, -1])[:, None]) & (rows[held] != own[who][:, None]))
            gathered.append((who[i], scores[i, j], held[j]))
            waiting += len(i)
            if waiting > GATHERED:
                put_in_order()
                waiting = 0
        put_in_order()
        full = score[:, -1] != NONE
        limit = np.where(full, np.minimum(limit, reach(q, np.where(full, score[:, -1], NONE), largest)), limit)
    i, j = np.nonzero(score != NONE)
    hit = pa.array(place[i, j])
    zero = pa.array(np.zeros(len(i), np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(own[i]), ids.take(hit), pa.array(rows[place[i, j]]), pa.array(score[i, j]), zero], ["row", "vec_id", "other", "score", "took"])
    blank = pa.nulls(len(own), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), ids.type), blank, blank, pa.array(found.computed)], ["row", "vec_id", "other", "score", "took"])
