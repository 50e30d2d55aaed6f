"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to unit length and cut in halves; each half has a codebook of its own, and the pairs
of codewords form a grid of cells. Every vector lies in its home cell and visits further cells in order
of the summed distances (multi-sequence traversal). How many it visits follows from the target recall:
for vectors that the codebooks weren't fitted on, and random partners at exactly the threshold, the traversal's rank of the
partner's home cell is measured, and the target's quantile is taken. Of two partners the one with the smaller home
cell does the visiting. In each cell visitors meet residents in blocks, and the cosine decides.

A codebook has LEAST_WORDS words or one for each CELL_VECTORS vectors a cell, whichever is more, at every size, so
cells don't grow with the table. Codebooks are fitted on half of a sample of `sample` vectors, or 32 a word if that is more (it
grows with the root of the table); every vector is indexed. Vectors of different lengths have grids of their own. Equal
vectors are one node with a multiplicity, so copies are never compared. Tasks send counts and at most one edge a
vector; cells that are large are told by a join, so nothing about cells passes the driver.

Defined cases: null, empty and zero vectors, and those with null or non-finite components, link with
nothing (n_links 0, own component, kept); vectors of different lengths don't link; repeated rows count
as several vectors; a null vec_id links like others but names no component; an empty table gives an
empty table; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from kairograph.llm.common import bounded_batches, group_starts, materialize, valid_vectors, whole_groups
from kairograph.llm.components import connected_components

COSINE = 0.9
RECALL = 0.995
SAMPLE = 8192
#: Vectors of the sample, and as many partners, on which visits are measured.
MEASURED = 4096
LEAST_WORDS, CELL_VECTORS = 12, 400
RESIDENTS, VISITORS = 2048, 8192
#: Cell ids hold the vectors' length above this many bits.
LENGTH_BITS = 40


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([((centres**2).sum(1) - 2 * part @ centres.T).argmin(1) for part in np.array_split(x, -(-len(x) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        count = np.bincount(own, minlength=k)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


class Grid:
    """Two codebooks and the number of cells to visit. Codebooks are fitted on one half of the sample; the visits are measured on
    the other half, which they don't know, by the rule that is used: of two partners the one with the smaller home cell visits."""

    def __init__(self, sample: np.ndarray, words: int, cosine: float, recall: float):
        self.half = max(1, sample.shape[1] // 2)
        rng = np.random.default_rng(0)
        sample = sample[rng.permutation(len(sample))]
        known, u = (sample[::2], sample[1::2][:MEASURED]) if len(sample) > 1 else (sample, sample)
        self.words = min(words, len(known))
        self.books = kmeans(known[:, : self.half], self.words), kmeans(known[:, self.half :], self.words)
        g = rng.normal(size=u.shape)
        g -= (g * u).sum(1, keepdims=True) * u
        g /= np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12)
        v = cosine * u + np.sqrt(1 - cosine**2) * g
        own, other = self.home(u), self.home(v)
        visitor = np.where((own <= other)[:, None], u, v)
        target = np.divmod(np.maximum(own, other), self.words)
        a, b = self.distances(visitor)
        at = np.arange(len(u))
        sums = a[at, target[0]] + b[at, target[1]]
        a, b = np.sort(a, axis=1), np.sort(b, axis=1)
        rank = np.array([int(np.searchsorted(b[i], sums[i] - a[i], "left").sum()) for i in at])
        rank[own == other] = 0  # they meet at home
        self.visits = min(self.words**2, int(np.quantile(rank, recall, method="higher")) + 1)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = x[:, : self.half], x[:, self.half :]
        return tuple(np.maximum(0, (p**2).sum(1)[:, None] + (c**2).sum(1) - 2 * p @ c.T) for p, c in zip(parts, self.books, strict=True))

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * self.words + b.argmin(1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The first `visits` cells of each vector's traversal (rank r of one half and s of the other come within r * s cells)."""
        a, b = self.distances(x)
        first, second = a.argsort(1), b.argsort(1)
        wide = [min(self.words, self.visits // (r + 1)) for r in range(min(self.words, self.visits))]
        r, s = np.repeat(np.arange(len(wide)), wide), np.concatenate([np.arange(w) for w in wide])
        sums = np.take_along_axis(a, first, 1)[:, r] + np.take_along_axis(b, second, 1)[:, s]
        best = np.argsort(sums, axis=1, kind="stable")[:, : self.visits]
        return np.take_along_axis(first[:, r], best, 1) * self.words + np.take_along_axis(second[:, s], best, 1)


def fitted(rows: list[np.ndarray], size: int, cosine: float, recall: float) -> dict[int, Grid]:
    """A grid for each length of a sample's vectors, out of `size` vectors in all."""
    grids = {}
    for n in {len(x) for x in rows} - {1}:
        own = np.array([x for x in rows if len(x) == n])
        grids[n] = Grid(own / np.linalg.norm(own, axis=1, keepdims=True), words_for(size * len(own) // len(rows)), cosine, recall)
    return grids


def words_for(size: int) -> int:
    return max(LEAST_WORDS, int(np.ceil(np.sqrt(size / CELL_VECTORS))))


def _roots(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of the rows and columns of a bipartite adjacency matrix (labels count rows first)."""
    rows, columns = np.arange(mask.shape[0]), np.arange(mask.shape[1]) + mask.shape[0]
    far = mask.shape[0] + mask.shape[1]
    while True:
        new_rows = np.minimum(rows, np.where(mask, columns, far).min(1))
        new_columns = np.minimum(columns, np.where(mask, new_rows[:, None], far).min(0))
        if (new_rows == rows).all() and (new_columns == columns).all():
            return rows, columns
        rows, columns = new_rows, new_columns


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    kind = vectors.schema["embedding"].dataType
    form = "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"  # nothing is rounded
    size_of = np.dtype(form).itemsize

    def unpacked(raw: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(raw), form).astype(float).reshape(len(raw), -1)

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at, good = valid_vectors(batch.column("embedding"))
            raw = [flat[a:b].astype(form).tobytes() if g and flat[a:b].any() else None for a, b, g in zip(at[:-1], at[1:], good, strict=True)]
            nodes = [None if r is None else int.from_bytes(blake2b(r, digest_size=8).digest(), "little", signed=True) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nodes, pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "node", "raw"])

    rows = materialize(vectors.select("vec_id", "embedding").mapInArrow(prepared, f"vec_id {id_type}, node long, raw binary"), "vectors")
    nodes = materialize(rows.where("node IS NOT NULL").groupBy("node").agg(F.first("raw").alias("raw"), F.count("*").alias("copies"), F.min("vec_id").alias("least")), "nodes")
    size = nodes.count()
    # a sample in the order of the digests
    chosen = [np.frombuffer(r["raw"], form).astype(float) for r in nodes.orderBy("node").limit(max(sample, 32 * words_for(size))).select("raw").collect()]
    grids = spark.sparkContext.broadcast(fitted(chosen, size, cosine, recall))

    def located(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of one length, their home cells, and whom they visit: a row of cells each, home included, -1 for none."""
        raw = batch.column("raw").to_pylist()
        lengths = np.array([len(r) // size_of for r in raw], np.int64)
        for n in np.unique(lengths).tolist():
            own, base = np.flatnonzero(lengths == n), n << LENGTH_BITS
            if (grid := grids.value.get(n)) is None:  # a length that the sample doesn't have
                yield own, np.full(len(own), base), np.full((len(own), 1), base)
                continue
            x = unpacked([raw[i] for i in own])
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            home, near = grid.home(x), grid.nearest(x)
            cells = np.where(near > home[:, None], near + base, -1)
            yield own, home + base, np.concatenate([home[:, None] + base, cells], 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, home, cells in located(batch):
                seen, times = np.unique(cells[cells >= 0], return_counts=True)
                own = np.bincount(np.searchsorted(seen, home), minlength=len(seen))
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(own.astype(np.int64)), pa.array(times.astype(np.int64))], ["cell", "residents", "visitors"])

    totals = nodes.select("raw").mapInArrow(counted, "cell long, residents long, visitors long").groupBy("cell").agg(F.sum("residents").alias("r"), F.sum("visitors").alias("v"))
    large = totals.select("cell", F.ceil(F.col("r") / RESIDENTS).cast("int").alias("blocks"), F.ceil(F.col("v") / VISITORS).cast("int").alias("turns")).where("blocks > 1 OR turns > 1")
    large = materialize(large, "large")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, home, cells in located(batch):
                for start in range(0, len(own), 256):
                    part = cells[start : start + 256]
                    i, j = np.nonzero(part >= 0)
                    is_home = j == 0
                    at = np.concatenate([i, i[is_home]])  # the residents once more, as such
                    resident = np.repeat([False, True], [len(i), int(is_home.sum())])
                    cell = np.concatenate([part[i, j], part[i[is_home], 0]])
                    held = batch.take(pa.array(own[start + at]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell), pa.array(resident), pa.array(home[start + at]), held.column("node"), held.column("copies"), held.column("raw")],
                        ["cell", "resident", "home", "node", "copies", "raw"],
                    )

    keys = ["cell", "block", "turn"]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 1):
            starts = group_starts(table, keys)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                group = table.slice(a, b - a)
                yield from _met(group, unpacked(group.column("raw").to_pylist()), cosine)

    # visitors meet every block of residents in their turn, residents every turn of visitors in their block
    calls = nodes.select("node", "copies", "raw").mapInArrow(dealt, "cell long, resident boolean, home long, node long, copies long, raw binary").join(large, "cell", "left")
    blocks, turns = F.coalesce("blocks", F.lit(1)), F.coalesce("turns", F.lit(1))
    places = F.when(F.col("resident"), F.sequence(F.lit(0), turns - 1)).otherwise(F.sequence(F.lit(0), blocks - 1))
    own = F.when(F.col("resident"), F.pmod(F.xxhash64("node"), blocks)).otherwise(F.pmod(F.xxhash64("node", F.lit(1)), turns)).cast("int")
    placed = calls.withColumns({"own": own, "place": F.explode(places)})
    placed = placed.withColumns({"block": F.when(F.col("resident"), F.col("own")).otherwise(F.col("place")), "turn": F.when(F.col("resident"), F.col("place")).otherwise(F.col("own"))})
    meetings = (
        placed.select(*keys, "resident", "home", "node", "copies", "raw")
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(met, "node long, links long, root long")
    )
    found = materialize(meetings, "meetings")
    roots = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "copies", "least").join(sums, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = named.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return (
        rows.select("vec_id", "node")
        .join(of_node, "node", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def _met(group: pa.Table, x: np.ndarray, cosine: float) -> Iterator[pa.RecordBatch]:
    """Links between the residents and the visitors of one block: counts and a forest."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    resident = group.column("resident").to_numpy(zero_copy_only=False)
    node, home, copies = group.column("node").to_numpy(), group.column("home").to_numpy(), group.column("copies").to_numpy()
    cell = group.column("cell")[0].as_py()
    own = np.flatnonzero(resident)
    visitors = np.flatnonzero(~resident)
    if not len(own) or not len(visitors):
        return
    for start in range(0, len(visitors), 1024):
        part = visitors[start : start + 1024]
        mask = x[part] @ x[own].T >= cosine
        mask &= (home[part] < cell)[:, None] | (node[part][:, None] < node[own][None, :])
        rows, columns = mask.any(1), mask.any(0)
        if not rows.any():
            continue
        mask, p, r = mask[np.ix_(rows, columns)], part[rows], own[columns]
        links = np.concatenate([mask @ copies[r], copies[p] @ mask])
        ids = np.concatenate([node[p], node[r]])
        root = np.concatenate(_roots(mask))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(ids[root])], ["node", "links", "root"])
