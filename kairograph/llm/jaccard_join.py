"""Jaccard self-join of word n-gram sets by token-combination prefixes.

A document's set holds the hashes of its distinct word n-grams; equal sets are one node. A fixed-size
count sketch over all documents orders the tokens, rare ones first. Tokens of high counts form the
frequent class. A node's prefix holds its rarest tokens:

* with e tokens at most missing from any partner, e + 1 rare tokens are indexed one by one;
* a node with fewer rare tokens indexes those, and its prefix extends into the frequent class, where
  pairs of neighbouring tokens are indexed. Missing tokens break two pairs, foreign ones one, so the
  prefix holds enough of them that one pair survives.

Any two linked nodes share an index entry, for if the prefix of x ends first in the common order, what
both share of it lies in the prefix of y. Entries with the same members are taken once; members are
compared in blocks, first by size and parity bitmaps (which never exceed the real difference), then
exactly. Candidates that hang together form clusters, and near copies stand in many that overlap: every node
is first verified in its largest cluster, then only those whose members are neither all joined by then nor were
all verified in one cluster. Links merge inside a task, so at most one row a member leaves it, and components follow.

The sketch's counts only order the tokens; results don't depend on them. Node ids are 64-bit digests of
the sets: two different sets are taken for one with odds of n * n / 2**65.

Defined cases: null texts, and texts without words, have empty sets, which link with nothing; a text of
fewer words than n has one token, its whole sequence; repeated rows give repeated rows; rows with a null
doc_id link like others and never name a component (a component of such rows only has a null id); an
empty table gives an empty table; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.llm.common import bounded_batches, group_starts, materialize, mix64, row_slices, tidy, whole_groups, word_lists
from kairograph.llm.components import connected_components

WORDS = 3
SIMILARITY = (90, 100)
SKETCH_BITS, CHUNK_BITS = 22, 16
FILTER_BITS = 24
#: Longest parity bitmap: every index entry carries its set's, so those of very long texts must stay small.
PARITY_BITS = 1 << 11
BLOCK = 512


def token_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams."""
    distinct, codes, offsets = word_lists(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))
    h = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    grams = h.copy()
    for k in range(1, words):
        grams[: len(h) - k] = mix64(grams[: len(h) - k]) + h[k:]
    grams = mix64(grams)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        elif b > a:
            yield np.array([int.from_bytes(blake2b(h[a:b].tobytes(), digest_size=8).digest(), "little")], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def node_of(tokens: np.ndarray) -> int:
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity(tokens: np.ndarray) -> bytes:
    """Parity bitmap: each token flips one bit. Two sets differ by as many tokens as their bitmaps by bits, or more."""
    bits = 512
    while bits < len(tokens) // 2 and bits < PARITY_BITS:
        bits *= 2
    flips = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    while len(bitmap) > size:
        bitmap = bitmap[: len(bitmap) // 2] ^ bitmap[len(bitmap) // 2 :]
    return bitmap


def prefix_keys(tokens: np.ndarray, order: np.ndarray, frequent: int, similarity: tuple[int, int]) -> np.ndarray:
    """Index entries of one set, given each token's class in the common order."""
    num, den = similarity
    n = len(tokens)
    missing = n - -(-n * num // den)
    differing = n * (den - num) // num
    if not differing:
        return np.zeros(0, np.uint64)  # only equal sets reach the similarity
    rare = order < frequent
    few = int(rare.sum())
    ranked = np.lexsort((tokens, order))
    if few > missing:
        return mix64(tokens[ranked[: missing + 1]])
    own = tokens[ranked[few : few + max(0, missing - few) + max(0, differing - few) + 2]]
    return np.concatenate([mix64(tokens[ranked[:few]]), mix64(mix64(own[:-1] ^ np.uint64(0x9E3779B97F4A7C15)) + own[1:])])


@lru_cache(maxsize=1)
def _below(m: int) -> tuple[np.ndarray, np.ndarray]:
    return np.tril_indices(m, -1)


def _triangle(m: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of m members; those of fewer members are the first ones of a block's."""
    if m > BLOCK:
        return np.tril_indices(m, -1)
    i, j = _below(BLOCK)
    return i[: m * (m - 1) // 2], j[: m * (m - 1) // 2]


def _candidates(n: np.ndarray, side: np.ndarray, bits: np.ndarray, full: list[bytes], similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one block that sizes and bitmaps allow, and the bits by which they differ."""
    num, den = similarity
    if side.any():
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = np.repeat(left, len(right)), np.tile(right, len(left))
    else:
        i, j = _triangle(len(n))
    ok = den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])
    i, j = i[ok], j[ok]
    most = (n[i] + n[j]) * (den - num) // (den + num)
    far = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1)
    ok = far <= most
    i, j, far, most = i[ok], j[ok], far[ok], most[ok]
    for p in np.flatnonzero(np.minimum(n[i], n[j]) > 1024):
        a, b = np.frombuffer(full[i[p]], np.uint64), np.frombuffer(full[j[p]], np.uint64)
        size = min(len(a), len(b))
        far[p] = np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum()
    ok = far <= most
    return i[ok], j[ok], far[ok]


def _clusters(i: np.ndarray, j: np.ndarray, size: int) -> list[np.ndarray]:
    """Members of the connected parts of a graph of `size` nodes that have an edge."""
    label = np.arange(size)
    while len(i):
        low = np.minimum(label[i], label[j])
        if (low == label[i]).all() and (low == label[j]).all():
            break
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
    touched = np.unique(np.concatenate([i, j]))
    order = touched[np.argsort(label[touched], kind="stable")]
    return np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(order) else []


def _bitmaps(column: pa.ChunkedArray) -> tuple[np.ndarray, list[bytes]]:
    full = column.to_pylist()
    return np.array([_folded(np.frombuffer(b, np.uint64), 8) for b in full], np.uint64).reshape(len(full), 8), full


def _linked(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """A forest of the links among candidate pairs (likely ones first); pairs that are joined already are not compared."""
    num, den = similarity
    root = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    found = []
    start = 0
    while start < len(i):
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[i[start : start + 4096]]), 500_000)))
        a, b = i[start:stop], j[start:stop]
        start = stop
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        if not len(a):
            continue
        used = np.unique(np.concatenate([a, b]))
        flat = np.concatenate([sets[u] for u in used])
        _, code = np.unique(flat, return_inverse=True)
        width = int(code.max()) + 1 if len(code) else 1
        ends = np.concatenate([[0], np.cumsum(sizes[used])])
        owner = np.repeat(np.arange(len(used)), sizes[used])
        present = owner * width + code  # sorted: codes follow the sets' own order
        la, lb = np.searchsorted(used, a), np.searchsorted(used, b)
        lengths = sizes[a]
        pair = np.repeat(np.arange(len(a)), lengths)
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        wanted = np.repeat(lb, lengths) * width + code[np.repeat(ends[la], lengths) + inside]
        at = np.minimum(np.searchsorted(present, wanted), len(present) - 1)
        shared = np.bincount(pair, weights=present[at] == wanted, minlength=len(a)).astype(np.int64)
        for x, y in zip(a[(hit := den * shared >= num * (sizes[a] + sizes[b] - shared))], b[hit], strict=True):
            if root[x] != root[y]:
                found.append((int(x), int(y)))
                root[root == root[y]] = root[x]
    return found


def _classes(counts: np.ndarray | float) -> np.ndarray:
    return np.minimum(255, 8 * np.log2(1 + np.asarray(counts, float))).astype(np.uint8)


def _sketch(counted: DataFrame) -> tuple[np.ndarray, float]:
    """Frequency class of every cell of the count sketch, summed over all tasks, and the mean count of a cell."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                cells = np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.uint64)
                sums[chunk] = sums[chunk] + cells if chunk in sums else cells
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([_classes(x).tobytes() for x in sums.values()], pa.binary()), pa.array([int(x.sum()) for x in sums.values()], pa.int64())], ["chunk", "classes", "tokens"])

    classes, tokens = np.zeros(1 << SKETCH_BITS, np.uint8), 0
    # a row for each of the sketch's chunks, whatever the input's size
    for r in counted.repartition(1 << (SKETCH_BITS - CHUNK_BITS), "chunk").mapInArrow(tidy(summed), "chunk int, classes binary, tokens long").collect():
        classes[r["chunk"] << CHUNK_BITS : (r["chunk"] + 1) << CHUNK_BITS] = np.frombuffer(r["classes"], np.uint8)
        tokens += r["tokens"]
    return classes, tokens / (1 << SKETCH_BITS)


def join(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles (size of its set) and component_id."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    num, den = similarity
    id_type = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", "text")
    cell = np.uint64(64 - SKETCH_BITS)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "n", "node", "parity", "chunk", "packed"]
        for batch in batches:
            for part in row_slices(batch, "text"):
                n, nodes, bits = [], [], []
                for tokens in token_sets(part.column("text"), words):
                    n.append(len(tokens))
                    nodes.append(node_of(tokens))
                    bits.append(parity(tokens))
                    np.add.at(cells, (tokens >> cell).astype(np.int64), np.uint32(1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int32()), pa.array(nodes, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        chunks = [(k, c) for k, c in enumerate(np.split(cells, 1 << (SKETCH_BITS - CHUNK_BITS))) if c.any()]
        if chunks:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(chunks), batch.schema.field("doc_id").type), pa.nulls(len(chunks), pa.int32()), pa.nulls(len(chunks), pa.int64()), pa.nulls(len(chunks), pa.binary()), pa.array([k for k, _ in chunks], pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for _, c in chunks], pa.binary())], names
            )

    seen = materialize(rows.mapInArrow(tidy(described), f"doc_id {id_type.simpleString()}, n int, node long, parity binary, chunk int, packed binary"), "sets")
    classes_of_cells, load = _sketch(seen.where("chunk IS NOT NULL").select("chunk", "packed"))
    order = spark.sparkContext.broadcast(classes_of_cells)  # 4 MB, always
    frequent = int(8 * np.log2(1 + 4 * load + 32))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, done = order.value, set()
        for batch in batches:
            for part in row_slices(batch, "text"):
                keys, nodes, n = [], [], []
                for tokens in token_sets(part.column("text"), words):
                    if not len(tokens) or (node := node_of(tokens)) in done:
                        continue
                    done.add(node)
                    keys.append(np.unique(prefix_keys(tokens, classes[(tokens >> cell).astype(np.int64)], frequent, similarity)))
                    nodes.append(node)
                    n.append(len(tokens))
                times = [len(k) for k in keys]
                if sum(times):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), times)), pa.array(np.repeat(np.array(n, np.int32), times))], ["entry", "node", "n"])

    # most entries have one node: they go where the entries meet first, and are neither written nor shuffled again
    of_entry = Window.partitionBy("entry")
    met = rows.mapInArrow(tidy(indexed), "entry long, node long, n int").select("entry", "node", "n", F.min("node").over(of_entry).alias("first"), F.max("node").over(of_entry).alias("last"))
    entries = materialize(met.where("first < last").groupBy("entry", "node").agg(F.first("n").alias("n")), "entries")
    # each set of members once, told by number, ends and exclusive or of its nodes
    shared = (
        entries.groupBy("entry")
        .agg(F.count("*").alias("m"), F.bit_xor("node").alias("mixed"), F.min("node").alias("first"), F.max("node").alias("last"), F.min("n").alias("low"), F.max("n").alias("high"))
        .where((F.col("m") > 2) | (F.col("low") * den >= F.col("high") * num))  # two sets of too different sizes can't be linked
        .groupBy("m", "mixed", "first", "last")
        .agg(F.min("entry").alias("entry"))
    )
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod("node", blocks).cast("int")
    members = (
        entries.join(shared.select("entry", "m"), "entry")
        .withColumn("block", mine)
        .select("entry", "node", "n", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("entry", "node", "n", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    )
    # in a block pair (i, j) with i < j side 1 holds block j
    keys = ["entry", "i", "j"]
    bitmaps = seen.where("node IS NOT NULL").groupBy("node").agg(F.first("parity").alias("parity"))

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            starts = group_starts(table, keys)
            n, side, node = table.column("n").to_numpy().astype(np.int64), table.column("side").to_numpy(), table.column("node").to_numpy()
            bits, full = _bitmaps(table.column("parity"))
            at, cluster = [], []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a > 1:
                    for members in _clusters(*_candidates(n[a:b], side[a:b], bits[a:b], full[a:b], similarity)[:2], b - a):
                        at.append(a + members)
                        cluster += [node_of(np.sort(node[a + members]))] * len(members)
            if at:
                yield from table.select(["node", "n", "parity"]).take(pa.array(np.concatenate(at))).append_column("cluster", pa.array(cluster, pa.int64())).to_batches()

    # candidates that hang together, named by their members: the same ones from several entries are compared once
    live = materialize(
        members.join(bitmaps, "node").select("entry", "i", "j", "side", "node", "n", "parity").repartition("entry", "i", "j").sortWithinPartitions(*keys)
        .mapInArrow(tidy(allowed), "node long, n int, parity binary, cluster long").dropDuplicates(["cluster", "node"]),
        "live",
    )
    # a bitmap of fixed size tells which sets may be wanted; the join decides
    slot = F.pmod("node", F.lit(1 << FILTER_BITS))
    wanted = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    words_of_filter = live.select((slot / 32).cast("int").alias("word"), (slot % 32).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    wanted[words_of_filter["word"].to_numpy()] = words_of_filter["bits"].to_numpy().astype(np.uint32)
    filters = spark.sparkContext.broadcast(wanted)  # 2 MB, always

    def verbatim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, done = filters.value, set()
        for batch in batches:
            for part in row_slices(batch, "text"):
                nodes, sets = [], []
                for tokens in token_sets(part.column("text"), words):
                    node = node_of(tokens)
                    at = node % (1 << FILTER_BITS)
                    if flags[at >> 5] >> np.uint32(at & 31) & np.uint32(1) and node not in done:
                        done.add(node)
                        nodes.append(node)
                        sets.append(tokens.tobytes())
                if nodes:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "tokens"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["cluster"], 2_000):
            starts = group_starts(table, ["cluster"])
            n, node = table.column("n").to_numpy().astype(np.int64), table.column("node").to_numpy()
            bits, full = _bitmaps(table.column("parity"))
            sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
            found = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                i, j, far = _candidates(n[a:b], np.zeros(b - a, int), bits[a:b], full[a:b], similarity)
                likely = np.argsort(far, kind="stable")
                found += [(a + x, a + y) for x, y in _linked(i[likely], j[likely], sets[a:b], similarity)]
            pairs = np.array(found, np.int64).reshape(len(found), 2)
            yield pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], ["u", "v"])

    sets = materialize(rows.mapInArrow(tidy(verbatim), "node long, tokens binary").groupBy("node").agg(F.first("tokens").alias("tokens")), "tokens")

    def links_of(clusters: DataFrame) -> DataFrame:
        held = clusters.join(sets, "node").repartition("cluster").sortWithinPartitions("cluster")
        return materialize(held.mapInArrow(tidy(verified), "u long, v long").distinct(), "links")

    sizes = live.groupBy("cluster").agg(F.count("*").alias("size"))
    largest = F.max_by("cluster", F.struct("size", "cluster")).alias("cluster")
    chosen = materialize(live.join(sizes, "cluster").groupBy("node").agg(F.first("n").alias("n"), F.first("parity").alias("parity"), largest), "chosen")
    links = links_of(chosen)
    done = chosen.select("node", F.col("cluster").alias("within")).join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("root", "within") for f in (F.min, F.max)]
    undecided = live.select("cluster", "node").join(done, "node").groupBy("cluster").agg(*ends).where("min_root <> max_root AND min_within <> max_within").select("cluster")
    roots = connected_components(links.unionByName(links_of(live.join(undecided, "cluster", "left_semi"))))

    facts = seen.where("node IS NOT NULL").select("doc_id", "n", "node")
    named = facts.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n").alias("n")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    components = named.where("root <> node OR n > 0").groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = named.join(components, "root").select("node", "component_id")
    return facts.join(of_node, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_first(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Of each group of linked rows of `docs` one row, with all columns: the one with the least doc_id (null last), then the least
    digest of its text; of rows equal in both any one. Rows without words link with nothing and all stay."""
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"))
    found = join(docs.select(key.alias("doc_id"), "text"), words, similarity)
    rows = found.where("n_shingles > 0").groupBy("doc_id").agg(F.first("component_id").alias("component_id"), F.count("*").alias("times")).where("doc_id <> component_id OR times > 1")
    rows = materialize(rows.select(F.col("doc_id.id").alias("__id"), F.col("doc_id.digest").alias("__digest"), (F.col("doc_id") == F.col("component_id")).alias("__first")), "not-alone")
    # a bitmap of fixed size tells which rows may be among them; only their texts are shuffled, and the join decides
    marks = rows.select(_slot(F.col("__id"), F.col("__digest")).alias("slot")).groupBy(F.shiftright("slot", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("__bits"))
    slot = _slot(docs["doc_id"], F.xxhash64(docs["text"]))
    marked = docs.join(F.broadcast(marks), F.shiftright(slot, 6) == marks["__word"], "left").select(docs["*"], F.coalesce(F.getbit(marks["__bits"], (slot % 64).cast("int")) == 1, F.lit(False)).alias("__may"))
    sure, may = marked.where("NOT __may").drop("__may"), marked.where("__may").drop("__may")
    same = may["doc_id"].eqNullSafe(rows["__id"]) & (F.xxhash64(may["text"]) == rows["__digest"])
    alone = sure.unionByName(may.join(rows, same, "left_anti"))
    first = may.join(rows.where("__first"), same, "left_semi").withColumn("__digest", F.xxhash64("text")).dropDuplicates(["doc_id", "__digest"])
    return alone.unionByName(first.drop("__digest"))


def _slot(doc_id: Column, digest: Column) -> Column:
    """A row's place in the bitmap."""
    return F.pmod(F.xxhash64(doc_id, digest), F.lit(1 << FILTER_BITS))
