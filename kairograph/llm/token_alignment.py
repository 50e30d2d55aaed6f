"""Alignment of two tokenizers' tokens of the same text by a label for every byte.

Each text is encoded by A (byte-level BPE, with a space before the text) and by B (sentencepiece, which adds that
space itself). Every byte gets a label: no token ends with it, one of A ends, one of B ends, or both. A regular
expression scans the labels and takes stretches up to each both-label; how many A-ends and B-ends a stretch holds is
the group's size on either side. All pairs of an A token and a B token of one group are linked.

A pair of ids counts in how many documents hold it linked. Documents are gathered into blocks of at most BLOCK_PAIRS
distinct pairs a document. A block names each of its pairs once, with its documents, so the counts are sums over
blocks; they are joined back to the blocks that ask for them, and a block's documents look their pairs up there. No
document's pairs are shuffled one by one, and a pair that all documents hold costs a row a block. Counts are never
collected or broadcast.

Defined cases: texts null or empty, and texts whose A or B tokens don't spell the space and the text byte for byte (a
normaliser changed something, an unknown piece), have no tokens, groups or links; the special tokens' strings in a text
are plain text; a document that stands in several rows counts once a row, also with null ids; an empty table gives an
empty table; other columns are not looked at, whatever their names. A group is expanded by distinct ids once it
has more than WIDE pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kairograph.llm import bpe
from kairograph.llm.common import bounded_batches, materialize, row_slices, tidy

#: Distinct pairs of all documents of a block, added up.
BLOCK_PAIRS = 1 << 22
#: Pairs that one row of a block names at most.
ROW_PAIRS = 1 << 15
#: Pairs of one group from which on distinct ids are paired, and pairs that are expanded at once.
WIDE, EXPANDED = 1 << 12, 1 << 21

# Labels: bit 0 where a token of A ends, bit 1 where one of B ends.
_GROUP = re.compile(rb"[\x00-\x02]*\x03")
#: Bits of a pair's number that hold the id of B.
B_BITS = 24


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A sentencepiece model, and the bytes that each of its ids stands for."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Side:
    """What one tokenizer's ids look like: bytes and their number, and decimal text with what follows a token."""

    def __init__(self, spelt: list[bytes], last: str):
        self.spelt = spelt
        self.size = np.array([len(x) for x in spelt], np.int64)
        self.shown = [f"{i}{sign}" for i in range(len(spelt)) for sign in (",", last)]


@lru_cache(maxsize=2)
def _sides(a_path: str, b_path: str) -> tuple[bpe.Codec, Pieces, Side, Side]:
    codec, pieces = bpe.codec(a_path), Pieces(b_path)
    spelt = [codec.core.decode_single_token_bytes(i) for i in range(codec.core.n_vocab)]
    return codec, pieces, Side(spelt, "|"), Side(pieces.bytes, ";")


def groups(a_ends: np.ndarray, b_ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end in bytes, A tokens, B tokens) of each group, for the ends of both sides' tokens in `size` bytes that both cover."""
    label = np.zeros(size, np.uint8)
    label[a_ends - 1] |= 1
    label[b_ends - 1] |= 2
    end = np.cumsum(np.fromiter(map(len, _GROUP.findall(label.tobytes())), np.int64))
    count = lambda bit: np.diff(np.cumsum(label & bit, dtype=np.int64)[end - 1] // bit, prepend=0)
    return end, count(1), count(2)


def linked_pairs(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, times): how often each pair of ids is linked in each row; by row, then pair. row: of each group, ascending."""
    first_a, first_b, links = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(rows: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        order = np.lexsort((pairs, rows))
        rows, pairs = rows[order], pairs[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (pairs[1:] != pairs[:-1])
        at = np.flatnonzero(new)
        found.append((rows[at], pairs[at], np.add.reduceat(times[order], at) if len(at) else times))

    narrow = np.flatnonzero(links <= WIDE)
    upto, cut = np.cumsum(links[narrow]), 0
    while cut < len(narrow):
        stop = max(cut + 1, int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + EXPANDED, "right")))
        g, cut = narrow[cut:stop], stop
        k = np.repeat(np.arange(len(g)), links[g])
        inside = np.arange(len(k)) - np.repeat(np.cumsum(links[g]) - links[g], links[g])
        g = g[k]
        add(row[g], a[first_a[g] + inside // n_b[g]] << B_BITS | b[first_b[g] + inside % n_b[g]], np.ones(len(k), np.int64))
    for g in np.flatnonzero(links > WIDE):
        xs, x_times = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        ys, y_times = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        step = max(1, EXPANDED // len(ys))
        for i in range(0, len(xs), step):
            pairs = (xs[i : i + step, None] << B_BITS | ys).ravel()
            add(np.full(len(pairs), row[g]), pairs, np.outer(x_times[i : i + step], y_times).ravel())
    if len(found) == 1:
        return found[0]
    whole = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
    found = []
    add(*whole)
    return found[0]


def _lists(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, bounds: np.ndarray, sides: tuple[Side, Side]) -> list[str]:
    """The groups of each row in decimal: `a1,a2|b1;a3|b2,b3`. bounds: of the rows in groups."""
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[first_a + n_a - 1] = 1
    last_b[first_b + n_b - 1] = 1
    line = np.empty(len(a) + len(b), object)
    line[np.arange(len(a)) + np.repeat(first_b, n_a)] = list(map(sides[0].shown.__getitem__, (2 * a + last_a).tolist()))
    line[np.arange(len(b)) + np.repeat(first_a + n_a, n_b)] = list(map(sides[1].shown.__getitem__, (2 * b + last_b).tolist()))
    tokens = np.append(first_a + first_b, len(line))[bounds]
    line = line.tolist()
    return ["".join(line[i:j])[:-1] for i, j in zip(tokens[:-1].tolist(), tokens[1:].tolist(), strict=True)]


_ROWS = "block long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary, block_pairs binary, block_documents binary"
_SHAPE = pa.schema([
    ("block", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
    ("pairs", pa.binary()), ("times", pa.binary()), ("block_pairs", pa.binary()), ("block_documents", pa.binary()),
])


def align(docs: DataFrame, tokenizer: str | None = None, pieces: str | None = None, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """A row for each document: doc_id, its block, n_a, n_b, n_groups, n_links, groups (decimal ids), and the distinct pairs of
    linked ids with how often each is linked (packed 64- and 32-bit integers, a pair being id of A << B_BITS | id of B). Rows
    without n_a belong to blocks: block_pairs are pairs of the block's documents, block_documents how many have each."""
    bounded_batches(docs.sparkSession)
    a_path, b_path = tokenizer or bpe.default_tokenizer(), pieces or default_pieces()
    id_type = docs.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)

    def aligned(part: pa.RecordBatch) -> tuple[dict[str, pa.Array], np.ndarray]:
        """The documents' columns, and all their pairs."""
        codec, model, *sides = _sides(a_path, b_path)
        given = part.column("text").to_pylist()
        rows = [i for i, t in enumerate(given) if t]
        texts = [given[i] for i in rows]
        a_ids, b_ids = [codec.straight(" " + t).tolist() for t in texts], model.encode(texts)
        right = []
        for k, t in enumerate(texts):
            raw = b" " + t.encode()
            if all(b"".join(map(side.spelt.__getitem__, ids)) == raw for side, ids in zip(sides, (a_ids[k], b_ids[k]), strict=True)):
                right.append(k)
        rows, a_ids, b_ids = [rows[k] for k in right], [a_ids[k] for k in right], [b_ids[k] for k in right]
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a_ids, b_ids))
        a_ends, b_ends = (np.cumsum(side.size[ids]) for side, ids in zip(sides, (a, b), strict=True))
        token_ends = np.cumsum([len(x) for x in a_ids], dtype=np.int64)
        size = int(a_ends[-1]) if len(a) else 0
        end, n_a, n_b = groups(a_ends, b_ends, size)
        bounds = np.append(0, np.searchsorted(end, a_ends[token_ends - 1], "right")) if len(rows) else np.zeros(1, np.int64)
        row_of = np.repeat(np.arange(len(rows)), np.diff(bounds))
        of, pair, times = linked_pairs(a, b, n_a, n_b, row_of)
        cuts = np.searchsorted(of, np.arange(len(rows) + 1))
        links = np.append(0, np.cumsum(n_a * n_b))[bounds]
        spread = {
            "n_a": [len(x) for x in a_ids], "n_b": [len(x) for x in b_ids], "n_groups": np.diff(bounds).tolist(), "n_links": np.diff(links).tolist(),
            "groups": _lists(a, b, n_a, n_b, bounds, sides) if len(a) else [],
            "pairs": [pair[i:j].astype("<u8").tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)],
            "times": [times[i:j].astype("<u4").tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)],
        }
        nothing = {"groups": "", "pairs": b"", "times": b""}
        columns = {}
        for name, values in spread.items():
            whole = [nothing.get(name, 0)] * part.num_rows
            for i, v in zip(rows, values, strict=True):
                whole[i] = v
            columns[name] = pa.array(whole, _SHAPE.field(name).type)
        return columns, pair

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        for batch in batches:
            for part in row_slices(batch, "text", min(2 << 20, 8 * block_pairs)):  # one part doesn't exceed a block by much
                columns, pair = aligned(part)
                held.append(pair)
                empty = [pa.nulls(part.num_rows, pa.binary())] * 2
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([block] * part.num_rows, pa.int64()), *columns.values(), *empty], ["doc_id", *_SHAPE.names])
                if sum(map(len, held)) >= block_pairs:
                    yield from named(block, held)
                    held, block = [], block + 1
        if held:
            yield from named(block, held)

    def named(block: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs, documents = np.unique(np.concatenate(held), return_counts=True)
        for i in range(0, len(pairs), ROW_PAIRS):
            values = {"block": block, "block_pairs": pairs[i : i + ROW_PAIRS].astype("<u8").tobytes(), "block_documents": documents[i : i + ROW_PAIRS].astype("<u4").tobytes()}
            yield pa.RecordBatch.from_arrays([pa.nulls(1, arrow_id), *(pa.array([values.get(f.name)], f.type) for f in _SHAPE)], ["doc_id", *_SHAPE.names])

    return docs.select("doc_id", "text").mapInArrow(tidy(found), f"doc_id {id_type.simpleString()}, {_ROWS}")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, pairs, documents in zip(*(batch.column(c) for c in ("block", "block_pairs", "block_documents")), strict=True):
            pair = np.frombuffer(pairs.as_py(), "<u8").astype(np.int64)
            n = np.frombuffer(documents.as_py(), "<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block.as_py())), pa.array(pair), pa.array(n)], ["block", "pair", "documents"])


def pair_counts(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, pair, documents) of each block, and (pair, count, best) over all: documents that hold the pair linked, and whether
    no pair of the same id of A has more."""
    blocks = aligned.where("n_a IS NULL").select("block", "block_pairs", "block_documents").mapInArrow(tidy(_named), "block long, pair long, documents long")
    total = blocks.groupBy("pair").agg(F.sum("documents").alias("count"))
    of_a = F.shiftright("pair", B_BITS)
    most = total.groupBy(of_a.alias("a")).agg(F.max("count").alias("most"))
    return blocks, total.withColumn("a", of_a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(aligned: DataFrame) -> DataFrame:
    """The documents' rows of `align`, written before, with n_best and count_sum. A block's documents and its pairs, both bounded,
    meet in one group."""
    blocks, counts = pair_counts(aligned)
    asked = blocks.select("block", "pair").join(counts, "pair").select("block", "pair", "count", "best")
    kept = [c for c in aligned.columns if c not in ("pairs", "times", "block_pairs", "block_documents")]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name in kept)

    def looked_up(documents: pa.Table, known: pa.Table) -> pa.Table:
        pair = known.column("pair").to_numpy()
        order = np.argsort(pair)
        pair, count, best = pair[order], known.column("count").to_numpy()[order], known.column("best").to_numpy().astype(np.int64)[order]
        n_best, count_sum = [], []
        for pairs, times in zip(documents.column("pairs"), documents.column("times"), strict=True):
            own, times = np.frombuffer(pairs.as_py(), "<u8").astype(np.int64), np.frombuffer(times.as_py(), "<u4").astype(np.int64)
            at = np.searchsorted(pair, own)
            n_best.append(int((times * best[at]).sum()) if len(own) else 0)
            count_sum.append(int((times * count[at]).sum()) if len(own) else 0)
        return documents.select(kept).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    return aligned.where("n_a IS NOT NULL").select(*kept, "pairs", "times").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(looked_up, f"{types}, n_best long, count_sum long")


def digests(docs: DataFrame, tokenizer: str | None = None, pieces: str | None = None) -> DataFrame:
    """Per document: tokens, groups, links, links of best count, the counts' sum, and SHA-256 of the groups."""
    rows = align(docs, tokenizer, pieces)
    sha = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    rows = materialize(rows.withColumn("groups_sha256", sha).drop("groups"), "aligned", compression="zstd")
    return scored(rows).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
