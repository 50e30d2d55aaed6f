"""Packing of token sequences into windows by non-negative least squares on the histogram of lengths.

Each document's ids, with an end mark, are cut into full windows and a rest. A rest is a piece of 1 to window - 1
ids; how many pieces have each length is all that the plan needs to know, so it is computed on the driver from a
histogram of at most `window` numbers, whatever the corpus.

1. All ways of filling a window exactly with at most `depth` pieces of lengths that occur are enumerated (one piece: the full
   windows themselves).
2. Non-negative least squares gives each way a number of repeats so that together they use the histogram: an active set that
   starts from the ways of two pieces, lets in several ways at a time, of which no two share a length, while they help, and
   drops those whose numbers turn negative; the nearest solution found counts.
3. Numbers are rounded, and no way takes more pieces than are left.
4. What is left is packed greedily, the longest pieces first, one after another; where a window ends, the piece is cut. The
   last window is cut into windows of powers of two, which need no padding. So nothing is padded at all.

Pieces learn their place from their rank among those of their length: ranks are counted within tasks and carried over by
sums a task and length, so a length that a third of all pieces have costs no more than others. A table of at
most a few thousand rows (length, ranks, sequence, offset) then places each piece by itself.

Defined cases: a null or empty text is the end mark alone; the special token's string in a text is the special token (as the
tokenizers library reads it); repeated rows are packed one by one, also with null ids; an empty table gives no
pieces; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kairograph.llm import bpe
from kairograph.llm.common import bounded_batches, materialize, row_slices, tidy

WINDOW = 1024
DEPTH = 3
#: Ways that enter the active set at once, and rounds of the solver at most.
BATCH, ROUNDS = 128, 60
#: The solver ends once no way outside the set has a gradient above TOLERANCE (the largest length count is 1), or after PATIENCE
#: rounds that each made the squared miss smaller by less than a share of GAIN.
TOLERANCE, GAIN, PATIENCE = 1e-6, 1e-3, 2


def ways(lengths: np.ndarray, window: int, depth: int) -> np.ndarray:
    """Rows of 2 to `depth` (3 at most) of the given lengths, descending, that add up to `window`; 0 where there is none."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    x = np.flatnonzero(there[:window])
    x = x[x > 0]
    pairs = x[(window - x <= x) & there[window - x]]
    found = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], 1)]
    if depth >= 3:
        a, b = np.meshgrid(x, x, indexing="ij")
        c = window - a - b
        ok = (a >= b) & (b >= c) & (c > 0) & there[np.maximum(c, 0)]
        found.append(np.stack([a[ok], b[ok], c[ok]], 1))
    return np.concatenate(found)


def least_squares(columns: np.ndarray, histogram: np.ndarray) -> tuple[np.ndarray, bool]:
    """Repeats x >= 0 of each row of `columns` that bring the sum of their lengths nearest to `histogram` (indexed by length), and
    whether the solver ended by itself. histogram[0] is not looked at."""
    target = histogram.astype(float)
    target[0] = 0
    scale = max(1.0, float(target.max()))
    target = target / scale
    x = np.zeros(len(columns))
    if not len(columns):
        return x, True
    used = columns > 0

    def gradient(rest: np.ndarray) -> np.ndarray:
        return np.where(used, rest[columns], 0.0).sum(1)

    def filled(some: np.ndarray) -> np.ndarray:
        sums = np.bincount(columns[some].ravel(), np.repeat(x[some], columns.shape[1]), len(target))
        sums[0] = 0
        return sums

    def solved(some: np.ndarray) -> np.ndarray:
        matrix = np.zeros((len(target), len(some)))
        np.add.at(matrix, (columns[some].ravel(), np.repeat(np.arange(len(some)), columns.shape[1])), 1.0)
        matrix[0] = 0
        return np.linalg.solve(matrix.T @ matrix + 1e-9 * np.eye(len(some)), matrix.T @ target)

    active, least, kept, stalled = np.flatnonzero(columns[:, 2] == 0), np.inf, x, 0
    for _ in range(ROUNDS):
        x = np.zeros(len(columns))
        while len(active):
            best = solved(active)
            if (best > 0).all():
                x[active] = best
                break
            active = active[best > 0]
        rest = target - filled(active)
        miss = float(rest @ rest)
        stalled = 0 if miss < least * (1 - GAIN) else stalled + 1
        if miss < least:
            least, kept = miss, x
        slope = gradient(rest)
        slope[active] = 0
        entering, taken = [], np.zeros(len(target), bool)
        for k in np.argsort(-slope, kind="stable")[: 64 * BATCH]:
            if slope[k] <= TOLERANCE or len(entering) == BATCH:
                break
            lengths = columns[k][used[k]]
            if not taken[lengths].any():
                taken[lengths] = True
                entering.append(k)
        if not entering or stalled == PATIENCE:
            return kept * scale, True
        active = np.append(active, entering).astype(np.int64)
    return kept * scale, False


def plan(histogram: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]], int]:
    """Where pieces go that `histogram` counts by length: rows (length, first rank, end rank, sequence, offset), the piece of rank
    first + k lying in sequence + k; rows (length, first rank, place) for those left over, the piece of rank
    first + k lying at place + k * length of one long line; and the first sequence of that line."""
    left = histogram.astype(np.int64).copy()
    given = np.flatnonzero(left[:window])
    columns = ways(given[given > 0], window, depth)
    repeats, _ = least_squares(columns, left[:window])
    placed: list[tuple[int, int, int, int, int]] = []
    rank: dict[int, int] = defaultdict(int)
    sequence = int(left[window])
    if sequence:
        placed.append((window, 0, sequence, 0, 0))
    for k in np.argsort(-repeats, kind="stable"):
        n = int(np.floor(repeats[k] + 0.5))
        if n == 0:
            break
        lengths, times = np.unique(columns[k][columns[k] > 0], return_counts=True)
        n = min(n, int((left[lengths] // times).min()))
        if n <= 0:
            continue
        left[lengths] -= n * times
        offset = 0
        for length in (int(x) for x in columns[k] if x):
            placed.append((length, rank[length], rank[length] + n, sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    line, place = [], 0
    for length in range(window - 1, 0, -1):
        if left[length]:
            line.append((length, rank[length], place))
            place += int(left[length]) * length
    return placed, line, sequence


def line_windows(total: int, window: int) -> list[tuple[int, int]]:
    """Start and length of the windows behind the whole ones of a line of `total` ids: the rest as a sum of powers of two."""
    start, found = total - total % window, []
    for bit in range(window.bit_length() - 1, -1, -1):
        if (total - start) >> bit & 1 and 1 << bit < window:
            found.append((start, 1 << bit))
            start += 1 << bit
    return found


def cut(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """Each document's ids and the end mark in pieces of at most `window`: doc_id, start, length, ids (packed), doc_tokens, and task
    and nth, the piece's number among those of its length in one task."""
    bounded_batches(docs.sparkSession)
    path = tokenizer or bpe.default_tokenizer()
    id_type = docs.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, seen = bpe.codec(path), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            for part in row_slices(batch, "text"):
                rows, starts, lengths, packed, sizes, nth = [], [], [], [], [], []

                def given(rows=rows, starts=starts, lengths=lengths, packed=packed, sizes=sizes, nth=nth, part=part):
                    columns = [pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(packed, pa.binary()), pa.array(sizes, pa.int64()), pa.array([task] * len(rows), pa.int64()), pa.array(nth, pa.int64())]
                    return pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows, pa.int64())).cast(arrow_id), *columns], ["doc_id", "start", "length", "ids", "doc_tokens", "task", "nth"])

                for row, text in enumerate(part.column("text").to_pylist()):
                    ids = np.append(own.straight_whole(text or ""), np.uint32(end_id)).astype("<u4")
                    raw = ids.tobytes()
                    for start in range(0, len(ids), window):
                        length = min(window, len(ids) - start)
                        rows.append(row)
                        starts.append(start)
                        lengths.append(length)
                        packed.append(raw[4 * start : 4 * (start + length)])
                        sizes.append(len(ids))
                        nth.append(int(seen[length]))
                        seen[length] += 1
                yield given()

    return docs.select("doc_id", "text").mapInArrow(tidy(pieces), f"doc_id {id_type.simpleString()}, start long, length long, ids binary, doc_tokens long, task long, nth long")


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, depth: int = DEPTH, end_id: int = 0) -> DataFrame:
    """A row for each piece: doc_id, start and length in the document's ids, ids (packed little-endian unsigned 32-bit),
    doc_tokens, sequence_id and offset there. window: a power of two; depth: 2 or 3."""
    if window < 2 or window & (window - 1) or depth not in (2, 3):
        raise ValueError("the window is a power of two, and a way has two or three pieces")
    spark = docs.sparkSession
    found = materialize(cut(docs, tokenizer, window, end_id), "pieces")
    by_task = materialize(found.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(window + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():  # at most `window` rows
        histogram[length] = n
    placed, line, sequence = plan(histogram, window, depth)
    total = sum(int(histogram[length] - first) * length for length, first, _ in line)
    # a piece of a length in the line can lie at the end of the histogram only, so its ranks have no end
    rows = [(*r, False) for r in placed] + [(length, first, int(histogram[length]), 0, place, True) for length, first, place in line]
    table = spark.createDataFrame(rows, "of long, first long, end long, sequence long, at long, lined boolean")
    # ranks of a task's pieces go on where those of earlier tasks end; a length has as many rows as there are tasks
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    ranked = found.join(by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("earlier")), ["length", "task"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    inside = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    k = F.col("rank") - F.col("first")
    put = ranked.join(F.broadcast(table), inside)  # a few rows a way in use, of which there are not many more than lengths
    kept = ["doc_id", "start", "length", "ids", "doc_tokens"]
    whole = put.where("NOT lined").select(*kept, (F.col("sequence") + k).alias("sequence_id"), F.col("at").alias("offset"))
    # the line: windows of equal size, and at most log2(window) smaller ones at its end
    tail = line_windows(total, window)
    full = total // window
    spread = put.where("lined").withColumn("from", F.col("at") + k * F.col("length")).withColumn("to", F.col("from") + F.col("length"))
    w = F.lit(window).cast("long")
    last_full = F.least(F.floor((F.col("to") - 1) / w), F.lit(full - 1).cast("long"))
    first_full = F.floor(F.col("from") / w)
    windows = F.when(first_full <= last_full, F.transform(F.sequence(first_full, F.greatest(first_full, last_full)), lambda i: F.struct(i.alias("number"), (i * w).alias("begin"), ((i + 1) * w).alias("close")))).otherwise(
        F.array().cast("array<struct<number:bigint,begin:bigint,close:bigint>>")
    )
    if tail:
        small = F.array(*(F.struct(F.lit(full + i).cast("long").alias("number"), F.lit(b).cast("long").alias("begin"), F.lit(b + n).cast("long").alias("close")) for i, (b, n) in enumerate(tail)))
        windows = F.concat(windows, F.filter(small, lambda s: (s["begin"] < F.col("to")) & (s["close"] > F.col("from"))))
    parts = spread.withColumn("w", F.explode(windows))
    begin, close = F.greatest("from", "w.begin"), F.least("to", "w.close")
    skipped = begin - F.col("from")
    lined = parts.select(
        "doc_id", (F.col("start") + skipped).alias("start"), (close - begin).alias("length"), F.substr("ids", (4 * skipped + 1).cast("int"), (4 * (close - begin)).cast("int")).alias("ids"), "doc_tokens",
        (F.lit(sequence) + F.col("w.number")).alias("sequence_id"), (begin - F.col("w.begin")).alias("offset"),
    )
    return whole.unionByName(lined)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of each sequence of `pack`, put together; a sequence has at most a window of ids."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    joined = F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, CRC-32 of its ids, doc_tokens, sequence_id and offset."""
    return pack(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
