"""Maximal periodic runs of words, by tandem repeats of a suffix tree.

The words of a batch of texts are numbered and each text gets its own suffix tree, held as a suffix array with its
nested intervals of common prefixes: an interval is an inner node, the ranks in it are its leaf list, its depth is the
length of what the leaves share. The array is sorted by prefix doubling, all texts of a batch at once; ranks start
from (text, word), so texts never meet. A run of exponent x has floor(x) leaves below the node of its period, so
nodes with fewer leaves aren't refined.

A node of depth d and two of its leaves i and i + d give the tandem repeat of 2d words at i; it is branching if the word
after it differs from the one d before. Only leaves outside the largest child are visited, each looking d to the
right and d to the left, so a leaf is visited a logarithmic number of times. Each maximal run ends with
exactly one branching repeat of its period; rotating that to the left as long as words allow gives its start.
Repeats of multiples of the period end in the same run and are merged into it: of the repeats with one end the shortest
is rotated first and takes out those that its run contains.

Defined cases: null and empty texts, and those of white space alone, have no words, no runs and an empty collapsed text;
repeated rows give repeated rows, also with null ids; an empty table gives an empty table; other columns are not
looked at, whatever their names. One text is handled by one task, in memory proportional to its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import bounded_batches, row_slices, tidy, word_lists

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Leaves that are looked at in one step.
VISITS = 1 << 21
#: Rotations made for all repeats together before the long ones are followed by themselves.
STEPS = 16
WORDS = r"[^\x20\x09-\x0D]+"


def _grouped(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the groups of equal keys."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(sorted_keys)))


def _suffix_order(words: np.ndarray, text_of: np.ndarray, least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in the order of their suffixes, those whose word stands `least` times or more in its text; and the rank of
    every position by its first 1, 2, 4... words. Groups of under `least` members are not sorted any further."""
    n = len(words)
    key = text_of.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    act = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    starts, sizes = _grouped(key[act])
    rank[act] = np.where(np.repeat(sizes >= least, sizes), np.repeat(starts, sizes), np.arange(n))
    held = act = act[np.repeat(sizes >= least, sizes)]
    levels, width = [rank], 1
    while len(act):
        own = rank[act]
        key = own * n + rank[act + width]
        order = np.argsort(key, kind="stable")
        act, key = act[order], key[order]
        starts, sizes = _grouped(key)
        old, old_sizes = _grouped(own)  # sorting keeps groups in place
        place = own + np.arange(len(act)) - np.repeat(old, old_sizes)
        large = np.repeat(sizes >= least, sizes)
        rank = rank.copy()
        rank[act] = np.where(large, np.repeat(place[starts], sizes), place)
        act = act[large]
        levels.append(rank)
        width *= 2
    return held[np.argsort(rank[held])], levels


def _shared(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix shares with the one before it in the order; 0 at both ends."""
    x, y = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(order) + 1, np.int64)
    for t in range(len(levels) - 1, -1, -1):
        step = (levels[t][x] == levels[t][y]).astype(np.int64) << t
        x += step
        y += step
    common[1:-1] = y - order[1:]
    return common


def _intervals(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place at which neighbours share words: the place, and the ends [lo, hi) of the interval that shares as many."""
    at = np.flatnonzero(common)
    mins = [common]
    while 2 << (len(mins) - 1) <= len(common):
        w = 1 << (len(mins) - 1)
        mins.append(np.minimum(mins[-1][:-w], mins[-1][w:]))
    own, lo, hi = common[at], at - 1, at + 1
    for b in range(len(mins) - 1, -1, -1):
        m, w = mins[b], 1 << b
        ok = hi + w <= len(common)
        hi = np.where(ok & (m[np.where(ok, hi, 0)] >= own), hi + w, hi)
        ok = lo - w + 1 >= 0
        lo = np.where(ok & (m[np.where(ok, lo - w + 1, 0)] >= own), lo - w, lo)
    return at, lo, hi


def _branching(words: np.ndarray, order: np.ndarray, common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends and periods of all branching tandem repeats below nodes of `least` leaves or more, by end, then period."""
    n = len(words)
    at, lo, hi = _intervals(common)
    large = hi - lo >= least
    at, lo, hi = at[large], lo[large], hi[large]
    depth = common[at]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by = np.argsort(lo * (int(depth.max()) + 1) + depth, kind="stable")
    at, lo, hi, depth = at[by], lo[by], hi[by], depth[by]
    first, inner = _grouped(lo * (int(depth.max()) + 1) + depth)
    # a node's children: from its start to the first place, between places, from the last place to its end
    lo, hi, depth, count = lo[first], hi[first], depth[first], inner + 1
    heads = np.cumsum(count) - count
    begin = np.empty(int(count.sum()), np.int64)
    is_head = np.zeros(len(begin), bool)
    is_head[heads] = True
    begin[is_head], begin[~is_head] = lo, at
    end = np.append(begin[1:], 0)
    end[heads + count - 1] = hi
    node = np.repeat(np.arange(len(lo)), count)
    size = end - begin
    widest = np.flatnonzero(size == np.repeat(np.maximum.reduceat(size, heads), count))
    visited = np.ones(len(begin), bool)
    visited[widest[np.append(True, np.diff(node[widest]) > 0)]] = False
    begin, size, node = begin[visited], size[visited], node[visited]
    place = np.full(n + 1, -1, np.int64)
    place[order] = np.arange(len(order))
    found = []
    upto = np.cumsum(size)
    cut = 0
    while cut < len(size):
        stop = max(cut + 1, int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + VISITS, "right")))
        b, s, v = begin[cut:stop], size[cut:stop], node[cut:stop]
        leaf = order[np.arange(int(s.sum())) + np.repeat(b - (np.cumsum(s) - s), s)]
        v = np.repeat(v, s)
        d, low, high = depth[v], lo[v], hi[v]
        right = leaf + d
        p = place[right]
        ok = np.flatnonzero((p >= low) & (p < high))
        ok = ok[words[right[ok]] != words[right[ok] + d[ok]]]
        found.append((right[ok] + d[ok]) * n + d[ok])
        left = leaf - d
        p = place[np.maximum(left, -1)]  # the last place is none
        ok = np.flatnonzero((p >= low) & (p < high))
        ok = ok[words[leaf[ok]] != words[leaf[ok] + d[ok]]]
        found.append((leaf[ok] + d[ok]) * n + d[ok])
        cut = stop
    key = np.unique(np.concatenate(found))
    return key // n, key % n


def _rotations(words: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How far each repeat can be moved to the left, word by word, and stay one."""
    moved = np.zeros(len(start), np.int64)
    act = np.arange(len(start))
    for _ in range(STEPS):
        before = start[act] - moved[act] - 1
        act = act[(before >= 0) & (words[before] == words[before + period[act]])]
        if not len(act):
            return moved
        moved[act] += 1
    for k in act:
        i, d, width = int(start[k] - moved[k]), int(period[k]), 64
        while i:
            w = min(width, i)
            differ = np.flatnonzero(words[i - w : i] != words[i - w + d : i + d])
            if len(differ):
                i += int(differ[-1]) + 1 - w
                break
            i, width = i - w, width * 2
        moved[k] = start[k] - i
    return moved


def maximal_runs(words: np.ndarray, offsets: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of texts given as word numbers and offsets, by text, start and period."""
    texts = len(offsets) - 1
    ends = np.arange(1, texts + 1) + offsets[1:] - 1  # every text ends with a word of its own
    line = np.empty(len(words) + texts, np.int64)
    is_end = np.zeros(len(line), bool)
    is_end[ends] = True
    line[~is_end] = words
    line[is_end] = int(words.max(initial=0)) + 1 + np.arange(texts)
    text_of = np.repeat(np.arange(texts), np.diff(offsets) + 1)
    least = max(2, int(min_exponent))
    order, levels = _suffix_order(line, text_of, least)
    end, period = _branching(line, order, _shared(order, levels), least) if len(order) else (np.zeros(0, np.int64),) * 2
    kept = []
    while len(end):
        first, sizes = _grouped(end)
        length = 2 * period[first] + _rotations(line, end[first] - 2 * period[first], period[first])
        kept.append((end[first], length, period[first]))
        rest = 2 * period > np.repeat(length, sizes)
        rest[first] = False
        end, period = end[rest], period[rest]
    if not kept:
        return (np.zeros(0, np.int64),) * 4
    end, length, period = map(np.concatenate, zip(*kept, strict=True))
    enough = (length >= min_length) & (length >= min_exponent * period)
    end, length, period = end[enough], length[enough], period[enough]
    text = text_of[end - 1]
    start = end - length - (offsets[text] + text)
    by = np.lexsort((period, start, text))
    return text[by], start[by], length[by], period[by]


def collapsed(offsets: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words stay: all but those that a run contains after its first period."""
    change = np.zeros(offsets[-1] + 1, np.int64)
    at = offsets[text] + start
    np.add.at(change, at + period, 1)
    np.add.at(change, at + length, -1)
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, in words, by start, then period) and collapsed, the words that
    no run repeats, joined by single spaces. A run has `min_length` words and `min_exponent` (2 or more) periods at least."""
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    bounded_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                distinct, codes, offsets = word_lists(part.column("text"))
                codes = codes.astype(np.int64)
                text, start, length, period = maximal_runs(codes, offsets, min_length, min_exponent)
                keep = collapsed(offsets, text, start, length, period)
                bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
                left = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), distinct.take(pa.array(codes[keep])))
                runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(run_type))
                at = np.searchsorted(text, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), runs), pc.binary_join(left, " ")],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(found), f"doc_id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which the words of every document whose crc32 of the id is a multiple of ten go on periodically from
    some word on: the place and the period follow from the same number."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("__h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("__words"))
    g, n, words = F.floor(F.col("__h") / 10), F.size("__words"), F.col("__words")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return chosen.select("doc_id", F.when(words.isNotNull() & (n > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def _longest(field: str) -> Column:
    """A field of the first run in the order of length, the longest first, then start, then period."""
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    return first[field]


def digests(docs: DataFrame) -> DataFrame:
    """Per document: number of runs, the longest, and SHA-256 of all runs and of the collapsed text."""
    done = periodic_runs(with_periods(docs))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return done.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(_longest(c).alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * _longest("length") / _longest("period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
