"""Toxicity classifier with counterfactual regularisation.

Features are the words of a text and the beginnings of its words, each present or absent. Counts over
labelled texts pick the features that lean to toxic texts; a logistic model over them is fitted so that
swapping an identity term of a labelled sentence for another of its group changes the score as little
as possible (the squared change of the logit is part of the loss). Neutral mentions of groups that
happen to stand in toxic texts so gain no weight.

Identity terms are those of a list (below) and those that the labelled texts themselves have: words that stand in
toxic and in clean texts alike (in LEAST_SHARE of either kind, neither kind MOST_LEAN times as likely to have
them), grouped into distributional classes by the frequent words before and after them. Terms of one group are
swapped for one another, in a derived group for the next ones in alphabetical order. Swaps that exchange the same
features count as one with a multiplicity, so every swap of every labelled sentence takes part.

The model is fitted on a bounded sample of labelled rows (`max_docs`, the first by a hash of doc_id), which bounds all
else that the driver holds; scoring covers every row and whole texts.

Defined cases: null and empty texts score as texts without any feature; without labels of both kinds every row scores
(toxic + 1) / (labelled + 3): below 0.5 without labels or with clean ones only, above it with toxic ones only; labels
that are null are no labels; a document labelled twice counts as toxic if any label says so, and of a doc_id with
several texts the smallest is learned from; repeated rows give repeated rows; an empty table gives an empty table;
other columns of the documents are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import bounded_batches, crc_fold, labelled_sample, materialize, row_slices, tidy, word_lists
from kairograph.llm.multi_index import kmeans

FOLDS, HELD_OUT = 5, 0
MAX_DOCS = 20_000
#: Lengths of the beginnings of words that are features, and what a feature must show: toxic texts, and how many times as likely.
SHORTEST, LONGEST = 3, 8
LEAST_TOXIC, MOST_LEAN = 3, 4.0
#: Derived identity terms: share of the toxic and of the clean texts that must have one, words that tell contexts, terms a group.
LEAST_SHARE, CONTEXTS, GROUP = 0.02, 32, 8

# Identity terms by group, lower case. Terms of one group are swapped for one another.
IDENTITY_TERMS = {
    "gender": ("woman", "man", "women", "men", "femme", "homme", "frau", "mann", "mujer", "hombre"),
    "religion": ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "musulman", "chrétien", "juif", "moslem", "jude", "musulmán", "cristiano", "judío"),
    "origin": ("black", "white", "asian", "african", "european", "american", "arab", "latino", "immigrant", "native"),
    "orientation": ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    "age_ability": ("old", "young", "elderly", "disabled", "deaf", "blind"),
}

_EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_/\\~`"
_SENTENCE = re.compile(r"[^.!?\n]+")


def word_features(word: str) -> list[str]:
    """The word itself (after =) and its beginnings (after ^)."""
    return [f"={word}", *(f"^{word[:n]}" for n in range(SHORTEST, min(LONGEST, len(word)) + 1))] if word else []


@dataclass(frozen=True)
class Model:
    features: tuple[str, ...]
    weights: np.ndarray
    bias: float

    def tables(self) -> dict[str, int]:
        return {f: i for i, f in enumerate(self.features)}


def _present(batch: pa.RecordBatch, index: dict[str, int], cache: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once, of a batch's texts."""
    words, codes, offsets = word_lists(pc.utf8_lower(pc.fill_null(batch.column("text"), "")))
    lists = []
    for raw in words.to_pylist():
        found = cache.get(raw)
        if found is None:
            found = tuple(i for f in word_features(raw.strip(_EDGES)) if (i := index.get(f)) is not None)
            if len(cache) > 100_000:
                cache.clear()
            cache[raw] = found
        lists.append(found)
    some = np.array([bool(x) for x in lists], bool)
    rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
    hit = some[codes] if len(codes) else np.zeros(0, bool)
    n = max(1, len(index))
    pairs = np.unique(rows[hit] * len(lists) + codes[hit]) if hit.any() else np.zeros(0, np.int64)
    both = [(r * n + i) for r, c in zip(*np.divmod(pairs, max(1, len(lists))), strict=True) for i in lists[c]]
    return np.divmod(np.unique(np.array(both, np.int64)), n)


def _counts(train: DataFrame) -> DataFrame:
    """(word, toxic, clean): how many texts of each kind have a word."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                words, codes, offsets = word_lists(pc.utf8_lower(pc.fill_null(part.column("text"), "")))
                label = part.column("label").to_numpy(zero_copy_only=False)
                rows = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                pairs = np.unique(rows * max(1, len(words)) + codes)
                row, code = np.divmod(pairs, max(1, len(words)))
                toxic = np.bincount(code, weights=label[row], minlength=len(words)).astype(np.int64)
                every = np.bincount(code, minlength=len(words)).astype(np.int64)
                sums: dict[str, list[int]] = {}
                for raw, t, n in zip(words.to_pylist(), toxic.tolist(), every.tolist(), strict=True):
                    held = sums.setdefault(raw.strip(_EDGES), [0, 0])
                    held[0] += t
                    held[1] += n - t
                yield pa.RecordBatch.from_arrays([pa.array(sums, pa.string()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1] for x in sums.values()], pa.int64())], ["word", "toxic", "clean"])

    found = train.mapInArrow(tidy(counted), "word string, toxic long, clean long").where("word <> ''")
    return materialize(found.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "words")


def _lean(sizes: dict[int, int]) -> Column:
    """Log of how many times as likely toxic texts are to have it."""
    return F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1))


def _selected(words: DataFrame, sizes: dict[int, int]) -> list[str]:
    """Features that lean to toxic texts, the strongest first."""
    starts = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("word"))), lambda n: F.concat(F.lit("^"), F.substring(F.col("word"), F.lit(1), n)))
    features = F.when(F.length("word") >= SHORTEST, F.concat(F.array(F.concat(F.lit("="), "word")), starts)).otherwise(F.array(F.concat(F.lit("="), "word")))
    summed = words.select(F.explode(features).alias("feature"), "toxic", "clean").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    leaning = summed.where((F.col("toxic") >= LEAST_TOXIC) & (_lean(sizes) >= math.log(MOST_LEAN)))
    return [r["feature"] for r in leaning.orderBy((_lean(sizes) * F.sqrt("toxic")).desc(), "feature").select("feature").collect()]


def derived_terms(train: DataFrame, words: DataFrame, sizes: dict[int, int]) -> list[list[str]]:
    """Groups of words that stand in toxic and clean texts alike, by their neighbours."""
    neutral = words.where((F.col("toxic") >= LEAST_SHARE * sizes[1]) & (F.col("clean") >= LEAST_SHARE * sizes[0]) & (F.length("word") >= SHORTEST) & (F.abs(_lean(sizes)) < math.log(MOST_LEAN)))
    terms = sorted(r["word"] for r in neutral.where("toxic >= 2 AND clean >= 2").select("word").collect())
    around = [r["word"] for r in words.orderBy((F.col("toxic") + F.col("clean")).desc(), "word").limit(CONTEXTS).select("word").collect()]
    if len(terms) < 2:
        return []
    place, side = {t: i for i, t in enumerate(terms)}, {w: i for i, w in enumerate(around)}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column("text"):
                own = [w.strip(_EDGES) for w in (text.as_py() or "").lower().split()]
                for k, w in enumerate(own):
                    if (t := place.get(w)) is not None:
                        seen.update((t, c) for c in (side.get(own[k - 1]) if k else None, CONTEXTS + side[own[k + 1]] if k + 1 < len(own) and own[k + 1] in side else None) if c is not None)
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen], pa.int32()), pa.array([c for _, c in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["term", "context", "n"])

    table = np.zeros((len(terms), 2 * CONTEXTS))
    for r in train.select("text").mapInArrow(tidy(near), "term int, context int, n long").groupBy("term", "context").agg(F.sum("n").alias("n")).collect():
        table[r["term"], r["context"]] = r["n"]
    table = np.sqrt(table / np.maximum(1, table.sum(1, keepdims=True)))
    centres = kmeans(table, max(1, len(terms) // GROUP))
    own = ((centres**2).sum(1) - 2 * table @ centres.T).argmin(1)
    return [g for c in range(len(centres)) if len(g := [t for t, o in zip(terms, own, strict=True) if o == c]) > 1]


def swaps_of(groups: list[list[str]]) -> dict[str, tuple[str, ...]]:
    """What each identity term is swapped for: all others of a listed group, the next ones of a derived group."""
    found = {t: tuple(o for o in terms if o != t) for terms in IDENTITY_TERMS.values() for t in terms}
    for group in groups:
        for i, t in enumerate(group):
            found.setdefault(t, tuple(dict.fromkeys(group[(i + d) % len(group)] for d in (1, 2, 3) if (i + d) % len(group) != i)))
    return found


def swapped_pairs(train: DataFrame, swaps: dict[str, tuple[str, ...]], index: dict[str, int]) -> DataFrame:
    """(term, gone, come, n): features that swaps of a term in labelled sentences take away and bring, and how many swaps do."""

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, frozenset[int]] = {}

        def features(word: str) -> frozenset[int]:
            if word not in held:
                if len(held) > 100_000:
                    held.clear()
                held[word] = frozenset(i for f in word_features(word) if (i := index.get(f)) is not None)
            return held[word]

        for batch in batches:
            pairs: Counter = Counter()
            for text in batch.column("text"):
                for m in _SENTENCE.finditer((text.as_py() or "").lower()):
                    words = [w.strip(_EDGES) for w in m.group().split()]
                    if not any(w in swaps for w in words):
                        continue
                    times: Counter = Counter(i for w in words for i in features(w))
                    for w in words:
                        for other in swaps.get(w, ()):
                            gone = frozenset(i for i in features(w) if times[i] == 1) - features(other)
                            come = frozenset(i for i in features(other) if not times[i])
                            if gone or come:
                                pairs[w, tuple(sorted(gone)), tuple(sorted(come))] += 1
            sets = [pa.array([p[k] for p in pairs], pa.list_(pa.int32())) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), *sets, pa.array(list(pairs.values()), pa.int64())], ["term", "gone", "come", "n"])

    return train.select("text").mapInArrow(tidy(swapped), "term string, gone array<int>, come array<int>, n long").groupBy("term", "gone", "come").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, balance: float = 5.0, l2: float = 1e-4) -> Model:
    """Learn from labels outside the held-out fold. balance: weight of each term's mean squared score change under swaps."""
    bounded_batches(docs.sparkSession)
    train = materialize(labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, max_docs), "toxic-train")
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        toxic, every = sizes.get(1, 0), sum(sizes.values())
        return Model((), np.zeros(0), math.log((toxic + 1) / (every - toxic + 2)))
    words = _counts(train)
    swaps = swaps_of(derived_terms(train, words, sizes))
    features = tuple(dict.fromkeys([*_selected(words, sizes), *(f"={t}" for t in swaps)]))
    index = {f: i for i, f in enumerate(features)}

    def designed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for part in row_slices(batch, "text"):
                rows, ids = _present(part, index, cache)
                cuts = np.searchsorted(rows, np.arange(part.num_rows + 1))
                lists = [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(lists, pa.list_(pa.int32()))], ["label", "ids"])

    # the sample's rows, and the distinct exchanges of features in its sentences
    rows = train.select("label", "text").mapInArrow(tidy(designed), "label int, ids array<int>").groupBy("label", "ids").agg(F.count("*").alias("n")).orderBy("label", "ids").collect()
    pairs = swapped_pairs(train, swaps, index).orderBy("term", "gone", "come").collect()
    of_term: Counter = Counter()
    for r in pairs:
        of_term[r["term"]] += r["n"]
    weights, bias = _optimised(
        [r["ids"] for r in rows], np.array([r["label"] for r in rows], float), np.array([r["n"] for r in rows], float),
        [r["gone"] for r in pairs], [r["come"] for r in pairs], np.array([r["n"] / of_term[r["term"]] for r in pairs], float), len(features), balance, l2,
    )
    used = np.abs(weights) > 1e-3
    return Model(tuple(f for f, u in zip(features, used, strict=True) if u), weights[used], bias)


def _optimised(rows, y, n, left, right, m, width: int, balance: float, l2: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over the whole (bounded) sample."""

    def flat(lists):
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]).astype(np.int64), np.array([i for x in lists for i in x], np.int64)

    r, c = flat(rows)
    lr_, lc = flat(left)
    rr, rc = flat(right)
    total = n.sum()
    w, b = np.zeros(width), math.log((y @ n + 1) / ((1 - y) @ n + 1))
    state = np.zeros((2, width + 1))
    for t in range(1, steps + 1):
        z = np.bincount(r, weights=w[c], minlength=len(y)) + b
        g = n * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / total
        grad = np.bincount(c, weights=g[r], minlength=width) + l2 * w
        if len(m):
            d = np.bincount(lr_, weights=w[lc], minlength=len(m)) - np.bincount(rr, weights=w[rc], minlength=len(m))
            d = 2 * balance * d * m
            grad += np.bincount(lc, weights=d[lr_], minlength=width) - np.bincount(rc, weights=d[rr], minlength=width)
        full = np.append(grad, g.sum())
        state[0] = 0.9 * state[0] + 0.1 * full
        state[1] = 0.999 * state[1] + 0.001 * full**2
        step = 0.05 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row's whole text."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, cache = model.tables(), {}
        for batch in batches:
            for part in row_slices(batch, "text"):
                rows, ids = _present(part, index, cache)
                z = np.bincount(rows, weights=model.weights[ids], minlength=part.num_rows) + model.bias
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(scored), f"doc_id {id_type}, score double")


def classify(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted (1 if score >= 0.5)."""
    return score(docs, fit(docs, labels, **fitting)).select(
        "doc_id", (crc_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """The rows of `docs` that the classifier doesn't reject, with all their columns."""
    model = fit(docs, labels, **fitting)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, cache = model.tables(), {}
        for batch in batches:
            for part in row_slices(batch, "text"):
                rows, ids = _present(part, index, cache)
                z = np.bincount(rows, weights=model.weights[ids], minlength=part.num_rows) + model.bias
                yield part.filter(pa.array(z < 0))

    return docs.mapInArrow(tidy(kept), docs.schema)
