"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few numbers (lengths, shares of character classes, repetition, line shape). Every
number is binned at quantiles; shallow trees, boosted in cycles over the features, add up to one lookup
table per feature, and the pairs of features that explain most of what remains get tables of their own.
A score is the sum of table entries of the text's bins, passed through the logistic function.

The model is fitted on a bounded sample of labelled rows (`max_docs`, the first by a hash of doc_id, each
document once); scoring covers every row and whole texts.

Defined cases: null and empty texts have the features of a text without words; without labels of both
kinds every row scores the share of label 1 (0.5 without labels); labels that are null are no labels; a
document labelled twice has the larger label, and of a doc_id with several texts the smallest is learned from; repeated rows give repeated rows; an empty table gives an
empty table; other columns of the documents are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import bounded_batches, crc_fold, labelled_sample, row_slices, word_lists

FOLDS, HELD_OUT = 3, 1
MAX_DOCS = 20_000
BINS, PAIR_BINS = 32, 8

FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "most_common_word", "repeats_previous", "upper", "digits",
    "symbols", "pipes", "exclamations", "stops", "lines_per_word", "distinct_lines", "not_ascii", "spaces", "long_words",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HIGH = np.arange(256) >= 128
_CONTINUED = (np.arange(256) >= 128) & (np.arange(256) < 192)
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    texts = pc.fill_null(texts, "")
    words, codes, offsets = word_lists(texts)
    widths = pc.utf8_length(words).to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, int)
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        raw = text.as_py().encode()
        count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        chars = max(1, int(count[~_CONTINUED].sum()))
        own = codes[offsets[i] : offsets[i + 1]]
        n = max(1, len(own))
        times = np.unique(own, return_counts=True)[1] if len(own) else np.array([0])
        lines = raw.split(b"\n")
        letters = max(1, int(count[_UPPER | _LOWER].sum()))
        out[i] = (
            math.log1p(chars), math.log1p(len(own)), widths[own].mean() if len(own) else 0, len(times) / n, times.max() / n, (own[1:] == own[:-1]).sum() / n, count[_UPPER].sum() / letters, count[_DIGIT].sum() / chars,
            (count[_SYMBOL].sum() - count[46] - count[44]) / chars, count[124] / n, count[33] / n, (count[46] + count[44]) / n, len(lines) / n, len(set(lines)) / len(lines), count[_HIGH].sum() / chars, count[_SPACE].sum() / chars, (widths[own] > 20).sum() / n,
        )
    return out


@dataclass
class Model:
    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for p in self.pairs for j in p}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _leaves(g: np.ndarray, h: np.ndarray, most: int, ridge: float) -> np.ndarray:
    """A shallow regression tree over ordered bins: Newton steps of up to `most` leaves, split greedily."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    parts = [(0, len(g))]
    while len(parts) < most:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (a, b), int(at[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, most_pairs: int = 6, rate: float = 0.1, ridge: float = 5.0) -> Model:
    """Cyclic boosting over single features, then over the pairs with the largest remaining gain."""
    share = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Model(math.log(share / (1 - share)))
    quantiles = lambda v, bins: np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))
    model = Model(math.log(share / (1 - share)), [quantiles(v, BINS) for v in x.T], [], [], [quantiles(v, PAIR_BINS) for v in x.T])
    bins = [np.searchsorted(e, v, side="right") for e, v in zip(model.edges, x.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.bias)
    for _ in range(rounds):
        for b, table in zip(bins, model.tables, strict=True):
            p = 1 / (1 + np.exp(-z))
            step = rate * _leaves(np.bincount(b, weights=y - p, minlength=len(table)), np.bincount(b, weights=p * (1 - p), minlength=len(table)), 4, ridge)
            table += step
            z += step[b]
    coarse = [np.searchsorted(e, v, side="right") for e, v in zip(model.pair_edges, x.T, strict=True)]
    wide = [len(e) + 1 for e in model.pair_edges]
    p = 1 / (1 + np.exp(-z))
    gains = []
    for a, b in combinations(range(x.shape[1]), 2):
        cell = coarse[a] * wide[b] + coarse[b]
        g, h = np.bincount(cell, weights=y - p), np.bincount(cell, weights=p * (1 - p))
        gains.append(((g**2 / (h + ridge)).sum(), a, b))
    model.pairs = sorted((a, b) for _, a, b in sorted(gains, reverse=True)[:most_pairs])
    model.pair_tables = [np.zeros((wide[a], wide[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-z))
            cell = coarse[a] * wide[b] + coarse[b]
            step = rate * np.bincount(cell, weights=y - p, minlength=table.size) / (np.bincount(cell, weights=p * (1 - p), minlength=table.size) + ridge)
            table += step.reshape(table.shape)
            z += step[cell]
    return model


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Learn from a bounded sample of labels outside the held-out fold; only the sample's feature rows reach the driver."""
    bounded_batches(docs.sparkSession)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                rows = pa.FixedSizeListArray.from_arrays(pa.array(features(part.column("text")).ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), rows], ["doc_id", "label", "x"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    train_ = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, max_docs)
    rows = train_.mapInArrow(measured, f"doc_id {id_type}, label int, x array<double>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    return train(np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES)), rows["label"].to_numpy(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row's whole text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(features(part.column("text"))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {id_type}, score double")


def classify(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted (1 if score >= 0.5)."""
    return score(docs, fit(docs, labels, max_docs)).select(
        "doc_id", (crc_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
