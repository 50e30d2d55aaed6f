"""Mixing of a corpus to target shares, with soft domain membership.

Native DataFrame operations throughout. A naive-Bayes classifier learned from the labelled rows gives every document a
posterior over the domains (toxic, low quality, high quality). It has two kinds of features: four numbers about the text's
style, taken as Gaussian, whose moments are aggregated over the labelled rows; and which words of a lexicon stand
in the text, taken as independent yes-or-no draws. The lexicon holds the words that lean to toxic texts most, counted
over a bounded sample of labelled rows (`MAX_DOCS`, the first by a hash of doc_id; `LEXICON` words at most).

Document rates w >= 0 then minimise the squared distance between the expected tokens of each domain, sum of
w * tokens * posterior, and the targets, by projected gradient steps from w = 1. A step moves each document's rate against
the gradient, its posterior times the misses, scaled by the inverse of the live documents' Gram matrix of domains, and
projects it to 0 or more at once; a step that makes things worse is halved. A rate is a function of the posterior and the few
numbers of each step, so a pass only aggregates a few numbers a domain, whatever the corpus's size. The search
ends when no share misses its target by more than TOLERANCE, or after ROUNDS; `plan` tells which, and the miss.
A rate becomes whole copies by a hash of doc_id: floor of the rate plus one more with odds of the rest.

Defined cases: null and empty texts have no tokens, rate 0 and no copies; without labels all posteriors
are equal; targets that no document can serve are met as nearly as the rest allows; repeated rows are documents of their own,
with equal rates and copies; an empty table gives an empty table; further columns pass through `mixed`
(a doc_id of null counts as one id).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import materialize

DOMAINS = ("toxic", "low", "high")
#: Shares of all tokens.
TARGETS = {"toxic": 0.01, "low": 0.06, "high": 0.93}
ROUNDS = 40
TOLERANCE = 1e-4
#: Added to the Gram matrix, which needn't have an inverse.
RIDGE = 1e-6
MAX_DOCS = 20_000
#: Words of the lexicon at most; toxic texts of the sample that must have a word, and how many times as likely it must be there.
LEXICON, LEAST_TOXIC, LEAST_LEAN = 200, 5, 8.0

_UPPER = "".join(map(chr, range(65, 91)))
_SYMBOLS = "#$%&*|!<>{}[]=_~^@"


def _without(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def features(docs: DataFrame, lexicon: Sequence[str], *carried: str) -> DataFrame:
    """doc_id, carried columns, n_tokens (words between white space), four numbers about the text, and hits, which words of the
    lexicon it has."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"\S+"))
    hits = F.array_intersect(_words(text), F.array(*map(F.lit, lexicon))) if lexicon else F.array().cast("array<string>")
    counted = docs.select(
        "doc_id", *carried, words.cast("long").alias("n_tokens"), F.length(text).alias("chars"), _without(text, _UPPER).alias("upper"), _without(text, _SYMBOLS).alias("symbols"),
        _without(text, ".,").alias("stops"), hits.alias("hits"),
    )
    per_word = lambda c: F.col(c) / F.greatest("n_tokens", F.lit(1))
    return counted.select(
        "doc_id", *carried, "n_tokens", F.log1p(per_word("upper")).alias("x1"), F.log1p(per_word("symbols")).alias("x2"), F.log1p(per_word("stops")).alias("x3"), F.log1p(per_word("chars")).alias("x4"), "hits"
    )


def _domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic > 0, "toxic").when(quality > 0, "high").when(quality <= 0, "low")


def _named(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled ids."""
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(_domain(F.max("quality"), F.max("toxic")).alias("domain")).where("domain IS NOT NULL")


def fit_lexicon(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> dict[str, dict[str, float]]:
    """For each word of the lexicon the share of each domain's sampled texts that have it, add-half smoothed. Words come in the order of
    how many toxic texts they tell from others; without toxic texts or without others there are none."""
    sample = _named(labels).orderBy(F.xxhash64("doc_id", F.lit("lexicon")), "doc_id").limit(max_docs)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # max_docs bounds it
    texts = materialize(texts.select("domain", F.array_distinct(_words(F.coalesce("text", F.lit("")))).alias("words")), "labelled-words")
    size = {r["domain"]: r["n"] for r in texts.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # three rows at most
    toxic, rest = size.get("toxic", 0), sum(n for d, n in size.items() if d != "toxic")
    if not toxic or not rest:
        return {}
    counts = texts.select("domain", F.explode("words").alias("word")).where("word <> ''").groupBy("word").agg(*(F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS))
    lean = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("low") + F.col("high") + 0.5) / (rest + 1))
    chosen = counts.where((F.col("toxic") >= LEAST_TOXIC) & (lean >= math.log(LEAST_LEAN))).orderBy(F.desc(F.col("toxic") * lean), "word").limit(LEXICON).collect()
    return {r["word"]: {d: (r[d] + 0.5) / (n + 1) for d, n in size.items()} for r in chosen}


XS = tuple(f"x{i}" for i in range(1, 5))


def fit_domains(seen: DataFrame, labels: DataFrame) -> dict[str, dict]:
    """Share of each labelled domain, and mean and variance of each feature in it."""
    # a row for each domain
    rows = seen.join(_named(labels), "doc_id").groupBy("domain").agg(F.count("*").alias("n"), *(f(x).alias(f"{k}_{x}") for x in XS for k, f in (("mean", F.avg), ("var", F.var_pop)))).collect()
    total = sum(r["n"] for r in rows)
    return {r["domain"]: {"share": r["n"] / total} | {x: (r[f"mean_{x}"], max(r[f"var_{x}"], 1e-4)) for x in XS} for r in rows}


def _word_evidence(lexicon: dict[str, dict[str, float]], domain: str) -> Column:
    """Log-odds of which words of the lexicon stand in a text of the domain: that none does, and what each hit changes."""
    shares = {w: p[domain] for w, p in lexicon.items() if domain in p}
    if not shares:
        return F.lit(0.0)
    change = F.create_map(*(F.lit(x) for w, p in shares.items() for x in (w, math.log(p) - math.log1p(-p))))
    return F.aggregate("hits", F.lit(sum(math.log1p(-p) for p in shares.values())), lambda sum_, w: sum_ + F.coalesce(F.element_at(change, w), F.lit(0.0)))


def posteriors(seen: DataFrame, moments: dict[str, dict], lexicon: dict[str, dict[str, float]], *carried: str) -> DataFrame:
    """`seen` with p_toxic, p_low and p_high in place of the features."""
    if not moments:
        return seen.select("doc_id", *carried, "n_tokens", *(F.lit(1 / len(DOMAINS)).alias(f"p_{d}") for d in DOMAINS))
    logs = {d: math.log(m["share"]) - sum(0.5 * math.log(m[x][1]) for x in XS) - sum(((F.col(x) - m[x][0]) ** 2 / (2 * m[x][1]) for x in XS), F.lit(0.0)) + _word_evidence(lexicon, d) for d, m in moments.items()}
    told = seen.withColumns({f"log_{d}": v for d, v in logs.items()})
    weighed = told.withColumn("top", F.greatest(*(f"log_{d}" for d in logs)) if len(logs) > 1 else F.col(f"log_{next(iter(logs))}"))
    weights = {d: F.exp(F.col(f"log_{d}") - F.col("top")) for d in logs}
    whole = sum(weights.values(), F.lit(0.0))
    return weighed.select("doc_id", *carried, "n_tokens", *((weights[d] / whole if d in weights else F.lit(0.0)).alias(f"p_{d}") for d in DOMAINS))


def rate(steps: list[list[float]]) -> Column:
    """A document's rate: from 1 moved along its posterior step by step, projected to 0 or more after each."""
    w = F.lit(1.0)
    for step in steps:
        w = F.greatest(F.lit(0.0), w - sum((F.col(f"p_{d}") * s for d, s in zip(DOMAINS, step, strict=True)), F.lit(0.0)))
    return F.when(F.col("n_tokens") > 0, w).otherwise(0.0)


def fit_rates(scored: DataFrame, targets: dict[str, float] = TARGETS) -> tuple[list[list[float]], float]:
    """The steps after which expected domain tokens match the targets' shares of all tokens, and the largest miss that is left.

    Each pass over the documents sums the domains' tokens and, of documents whose rate isn't at 0, their Gram matrix.
    """
    ps = [F.col(f"p_{d}") for d in DOMAINS]
    n, w = F.col("n_tokens").cast("double"), F.col("w")
    total = scored.agg(F.sum(n)).first()[0] or 0.0
    k = len(DOMAINS)
    if not total:
        return [], 0.0
    goal = np.array([targets[d] for d in DOMAINS])
    live = F.when(w > 0, n).otherwise(0.0)
    steps: list[list[float]] = []
    tried, step, miss = steps, np.zeros(k), math.inf
    for _ in range(ROUNDS):
        # k + k * k numbers
        sums = np.array(scored.withColumn("w", rate(tried)).agg(*(F.sum(w * n * p) for p in ps), *(F.sum(live * a * b) for a in ps for b in ps)).first(), float) / total
        left = sums[:k] - goal
        if np.linalg.norm(left) >= miss:
            step = step / 2
        else:
            steps, miss, largest = tried, float(np.linalg.norm(left)), float(np.abs(left).max())
            if largest <= TOLERANCE:
                break
            step = np.linalg.solve(sums[k:].reshape(k, k) + RIDGE * np.eye(k), left)
        tried = [*steps, step.tolist()]
    return steps, largest


def copies(rate: Column, doc_id: Column) -> Column:
    """Whole copies whose expected number is the rate."""
    share = F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + share).cast("long")


def _fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float]) -> tuple[DataFrame, dict[str, dict], dict[str, dict[str, float]], list[list[float]], float]:
    lexicon = fit_lexicon(docs, labels)
    seen = materialize(features(docs, list(lexicon)), "features")
    moments = fit_domains(seen, labels)
    scored = materialize(posteriors(seen, moments, lexicon), "posteriors")
    return scored, moments, lexicon, *fit_rates(scored, targets)


def plan(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """Per row: doc_id, n_tokens, posteriors, rate and copies; and, the same in all rows, miss, by which the expected share of some
    domain differs from its target, and converged, whether that is TOLERANCE or less."""
    scored, _, _, steps, miss = _fitted(docs, labels, targets)
    fitted = scored.withColumn("rate", rate(steps)).withColumn("copies", copies(F.col("rate"), F.col("doc_id")))
    return fitted.withColumns({"miss": F.lit(miss), "converged": F.lit(miss <= TOLERANCE)})


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, outcome: dict | None = None) -> DataFrame:
    """Rows of `docs`, all columns, each as often as its copies say. The fitted rate is a function of the row, so no join or shuffle of texts.
    outcome, if given, gets miss and converged, as in `plan`: rows alone don't tell whether the targets were met."""
    _, moments, lexicon, steps, miss = _fitted(docs, labels, targets)
    if outcome is not None:
        outcome |= {"miss": miss, "converged": miss <= TOLERANCE}
    rows = features(docs.select(F.struct("*").alias("whole"), "doc_id", "text"), list(lexicon), "whole")
    # the added zero isn't deterministic for the optimizer, which else repeats the whole expression below the scan as a filter
    times = copies(rate(steps), F.col("doc_id")) + F.floor(F.rand(0) * 0.5).cast("int")
    timed = posteriors(rows, moments, lexicon, "whole").select("whole", times.alias("times"))
    return timed.select("whole", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select("whole.*")
