"""Cleaning of a document corpus, stage by stage; every stage works on all that the one before it kept.

1. toxicity: documents that the counterfactual-regularised classifier rejects go.
2. jaccard: of documents linked by word n-grams the one that names the group stays.
3. secrets: secrets, also encoded ones, are replaced by a mark.
4. mixing: documents are dropped or repeated so that expected domain tokens match the targets.
5. bpe: every remaining text is encoded and decoded; one row of digests for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm import bpe, jaccard_join, mixing, secrets, toxicity
from kairograph.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; null and empty texts are judged like others, repeated rows alike."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at 0.8 or more, repeated rows and rows without doc_id included; texts without
    words all stay. An empty table gives an empty table."""
    return jaccard_join.keep_first(docs, words=5, similarity=(80, 100))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark, compressed parts that can't be read by another, and n_chars following; null texts
    stay null."""
    return secrets.redact(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str, outcome: dict | None = None) -> DataFrame:
    """Documents as often as their fitted rates say; texts without words go, they have no tokens to mix. outcome gets whether the
    targets were met."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), outcome=outcome)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of every text's token ids, and digest of what they decode to; null is empty."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_domains),
    ("bpe", encode_tokens),
]

#: SQL can't express the classifiers or the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's digests; and, the same in all rows, mix_miss and mix_converged: by how much the shares of domains miss their
    targets, and whether that is within the tolerance."""
    mix: dict = {}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir, **({"outcome": mix} if stage is mix_domains else {}))
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs.withColumns({f"mix_{k}": F.lit(v) for k, v in mix.items()})
