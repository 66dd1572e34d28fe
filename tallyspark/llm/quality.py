"""Quality classifier: subword-bag embeddings with a softmax (see ``subword``), case kept.

Features are words, word pairs and triples, and character n-grams; scores are calibrated on a fifth of
the sample that training does not see.
Nulls: a null text scores like an empty one (the learnt prior). Unlabelled, null-labelled or
held-out rows are not learnt from (of several labels of one doc_id the larger counts); with no labels at all every score
is the prior alone. Repeated rows, and ties, score alike; very long texts are scored whole, in blocks; extra columns
are kept as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import subword

SHAPE = subword.Shape(bits=18, words=3, calibrated=True)
THRESHOLD, PARTS, PART = 0.7, 4, 2


def score(docs: DataFrame, labels: DataFrame, shape: subword.Shape = SHAPE) -> DataFrame:
    """``docs`` with held_out, score and predicted (1: good) put last."""
    model = subword.fit(docs, labels, "quality", ~subword.held_out(F.col("doc_id"), PARTS, PART), shape)
    out = subword.scored(docs, model, shape)
    return out.select("*", subword.held_out(F.col("doc_id"), PARTS, PART).alias("held_out"), (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    model = subword.fit(docs, labels, "quality", ~subword.held_out(F.col("doc_id"), PARTS, PART), SHAPE)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    out = subword.scored(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col("text")), model, SHAPE)
    return out.filter(F.col("score") >= THRESHOLD).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
