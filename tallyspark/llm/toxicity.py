"""Toxicity: subword-bag embeddings with a softmax (see ``subword``), A-Z in lower case.

Misspelt or inflected words share character n-grams with those seen in training. Both classes weigh the
same in the loss, as toxic rows are few. Nulls, missing labels, repeated rows, ties, very long texts, extra columns and
empty tables as in ``quality``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import subword

SHAPE = subword.Shape(lower=True, smooth=200.0, balance=1.0)
THRESHOLD, PARTS, PART = 0.5, 5, 0


def score(docs: DataFrame, labels: DataFrame, shape: subword.Shape = SHAPE) -> DataFrame:
    """``docs`` with held_out, score and predicted (1: toxic) put last."""
    model = subword.fit(docs, labels, "toxic", ~subword.held_out(F.col("doc_id"), PARTS, PART), shape)
    out = subword.scored(docs, model, shape)
    return out.select("*", subword.held_out(F.col("doc_id"), PARTS, PART).alias("held_out"), (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
