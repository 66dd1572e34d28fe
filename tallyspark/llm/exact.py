"""Exact dedup by skew-safe combining.

Texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``.
Three combines, each comparing the full normalised content beside its digest: within the map
task (Spark's partial aggregation), within a (digest, salt) group, and across the salts of a
digest. A group of copies thus never meets in one task as more rows than there are salts and
map tasks. Should two different contents share a digest, their rows are grouped by content
on a path of their own.

The winners go back to the documents by digest; digests with a large share of all rows are broadcast (``_skew``).

Nulls: a null text counts as empty; a null doc_id is larger than any other. Ties of length go to the smaller
doc_id. Repeated rows: one of several identical rows stays. Very long texts: a text is one value and is
held whole, as often as a sort buffer holds it; digests, not texts, are joined. Extra columns are ignored by
``mark`` and kept by ``dedup``, whatever their names. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm._skew import join_keys
from tallyspark.llm._store import Scratch

SALTS = 16  # at least; more with more shuffle partitions


def normalised(text: Column) -> Column:
    """Text without white space; literal replacement is several times faster than a pattern."""
    out = F.coalesce(text, F.lit(""))
    for code in (0x20, 0x0A, 0x09, 0x0B, 0x0C, 0x0D):
        out = F.replace(out, F.lit(chr(code)), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _best() -> Column:
    return F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))


def _combined(rows: DataFrame, salts: int) -> DataFrame:
    """(sha, norm, best, size) per distinct content, partitioned by sha."""
    salted = rows.withColumn("salt", F.pmod(F.hash("doc_id", "n"), F.lit(salts)))
    local = salted.groupBy("sha", "salt", "norm").agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("size"))
    return local.repartition("sha").groupBy("sha", "norm").agg(F.min("best").alias("best"), F.sum("size").alias("size"))


def mark(docs: DataFrame, salts: int | None = None, digest: Callable[[Column], Column] = sha256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n (code points), keep_id, group_size, kept, text_sha256."""
    store = Scratch(docs.sparkSession, "exact")
    salts = salts or max(SALTS, isqrt(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.char_length(text).cast("long").alias("n"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("sha", digest(F.col("norm")))
    winners = store.table("winners", _combined(rows, salts).groupBy("sha").agg(F.min("best").alias("best"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("contents")))
    ids = rows.withColumn("true_sha", sha256(F.col("norm")) if digest is not sha256 else F.col("sha"))
    clash = winners.filter("contents > 1").select("sha")
    if clash.isEmpty():
        keys = ["doc_id", "n", "sha"] if digest is sha256 else ["doc_id", "n", "sha", "true_sha"]
        own = store.table("ids", ids.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")))
        own = own.withColumn("true_sha", F.col("sha")) if digest is sha256 else own
        joined = join_keys(own, winners, ["sha"], "size", winners.agg(F.sum("size")).first()[0] or 0)
        store.keep("winners", "ids")
    else:
        single = ids.join(clash, "sha", "left_anti").groupBy("doc_id", "n", "sha", "true_sha").agg(F.count(F.lit(1)).alias("rows")).join(winners.drop("contents"), "sha")
        both = ids.join(clash, "sha", "left_semi")
        split = both.groupBy("doc_id", "n", "sha", "true_sha", "norm").agg(F.count(F.lit(1)).alias("rows")).join(_combined(both.drop("true_sha"), salts), ["sha", "norm"])
        joined = single.unionByName(split.drop("norm"))
    first = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("n") == -F.col("best.n"))
    return joined.select(
        "doc_id",
        "n",
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        first.alias("first"),
        F.lower(F.hex("true_sha")).alias("text_sha256"),
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"),
    ).select("doc_id", "n", "keep_id", "group_size", (F.col("first") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with all their columns."""
    kept = mark(docs, **options).filter("kept").select(F.col("doc_id").alias("__id"), F.col("n").alias("__n"), F.col("text_sha256").alias("__sha"), F.lit(1).alias("__copy"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("*", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__key"), F.char_length(text).cast("long").alias("__n"), F.sha2(normalised(F.col("text")), 256).alias("__sha"))
    order = Window.partitionBy("__key", "__n", "__sha").orderBy("text")
    kept = kept.select(F.coalesce(F.col("__id").cast("string"), F.lit("")).alias("__key"), "__n", "__sha", "__copy")
    return rows.withColumn("__copy", F.row_number().over(order)).join(kept, ["__key", "__n", "__sha", "__copy"], "left_semi").select(*docs.columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size,
             row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id ASC NULLS LAST) = 1 AS kept FROM t)
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM w
"""
