"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words: its weight's share of all words, at most
``limit`` times its own size, what is cut off being reshared by weight (a water level over
the sources sorted by size / weight, found with two windows over the small table of sources).
A document's expected copies are target / source size; prefix sums of them within the source,
plus one random offset, cross an integer as often as the document is emitted. Documents are
ranked by size class first, so that the words taken come out near the target as well as the
number of documents. Ranks come from group counts (source, size class, salt: a hash of doc_id modulo a number
that grows with the rows) and row numbers within such a group: no task sees a whole source.

Nulls: a null text has size 0, a null source is a source of its own (last), a null doc_id sorts
last. Repeated rows, and ties of size and doc_id, are ranked one by one, and are alike to the result. Very long
texts: only their number of words is kept. Extra columns are ignored by ``with_copies`` unless carried, and kept by
``mix``, whatever their names. Empty table: empty result. No words at all: every target is 0. Reruns agree,
since the order and the offset are fixed by the data and the seed.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm._store import Scratch

WEIGHTS, LIMIT, SALTS, SALT_ROWS, SEED = (5, 2, 1), 3, 256, 100_000, 17
WORDS = r"[^\x20\x09-\x0D]+"


def offset(seed: int = SEED) -> float:
    return random.Random(seed).randrange(1 << 20) / (1 << 20)


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """sizes: key, source, source_size. Adds target."""
    whole = 1
    for w in set(weights):
        whole *= w
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(order, F.lit(len(weights))) + 1).cast("int")).cast("long")
    rising = Window.orderBy("ratio", "weight", "key").rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.withColumn("weight", weight).withColumn("ratio", F.col("source_size") * (F.lit(whole) / F.col("weight")).cast("long"))
    everything = Window.partitionBy()
    s = s.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.lit(limit) * F.sum("source_size").over(rising), F.lit(0)))
    s = s.withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0)))
    s = s.withColumn("full", F.lit(limit) * F.col("source_size") * F.col("rest_weight") <= F.col("rest") * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct("ratio", "weight", "key", "rest", "rest_weight"))).over(everything)
    s = s.withColumn("level", level)
    share = F.col("level.rest").cast("double") * F.col("weight") / F.col("level.rest_weight")
    return s.select("key", "source", "source_size", F.when(F.col("full"), (F.lit(limit) * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def with_copies(docs: DataFrame, carried: list[str], weights=WEIGHTS, limit=LIMIT, seed: int = SEED, id_col="doc_id", source_col="source", text_col="text") -> DataFrame:
    """carried columns as __0, __1, ... and doc_id, size, source_size, target, copies."""
    store = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(carried)],
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("key"),
        n_words(F.col(text_col)).alias("size"),
    )
    rows = rows.withColumn("class", F.length(F.bin("size")))
    if not carried:  # narrow: count words once
        rows = store.table("sizes", rows)
    salts = max(SALTS, rows.count() // SALT_ROWS)
    mark = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("salt", F.coalesce(F.pmod(mark, F.lit(salts)), F.lit(salts)))
    groups = store.table("groups", rows.groupBy("key", "source", "class", "salt").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words")))
    aim = targets(groups.groupBy("key", "source").agg(F.sum("words").alias("source_size")), weights, limit).drop("source")
    before = Window.partitionBy("key").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("key", "class", "salt", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")).join(aim, "key")
    starts = store.table("starts", starts)
    store.keep("sizes", "starts")
    rank = F.col("start") + F.row_number().over(Window.partitionBy("key", "class", "salt").orderBy("size", F.col("doc_id").asc_nulls_last()))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = rows.join(starts, ["key", "class", "salt"]).withColumn("rank", rank).withColumn("each", each)
    crossed = F.floor(F.lit(offset(seed)) + F.col("rank") * F.col("each")) - F.floor(F.lit(offset(seed)) + (F.col("rank") - 1) * F.col("each"))
    return out.withColumn("copies", crossed.cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Each document as often as the mix takes it, with all its columns."""
    out = with_copies(docs, docs.columns, **options).filter("copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"), [])
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS BIGINT) AS size FROM documents),
z AS (SELECT source, coalesce('=' || source, '') AS key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
y AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM z),
x AS (SELECT *, source_size * (10 // weight) AS ratio FROM y),
v AS (SELECT *, CAST((SELECT sum(source_size) FROM z) - {LIMIT} * coalesce(sum(source_size) OVER w, 0) AS BIGINT) AS rest,
             CAST((SELECT sum(weight) FROM y) - coalesce(sum(weight) OVER w, 0) AS BIGINT) AS rest_weight
      FROM x WINDOW w AS (ORDER BY ratio, weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, {LIMIT} * source_size * rest_weight <= rest * weight AS full_ FROM v),
l AS (SELECT rest, rest_weight FROM u WHERE NOT full_ ORDER BY ratio, weight, key LIMIT 1),
n AS (SELECT greatest({SALTS}, count(*) // {SALT_ROWS}) AS salts FROM d),
t AS (SELECT key, source_size, CASE WHEN full_ THEN CAST({LIMIT} * source_size AS DOUBLE)
             ELSE CAST((SELECT rest FROM l) AS DOUBLE) * weight / (SELECT rest_weight FROM l) END AS target FROM u),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS each,
             row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size)), coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % n.salts, n.salts), size, doc_id NULLS LAST) AS rank
      FROM d CROSS JOIN n JOIN t ON coalesce('=' || d.source, '') = t.key)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor({offset()} + rank * each) - floor({offset()} + (rank - 1) * each)) AS BIGINT) AS taken FROM r
"""
