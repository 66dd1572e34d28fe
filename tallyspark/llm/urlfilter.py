"""URL filters by a Bloom filter cascade, in DataFrame functions only.

A url's keys are the last labels of its host (all of it, or as many as the longest rule has), each with the
prefixes of its path that are as long as some rule's path. A cascade answers exactly, for every key of the corpus,
whether it is listed: level 1 encodes the listed keys, level 2 the keys of the corpus that level 1 wrongly
passes, level 3 the listed keys that level 2 passes, and so on until a level errs on nothing.
The complete key universe is read twice (to count it, and for the false positives of level 1).
Level 1 is sized by that count so that the false positives, and with them all later levels, stay
about as many as the rules; if there are more than four times that, level 1 is made larger and
the keys are read again. What is sent to the tasks, one bitmap a level, is therefore bounded by the list of rules.
Pages are judged without a join. Two cascades are used: one for "is a rule", one for "is a blocking rule"
(whose universe is the rules themselves).

Rules are a list or a DataFrame of (verdict, host, path). Two rules with one key: they are one rule, which
blocks if either does. Of rules that fit, the one with the longest key wins; two different ones of one length
cannot both fit. Nulls: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed; rules with a null in them are left out. Repeated rows are judged one by one; very long urls are cut by
built-in functions at a cost in proportion to their length, however many labels they have; extra columns
are ignored, whatever their names; an empty table gives an empty result, no rules allow everything.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm._store import Scratch

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Distinct host suffix (of up to so many labels) + path prefix, for each given length of prefix that the path has."""
    suffixes = F.array_distinct(F.array(*[F.substring_index(host, ".", -n) for n in range(1, labels + 1)]).cast("array<string>"))
    prefixes = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]).cast("array<string>"), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


class Level:
    """One Bloom filter: a bitmap of ``m`` bits, ``k`` hashes."""

    def __init__(self, number: int, n: int, rate: float):
        self.number, self.k = number, max(1, round(-math.log2(rate)))
        self.m = max(64, math.ceil(n * self.k / math.log(2)))
        self.bits = bytearray(-(-self.m // 8))

    def places(self, key: Column) -> list[Column]:
        h1, h2 = F.xxhash64(key, F.lit(2 * self.number)), F.xxhash64(key, F.lit(2 * self.number + 1))
        m = F.lit(self.m)
        return [F.pmod(F.pmod(h1, m) + F.lit(i) * F.pmod(h2, m), m) for i in range(self.k)]

    def encode(self, keys: DataFrame) -> "Level":
        """Sets the bits of the keys; what comes to the driver is the bitmap, a byte a row."""
        at = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("at")).select(F.floor(F.col("at") / 8).alias("byte"), F.pmod("at", F.lit(8)).cast("int").alias("bit"))
        for row in at.groupBy("byte").agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("bits")).toLocalIterator():
            self.bits[row.byte] = row.bits
        return self

    def passes(self, key: Column) -> Column:
        table, out = F.lit(bytes(self.bits)), F.lit(True)
        for at in self.places(key):
            byte = F.conv(F.hex(F.substring(table, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out & (F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1)
        return out


class Cascade:
    """Exact membership of ``listed`` among ``listed`` and the distinct keys of ``universe`` (DataFrames of ``key``)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, small: bool = False):
        """small: the universe is a short list, which needs no sizing of the first level."""
        store = Scratch(listed.sparkSession, "cascade")
        self.levels: list[Level] = []
        listed = store.table("listed", listed.filter("key IS NOT NULL").distinct())
        n = listed.count()
        if not n:
            store.drop()
            return
        rate = 0.5 if small else min(0.5, n / max(1, universe.agg(F.approx_count_distinct("key")).first()[0]))
        while True:
            first = Level(1, n, rate).encode(listed)
            passed = universe.filter(first.passes(F.col("key"))).distinct()
            wrong = store.table(f"wrong-{rate}", passed.join(listed, "key", "left_anti"))
            if small or wrong.count() <= 4 * n + 64:
                break
            rate /= 16
        self.levels.append(first)
        right, step = listed, 1
        while (n := wrong.count()) > 0:
            step += 1
            level = Level(step, n, 0.5 if step <= 40 else 2.0**-20).encode(wrong)
            self.levels.append(level)
            right, wrong = wrong, store.table(f"level-{step}", right.filter(level.passes(F.col("key"))))
        store.drop()

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            # failing level i+1 decides: an odd level encodes listed keys, an even one strangers
            out = F.when(~self.levels[i].passes(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """verdict, host, path of a list of rules (as a literal) or of a DataFrame of them."""
    if isinstance(rules, DataFrame):
        return rules.select("verdict", "host", "path").dropna()
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.explode(rows.cast("array<struct<verdict:string,host:string,path:string>>")).alias("r")).select("r.*")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict (allow if none fits)."""
    given = rule_table(pages.sparkSession, rules)
    shape = given.agg(F.max(F.size(F.split("host", r"\.", -1))), F.sort_array(F.collect_set(F.char_length("path")))).first()
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("keys", keys_of(F.col("host"), F.col("path"), shape[0] or 1, shape[1] or []))
    names = given.select(F.concat("host", "path").alias("key"), "verdict")
    listed = Cascade(names.select("key"), rows.select(F.explode("keys").alias("key")))
    blocking = Cascade(names.filter("verdict = 'block'").select("key"), names.select("key"), small=True)
    fits = F.filter("keys", listed.has)
    rule = F.aggregate(fits, F.lit(None).cast("string"), lambda best, key: F.when(best.isNull() | (F.char_length(key) > F.char_length(best)), key).otherwise(best))
    rows = rows.withColumn("rule", rule)
    verdict = F.when(F.col("rule").isNotNull() & blocking.has(F.col("rule")), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_FITS = "\n".join(f"       UNION ALL SELECT '{v}', '{h}', '{p}'" for v, h, p in RULES).replace("       UNION ALL ", "", 1)
SQL = rf"""
WITH rules(action, rule_host, rule_path) AS ({_FITS}),
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT p.*, (SELECT arg_max(action || ' ' || rule_host || rule_path, length(rule_host || rule_path)) FROM rules
                   WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best FROM p)
SELECT page_id, host, path, split_part(best, ' ', 2) AS rule, coalesce(split_part(best, ' ', 1), 'allow') AS verdict FROM m
"""
