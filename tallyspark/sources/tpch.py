"""A ledger over order tables: every line item is a balanced transaction of two postings.

The number of a posting comes from its order's date (16 bits of days), key (40 bits) and its place within the order
(6 bits), so that it needs no global sort and is the same however often it is computed; a key or place beyond
that is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.ledger import Ledger
from tallyspark.plans import values as V
from tallyspark.plans.rows import META

MONEY = "decimal(18,2)"
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CAD")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def entries(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer, nation = (read(spark, folder, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    flag = F.when(F.col("o_orderstatus") == "F", "*").when(F.col("o_orderstatus") == "O", "!").otherwise("P")
    return joined.select(
        F.col("o_orderkey").cast("bigint").alias("entry_id"), F.col("o_orderdate").cast("date").alias("date"), F.lit("transaction").alias("type"), flag.alias("flag"),
        F.col("c_name").alias("payee"), F.col("o_orderpriority").alias("narration"), F.col("c_mktsegment").alias("segment"), F.col("n_regionkey").alias("regionkey"),
    )


def postings(spark: SparkSession, folder: str) -> DataFrame:
    lineitem, part = read(spark, folder, "lineitem"), read(spark, folder, "part")
    lines = lineitem.join(entries(spark, folder), F.col("l_orderkey") == F.col("entry_id"))
    own = Window.partitionBy("entry_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = lines.withColumn("nth", F.row_number().over(own)).join(part, F.col("l_partkey") == F.col("p_partkey"))
    cash, spent = F.concat(F.lit("Assets:"), "segment"), F.concat_ws(":", F.lit("Expenses"), "p_type", "p_brand")
    n = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).cast(MONEY)
    currency = F.element_at(F.array(*map(F.lit, CURRENCIES)), F.least(F.col("regionkey"), F.lit(4)).cast("int") + 1)
    fits = F.col("entry_id").between(0, (1 << 40) - 1) & (F.col("nth") <= 31) & F.datediff("date", F.lit("1970-01-01")).between(-(1 << 15), (1 << 15) - 1)
    base = F.shiftleft(F.datediff("date", F.lit("1970-01-01")).cast("bigint"), 46) + F.shiftleft(F.col("entry_id"), 6) + F.col("nth") * 2
    base = F.when(fits, base).otherwise(F.raise_error(F.lit("an order's key, date or number of lines is out of range")).cast("bigint"))
    lines = lines.select("entry_id", "date", "type", "flag", "payee", "narration", n.alias("n"), currency.alias("currency"), base.alias("base"), cash.alias("cash"), spent.alias("spent"))
    legs = F.array(F.struct(F.col("base").alias("ord"), F.col("spent").alias("account"), F.col("n").alias("number")), F.struct((F.col("base") + 1).alias("ord"), F.col("cash").alias("account"), (-F.col("n")).cast(MONEY).alias("number")))
    return lines.select("entry_id", "date", "type", "flag", "payee", "narration", "currency", F.array("spent", "cash").alias("accounts"), F.lit(2).alias("scale"), F.explode(legs).alias("leg")).select("*", "leg.*").drop("leg")


def prices(spark: SparkSession, folder: str) -> DataFrame:
    events = read(spark, folder, "events").filter("value > 0")
    return events.select(F.col("ts").cast("date").alias("date"), F.upper("event_type").alias("base"), F.lit("USD").alias("quote"), F.col("value").cast(MONEY).cast("decimal(28,10)").alias("rate"), F.col("event_id").cast("bigint").alias("ord")).filter("rate <> 0")


def lots(spark: SparkSession, folder: str) -> DataFrame:
    """Holdings bought by users: units with a cost, and the event's properties as metadata."""
    events = read(spark, folder, "events")
    cost = F.struct(F.col("value").cast(MONEY).cast(V.NUMBER).alias("number"), F.lit(2).alias("scale"), F.lit("USD").alias("currency"), F.col("ts").cast("date").alias("date"), F.lit(None).cast("string").alias("label"))
    k = F.get_json_object("props", "$.k")
    meta = F.when(k.isNotNull(), F.array(F.struct(F.lit("k").alias("key"), F.struct(F.lit("number").alias("kind"), k.alias("s"), k.try_cast(V.NUMBER).alias("n"), F.lit(None).cast("date").alias("d"), F.lit(None).cast("boolean").alias("b")).alias("value")))).otherwise(F.array()).cast(META)
    return events.select(
        F.col("event_id").cast("bigint").alias("ord"), F.col("event_id").cast("bigint").alias("entry_id"), F.col("ts").cast("date").alias("date"), F.concat(F.lit("Assets:User:"), F.col("user_id").cast("string")).alias("account"),
        F.upper("event_type").alias("currency"), (F.lit(1) + F.col("event_id") % 7).cast(V.NUMBER).alias("number"), F.lit(0).alias("scale"), cost.alias("cost"), meta.alias("posting_meta"), F.lit("*").alias("flag"),
    )


def ledger(spark: SparkSession, folder: str) -> Ledger:
    return Ledger.of(postings(spark, folder), prices(spark, folder))


def lot_ledger(spark: SparkSession, folder: str) -> Ledger:
    return Ledger.of(lots(spark, folder), prices(spark, folder))
