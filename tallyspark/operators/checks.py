"""Ledger checks as relational passes over posting tables, for ledgers too large for one ordered fold."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.plans import values as V
from tallyspark.plans.rows import weight


def weights(postings: DataFrame) -> DataFrame:
    """entry_id, currency, weight: what each entry's postings come to, by the currency they weigh in."""
    return postings.select("entry_id", weight().alias("w")).filter("w IS NOT NULL").groupBy("entry_id", "w.currency").agg(F.sum("w.number").alias("weight"))


def tolerances(postings: DataFrame, multiplier: Decimal = Decimal("0.5")) -> DataFrame:
    """entry_id, currency, tolerance from the digits of the entry's units; integers give none."""
    unit = F.element_at(F.array(*[F.lit(str(Decimal(1).scaleb(-i) * multiplier)).cast(V.NUMBER) for i in range(1, 11)]), F.col("scale"))
    return postings.filter("scale > 0").groupBy("entry_id", "currency").agg(F.max(unit).alias("tolerance"))


def unbalanced(postings: DataFrame, multiplier: Decimal = Decimal("0.5")) -> DataFrame:
    """entry_id, currency, weight of what exceeds its tolerance."""
    w, t = weights(postings), tolerances(postings, multiplier)
    return w.join(t, ["entry_id", "currency"], "left").filter(F.abs("weight") > F.coalesce("tolerance", F.lit(0))).select("entry_id", "currency", "weight")


def outside_lifetime(postings: DataFrame, accounts: DataFrame) -> DataFrame:
    """Postings on accounts that are not open (unknown, too early, or after the close)."""
    spans = accounts.select(F.col("account").alias("name"), "open", "close")
    joined = postings.join(spans, F.col("account") == F.col("name"), "left")
    bad = F.col("open").isNull() | (F.col("date") < F.col("open")) | (F.col("date") > F.coalesce("close", F.col("date")))
    return joined.filter(bad).select(*postings.columns)


def asserted(postings: DataFrame, assertions: DataFrame) -> DataFrame:
    """assertions: account, currency, date, number. Adds ``held`` at the start of the day: one pass over the
    union of daily sums and assertions, no range join."""
    daily = postings.filter("is_valid AND number IS NOT NULL").groupBy("account", "currency", "date").agg(F.sum("number").alias("change"))
    both = daily.select("account", "currency", "date", "change", F.lit(None).cast(V.NUMBER).alias("number"), F.lit(1).alias("kind"))
    both = both.unionByName(assertions.select("account", "currency", "date", F.lit(None).cast("decimal(38,10)").alias("change"), F.col("number").cast(V.NUMBER).alias("number"), F.lit(0).alias("kind")))
    before = Window.partitionBy("account", "currency").orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("held", F.coalesce(F.sum("change").over(before), F.lit(0)))
    return held.filter("kind = 0").select("account", "currency", "date", "number", "held")


def padded(postings: DataFrame, pads: DataFrame, assertions: DataFrame) -> DataFrame:
    """pads: account, source, date. What each pad must add so that the first assertion after it holds."""
    due = asserted(postings, assertions).withColumn("lacking", F.col("number") - F.col("held"))
    events = due.select("account", "currency", "date", "lacking", F.lit(None).cast("string").alias("source"), F.lit(None).cast("date").alias("padded"))
    currencies = due.select("account", "currency").distinct()
    starts = pads.join(currencies, "account").select("account", "currency", "date", F.lit(None).cast("decimal(38,10)").alias("lacking"), "source", F.col("date").alias("padded"))
    order = Window.partitionBy("account", "currency").orderBy("date", F.col("lacking").isNull().desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = events.unionByName(starts)
    rows = rows.withColumn("source", F.coalesce("source", F.last("source", ignorenulls=True).over(order))).withColumn("last_pad", F.last("padded", ignorenulls=True).over(order))
    hits = rows.filter("lacking IS NOT NULL AND last_pad < date")
    first = hits.withColumn("nth", F.row_number().over(Window.partitionBy("account", "currency", "last_pad").orderBy("date"))).filter("nth = 1 AND lacking <> 0")
    return first.select(F.col("last_pad").alias("date"), "account", "source", "currency", F.col("lacking").alias("number"))


def held_by_rule(lots: DataFrame, sales: DataFrame, method: str = "FIFO") -> DataFrame:
    """Which lots the sales of a key take, oldest (or newest) first.

    lots: key, ord, units, cost; sales: key, ord, units. Both sides become stretches of one running total
    per key, and a sale takes the lots whose stretches overlap its own: key, sale, lot, units, cost.
    It holds for sales that come after all lots of their key; others need the ordered fold of ``processing``.
    """
    down = method == "LIFO"
    by = Window.partitionBy("key").orderBy(F.col("ord").desc() if down else F.col("ord")).rowsBetween(Window.unboundedPreceding, 0)
    sold = Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    a = lots.select("key", F.col("ord").alias("lot"), "cost", F.sum("units").over(by).alias("to"), "units").withColumn("from", F.col("to") - F.col("units")).drop("units")
    b = sales.select("key", F.col("ord").alias("sale"), F.sum("units").over(sold).alias("sold_to"), "units").withColumn("sold_from", F.col("sold_to") - F.col("units")).drop("units")
    both = a.join(b, "key").filter((F.col("from") < F.col("sold_to")) & (F.col("sold_from") < F.col("to")))
    return both.select("key", "sale", "lot", (F.least("to", "sold_to") - F.greatest("from", "sold_from")).alias("units"), "cost")
