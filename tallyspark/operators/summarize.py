"""OPEN, CLOSE and CLEAR of a stream of postings.

All three are unions of aggregates with the rows themselves. Synthetic postings are numbered below or
above all others, by the account's place among all accounts (the one thing counted in a single task, a row an account)
and the posting's within the account, so that they come first or last in ledger order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.scalars import cost_amount, type_index
from tallyspark.plans import values as V

FIRST, LAST, LOT_BITS = -(1 << 62), 1 << 61, 24


def close(rows: DataFrame, date: dt.date | None) -> DataFrame:
    return rows.filter(F.col("date") < F.lit(date)) if date else rows


def _lots(rows: DataFrame) -> DataFrame:
    held = rows.filter("number IS NOT NULL AND currency IS NOT NULL").groupBy("account", "currency", "cost").agg(F.sum("number").cast(V.NUMBER).alias("number"), F.max("scale").alias("scale"))
    return held.filter("number <> 0")


def _entries(lots: DataFrame, like: DataFrame, date: Column, flag: str, narration: str, equity: str, sign: int, start: int) -> DataFrame:
    """Two-sided transactions, one an account: its lots times ``sign``, and their cost the other way per currency."""
    value = cost_amount(F.struct("number", "scale", "currency", "cost"))
    own = F.struct(F.lit(0).alias("side"), F.col("account").alias("leg"), "currency", "cost", (F.col("number") * sign).cast(V.NUMBER).alias("number"), F.col("scale").cast("int").alias("scale"))
    none = F.lit(None).cast(V.COST).alias("cost")
    other = F.struct(F.lit(1).alias("side"), F.lit(equity).alias("leg"), F.col("v.currency").alias("currency"), none, (F.col("v.number") * -sign).cast(V.NUMBER).alias("number"), F.col("v.scale").cast("int").alias("scale"))
    legs = lots.withColumn("v", value).select("account", F.explode(F.array(own, other)).alias("x")).select("account", "x.*")
    legs = legs.groupBy("account", "side", "leg", "currency", "cost").agg(F.sum("number").cast(V.NUMBER).alias("number"), F.max("scale").alias("scale"))
    order = Window.partitionBy("account").orderBy("side", "currency", "cost.currency", "cost.number", "cost.date", "cost.label")
    accounts = lots.select("account").distinct().withColumn("nth", F.row_number().over(Window.orderBy("account")).cast("bigint"))
    legs = legs.join(accounts, "account")
    made = {
        "ord": F.lit(start) + F.shiftleft("nth", LOT_BITS) + F.row_number().over(order), "entry_id": F.lit(start) + F.col("nth"), "date": date, "type": F.lit("transaction"), "flag": F.lit(flag), "payee": F.lit(""),
        "narration": F.concat(*[F.lit(x) if i % 2 == 0 else F.col("account") for i, x in enumerate(narration.replace("{}", "\0\0").split("\0"))]), "filename": F.lit(""), "lineno": F.lit(0).cast("bigint"), "posting_line": F.lit(0).cast("bigint"),
        "accounts": F.array("account", F.lit(equity)), "account": F.col("leg"), "posting_flag": F.lit(""), "number": F.col("number"), "scale": F.col("scale").cast("int"), "currency": F.col("currency"), "cost": F.col("cost"), "is_valid": F.lit(True),
    }
    empty = {"tags": "array<string>", "links": "array<string>"}
    columns = []
    for field in like.schema.fields:
        if field.name in made:
            c = made[field.name]
        elif field.name in empty:
            c = F.array()
        else:
            c = F.lit(None)
        columns.append(c.cast(field.dataType).alias(field.name))
    return legs.select(*columns)


def open_on(context, rows: DataFrame, date: dt.date) -> DataFrame:
    """What happened before ``date`` as one opening transaction an account; income and expenses as earnings."""
    early = rows.filter(F.col("date") < F.lit(date))
    earnings = F.lit(f"{context.roots[2]}:Earnings:Previous")
    early = early.withColumn("account", F.when(type_index(context, F.col("account")).isin(3, 4), earnings).otherwise(F.col("account")))
    opening = _entries(_lots(early), rows, F.lit(date - dt.timedelta(days=1)), "S", "Opening balance for '{}' (Summarization)", f"{context.roots[2]}:Opening-Balances", 1, FIRST)
    return opening.unionByName(rows.filter(F.col("date") >= F.lit(date)))


def clear(context, rows: DataFrame, last: dt.date | None) -> DataFrame:
    """Income and expenses moved to equity at the last date."""
    if last is None:
        return rows
    flows = _lots(rows.filter(type_index(context, F.col("account")).isin(3, 4)))
    closing = _entries(flows, rows, F.lit(last), "T", "Transfer balance for '{}' (Transfer balance)", f"{context.roots[2]}:Earnings:Current", -1, LAST)
    return rows.unionByName(closing)
