"""The one table that SELECT reads: a posting with the columns of its entry, and its columns in queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.plans import values as V
from tallyspark.plans.values import Kind, Typed

META = f"array<struct<key:string,value:{V.OBJECT}>>"
ENTRY = {
    "entry_id": "bigint", "date": "date", "type": "string", "flag": "string", "payee": "string", "narration": "string", "tags": "array<string>",
    "links": "array<string>", "filename": "string", "lineno": "bigint", "entry_meta": META, "accounts": "array<string>", "is_valid": "boolean",
}
POSTING = {
    "ord": "bigint", **ENTRY, "account": "string", "posting_flag": "string", "posting_line": "bigint", "number": V.NUMBER, "scale": "int", "currency": "string",
    "cost": V.COST, "price": V.AMOUNT, "posting_meta": META,
}


def completed(df: DataFrame, form: dict[str, str] = POSTING) -> DataFrame:
    """``df`` with all columns of ``form``; those it lacks are empty or NULL."""
    default = {"type": F.lit("transaction"), "tags": F.array(), "links": F.array(), "entry_meta": F.array(), "posting_meta": F.array(), "accounts": F.array("account") if "account" in df.columns else F.array(), "is_valid": F.lit(True), "posting_flag": F.lit(""), "filename": F.lit(""), "lineno": F.lit(0), "posting_line": F.lit(0)}
    if "scale" not in df.columns and "number" in df.columns:
        default["scale"] = V.least_scale(F.col("number").cast(V.NUMBER))
    return df.select(*[(F.col(c) if c in df.columns else default.get(c, F.lit(None))).cast(t).alias(c) for c, t in form.items()])


def position() -> Column:
    cost = F.when(F.col("cost").isNotNull(), F.col("cost").withField("date", F.coalesce("cost.date", "date")))
    return F.when(F.col("number").isNotNull() & F.col("currency").isNotNull(), F.struct("number", "scale", "currency", cost.alias("cost")))


def weight() -> Column:
    """Cost, else price, else units."""
    at_cost = F.struct(V.times(F.col("number"), F.col("cost.number")).alias("number"), (F.col("scale") + F.col("cost.scale")).alias("scale"), F.col("cost.currency").alias("currency"))
    at_price = F.struct(V.times(F.col("number"), F.col("price.number")).alias("number"), (F.col("scale") + F.col("price.scale")).alias("scale"), F.col("price.currency").alias("currency"))
    plain = V.amount(F.col("number"), F.col("scale"), F.col("currency"))
    return F.when(F.col("number").isNull(), None).when(F.col("cost").isNotNull(), at_cost).when(F.col("price").isNotNull(), at_price).otherwise(plain)


def _description() -> Column:
    payee, narration = F.coalesce("payee", F.lit("")), F.coalesce("narration", F.lit(""))
    both = F.when((payee != "") & (narration != ""), F.concat(payee, F.lit(" | "), narration)).otherwise(F.concat(payee, narration))
    return F.when(F.col("type") == "transaction", both)


def _text(name: str) -> Typed:
    return Typed(Kind.STRING, F.col(name))


ENTRY_COLUMNS = {
    "date": lambda: Typed(Kind.DATE, F.col("date")),
    "year": lambda: Typed(Kind.INT, F.year("date").cast("bigint")),
    "month": lambda: Typed(Kind.INT, F.month("date").cast("bigint")),
    "day": lambda: Typed(Kind.INT, F.dayofmonth("date").cast("bigint")),
    "type": lambda: _text("type"),
    "filename": lambda: _text("filename"),
    "lineno": lambda: Typed(Kind.INT, F.col("lineno")),
    "id": lambda: Typed(Kind.STRING, F.md5(F.concat_ws(":", "filename", F.col("lineno").cast("string")))),
    "flag": lambda: _text("flag"),
    "payee": lambda: _text("payee"),
    "narration": lambda: _text("narration"),
    "description": lambda: Typed(Kind.STRING, _description()),
    "tags": lambda: Typed(Kind.SET, F.col("tags")),
    "links": lambda: Typed(Kind.SET, F.col("links")),
}
POSTING_COLUMNS = ENTRY_COLUMNS | {
    "account": lambda: _text("account"),
    "position": lambda: Typed(Kind.POSITION, position()),
    "change": lambda: Typed(Kind.POSITION, position()),
    "balance": lambda: Typed(Kind.INVENTORY, F.col("balance")),
    "number": lambda: Typed(Kind.DECIMAL, F.col("number"), F.col("scale")),
    "currency": lambda: Typed(Kind.STRING, F.when(F.col("number").isNotNull(), F.col("currency"))),
    "cost_number": lambda: Typed(Kind.DECIMAL, F.col("cost.number"), F.col("cost.scale")),
    "cost_currency": lambda: _text("cost.currency"),
    "cost_date": lambda: Typed(Kind.DATE, F.when(F.col("cost").isNotNull(), F.coalesce("cost.date", "date"))),
    "cost_label": lambda: _text("cost.label"),
    "price": lambda: Typed(Kind.AMOUNT, F.col("price")),
    "weight": lambda: Typed(Kind.AMOUNT, weight()),
    "posting_flag": lambda: _text("posting_flag"),
    "other_accounts": lambda: Typed(Kind.SET, F.array_sort(F.array_except("accounts", F.array("account")))),
    "location": lambda: Typed(Kind.STRING, F.concat("filename", F.lit(":"), F.col("posting_line").cast("string"), F.lit(":"))),
}
DEFAULT_COLUMNS = ("date", "flag", "payee", "narration", "position")
