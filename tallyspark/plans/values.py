"""Types of the query language over Spark columns, and their truth, text form, equality and order.

A number keeps its scale (digits after the point as written) beside it, since tolerances and layout
depend on it; a Spark decimal column has one scale for all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "decimal(28,10)"
COST = f"struct<number:{NUMBER},scale:int,currency:string,date:date,label:string>"
AMOUNT = f"struct<number:{NUMBER},scale:int,currency:string>"
POSITION = f"struct<number:{NUMBER},scale:int,currency:string,cost:{COST}>"
INVENTORY = f"array<{POSITION}>"
OBJECT = f"struct<kind:string,s:string,n:{NUMBER},d:date,b:boolean>"


class Kind(Enum):
    ANY = "object"
    BOOL = "bool"
    INT = "int"
    DECIMAL = "Decimal"
    STRING = "str"
    DATE = "date"
    SET = "set"
    AMOUNT = "Amount"
    POSITION = "Position"
    INVENTORY = "Inventory"
    NULL = "NoneType"


SPARK_TYPES = {
    Kind.ANY: OBJECT, Kind.BOOL: "boolean", Kind.INT: "bigint", Kind.DECIMAL: NUMBER, Kind.STRING: "string", Kind.DATE: "date",
    Kind.SET: "array<string>", Kind.AMOUNT: AMOUNT, Kind.POSITION: POSITION, Kind.INVENTORY: INVENTORY, Kind.NULL: "string",
}


@dataclass(frozen=True)
class Typed:
    kind: Kind
    col: Column
    scale: Column | None = None  # of a DECIMAL
    constant: object = None  # the value of a literal


def number(x: Column) -> Column:
    return x.try_cast(NUMBER)


def times(a: Column, b: Column) -> Column:
    """Product without loss: 19 digits with 8 after the point, times 18 with 8."""
    return number(F.try_multiply(a.try_cast("decimal(19,8)"), b.try_cast("decimal(18,8)")))


def rated(a: Column, rate: Column) -> Column:
    return number(F.try_multiply(a.try_cast("decimal(19,8)"), rate.try_cast("decimal(18,10)")))


def over(a: Column, b: Column) -> Column:
    """Quotient; NULL for a zero divisor."""
    return number(F.try_divide(a.cast(NUMBER), b.cast(NUMBER)))


def least_scale(x: Column) -> Column:
    """Digits after the point that a number needs."""
    digits = F.regexp_extract(F.regexp_replace(x.cast("string"), "0+$", ""), r"\.(\d*)$", 1)
    return F.length(digits)


def scale_of(x: Typed) -> Column:
    if x.scale is not None:
        return x.scale
    return least_scale(x.col) if x.kind is Kind.DECIMAL else F.lit(0)


def plain(x: Column, scale: Column | None = None) -> Column:
    """A number as text: without zeros that it doesn't need, or with ``scale`` digits after the point."""
    text = x.cast("string")
    short = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if scale is None:
        return short
    whole, digits = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    return F.when(scale > 0, F.concat(whole, F.lit("."), F.substring(digits, F.lit(1), scale))).otherwise(whole)


def position_text(p: Column) -> Column:
    units = F.concat(plain(p["number"], p["scale"]), F.lit(" "), p["currency"])
    cost = p["cost"]
    label = F.when(F.coalesce(cost["label"], F.lit("")) != "", F.concat(F.lit(', "'), cost["label"], F.lit('"'))).otherwise("")
    held = F.concat(F.lit(" {"), plain(cost["number"], cost["scale"]), F.lit(" "), cost["currency"], F.coalesce(F.concat(F.lit(", "), cost["date"].cast("string")), F.lit("")), label, F.lit("}"))
    return F.when(p["currency"].isNull(), "").otherwise(F.concat(units, F.when(cost.isNotNull(), held).otherwise("")))


def text(x: Typed) -> Column:
    """The value as ``str`` shows it; NULL as empty."""
    match x.kind:
        case Kind.STRING:
            out = x.col
        case Kind.BOOL:
            out = F.when(x.col, "True").when(~x.col, "False")
        case Kind.INT | Kind.DATE:
            out = x.col.cast("string")
        case Kind.DECIMAL:
            out = plain(x.col, scale_of(x))
        case Kind.SET:
            inner = F.array_join(F.transform(F.array_sort(x.col), lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", ")
            out = F.when(F.size(x.col) == 0, "frozenset()").when(x.col.isNotNull(), F.concat(F.lit("frozenset({"), inner, F.lit("})")))
        case Kind.AMOUNT:
            out = F.concat(plain(x.col["number"], x.col["scale"]), F.lit(" "), x.col["currency"])
        case Kind.POSITION:
            out = position_text(x.col)
        case Kind.INVENTORY:
            out = F.array_join(F.transform(x.col, position_text), ", ")
        case Kind.ANY:
            out = x.col["s"]
        case _:
            out = F.lit(None).cast("string")
    return F.coalesce(out, F.lit(""))


def truth(x: Typed) -> Column:
    """NULL, zero and what is empty are false."""
    match x.kind:
        case Kind.BOOL:
            out = x.col
        case Kind.INT | Kind.DECIMAL:
            out = x.col != 0
        case Kind.STRING:
            out = x.col != ""
        case Kind.SET | Kind.INVENTORY:
            out = F.size(x.col) > 0
        case Kind.ANY:
            by = F.when(x.col["kind"] == "bool", x.col["b"]).when(x.col["kind"] == "number", x.col["n"] != 0)
            out = F.coalesce(by, x.col["s"] != "")
        case Kind.NULL:
            return F.lit(False)
        case _:
            out = x.col.isNotNull()
    return F.coalesce(out, F.lit(False))


_NUMERIC = {Kind.INT, Kind.DECIMAL}


def missing(x: Typed) -> Column:
    return F.lit(True) if x.kind is Kind.NULL else x.col.isNull()


def comparable(a: Typed, b: Typed) -> tuple[Column, Column]:
    """Two columns that compare as the values do."""
    if a.kind in _NUMERIC and b.kind in _NUMERIC:
        return a.col, b.col
    if a.kind is b.kind and a.kind in (Kind.STRING, Kind.DATE, Kind.BOOL):
        return a.col, b.col
    return tuple(F.when(~missing(x), text(x)) for x in (a, b))


def equal(a: Typed, b: Typed) -> Column:
    if Kind.NULL in (a.kind, b.kind):
        return missing(a) & missing(b) if a.kind is not b.kind else F.lit(True)
    if Kind.ANY in (a.kind, b.kind) and _NUMERIC & {a.kind, b.kind}:
        n = [x.col["n"] if x.kind is Kind.ANY else x.col for x in (a, b)]
        return n[0].eqNullSafe(n[1])
    x, y = comparable(a, b)
    return x.eqNullSafe(y)


def sort_key(x: Typed) -> Column:
    return x.col if x.kind in (*_NUMERIC, Kind.STRING, Kind.DATE, Kind.BOOL) else F.when(~missing(x), text(x))


def group_key(x: Typed) -> Column:
    """Grouping treats NULL and what shows as nothing alike."""
    if x.kind is Kind.STRING:
        return F.coalesce(x.col, F.lit(""))
    if x.kind in (*_NUMERIC, Kind.DATE, Kind.BOOL):
        return x.col
    return text(x)


def amount(n: Column, scale: Column, currency: Column) -> Column:
    return F.when(n.isNotNull() & currency.isNotNull(), F.struct(number(n).alias("number"), scale.cast("int").alias("scale"), currency.alias("currency")))


def merged(inventory: Column) -> Column:
    """Positions of one currency and cost added up, those of zero left out, in canonical order."""
    key = lambda p: F.struct(p["currency"].alias("currency"), p["cost"].alias("cost"))
    keys = F.array_distinct(F.transform(inventory, key))

    def total(k: Column) -> Column:
        same = F.filter(inventory, lambda p: key(p).eqNullSafe(k))
        n = F.aggregate(same, F.lit(0).cast("decimal(38,10)"), lambda s, p: (s + p["number"]).cast("decimal(38,10)"))
        scale = F.array_max(F.transform(same, lambda p: p["scale"]))
        return F.struct(n.cast(NUMBER).alias("number"), scale.alias("scale"), k["currency"].alias("currency"), k["cost"].alias("cost"))

    return ordered(F.filter(F.transform(keys, total), lambda p: p["number"] != 0))


def ordered(inventory: Column) -> Column:
    """By currency, then cost: none first, cost currency, number, date, label."""
    keyed = F.transform(
        inventory,
        lambda p: F.struct(
            p["currency"].alias("a"), p["cost"]["currency"].alias("b"), p["cost"]["number"].alias("c"), p["cost"]["date"].alias("d"), p["cost"]["label"].alias("e"), p.alias("p"),
        ),
    )
    return F.transform(F.sort_array(keyed), lambda x: x["p"])
