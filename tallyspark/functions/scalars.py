"""Scalar functions: a table of (name, argument kinds) to Column builders, all JVM-side.

The first overload whose kinds fit is taken; a value of kind ``object`` fits any. Unless an overload
takes objects, a NULL argument makes the result NULL.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.language.syntax import QueryError
from tallyspark.plans import values as V
from tallyspark.plans.values import Kind, Typed

S, I, D, DT, A, P, INV, SET, ANY, B = Kind.STRING, Kind.INT, Kind.DECIMAL, Kind.DATE, Kind.AMOUNT, Kind.POSITION, Kind.INVENTORY, Kind.SET, Kind.ANY, Kind.BOOL
TABLE: dict[str, list[tuple[tuple[Kind, ...], Kind, Callable]]] = {}
ROOTS = ("Assets", "Liabilities", "Equity", "Income", "Expenses")


def function(name: str, args: tuple[Kind, ...], result: Kind):
    def add(build):
        TABLE.setdefault(name, []).append((args, result, build))
        return build

    return add


def as_kind(x: Typed, kind: Kind) -> Typed:
    """An object or NULL as the kind that a parameter asks for."""
    if kind is Kind.ANY or x.kind is kind:
        return x
    if x.kind is Kind.NULL:
        return Typed(kind, F.lit(None).cast(V.SPARK_TYPES[kind]))
    got = {Kind.STRING: "s", Kind.DECIMAL: "n", Kind.DATE: "d", Kind.BOOL: "b"}.get(kind)
    return Typed(kind, x.col[got] if got else F.lit(None).cast(V.SPARK_TYPES[kind]))


def call(context, name: str, args: list[Typed], where: str) -> Typed:
    for kinds, result, build in TABLE.get(name, ()):
        if len(kinds) == len(args) and all(k is ANY or a.kind in (k, ANY, Kind.NULL) for k, a in zip(kinds, args, strict=True)):
            given = [as_kind(a, k) for a, k in zip(args, kinds, strict=True)]
            out = build(context, *given)
            if not isinstance(out, Typed):
                out = Typed(result, out)
            need = [a.col.isNotNull() for a, k in zip(given, kinds, strict=True) if k is not ANY]
            if need:
                known = need[0]
                for n in need[1:]:
                    known = known & n
                out = Typed(out.kind, F.when(known, out.col), out.scale)
            return out
    raise QueryError(f"Invalid function '{name}({', '.join(a.kind.value for a in args)})' in {where}.")


# numbers

for _k in (I, D):
    function("abs", (_k,), _k)(lambda c, x: Typed(x.kind, F.abs(x.col), x.scale))
    function("neg", (_k,), _k)(lambda c, x: Typed(x.kind, F.negative(x.col), x.scale))


def _with_number(p: Column, n: Column) -> Column:
    return F.struct(n.cast(V.NUMBER).alias("number"), p["scale"].alias("scale"), p["currency"].alias("currency"), p["cost"].alias("cost"))


def _units_with(p: Column, change: Callable[[Column], Column]) -> Column:
    return _with_number(p, change(p["number"]))


for _name, _change in (("abs", F.abs), ("neg", F.negative)):
    function(_name, (P,), P)(lambda c, x, f=_change: _units_with(x.col, f))
    function(_name, (INV,), INV)(lambda c, x, f=_change: V.merged(F.transform(x.col, lambda p: _units_with(p, f))))
function("neg", (A,), A)(lambda c, x: F.struct(F.negative(x.col["number"]).cast(V.NUMBER).alias("number"), x.col["scale"].alias("scale"), x.col["currency"].alias("currency")))


def _safediv(c, x: Typed, y: Typed) -> Column:
    return F.coalesce(V.over(x.col, y.col), F.lit(0).cast(V.NUMBER))


function("safediv", (D, D), D)(_safediv)
function("safediv", (D, I), D)(_safediv)

# dates

for _name, _part in (("year", F.year), ("month", F.month), ("day", F.dayofmonth)):
    function(_name, (DT,), I)(lambda c, d, f=_part: f(d.col).cast("bigint"))
function("quarter", (DT,), S)(lambda c, d: F.concat(F.date_format(d.col, "yyyy"), F.lit("-Q"), F.quarter(d.col).cast("string")))
function("weekday", (DT,), S)(lambda c, d: F.date_format(d.col, "EEE"))
function("ymonth", (DT,), DT)(lambda c, d: F.trunc(d.col, "MM"))
function("today", (), DT)(lambda c: Typed(DT, F.lit(c.today), constant=c.today))
function("date_add", (DT, I), DT)(lambda c, d, n: F.date_add(d.col, n.col.cast("int")))
function("date_diff", (DT, DT), I)(lambda c, a, b: F.datediff(a.col, b.col).cast("bigint"))


@function("date", (I, I, I), DT)
def _date(c, y, m, d):
    """Months and days out of range run over into their neighbours."""
    start = F.make_date(y.col.cast("int"), F.lit(1), F.lit(1))
    return F.date_add(F.add_months(start, (m.col - 1).cast("int")), (d.col - 1).cast("int"))


@function("date", (S,), DT)
def _parsed_date(c, s):
    return F.when(s.col.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}\z"), F.regexp_replace(s.col, "/", "-").try_cast("date"))


# accounts

function("parent", (S,), S)(lambda c, s: F.regexp_extract(s.col, r"^(.*):", 1))
function("leaf", (S,), S)(lambda c, s: F.substring_index(s.col, ":", -1))


@function("root", (S, I), S)
def _root(c, s, n):
    parts = F.split(s.col, ":")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.least(n.col.cast("int"), F.size(parts)))), ":")


def type_index(context, account: Column) -> Column:
    first = F.substring_index(account, ":", 1)
    out = F.lit(5)
    for i, root in enumerate(context.roots):
        out = F.when(first == root, F.lit(i)).otherwise(out)
    return out


@function("account_sortkey", (S,), S)
def _sortkey(c, s):
    return F.concat(type_index(c, s.col).cast("string"), F.lit("-"), s.col)


for _name, _column in (("open_date", "open"), ("close_date", "close")):
    function(_name, (S,), DT)(lambda c, s, k=_column: c.lookup(c.accounts(), "account", s.col, k))


@function("has_account", (S,), B)
def _has_account(c, pattern):
    test = matcher(pattern)
    return F.exists("accounts", lambda a: test(a))


def _signed(c, n: Column, account: Column) -> Column:
    return F.when(type_index(c, account).isin(1, 2, 3), F.negative(n)).otherwise(n)


function("possign", (D, S), D)(lambda c, x, s: Typed(D, _signed(c, x.col, s.col), x.scale))
function("possign", (A, S), A)(lambda c, x, s: F.struct(_signed(c, x.col["number"], s.col).cast(V.NUMBER).alias("number"), x.col["scale"].alias("scale"), x.col["currency"].alias("currency")))
function("possign", (P, S), P)(lambda c, x, s: _units_with(x.col, lambda n: _signed(c, n, s.col)))
function("possign", (INV, S), INV)(lambda c, x, s: V.merged(F.transform(x.col, lambda p: _units_with(p, lambda n: _signed(c, n, s.col)))))

# amounts, positions, inventories

function("number", (A,), D)(lambda c, x: Typed(D, x.col["number"], x.col["scale"]))
function("currency", (A,), S)(lambda c, x: x.col["currency"])
function("commodity", (A,), S)(lambda c, x: x.col["currency"])


def _bare(p: Column) -> Column:
    return F.struct(p["number"].alias("number"), p["scale"].alias("scale"), p["currency"].alias("currency"), F.lit(None).cast(V.COST).alias("cost"))


def cost_amount(p: Column) -> Column:
    """Units times unit cost; the units without a cost."""
    cost = p["cost"]
    total = F.struct(V.times(p["number"], cost["number"]).alias("number"), F.coalesce(p["scale"] + cost["scale"], F.lit(0)).alias("scale"), cost["currency"].alias("currency"))
    return F.when(cost.isNotNull(), total).otherwise(units_amount(p))


def units_amount(p: Column) -> Column:
    return F.struct(p["number"].alias("number"), p["scale"].alias("scale"), p["currency"].alias("currency"))


def as_position(a: Column) -> Column:
    return F.struct(a["number"].alias("number"), a["scale"].alias("scale"), a["currency"].alias("currency"), F.lit(None).cast(V.COST).alias("cost"))


function("units", (P,), A)(lambda c, x: units_amount(x.col))
function("units", (INV,), INV)(lambda c, x: V.merged(F.transform(x.col, _bare)))
function("cost", (P,), A)(lambda c, x: cost_amount(x.col))
function("cost", (INV,), INV)(lambda c, x: V.merged(F.transform(x.col, lambda p: as_position(cost_amount(p)))))


@function("only", (S, INV), A)
def _only(c, s, inv):
    same = F.filter(inv.col, lambda p: p["currency"] == s.col)
    total = F.aggregate(same, F.lit(0).cast("decimal(38,10)"), lambda t, p: (t + p["number"]).cast("decimal(38,10)"))
    scale = F.coalesce(F.array_max(F.transform(same, lambda p: p["scale"])), F.lit(0))
    return F.struct(total.cast(V.NUMBER).alias("number"), scale.alias("scale"), s.col.alias("currency"))


function("filter_currency", (P, S), P)(lambda c, p, s: F.when(p.col["currency"] == s.col, p.col))
function("filter_currency", (INV, S), INV)(lambda c, v, s: F.filter(v.col, lambda p: p["currency"] == s.col))

# prices


def _today(c) -> Typed:
    return Typed(DT, F.lit(c.today), constant=c.today)


def _rate(rates: Column, base: Column, quote: Column) -> Column:
    return F.when(base == quote, F.lit(1).cast("decimal(18,10)")).otherwise(F.try_element_at(rates, base))


def _converted(rates: Column, a: Column, quote: Column) -> Column:
    rate = _rate(rates, a["currency"], quote)
    n = V.rated(a["number"], rate)
    new = F.struct(n.alias("number"), V.least_scale(n).cast("int").alias("scale"), quote.alias("currency"))
    return F.when((a["currency"] == quote) | rate.isNull(), units_amount(a)).otherwise(new)


def _getprice(c, base, quote, when=None):
    when = when or _today(c)
    return V.number(_rate(c.rates(when, quote), base.col, quote.col))


function("getprice", (S, S), D)(_getprice)
function("getprice", (S, S, DT), D)(_getprice)


def _convert(c, x, quote, when=None):
    rates = c.rates(when or _today(c), quote)
    if x.kind is INV:
        return V.merged(F.transform(x.col, lambda p: F.when((p["currency"] == quote.col) | F.try_element_at(rates, p["currency"]).isNull(), p).otherwise(as_position(_converted(rates, p, quote.col)))))
    return _converted(rates, x.col, quote.col)


for _k, _r in ((A, A), (P, A), (INV, INV)):
    function("convert", (_k, S), _r)(_convert)
    function("convert", (_k, S, DT), _r)(_convert)


def _value(c, x, when=None):
    """At the market, in the currency of the cost; without cost the units."""
    rates = c.rates(when or _today(c), None)

    def one(p: Column) -> Column:
        quote = p["cost"]["currency"]
        there = F.coalesce(F.try_element_at(rates, quote), F.create_map().cast("map<string,decimal(18,10)>"))
        return F.when(p["cost"].isNull(), units_amount(p)).otherwise(_converted(there, p, quote))

    return V.merged(F.transform(x.col, lambda p: as_position(one(p)))) if x.kind is INV else one(x.col)


for _k, _r in ((P, A), (INV, INV)):
    function("value", (_k,), _r)(_value)
    function("value", (_k, DT), _r)(_value)

# text

function("str", (ANY,), S)(lambda c, x: V.text(x))
function("length", (S,), I)(lambda c, s: F.octet_length(s.col).cast("bigint"))
function("length", (SET,), I)(lambda c, s: F.size(s.col).cast("bigint"))
function("upper", (S,), S)(lambda c, s: F.upper(s.col))
function("lower", (S,), S)(lambda c, s: F.lower(s.col))
function("joinstr", (SET,), S)(lambda c, s: F.array_join(F.array_sort(s.col), ","))
function("coalesce", (ANY, ANY), ANY)(lambda c, a, b: Typed(a.kind if a.kind is b.kind or b.kind is Kind.NULL else b.kind if a.kind is Kind.NULL else ANY, F.coalesce(*[x.col if a.kind is b.kind or Kind.NULL in (a.kind, b.kind) else as_object(x) for x in (a, b)])))


def as_object(x: Typed) -> Column:
    if x.kind is ANY:
        return x.col
    kind = {S: "string", I: "number", D: "number", DT: "date", B: "bool"}.get(x.kind, "string")
    made = F.struct(
        F.lit(kind).alias("kind"), V.text(x).alias("s"), (V.number(x.col) if kind == "number" else F.lit(None).cast(V.NUMBER)).alias("n"),
        (x.col if kind == "date" else F.lit(None).cast("date")).alias("d"), (x.col if kind == "bool" else F.lit(None).cast("boolean")).alias("b"),
    )
    return F.when(~V.missing(x), made).cast(V.OBJECT)


@function("maxwidth", (S, I), S)
def _maxwidth(c, s, n):
    """Whole words while they and ' [...]' fit, counted in bytes."""
    words = F.filter(F.split(s.col, r"[\s]+"), lambda w: w != "")
    whole = F.array_join(words, " ")
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("done"))

    def add(state, word):
        longer = F.when(state["out"] == "", word).otherwise(F.concat(state["out"], F.lit(" "), word))
        done = state["done"] | (F.octet_length(longer) + 6 > n.col)
        return F.struct(F.when(done, state["out"]).otherwise(longer).alias("out"), done.alias("done"))

    short = F.aggregate(words, start, add, lambda state: F.when(state["out"] == "", "[...]").otherwise(F.concat(state["out"], F.lit(" [...]"))))
    return F.when(F.octet_length(whole) <= n.col, whole).otherwise(short)


# patterns


def java_pattern(pattern: str) -> str | None:
    """A pattern as Java reads it; None if it is not valid."""
    try:
        re.compile(re.sub(r"\(\?P?<([A-Za-z_])", r"(?P<\1", pattern))
    except re.error:
        return None
    out = re.sub(r"\(\?P<", "(?<", pattern)
    return re.sub(r"(\\.|\[[^\]]*\])|\$", lambda m: m[1] or r"\z", out)


def matcher(pattern: Typed) -> Callable[[Column], Column]:
    if isinstance(pattern.constant, str):
        java = java_pattern(pattern.constant)
        return lambda x: F.coalesce(x.rlike(java), F.lit(False)) if java is not None else F.lit(False)
    return lambda x: F.coalesce(F.rlike(x, F.regexp_replace(pattern.col, r"\(\?P<", "(?<")), F.lit(False))


def _dynamic(pattern: Typed) -> Column:
    """A pattern that differs from row to row: named groups are adapted, all else must mean the same to Java; what Java
    refuses is an error."""
    return F.regexp_replace(pattern.col, r"\(\?P<", "(?<")


@function("grep", (S, S), S)
def _grep(c, pattern, s):
    if not isinstance(pattern.constant, str):
        return F.nullif(F.call_function("regexp_extract", s.col, F.concat(F.lit("("), _dynamic(pattern), F.lit(")")), F.lit(1)), F.lit(""))
    java = java_pattern(pattern.constant)
    return F.nullif(F.regexp_extract(s.col, f"({java})", 1), F.lit("")) if java is not None else F.lit(None).cast("string")


@function("grepn", (S, S, I), S)
def _grepn(c, pattern, s, n):
    if not isinstance(pattern.constant, str):
        found = F.call_function("regexp_extract", s.col, _dynamic(pattern), n.col.cast("int"))
        return F.when(F.rlike(s.col, _dynamic(pattern)), found)
    java = java_pattern(pattern.constant)
    if java is None or not isinstance(n.constant, int) or not 0 <= n.constant <= re.compile(re.sub(r"\(\?<([A-Za-z_])", r"(?P<\1", java).replace(r"\z", "$")).groups:
        return F.lit(None).cast("string")
    return F.when(s.col.rlike(java), F.regexp_extract(s.col, java, n.constant))


@function("subst", (S, S, S), S)
def _subst(c, pattern, replacement, s):
    """Templates name groups as $1 or ${name}; a name is as long as it can be."""
    if not isinstance(pattern.constant, str) or not isinstance(replacement.constant, str):
        template = F.replace(replacement.col, F.lit("\\"), F.lit("\\\\"))
        java = java_pattern(pattern.constant) if isinstance(pattern.constant, str) else None
        return F.regexp_replace(s.col, F.lit(java) if java is not None else _dynamic(pattern), template)
    java = java_pattern(pattern.constant)
    if java is None:
        return s.col
    groups = re.compile(re.sub(r"\(\?<([A-Za-z_])", r"(?P<\1", java).replace(r"\z", "$"))

    def one(m):
        name = m[1] or m[2]
        if m[0] == "$$":
            return r"\$"
        if name.isdigit():
            return f"${name}" if int(name) <= groups.groups else ""
        return f"${groups.groupindex[name]}" if name in groups.groupindex else ""

    template = re.sub(r"\$\$|\$(?:\{(\w+)\}|(\w+))", one, replacement.constant.replace("\\", "\\\\"))
    return F.regexp_replace(s.col, java, template)


@function("findfirst", (S, SET), S)
def _findfirst(c, pattern, values):
    test = matcher(pattern)
    return F.get(F.filter(F.array_sort(values.col), lambda v: test(v)), F.lit(0))


def _meta(columns: tuple[str, ...]):
    def build(c, key):
        found = [F.get(F.filter(F.col(m), lambda e: e["key"] == key.col), F.lit(0))["value"] for m in columns]
        return F.coalesce(*found)

    return build


function("meta", (S,), ANY)(_meta(("posting_meta",)))
function("entry_meta", (S,), ANY)(_meta(("entry_meta",)))
function("any_meta", (S,), ANY)(_meta(("posting_meta", "entry_meta")))
