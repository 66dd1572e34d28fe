"""From a parsed SELECT to one plan: transforms, filters, grouping, order, DISTINCT and LIMIT."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import scalars
from tallyspark.functions.scalars import as_kind
from tallyspark.language import syntax as Q
from tallyspark.language.syntax import QueryError
from tallyspark.operators import inventory, lots, summarize
from tallyspark.plans import rows as R
from tallyspark.plans import values as V
from tallyspark.plans.values import Kind, Typed

AGGREGATES = {"count", "first", "last", "min", "max", "sum"}
INVENTORIES = (Kind.AMOUNT, Kind.POSITION, Kind.INVENTORY)
_MAP = "map<string,decimal(18,10)>"


class Context:
    """What functions see beside their arguments: roots, today, accounts and prices; and the joins they ask for."""

    def __init__(self, ledger, today: dt.date):
        self.ledger, self.today, self.roots = ledger, today, ledger.roots
        self.pending: list[tuple[str, DataFrame, Column]] = []
        self.rows: DataFrame | None = None
        self.count = 0

    def accounts(self) -> DataFrame:
        return self.ledger.accounts

    def lookup(self, table: DataFrame, key: str, at: Column, value: str) -> Column:
        name = f"__l{self.count}"
        self.count += 1
        self.pending.append((name, table.select(F.col(key).alias(f"{name}k"), F.col(value).alias(name)), at))
        return F.col(name)

    def apply(self, rows: DataFrame) -> DataFrame:
        for name, table, at in self.pending:
            rows = rows.withColumn(f"{name}a", at)
            rows = rows.join(table, F.col(f"{name}a") == F.col(f"{name}k"), "left").drop(f"{name}a", f"{name}k")
        self.pending = []
        return rows

    def rates(self, when: Typed, quote: Typed | None) -> Column:
        """Map of currencies to their rates in ``quote`` (None: map of quotes to such maps)."""
        if isinstance(when.constant, dt.date):
            by: dict[str, dict[str, object]] = {}
            for (source, target), rate in self.ledger.price_book.at(when.constant).items():
                by.setdefault(target, {})[source] = rate
            one = lambda rates: F.create_map(*[x for k, r in rates.items() for x in (F.lit(k), F.lit(str(round(r, 10))).try_cast("decimal(18,10)"))]).cast(_MAP)
            if quote is not None and isinstance(quote.constant, str):
                return one(by.get(quote.constant, {}))
            every = F.create_map(*[x for k, rates in by.items() for x in (F.lit(k), one(rates))]).cast(f"map<string,{_MAP}>")
        else:
            if self.rows is None:
                raise QueryError("the date of a conversion of aggregates must be a constant")
            dates = self.rows.select(when.col.alias("date"))
            if quote is not None and isinstance(quote.constant, str):
                found = self.lookup(self.ledger.price_book.to_quote(dates, quote.constant), "date", when.col, "rates")
                return F.coalesce(found, F.create_map().cast(_MAP))
            every = self.lookup(self.ledger.price_book.by_date(dates), "date", when.col, "rates")
        if quote is None:
            return F.coalesce(every, F.create_map().cast(f"map<string,{_MAP}>"))
        return F.coalesce(F.try_element_at(every, quote.col), F.create_map().cast(_MAP))


@dataclass
class Planned:
    name: str
    value: Typed
    key: str
    hidden: bool = False
    aggregate: bool = False


@dataclass
class Result:
    """names, kinds and ordered rows; ``df`` has the visible columns, ``detailed`` also the scales of numbers."""

    names: list[str]
    kinds: list[Kind]
    detailed: DataFrame

    @property
    def df(self) -> DataFrame:
        seen: dict[str, int] = {}
        out = []
        for i, name in enumerate(self.names):
            seen[name] = seen.get(name, 0) + 1
            out.append(F.col(f"__t{i}").alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
        return self.detailed.select(*out)


def has_aggregate(expr) -> bool:
    match expr:
        case Q.Call(func, args):
            return func in AGGREGATES or any(map(has_aggregate, args))
        case Q.Unary(_, arg):
            return has_aggregate(arg)
        case Q.Binary(_, left, right):
            return has_aggregate(left) or has_aggregate(right)
    return False


def _binary(op: str, a: Typed, b: Typed) -> Typed:
    if op in ("and", "or"):
        x, y = V.truth(a), V.truth(b)
        return Typed(Kind.BOOL, x & y if op == "and" else x | y)
    if op in ("=", "!="):
        same = V.equal(a, b)
        return Typed(Kind.BOOL, same if op == "=" else ~same)
    if op in ("<", "<=", ">", ">="):
        if Kind.NULL in (a.kind, b.kind):
            return Typed(Kind.BOOL, F.lit(False))
        x, y = V.comparable(a, b)
        out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return Typed(Kind.BOOL, F.coalesce(out, F.lit(False)))
    if op == "~":
        if a.kind not in (Kind.STRING, Kind.ANY) or b.kind not in (Kind.STRING, Kind.ANY):
            return Typed(Kind.BOOL, F.lit(False))
        return Typed(Kind.BOOL, scalars.matcher(as_kind(b, Kind.STRING))(as_kind(a, Kind.STRING).col))
    if op == "in":
        if b.kind is not Kind.SET or a.kind not in (Kind.STRING, Kind.ANY):
            return Typed(Kind.BOOL, F.lit(False))
        return Typed(Kind.BOOL, F.coalesce(F.array_contains(b.col, as_kind(a, Kind.STRING).col), F.lit(False)))
    a, b = (as_kind(x, Kind.DECIMAL) if x.kind is Kind.ANY else x for x in (a, b))
    numeric = {a.kind, b.kind} <= {Kind.INT, Kind.DECIMAL}
    if not numeric:
        return Typed(Kind.DECIMAL if op == "/" or Kind.DECIMAL in (a.kind, b.kind) else Kind.INT, F.lit(None).cast(V.NUMBER if op == "/" or Kind.DECIMAL in (a.kind, b.kind) else "bigint"))
    if op == "/":
        return Typed(Kind.DECIMAL, V.over(a.col, b.col))
    if a.kind is b.kind is Kind.INT:
        return Typed(Kind.INT, {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a.col, b.col))
    if op == "*":
        return Typed(Kind.DECIMAL, V.times(a.col, b.col), V.scale_of(a) + V.scale_of(b))
    out = (F.try_add if op == "+" else F.try_subtract)(a.col.cast(V.NUMBER), b.col.cast(V.NUMBER))
    return Typed(Kind.DECIMAL, V.number(out), F.greatest(V.scale_of(a), V.scale_of(b)))


@dataclass
class Planner:
    ledger: object
    today: dt.date
    aggregates: list[tuple[str, str, Typed]] = field(default_factory=list)  # name, function, argument
    uses_balance: bool = False

    def __post_init__(self):
        self.context = Context(self.ledger, self.today)
        self.later: list[tuple[str, DataFrame, Column]] = []  # joins on groups

    # expressions

    def literal(self, value) -> Typed:
        kind = {str: Kind.STRING, bool: Kind.BOOL, int: Kind.INT, dt.date: Kind.DATE, type(None): Kind.NULL}.get(type(value), Kind.DECIMAL)
        if kind is Kind.DECIMAL:
            return Typed(kind, F.lit(str(value)).cast(V.NUMBER), F.lit(max(0, -value.as_tuple().exponent)), value)
        return Typed(kind, F.lit(value).cast(V.SPARK_TYPES[kind]), constant=value)

    def expression(self, expr, columns: dict, where: str) -> Typed:
        """A value from the columns of a row; aggregates are not allowed."""
        match expr:
            case Q.Literal(value):
                return self.literal(value)
            case Q.Name(text):
                if text not in columns:
                    raise QueryError(f"Invalid column name '{text}' in {where}.")
                self.uses_balance |= text == "balance"
                return columns[text]()
            case Q.Call(func, args):
                if func in AGGREGATES:
                    raise QueryError("Aggregates are disallowed in this context.")
                if func not in scalars.TABLE:
                    raise QueryError(f"Invalid function '{func}({', '.join(map(_shown, args))})' in {where}.")
                return scalars.call(self.context, func, [self.expression(a, columns, where) for a in args], where)
            case Q.Unary(op, arg):
                return self.unary(op, self.expression(arg, columns, where))
            case Q.Binary(op, left, right):
                return _binary(op, self.expression(left, columns, where), self.expression(right, columns, where))
        raise QueryError("unsupported expression")

    @staticmethod
    def unary(op: str, x: Typed) -> Typed:
        if op == "not":
            return Typed(Kind.BOOL, ~V.truth(x))
        if op == "+":
            return x
        x = as_kind(x, Kind.DECIMAL) if x.kind is Kind.ANY else x
        if x.kind not in (Kind.INT, Kind.DECIMAL):
            return Typed(x.kind, F.lit(None).cast(V.SPARK_TYPES[x.kind]))
        constant = -x.constant if x.constant is not None else None
        return Typed(x.kind, F.negative(x.col), x.scale, constant)

    def grouped(self, expr, where: str) -> Typed:
        """A value of a group; what is not aggregated is taken from the group's first row."""
        if isinstance(expr, Q.Literal):
            return self.literal(expr.value)
        if isinstance(expr, Q.Call) and expr.func in AGGREGATES:
            if len(expr.args) != 1:
                raise QueryError(f"Aggregate function '{expr.func}' takes exactly one argument.")
            return self.aggregate(expr.func, self.expression(expr.args[0], R.POSTING_COLUMNS, where), where)
        if not has_aggregate(expr):
            return self.aggregate("first", self.expression(expr, R.POSTING_COLUMNS, where), where)
        match expr:
            case Q.Call(func, args):
                given = [self.grouped(a, where) for a in args]
                pending, rows = self.context.pending, self.context.rows
                self.context.pending, self.context.rows = self.later, None
                try:
                    return scalars.call(self.context, func, given, where)
                finally:
                    self.context.pending, self.context.rows = pending, rows
            case Q.Unary(op, arg):
                return self.unary(op, self.grouped(arg, where))
            case Q.Binary(op, left, right):
                return _binary(op, self.grouped(left, where), self.grouped(right, where))
        raise QueryError("unsupported expression")

    def aggregate(self, func: str, x: Typed, where: str) -> Typed:
        name = f"__a{len(self.aggregates)}"
        kind = x.kind
        if func == "count":
            kind = Kind.INT
        elif func == "sum":
            if kind not in (Kind.INT, Kind.DECIMAL, Kind.ANY, *INVENTORIES):
                raise QueryError(f"Invalid function 'sum({kind.value})' in {where}.")
            kind = Kind.INVENTORY if kind in INVENTORIES else Kind.DECIMAL if kind is Kind.ANY else kind
        self.aggregates.append((name, func, x))
        return Typed(kind, F.col(name), F.col(f"{name}s") if kind is Kind.DECIMAL else None)

    # rows

    def rows(self, source: Q.Source | None) -> DataFrame:
        rows, source = self.ledger.postings, source or Q.Source()
        if source.open_on:
            rows = summarize.open_on(self.context, self.dated(rows), source.open_on)
        rows = summarize.close(rows, source.close_on)
        if source.clear:
            rows = summarize.clear(self.context, self.dated(rows), self.ledger.last_date(source.close_on))
        if source.where is not None:
            self.context.rows = rows
            keep = V.truth(self.expression(source.where, R.ENTRY_COLUMNS, "FROM clause"))
            rows = self.context.apply(rows).filter(keep).select(*rows.columns)
        return self.dated(rows)

    def dated(self, rows: DataFrame) -> DataFrame:
        return lots.inherited_dates(rows) if self.ledger.has_undated_costs else rows

    def select(self, query: Q.Select) -> Result:
        where = "targets/column context"
        if query.pivot_by:
            for item in query.pivot_by:
                if not isinstance(item, Q.Literal):
                    self.expression(item, R.POSTING_COLUMNS, where)
        rows = self.rows(query.source)
        self.context.rows = rows
        keep = None
        if query.where is not None:
            if has_aggregate(query.where):
                raise QueryError("Aggregates are disallowed in WHERE clause.")
            keep = V.truth(self.expression(query.where, R.POSTING_COLUMNS, "WHERE clause"))
        exprs = [(Q.Name(c), None) for c in R.DEFAULT_COLUMNS] if query.targets is None else [(t.expr, t.alias) for t in query.targets]
        items = [(e, a or Q.derived_name(e), Q.derived_name(e)) for e, a in exprs]
        grouping = bool(query.group_by) or any(has_aggregate(e) for e, _, _ in items) or any(map(has_aggregate, query.order_by))
        visible = len(items)
        group_at = [self.resolve(i, items, visible) for i in query.group_by]
        if any(has_aggregate(items[i][0]) for i in group_at):
            raise QueryError("GROUP-BY expressions may not be aggregates.")
        if grouping and not query.group_by:
            group_at = [i for i in range(visible) if not has_aggregate(items[i][0])]
        order_at = [self.resolve(i, items, visible) for i in query.order_by]
        if grouping:
            lacking = [f'"{items[i][1]}"' for i in range(visible) if i not in group_at and not has_aggregate(items[i][0])]
            if lacking:
                raise QueryError(f"All non-aggregates must be covered by GROUP-BY clause in aggregate query; the following targets are missing: {','.join(lacking)}.")
        if query.pivot_by:
            raise QueryError("The PIVOT BY clause is not supported yet.")
        values = self.group_values(items, group_at, where) if grouping else [self.expression(e, R.POSTING_COLUMNS, where) for e, _, _ in items]
        needed = self.uses_balance
        rows = self.context.apply(rows)
        if keep is not None:
            rows = rows.filter(keep)
        if needed:
            rows = inventory.running(rows, R.position(), "balance")
        if grouping:
            rows = self.grouped_rows(rows, group_at)
            self.context.pending = self.later
        return self.finish(rows, items, values, visible, order_at, query)

    def resolve(self, item, items: list, visible: int) -> int:
        """Number of the target an item of a clause means; others become hidden targets."""
        if isinstance(item, Q.Literal) and type(item.value) is int:
            if not 1 <= item.value <= visible:
                raise QueryError(f"Invalid GROUP-BY column index {item.value}")
            return item.value - 1
        if isinstance(item, Q.Name):
            for i in range(visible):
                if items[i][1] == item.text:
                    return i
        key = Q.derived_name(item)
        for i, (_, _, other) in enumerate(items):
            if other == key:
                return i
        items.append((item, key, key))
        return len(items) - 1

    def group_values(self, items: list, group_at: list[int], where: str) -> list[Typed]:
        self.keys: list[Typed] = []
        out = []
        for i, (expr, _, _) in enumerate(items):
            if i in group_at:
                self.keys.append(self.expression(expr, R.POSTING_COLUMNS, where))
                out.append(self.aggregate("first", self.keys[-1], where))
            else:
                out.append(self.grouped(expr, where))
        return out

    def grouped_rows(self, rows: DataFrame, group_at: list[int]) -> DataFrame:
        names = [f"__k{i}" for i in range(len(self.keys))] or ["__k0"]
        keyed = [V.group_key(k).alias(n) for k, n in zip(self.keys, names, strict=False)] or [F.lit(1).alias("__k0")]
        plain, sums = [], []
        for name, func, x in self.aggregates:
            if func == "sum" and x.kind in INVENTORIES:
                sums.append((name, x))
            else:
                plain += self.aggregation(name, func, x)
        arguments = [inventory.positions_of(x).alias(f"{name}p") for name, x in sums]
        base = rows.select("*", *keyed, *arguments)
        branches = [inventory.summed(base, names, f"{name}p", name) for name, _ in sums]
        if plain or not branches:
            out = base.groupBy(*names).agg(*plain, F.min("ord").alias("__first"))
        else:
            out, branches = branches[0], branches[1:]
        for branch in branches:
            branch = branch.drop("__first").select(*[F.col(n).alias(f"{n}r") for n in names], *[c for c in branch.columns if c.startswith("__a")])
            on = F.lit(True)
            for n in names:
                on = on & F.col(n).eqNullSafe(F.col(f"{n}r"))
            out = out.join(branch, on).drop(*[f"{n}r" for n in names])
        return out.withColumnRenamed("__first", "ord")

    def aggregation(self, name: str, func: str, x: Typed) -> list[Column]:
        col, scale = x.col, V.scale_of(x) if x.kind is Kind.DECIMAL else F.lit(0)
        if func == "count":
            return [F.count(F.lit(1)).alias(name)]
        if func in ("first", "last"):
            pick = F.min_by if func == "first" else F.max_by
            out = [pick(col, "ord").alias(name)]
            return [*out, pick(scale, F.col("ord")).alias(f"{name}s")] if x.kind is Kind.DECIMAL else out
        if func == "sum":
            n = col["n"] if x.kind is Kind.ANY else col
            if x.kind is Kind.INT:
                return [F.coalesce(F.sum(n), F.lit(0)).alias(name)]
            scale = V.least_scale(n) if x.kind is Kind.ANY else scale
            return [F.coalesce(F.sum(n), F.lit(0)).cast(V.NUMBER).alias(name), F.coalesce(F.max(F.when(n.isNotNull(), scale)), F.lit(0)).alias(f"{name}s")]
        if x.kind in (Kind.INT, Kind.STRING, Kind.DATE, Kind.BOOL):
            return [(F.min if func == "min" else F.max)(col).alias(name)]
        known = F.when(~V.missing(x), F.struct(V.sort_key(x).alias("k"), (F.col("ord") if func == "min" else -F.col("ord")).alias("o")))
        pick = F.min_by if func == "min" else F.max_by
        out = [pick(col, known).alias(name)]
        return [*out, pick(scale, known).alias(f"{name}s")] if x.kind is Kind.DECIMAL else out

    def finish(self, rows: DataFrame, items, values: list[Typed], visible: int, order_at: list[int], query: Q.Select) -> Result:
        rows = self.context.apply(rows)
        shown = [v.col.alias(f"__t{i}") for i, v in enumerate(values[:visible])]
        shown += [V.scale_of(v).cast("int").alias(f"__s{i}") for i, v in enumerate(values[:visible]) if v.kind is Kind.DECIMAL]
        keys = [V.sort_key(values[i]).alias(f"__o{n}") for n, i in enumerate(order_at)]
        out = rows.select(*shown, *keys, F.col("ord").alias("__ord"))
        if query.distinct:
            same = [V.group_key(Typed(v.kind, F.col(f"__t{i}"), F.col(f"__s{i}") if v.kind is Kind.DECIMAL else None)).alias(f"__d{i}") for i, v in enumerate(values[:visible])]
            marks = [F.col(f"__o{n}") for n in range(len(keys))]
            first = F.struct(*marks, (-F.col("__ord") if query.descending else F.col("__ord")).alias("__ord"))
            pick = F.max_by if query.descending else F.min_by
            row = F.struct(*out.columns)
            out = out.select("*", *same).groupBy(*[f"__d{i}" for i in range(visible)]).agg(pick(row, first).alias("row")).select("row.*")
        order = [(F.col(f"__o{n}").desc_nulls_last() if query.descending else F.col(f"__o{n}").asc_nulls_first()) for n in range(len(keys))]
        out = out.orderBy(*order, "__ord")
        if query.limit is not None:
            out = out.limit(query.limit)
        kept = [c for c in out.columns if c.startswith(("__t", "__s"))]
        return Result([n for _, n, _ in items[:visible]], [v.kind for v in values[:visible]], out.select(*kept))


def _shown(expr) -> str:
    return expr.text if isinstance(expr, Q.Name) else Q.derived_name(expr)


def run(ledger, text: str, today: dt.date | None = None) -> Result:
    """Plans a SELECT, BALANCES or JOURNAL over a ledger."""
    statement = Q.desugared(Q.parse(text))
    if isinstance(statement, Q.Print):
        raise QueryError("PRINT gives ledger text; see tallyspark.sinks.printing")
    return Planner(ledger, today or dt.date.today()).select(statement)
