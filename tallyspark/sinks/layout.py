"""Text tables and CSV of query results.

Widths are counted in bytes and taken from all rows first, in one aggregate per column kind; rows
are then formatted as they stream to the driver in order, so that a result of any length can be
written. Numbers are aligned at the point, each currency with as many digits as any of its numbers has.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.plans import values as V
from tallyspark.plans.planner import Result
from tallyspark.plans.values import Kind, Typed

_HELD = (Kind.AMOUNT, Kind.POSITION, Kind.INVENTORY)
BOOLS = {True: "TRUE ", False: "FALSE"}


def _digits(number: Decimal, scale: int) -> str:
    return format(number.quantize(Decimal(1).scaleb(-scale)), "f")


def _pad(s: str, width: int) -> str:
    return s + " " * (width - len(s.encode()))


def _positions(value, kind: Kind) -> list:
    if value is None:
        return []
    return list(value) if kind is Kind.INVENTORY else [value]


def _cost(c) -> str:
    label = f', "{c["label"]}"' if c["label"] else ""
    return f"{{{_digits(c['number'], c['scale'])} {c['currency']}{label}}}"


@dataclass
class Column:
    """Layout of one column, gathered over all rows."""

    kind: Kind
    width: int = 1
    whole: int = 0  # digits before the point, with the sign
    part: int = 0  # digits after it
    digits: dict[str, int] = field(default_factory=dict)  # by currency
    currency: int = 0
    cost: int = 0
    empty: bool = True
    padded: bool = True

    def see(self, value, scale=None) -> None:
        if value is None:
            return
        self.empty = False
        if self.kind is Kind.DECIMAL:
            whole, _, part = _digits(value, scale or 0).partition(".")
            self.whole, self.part = max(self.whole, len(whole)), max(self.part, len(part))
            self.width = max(1, self.whole + (1 + self.part if self.part else 0))
        elif self.kind in _HELD:
            for p in _positions(value, self.kind):
                c = p["currency"]
                self.digits[c] = max(self.digits.get(c, 0), p["scale"])
                self.whole = max(self.whole, len(_digits(p["number"], p["scale"]).partition(".")[0]))
                self.currency = max(self.currency, len(c))
                if self.kind is not Kind.AMOUNT and p["cost"] is not None:
                    self.cost = max(self.cost, len(_cost(p["cost"])))
            deep = max((d + 1 for d in self.digits.values() if d), default=0)
            self.part = deep
            self.width = self.whole + deep + 1 + self.currency + (1 + self.cost if self.cost else 0) if self.currency else 1
        elif self.kind is Kind.DATE:
            self.width = 10
        elif self.kind is Kind.BOOL:
            self.width = 5
        else:
            self.width = max(self.width, len(self.text(value).encode()))

    def text(self, value) -> str:
        if value is None:
            return ""
        if self.kind is Kind.SET:
            return ",".join(sorted(value))
        return value["s"] if self.kind is Kind.ANY else str(value)

    def number(self, number: Decimal, currency: str) -> str:
        whole, _, part = _digits(number, self.digits.get(currency, 0)).partition(".")
        return _pad(f"{whole:>{self.whole}}" + (f".{part}" if part else ""), self.whole + self.part)

    def format(self, value, scale=None) -> str:
        if self.kind is Kind.DECIMAL:
            if value is None:
                return " " * self.width
            whole, _, part = _digits(value, scale or 0).partition(".")
            return _pad(f"{whole:>{self.whole}}" + (f".{part}" if part else ""), self.width)
        if self.kind is Kind.INT:
            return f"{'' if value is None else value:>{self.width}}"
        if self.kind is Kind.BOOL:
            return BOOLS.get(value, " " * 5)
        if self.kind is Kind.DATE:
            return str(value) if value is not None else " " * 10
        if self.kind in _HELD:
            one = self.width
            cells = []
            for p in _positions(value, self.kind):
                cell = f"{self.number(p['number'], p['currency'])} {_pad(p['currency'], self.currency)}"
                if self.kind is not Kind.AMOUNT and p["cost"] is not None:
                    cell += f" {_cost(p['cost'])}"
                cells.append(_pad(cell, one))
            return _pad(", ".join(cells), one)
        return _pad(self.text(value), self.width) if self.padded else self.text(value)


def _rows(result: Result) -> Iterator:
    """Rows in order, as tuples of (value, scale)."""
    scaled = {c for c in result.detailed.columns if c.startswith("__s")}
    for row in result.detailed.toLocalIterator():
        yield [(row[f"__t{i}"], row[f"__s{i}"] if f"__s{i}" in scaled else None) for i in range(len(result.names))]


def layout(result: Result, for_csv: bool = False) -> tuple[list[Column], Result]:
    """Columns fitted to the rows, and the result to format (held, so that both passes see one order)."""
    held = Result(result.names, result.kinds, result.detailed.persist())
    columns = [Column(k, width={Kind.DATE: 10, Kind.BOOL: 5}.get(k, 1), padded=not (for_csv and k is Kind.ANY)) for k in result.kinds]
    # one representative a distinct shape is enough: widths depend on lengths, digits and currencies only
    for i, c in enumerate(columns):
        value = Typed(c.kind, F.col(f"__t{i}"), F.col(f"__s{i}") if c.kind is Kind.DECIMAL else None)
        if c.kind in _HELD:
            flat = held.detailed.select(F.explode(F.array(value.col) if c.kind is not Kind.INVENTORY else value.col).alias("p")).filter("p IS NOT NULL")
            length = F.length(V.plain(F.col("p.number"), F.lit(0)))
            label = F.length(V.position_text(F.col("p"))) if c.kind is not Kind.AMOUNT else F.lit(0)
            shapes = flat.groupBy("p.currency", "p.scale").agg(F.max_by("p", length).alias("a"), F.max_by("p", label).alias("b"))
            for row in shapes.toLocalIterator():
                for p in (row.a, row.b):
                    c.see([p] if c.kind is Kind.INVENTORY else p)
        elif c.kind is Kind.DECIMAL:
            shapes = held.detailed.filter(value.col.isNotNull()).groupBy(value.scale.alias("scale")).agg(F.max_by(value.col, F.length(V.plain(value.col, F.lit(0)))).alias("a"))
            for row in shapes.toLocalIterator():
                c.see(row.a, row.scale)
        elif c.kind in (Kind.DATE, Kind.BOOL):
            c.empty = held.detailed.filter(value.col.isNotNull()).isEmpty()
        else:
            shown = F.array_join(value.col, ",") if c.kind is Kind.SET else value.col["s"] if c.kind is Kind.ANY else value.col.cast("string")
            widest = held.detailed.agg(F.max(F.octet_length(shown))).first()[0]
            c.empty = widest is None
            c.width = max(1, widest or 0)
    return columns, held


def text_table(result: Result) -> Iterator[str]:
    """Lines of a table: a centred header cut to the width, a rule, the rows."""
    columns, held = layout(result)
    first = True
    for row in _rows(held):
        if first:
            first = False
            head = []
            for name, c in zip(result.names, columns, strict=True):
                shown = "" if c.empty else name[: c.width]
                left = (c.width - len(shown)) // 2
                head.append(" " * left + shown + " " * (c.width - len(shown) - left))
            yield " ".join(head)
            yield " ".join("-" * c.width for c in columns)
        yield " ".join(c.format(v, s) for c, (v, s) in zip(columns, row, strict=True))
    if first:
        yield "(empty)"
    held.detailed.unpersist()


def _line(cells: list[str]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n").writerow(cells)
    return out.getvalue()


def csv_lines(result: Result, numberify: bool = False) -> Iterator[str]:
    """CRLF lines; values padded as in the table. With ``numberify`` a column per currency, numbers only."""
    columns, held = layout(result, for_csv=True)
    if not numberify:
        yield _line(result.names)
        for row in _rows(held):
            yield _line([c.format(v, s) for c, (v, s) in zip(columns, row, strict=True)])
        held.detailed.unpersist()
        return
    split: list[list[tuple[str, Column]]] = []
    for i, (name, c) in enumerate(zip(result.names, columns, strict=True)):
        if c.kind not in _HELD:
            split.append([(name, c)])
            continue
        seen: dict[str, Column] = {}
        for row in held.detailed.select(f"__t{i}").toLocalIterator():
            for p in _positions(row[0], c.kind):
                own = seen.setdefault(p["currency"], Column(Kind.DECIMAL))
                own.see(p["number"], c.digits[p["currency"]])
        split.append([(f"{name} ({currency})", own) for currency, own in seen.items()])
    yield _line([n for part in split for n, _ in part])
    for row in _rows(held):
        cells = []
        for (v, s), c, part in zip(row, columns, split, strict=True):
            if c.kind not in _HELD:
                cells.append(part[0][1].format(v, s))
                continue
            for name, own in part:
                currency = name.rpartition("(")[2][:-1]
                total = sum((p["number"] for p in _positions(v, c.kind) if p["currency"] == currency), Decimal(0))
                has = any(p["currency"] == currency for p in _positions(v, c.kind))
                cells.append(own.format(total if has else None, c.digits[currency]))
        yield _line(cells)
    held.detailed.unpersist()
