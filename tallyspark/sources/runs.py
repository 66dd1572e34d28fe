"""Runs of plain transactions of two postings, the second without units, from text to columns many at a time.

One pattern is matched along the text; what it found is checked and computed a column at a time, numbers in 64 bits. A
transaction that is no such, or whose numbers may not fit, is left to ``plain``, which gives the same rows one at a
time. The text of these transactions (``text_of``) and what their accounts gain (``gains_of``) are made of the columns, where
they are asked for.
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.booking import LotCost
from tallyspark.operators.processing import Account
from tallyspark.sources import ledger_text as T
from tallyspark.sources.config import Config
from tallyspark.sources.plain import _FLAT, _TWO, MOST, SCALE, Plain
from tallyspark.sources.printer import _WIDTH

_RUN = re.compile(f"{_TWO.pattern}(?:{T._BLANK.pattern})*+(?![ \t])", re.ASCII)
_TERM = re.compile(r"([-+*(])[ \t]*([0-9]+)\.?([0-9]*)")
_FIT = 9e18  # below, computed numbers are exact in 64 bits
_FEW = 16  # transactions in a row that are worth it
_SEPARATOR = "\x1f"  # in no ledger's text


class Run:
    """Transactions that follow each other: of the columns ``table``, the rows from ``first`` to ``last``."""

    __slots__ = ("first", "last", "table")

    def __init__(self, table: Table, first: int, last: int):
        self.table, self.first, self.last = table, first, last


class Table:
    """Columns of transactions in the order of their text; ``pid``s and ``rank``s follow, as runs of them are taken."""

    def __init__(self, dates: list, columns: dict, gained: set[tuple[str, str]]):
        self.dates, self.columns, self.gained, self.ranks = dates, columns, gained, []

    def lots(self) -> list[str]:
        """What is added to: "account currency"."""
        return [f"{account} {currency}" for account, currency in self.gained]

    def take(self, run: Run, counts: dict) -> None:
        """Numbers the transactions of a run by day."""
        ranks = self.ranks
        for date in self.dates[run.first : run.last]:
            n = counts.get((date, 0), 0)
            ranks.append(n)
            counts[date, 0] = n + 1


class Runs(Plain):
    """``Plain`` that takes runs, where there are any."""

    def __init__(self, config: Config, accounts: dict[str, Account], filename: str):
        super().__init__(config, accounts, filename)
        self.text, self.ahead, self.end = None, {}, 0
        self.days: dict[str, dt.date | None] = {}
        self.open = {n: (str(a.opened), str(a.closed or "9999-12-31"), a.currencies) for n, a in accounts.items()}
        self.labels: dict[tuple[str, tuple], tuple[list[str], str]] = {}

    def __call__(self, text: str, at: int, line: int, pushed: list[str], metas: list):
        if metas or not self.usable:
            return None
        if text is not self.text:
            self.text, self.ahead, self.end = text, {}, 0
        if at >= self.end:  # else it has been looked at: it is taken with others, or is no such transaction
            self._look(text, at, line, pushed)
        if found := self.ahead.pop(at, None):
            end, lines, run = found
            return end, line + lines, run
        return super().__call__(text, at, line, pushed, metas)

    def _look(self, text: str, at: int, line: int, pushed: list[str]) -> None:
        found = list(iter(_RUN.scanner(text, at).match, None))
        if not found:
            return
        if len(found) < _FEW:
            self.end = found[-1].end()
            return
        starts = [m.start() for m in found]
        self.end = found[-1].end()
        ends = [*starts[1:], self.end]
        lines = [text.count("\n", a, b) for a, b in zip(starts, ends, strict=True)]
        table, taken = self._table([m.groups() for m in found], lines, line, pushed)
        if table is None:
            return
        i, n, row = 0, len(found), 0
        while i < n:
            if not taken[i]:
                i += 1
                continue
            j = i
            while j < n and taken[j]:
                j += 1
            self.ahead[starts[i]] = (ends[j - 1], sum(lines[i:j]), Run(table, row, row + j - i))
            i, row = j, row + j - i

    def _day(self, raw: str) -> dt.date | None:
        try:
            found = dt.date.fromisoformat(raw)
        except ValueError:
            found = None
        self.days[raw] = found
        return found

    def _labels(self, raw: str, pushed: tuple) -> tuple[list[str], str]:
        """Tags in order of their names, and as they are written."""
        tags = [x[1:] for x in raw.split()]
        tags += [x for x in pushed if x not in tags]
        found = self.labels[raw, pushed] = sorted(set(tags)), "".join([f" #{x}" for x in tags])
        return found

    def _table(self, rows: list[tuple], lines: list[int], line: int, pushed: list[str]):
        """Columns of those rows that can be taken, and which ones these are."""
        import numpy as np
        import pyarrow as pa

        open_, days = self.open, self.days
        fits = []
        for r in rows:
            raw, currency, account, account2 = r[0], r[12], r[9], r[21]
            a, b = open_.get(account), open_.get(account2)
            fits.append(
                currency is not None and a is not None and b is not None and a[0] <= raw <= a[1] and b[0] <= raw <= b[1] and (not a[2] or currency in a[2])
                and (days.get(raw) or self._day(raw)) is not None and (r[13] is None or r[14] is not None)
            )
        at = np.flatnonzero(fits)
        if not len(at):
            return None, fits
        raw, flag, first, second, labels, key, digits, string, mark, account, number, sum_, currency, braces, cost, cost_currency, cost_date, _, price, price_currency, mark2, account2 = map(list, zip(*[rows[i] for i in at], strict=True))
        n, scale, ok = _numbers(number)
        if any(sum_):
            m, s, fine = _sums(sum_)
            summed = np.array([x is not None for x in sum_])
            n, scale, ok = np.where(summed, m, n), np.where(summed, s, scale), np.where(summed, fine, ok)
        weight, places, by = n, scale, currency
        at_cost = at_price = None
        if any(price):
            at_price = p, s, fine = _numbers(price)
            has = np.array([x is not None for x in price])
            ok &= ~has | (fine & (p > 0) & _scales(p, s) & (np.abs(n.astype(float) * p) < _FIT))
            weight, places = np.where(has, n * p, weight), np.where(has, scale + s, places)
            by = [x or y for x, y in zip(price_currency, by, strict=True)]
        if any(braces):
            at_cost = c, s, fine = _numbers(cost)
            has = np.array([x is not None for x in cost])
            ok &= ~has | (fine & (c > 0) & (n > 0) & _scales(c, s) & (np.abs(n.astype(float) * c) < _FIT))
            weight, places = np.where(has, n * c, weight), np.where(has, scale + s, places)
            by = [x or y for x, y in zip(cost_currency, by, strict=True)]
            bought = [(days.get(x) or self._day(x)) if x else None for x in cost_date]
            if any(cost_date):
                ok &= np.array([x is None or y is not None for x, y in zip(cost_date, bought, strict=True)])
        ok &= (places <= SCALE) & (np.abs(weight) < MOST) & _scales(n, scale) & _scales(weight, places)
        ok &= np.array([not open_[x][2] or y in open_[x][2] for x, y in zip(account2, by, strict=True)])
        if any(key):
            k, s, fine = _numbers(digits)
            ok &= np.array([x is None or bool(y or z) for x, y, z in zip(key, digits, string, strict=True)])
            ok &= np.array([x is None or not (len(x) > 1 and x[0] == "0" and x[1] != ".") for x in digits])  # as it would be shown
            ok &= np.array([x is None for x in digits]) | (fine & (s <= 6) & _scales(k, s))
        taken = np.zeros(len(rows), bool)
        taken[at[ok]] = True
        if not ok.any():
            return None, taken

        size = int(ok.sum())
        pick = (lambda xs: xs) if ok.all() else (lambda xs: [x for x, y in zip(xs, ok.tolist(), strict=True) if y])
        raw, flag, first, second, labels, key, digits, string, mark, account, currency, by, mark2, account2 = map(pick, (raw, flag, first, second, labels, key, digits, string, mark, account, currency, by, mark2, account2))
        n, scale, weight, places = n[ok], scale[ok], weight[ok], places[ok]
        starts = (line + np.concatenate([[0], np.cumsum(lines)[:-1]]))[at[ok]]
        under = starts + 1 + np.array([x is not None for x in key])

        tags, links, marks, these = [], [], [], tuple(pushed)
        known = self.labels
        for x in labels:
            i = x.find("^")
            if i < 0:
                i = len(x)
            elif x.find("#", i) >= 0:
                x = " ".join(sorted(x.split(), key=lambda y: y[0] == "^"))
                i = x.find("^")
            names, shown = known.get((x[:i], these)) or self._labels(x[:i], these)
            linked = [y[1:] for y in x[i:].split()]
            tags.append(names)
            links.append(linked if len(linked) < 2 else sorted(set(linked)))
            marks.append(shown + "".join([f" ^{y}" for y in linked]))
        if len(known) > 10_000:
            known.clear()

        dates = [days[x] for x in raw]
        date = pa.array(dates, pa.date32())
        leg = lambda one, two: pa.array(_dealt(one, two), pa.string())
        postings = {
            "account": leg(account, account2), "posting_flag": leg([x or "" for x in mark], [x or "" for x in mark2]), "posting_line": pa.array(_woven(under, under + 1)),
            "number": _decimal(_woven(_ten(n, scale), _ten(-weight, places))), "scale": pa.array(_woven(scale, places).astype(np.int32)), "currency": leg(currency, by),
        }
        gained = set()
        if at_cost is not None:
            c, s = at_cost[0][ok], at_cost[1][ok]
            has = np.array([x is not None for x in pick(cost)])
            gained.update((x, y) for x, y, z in zip(account, currency, has.tolist(), strict=True) if z)
            when = [(x or y) if z else None for x, y, z in zip(pick(bought), dates, has.tolist(), strict=True)]
            postings["cost"] = _amounts(c, s, pick(cost_currency), has), pa.array(_dealt(when, [None] * size), pa.date32())
        if at_price is not None:
            p, s = at_price[0][ok], at_price[1][ok]
            postings["price"] = _amounts(p, s, pick(price_currency), np.array([x is not None for x in pick(price)])), None
        has = np.array([x is not None for x in key])
        entry = {
            "lineno": pa.array(starts), "date": date, "flag": pa.array(flag, pa.string()), "marks": pa.array(marks, pa.string()),
            "payee": pa.array([_plainly(x) if y is not None else "" for x, y in zip(first, second, strict=True)], pa.string()),
            "narration": pa.array([_plainly((x or "") if y is None else y) for x, y in zip(first, second, strict=True)], pa.string()),
            "tags": _strings(tags), "links": _strings(links), "accounts": _strings([[x, y] if x < y else [y, x] if y < x else [x] for x, y in zip(account, account2, strict=True)]),
        }
        meta = None
        if has.any():
            numeric = np.array([x is not None for x in digits])
            k, s, _ = _numbers(digits)
            held = np.flatnonzero(has).tolist()
            meta = (
                has, pa.array([key[i] for i in held], pa.string()), pa.array(["string" if digits[i] is None else "number" for i in held], pa.string()),
                pa.array([string[i] if digits[i] is None else digits[i] for i in held], pa.string()), _decimal(np.where(numeric, _ten(k, s), 0)[has], numeric[has]),
            )
        return Table(dates, {"entry": entry, "postings": postings, "meta": meta}, gained), taken


def _plainly(raw: str) -> str:
    if "\\" not in raw:
        return raw
    out = raw.replace('\\"', '"')
    return out if "\\" not in out else T._plain_text(raw)


def _numbers(texts: list):
    """Numbers as integers, their scales, and where they are such as ``plain_number`` takes."""
    import numpy as np

    whole = [x.replace(".", "") if x else "0" for x in texts]
    scale = np.array([len(x) - 1 - x.find(".") if x and "." in x else 0 for x in texts], np.int64)
    if max(map(len, whole)) > 17:
        whole = [x if len(x) <= 17 else "0" for x in whole]
    n = np.array(whole, dtype="U17").astype(np.int64)
    return n, scale, (n != 0) & (scale <= SCALE) & (np.abs(n) < MOST)


def _sums(texts: list):
    """As ``_numbers``, of sums and products in parentheses; of those that are simple."""
    import numpy as np

    size = len(texts)
    given = [i for i, x in enumerate(texts) if x is not None and len(x) <= 40 and _FLAT.fullmatch(x)]
    n, scale, ok = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
    terms = _TERM.findall("".join([texts[i] for i in given]))
    if not terms:
        return n, scale, ok
    op, whole, part = zip(*terms, strict=True)
    both = [x + y for x, y in zip(whole, part, strict=True)]
    short = np.array([len(x) <= 16 for x in both])
    m, s = np.array([x if len(x) <= 16 else "0" for x in both], dtype="U16").astype(np.int64), np.fromiter(map(len, part), np.int64, len(part))
    op = np.array(op)
    begins, heads = np.flatnonzero(op == "("), np.flatnonzero(op != "*")
    size_of = np.maximum(m / 10.0**s, 1)  # as the parser's, no number on the way may be long
    product, places = np.multiply.reduceat(m, heads), np.add.reduceat(s, heads)
    fine = np.logical_and.reduceat(short, heads) & (np.multiply.reduceat(size_of, heads) < 1e11) & (np.multiply.reduceat(np.maximum(m, 1).astype(float), heads) < _FIT)
    first = np.searchsorted(heads, begins)
    most = np.maximum.reduceat(places, first)
    lengths = np.diff(np.append(first, len(heads)))
    lift = np.repeat(most, lengths) - places
    fine &= product.astype(float) * 10.0**lift < 1e17
    product = np.where(fine, product, 0) * 10 ** np.where(fine, lift, 0)
    total = np.add.reduceat(np.where(op[heads] == "-", -product, product), first)
    good = np.logical_and.reduceat(fine, first) & (np.add.reduceat(np.abs(product) / 10.0 ** np.repeat(most, lengths), first) < 1e11) & (total != 0) & (most <= 16)
    computed = np.diff(np.append(begins, len(op))) > 1
    for _ in range(16):  # a computed number has no zeros at its end
        strip = computed & good & (most > 0) & (total % 10 == 0)
        if not strip.any():
            break
        total, most = np.where(strip, total // 10, total), most - strip
    good &= (most <= SCALE) & (np.abs(total) < MOST)
    n[given], scale[given], ok[given] = total, most, good
    return n, scale, ok


def _scales(n, scale):
    """Where a number fits when all its ten places are written."""
    import numpy as np

    return np.abs(n.astype(float)) * 10.0 ** (SCALE - np.minimum(scale, SCALE)) < _FIT


def _ten(n, scale):
    return n * 10 ** (SCALE - scale)


def _woven(one, two):
    import numpy as np

    return np.stack([one, two], 1).reshape(-1)


def _dealt(one: list, two: list) -> list:
    out = [None] * (2 * len(one))
    out[::2], out[1::2] = one, two
    return out


def _decimal(n, present=None):
    """decimal(28, 10) of integers that are scaled already."""
    import numpy as np
    import pyarrow as pa

    data = np.ascontiguousarray(np.stack([n, n >> 63], 1).astype("<i8"))
    nulls = None if present is None else pa.array(present).buffers()[1]
    return pa.Array.from_buffers(pa.decimal128(28, 10), len(n), [nulls, pa.py_buffer(data.tobytes())])


def _amounts(n, scale, currencies: list, has) -> tuple:
    """Number, scale and currency of an amount that first postings have, and which postings these are."""
    import numpy as np
    import pyarrow as pa

    none, n, scale = np.zeros(len(n), np.int64), np.where(has, n, 0), np.where(has, scale, 0)
    return _decimal(_woven(_ten(n, scale), none)), pa.array(_woven(scale, none).astype(np.int32)), pa.array(_dealt(currencies, [None] * len(n)), pa.string()), _woven(has, none.astype(bool))


def _offsets(sizes):
    import numpy as np

    out = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=out[1:])
    return out


def _listed(kind, offsets, values):
    import pyarrow as pa

    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes())], children=[values])


def _strings(rows: list[list[str]]):
    import pyarrow as pa

    return [len(x) for x in rows], pa.array([y for x in rows for y in x], pa.string())


def batch(table: Table, schema, filename: str, pid: int):
    """The rows of a table, once all its runs have been taken."""
    import numpy as np
    import pyarrow as pa

    kind = {f.name: f.type for f in schema}
    n = len(table.dates)
    at = lambda t, name: t.field(t.get_field_index(name)).type
    posting = kind["postings"].value_type
    legs, entry = table.columns["postings"], table.columns["entry"]
    given = {}
    for i in range(posting.num_fields):
        name = posting.field(i).name
        form = posting.field(i).type
        if name == "posting_meta":
            given[name] = _listed(form, np.zeros(2 * n + 1, np.int32), pa.nulls(0, form.value_type))
        elif name not in legs:
            given[name] = pa.nulls(2 * n, form)
        elif name in ("cost", "price"):
            (number, scale, currency, has), date = legs[name]
            columns = {"number": number, "scale": scale, "currency": currency, "date": date, "label": pa.nulls(2 * n, pa.string())}
            given[name] = pa.StructArray.from_arrays([columns[form.field(j).name] for j in range(form.num_fields)], fields=[form.field(j) for j in range(form.num_fields)], mask=pa.array(~has))
        else:
            given[name] = legs[name].cast(form)
    element = kind["entry_meta"].value_type
    if table.columns["meta"] is None:
        metas = _listed(kind["entry_meta"], np.zeros(n + 1, np.int32), pa.nulls(0, element))
    else:
        has, key, sort, string, number = table.columns["meta"]
        value = at(element, "value")
        objects = pa.StructArray.from_arrays([sort, string, number, pa.nulls(len(key), pa.date32()), pa.nulls(len(key), pa.bool_())], fields=[value.field(j) for j in range(value.num_fields)])
        metas = _listed(kind["entry_meta"], _offsets(has), pa.StructArray.from_arrays([key, objects], fields=[element.field(j) for j in range(element.num_fields)]))
    columns = {name: _listed(kind[name], _offsets(x[0]), x[1]) if isinstance(x, tuple) else x for name, x in entry.items()}
    columns |= {name: pa.repeat(pa.scalar(x, kind[name]), n) for name, x in (("part", "entry"), ("pid", pid), ("priority", 0), ("type", "transaction"), ("filename", filename), ("is_valid", True))}
    columns["rank"] = pa.array(table.ranks, kind["rank"])
    columns["entry_meta"] = metas
    columns["postings"] = _listed(kind["postings"], np.arange(0, 2 * n + 1, 2, dtype=np.int32), pa.StructArray.from_arrays([given[posting.field(i).name] for i in range(posting.num_fields)], fields=[posting.field(i) for i in range(posting.num_fields)]))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _whole(x: Column) -> Column:
    """A number of these with all ten places, as an integer."""
    return (x["number"] * F.lit(10**SCALE)).cast("bigint")


def _written(x: Column) -> Column:
    """A number as it was written; a cast to text may give an exponent."""
    n, ten = F.abs(_whole(x)), F.lit(10**SCALE)
    places = F.substring(F.lpad((n % ten).cast("string"), SCALE, "0"), F.lit(1), x["scale"])
    return F.concat(F.when(x["number"] < 0, "-").otherwise(""), F.call_function("div", n, ten).cast("string"), F.when(x["scale"] > 0, F.concat(F.lit("."), places)).otherwise(""))


def text_of() -> Column:
    """The text of a transaction of these, as ``directive_text``; null, if it is of others."""
    shown = lambda x: F.concat(_written(x), F.lit(" "), x["currency"])

    def line(p: Column) -> Column:
        head = F.concat(F.lit("\n  "), F.when(p["posting_flag"] != "", F.concat(p["posting_flag"], F.lit(" "))).otherwise(""), p["account"], F.lit("  "))
        number = _written(p)
        room = F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(_WIDTH + 1) - F.length(head) - F.length(number)))
        cost = F.when(p["cost"].isNotNull(), F.concat(F.lit(" {"), shown(p["cost"]), F.lit(", "), p["cost"]["date"].cast("string"), F.lit("}"))).otherwise("")
        price = F.when(p["price"].isNotNull(), F.concat(F.lit(" @ "), shown(p["price"]))).otherwise("")
        return F.concat(head, room, number, F.lit(" "), p["currency"], cost, price)

    def meta(m: Column) -> Column:
        return F.concat(F.lit("\n  "), m["key"], F.lit(": "), F.when(m["value"]["kind"] == "number", m["value"]["s"]).otherwise(_quoted(m["value"]["s"])))

    payee = F.when(F.col("payee") != "", F.concat(F.lit(" "), _quoted(F.col("payee")))).otherwise("")
    head = F.concat(F.col("date").cast("string"), F.lit(" "), F.col("flag"), payee, F.lit(" "), _quoted(F.col("narration")), F.col("marks"))
    return F.concat(head, F.array_join(F.transform("entry_meta", meta), ""), F.array_join(F.transform("postings", line), ""))


def gains_of(rows: DataFrame) -> DataFrame:
    """What accounts gain at cost in these transactions, as rows ``gained``."""
    p = F.get("postings", F.lit(0))
    cost = p["cost"]
    whole = lambda x: [_whole(x).cast("string"), x["scale"].cast("string")]
    payload = F.concat_ws(_SEPARATOR, p["currency"], *whole(p), *whole(cost), cost["currency"], cost["date"].cast("string"))
    found = rows.filter(F.col("marks").isNotNull() & cost.isNotNull())
    return found.select(F.lit("gained").alias("part"), "date", "lineno", p["account"].alias("account"), F.encode(payload, "UTF-8").alias("payload"))


def gained_of(payload: bytes) -> tuple:
    """Currency, units and cost, of what ``gains_of`` gives."""
    currency, units, scale, cost = payload.decode().split(_SEPARATOR, 3)
    return currency, _as_written(units, scale), _cost(cost)


@lru_cache(1 << 16)
def _cost(text: str) -> LotCost:
    number, scale, currency, date = text.split(_SEPARATOR)
    return LotCost(_as_written(number, scale), currency, dt.date.fromisoformat(date))


@lru_cache(1 << 12)
def _as_written(n: str, scale: str) -> Decimal:
    return Decimal(int(n) // 10 ** (SCALE - int(scale))).scaleb(-int(scale))
