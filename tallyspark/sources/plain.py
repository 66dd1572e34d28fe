"""Transactions of the commonest form, from text to columns at once.

A block is plain if its lines are (``ledger_text``), its metadata stands above its postings, no metadata is pushed, its numbers
are short and not zero, it reduces no lots, its accounts are open and hold its currencies, and it balances to zero, one
posting's units being left out at most. Numbers are integers with a scale. Whatever else is met, the block is left to the
parser and to ``processing``, which give the same rows for plain blocks too, a directive at a time.
"""

from __future__ import annotations

import datetime as dt
import pickle
import re
from decimal import Decimal

from tallyspark.operators.processing import Account
from tallyspark.sources import ledger_text as T
from tallyspark.sources.config import Config
from tallyspark.sources.printer import _WIDTH, posting_line, quoted

MOST, SCALE = 10**16, 10  # numbers from here on, and finer ones, are not plain
_EXACT = 10**27  # below, decimals are exact
_SUM = re.compile(r"\d+(?:\.\d*)?|\.\d+|[-+*()]")
_FLAT = re.compile(r"\([ \t]*(\d+(?:\.\d*)?(?:[ \t]*[-+*][ \t]*\d+(?:\.\d*)?)*)[ \t]*\)")  # no signs, no parentheses within
_TERMS = re.compile(r"([-+*]?)[ \t]*(\d+)\.?(\d*)[ \t]*")
_BARE = rf"[ \t]+(?:([*!])[ \t]+)?({T.ACCOUNT}){T._END}"
# a transaction of at most one key and two postings, the second without units
_TWO = re.compile(f"{T._PLAIN_HEAD.pattern}(?:{T._PLAIN_META.pattern})?{T._PLAIN_POSTING.pattern}{_BARE}")


class _Other(Exception):
    """Not plain."""


def plain_number(raw: str) -> tuple[int, int]:
    whole, _, part = raw.partition(".")
    n, scale = int(whole + part), len(part)
    if not n or scale > SCALE or not -MOST < n < MOST:
        raise _Other
    return n, scale


def plain_sum(raw: str) -> tuple[int, int]:
    """Sums and products with parentheses; as of the parser, a computed number has no zeros at its end."""
    if (m := _FLAT.fullmatch(raw)) and len(m[1]) <= 26:
        return _flat_sum(_TERMS.findall(m[1]))
    tokens = _SUM.findall(raw)
    if "".join(tokens) != raw.translate({32: None, 9: None}) or len(raw) > 60 or sum(len(t) for t in tokens if t not in "+-*()") > 26:
        raise _Other
    at, computed = 0, False

    def kept(n: int, scale: int) -> tuple[int, int]:
        if not -(10 ** (12 + scale)) < n < 10 ** (12 + scale):  # the parser rounds to 16 of 28 digits
            raise _Other
        return n, scale

    def factor() -> tuple[int, int]:
        nonlocal at
        if at == len(tokens):
            raise _Other
        t = tokens[at]
        at += 1
        if t in "+-":
            n, scale = factor()
            return (-n if t == "-" else n), scale
        if t == "(":
            inner = total()
            if at == len(tokens) or tokens[at] != ")":
                raise _Other
            at += 1
            return inner
        if t in "*)":
            raise _Other
        whole, _, part = t.partition(".")
        return int(whole + part), len(part)

    def product() -> tuple[int, int]:
        nonlocal at, computed
        n, scale = factor()
        while at < len(tokens) and tokens[at] == "*":
            at, computed = at + 1, True
            m, more = factor()
            n, scale = kept(n * m, scale + more)
        return n, scale

    def total() -> tuple[int, int]:
        nonlocal at, computed
        n, scale = product()
        while at < len(tokens) and tokens[at] in "+-":
            minus, at, computed = tokens[at] == "-", at + 1, True
            m, other = product()
            if other > scale:
                n, scale = n * 10 ** (other - scale), other
            elif scale > other:
                m *= 10 ** (scale - other)
            n, scale = kept(n - m if minus else n + m, scale)
        return n, scale

    n, scale = total()
    if at != len(tokens) or not n or scale > 16:
        raise _Other
    while computed and scale and n % 10 == 0:
        n, scale = n // 10, scale - 1
    if scale > SCALE or not -MOST < n < MOST:
        raise _Other
    return n, scale


def _flat_sum(terms: list[tuple[str, str, str]]) -> tuple[int, int]:
    """``plain_sum`` of terms with the operator before each, without parentheses."""
    n = scale = m = more = 0
    last = len(terms) - 1
    minus = False
    for i, (op, whole, part) in enumerate(terms):
        if op == "*":
            m, more = m * int(whole + part), more + len(part)
            most = 10 ** (12 + more)
            if not -most < m < most:
                raise _Other
        else:
            m, more, minus = int(whole + part), len(part), op == "-"
        if i == last or terms[i + 1][0] != "*":
            if more > scale:
                n, scale = n * 10 ** (more - scale), more
            elif scale > more:
                m *= 10 ** (scale - more)
            n = n - m if minus else n + m
            most = 10 ** (12 + scale)
            if last and not -most < n < most:
                raise _Other
    if not n or scale > 16:
        raise _Other
    while last and scale and n % 10 == 0:
        n, scale = n // 10, scale - 1
    if scale > SCALE or not -MOST < n < MOST:
        raise _Other
    return n, scale


def shown(n: int, scale: int) -> str:
    if not scale:
        return str(n)
    text = str(abs(n)).rjust(scale + 1, "0")
    return f"{'-' if n < 0 else ''}{text[:-scale]}.{text[-scale:]}"


def gain(currency: str, units, number, cost_currency: str, date: dt.date, label: str | None) -> tuple:
    """Units gained at a cost, as they go to the task that books their account; read by ``gained``."""
    return currency, str(units), str(number), cost_currency, date, label


class Plain:
    """Takes plain blocks: rows to be written by ``Columns``, and what accounts gain at cost."""

    def __init__(self, config: Config, accounts: dict[str, Account], filename: str):
        self.accounts, self.filename = accounts, filename
        self.heads: dict[tuple, tuple[str, int]] = {}  # of the lines of postings, by account and mark: what stands first, room for the number
        self.usable = all(x >= 0 for x in (config.multiplier, *config.defaults.values()))

    def __call__(self, text: str, at: int, line: int, pushed: list[str], metas: list):
        """(where the next line starts, its number, row) of the block at ``at``; None if it is not plain."""
        if metas or not self.usable or not (m := T._PLAIN_HEAD.match(text, at)):
            return None
        if two := self._two(text, at, line, pushed):
            return two
        start, at, nth = m, m.end(), line + 1
        found, postings = [], []
        size = len(text)
        while at < size and text[at] in " \t":
            if m := T._PLAIN_POSTING.match(text, at):
                postings.append((m.groups(), nth))
            elif not postings and (m := T._PLAIN_META.match(text, at)):
                found.append(m.groups())
            elif m := T._BLANK.match(text, at):
                pass
            else:
                return None
            at, nth = m.end(), nth + 1
        while at < size and (m := T._BLANK.match(text, at)):
            at, nth = m.end(), nth + 1
        if at < size and text[at] in " \t":  # still of this block
            return None
        try:
            return at, nth, self._row(start, line, found, postings, pushed)
        except (_Other, ValueError):
            return None

    def _line(self, account: str, mark: str, n: str, currency: str) -> str:
        """As ``posting_line``."""
        found = self.heads.get((account, mark))
        if found is None:
            head = f"  {mark + ' ' if mark else ''}{account}  "
            found = self.heads[account, mark] = head, max(0, _WIDTH - len(head))
        return f"{found[0]}{n.rjust(found[1])} {currency}"

    def _two(self, text: str, at: int, line: int, pushed: list[str]):
        """As ``__call__``, of the commonest of plain blocks; None, if the block is no such or may not be plain."""
        if not (m := _TWO.match(text, at)):
            return None
        raw, flag, first, second, labels, key, digits, string, mark, account, number, sum_, currency, braces, cost, cost_currency, cost_date, _, price, price_currency, mark2, account2 = m.groups()
        a, b = self.accounts.get(account), self.accounts.get(account2)
        if a is None or b is None or currency is None:
            return None
        at, nth = m.end(), line + (4 if key else 3)
        size = len(text)
        while at < size and (m := T._BLANK.match(text, at)):
            at, nth = m.end(), nth + 1
        if at < size and text[at] in " \t":
            return None
        try:
            date = dt.date.fromisoformat(raw)
            if date < a.opened or date < b.opened or (a.closed and date > a.closed) or (b.closed and date > b.closed) or (a.currencies and currency not in a.currencies):
                return None
            weight, places = n, scale = plain_sum(sum_) if sum_ else plain_number(number)
            by, at_cost, at_price, gained, more = currency, None, None, [], ""
            if price:
                p, s = plain_number(price)
                if p < 0:
                    return None
                at_price, weight, places, by = (p, s, price_currency), n * p, scale + s, price_currency
                more = f" @ {shown(p, s)} {price_currency}"
            if braces:
                if not cost or n < 0:
                    return None
                c, s = plain_number(cost)
                if c < 0:
                    return None
                at_cost = (c, s, cost_currency, dt.date.fromisoformat(cost_date) if cost_date else date)
                weight, places, by = n * c, scale + s, cost_currency
                if a.booking != "NONE":
                    gained.append((account, gain(currency, shown(n, scale), shown(c, s), cost_currency, at_cost[3], None)))
                more = f" {{{shown(c, s)} {cost_currency}, {at_cost[3]}}}" + more
            if places > SCALE or not -MOST < weight < MOST or (b.currencies and by not in b.currencies):
                return None
            values, meta = [], ""
            if key:
                if digits:
                    k, s = plain_number(digits)
                    if s > 6:
                        return None
                    string = shown(k, s)
                    values.append((key, "number", string, k * 10 ** (SCALE - s)))
                    meta = f"\n  {key}: {string}"
                elif string:
                    values.append((key, "string", string, None))
                    meta = f"\n  {key}: {quoted(string)}"
                else:
                    return None
        except (_Other, ValueError):
            return None
        payee, narration = (first, second) if second is not None else ("", first or "")
        payee, narration = T._plain_text(payee), T._plain_text(narration)
        labels = labels.split()
        tags, links = [x[1:] for x in labels if x[0] == "#"], [x[1:] for x in labels if x[0] == "^"]
        tags += [x for x in pushed if x not in tags]
        marks = "".join([f" #{x}" for x in tags] + [f" ^{x}" for x in links])
        mark, mark2, under = mark or "", mark2 or "", line + (2 if key else 1)
        shape = f"{raw} {flag}{' ' + quoted(payee) if payee else ''} {quoted(narration)}{marks}{meta}\n{self._line(account, mark, shown(n, scale), currency)}{more}\n{self._line(account2, mark2, shown(-weight, places), by)}"
        out = [[account, mark, under, n, scale, currency, at_cost, at_price], [account2, mark2, under + 1, -weight, places, by, None, None]]
        return at, nth, ((date, flag, payee, narration, sorted(set(tags)), sorted(set(links)), line, sorted({account, account2}), shape), values, out, gained)

    def _row(self, head, line: int, metas: list, postings: list, pushed: list[str]) -> tuple:
        raw, flag, first, second, labels = head.groups()
        date = dt.date.fromisoformat(raw)
        payee, narration = (first, second) if second is not None else ("", first or "")
        payee, narration = T._plain_text(payee), T._plain_text(narration)
        labels = labels.split()
        tags, links = [x[1:] for x in labels if x[0] == "#"], [x[1:] for x in labels if x[0] == "^"]
        tags += [x for x in pushed if x not in tags]
        if len({k for k, *_ in metas}) != len(metas):
            raise _Other
        weights: dict[str, list[int]] = {}
        left, out, gained = None, [], []
        for (mark, account, number, sum_, currency, braces, cost, cost_currency, cost_date, _, price, price_currency), nth in postings:
            a = self.accounts.get(account)
            if a is None or date < a.opened or (a.closed and date > a.closed):
                raise _Other
            if currency is None:
                if left is not None:
                    raise _Other
                left = len(out)
                out.append([account, mark or "", nth, None, None, None, None, None])
                continue
            if a.currencies and currency not in a.currencies:
                raise _Other
            n, scale = plain_sum(sum_) if sum_ else plain_number(number)
            at_cost = at_price = None
            weight, places, by = n, scale, currency
            if price:
                p, s = plain_number(price)
                if p < 0:
                    raise _Other
                at_price = (p, s, price_currency)
                weight, places, by = n * p, scale + s, price_currency
            if braces:
                if not cost or n < 0:
                    raise _Other
                c, s = plain_number(cost)
                if c < 0:
                    raise _Other
                at_cost = (c, s, cost_currency, dt.date.fromisoformat(cost_date) if cost_date else date)
                weight, places, by = n * c, scale + s, cost_currency
                if a.booking != "NONE":
                    gained.append((account, gain(currency, shown(n, scale), shown(c, s), cost_currency, at_cost[3], None)))
            sums = weights.setdefault(by, [0, 0])
            if places > sums[1]:
                sums[0], sums[1] = sums[0] * 10 ** (places - sums[1]), places
            sums[0] += weight * 10 ** (sums[1] - places)
            if not -_EXACT < weight < _EXACT or not -_EXACT < sums[0] < _EXACT:
                raise _Other
            out.append([account, mark or "", nth, n, scale, currency, at_cost, at_price])
        if left is not None:
            open_ = [c for c, (n, _) in weights.items() if n] or list(weights)
            if len(open_) != 1:
                raise _Other
            n, scale = weights[open_[0]]
            allowed = self.accounts[out[left][0]].currencies
            if scale > SCALE or not -MOST < n < MOST or (allowed and open_[0] not in allowed):
                raise _Other
            out[left][3:6] = -n, scale, open_[0]
        elif any(n for n, _ in weights.values()):
            raise _Other
        marks = "".join([f" #{x}" for x in tags] + [f" ^{x}" for x in links])
        lines = [f"{raw} {flag}{' ' + quoted(payee) if payee else ''} {quoted(narration)}{marks}"]
        values = []
        for key, digits, string in metas:
            if digits:
                n, scale = plain_number(digits)
                if scale > 6:
                    raise _Other
                values.append((key, "number", shown(n, scale), n * 10 ** (SCALE - scale)))
                lines.append(f"  {key}: {values[-1][2]}")
            else:
                if not string:
                    raise _Other
                values.append((key, "string", string, None))
                lines.append(f"  {key}: {quoted(string)}".rstrip())
        for account, mark, _, n, scale, currency, cost, price in out:
            shape = posting_line(account, mark, shown(n, scale), currency)
            if cost is not None:
                shape += f" {{{shown(*cost[:2])} {cost[2]}, {cost[3]}}}"
            if price is not None:
                shape += f" @ {shown(*price[:2])} {price[2]}"
            lines.append(shape)
        entry = (date, flag, payee, narration, sorted(set(tags)), sorted(set(links)), line, sorted({p[0] for p in out}), "\n".join(lines))
        return entry, values, out, gained


def _decimals(values: list, scales: list | None = None):
    """decimal(28, 10) of integers with scales (None: scaled already); nulls as 0, to be masked."""
    import pyarrow as pa

    full = [v or 0 for v in values] if scales is None else [v * _TENS[SCALE - s] if v else 0 for v, s in zip(values, scales, strict=True)]
    data = b"".join([v.to_bytes(16, "little", signed=True) for v in full])
    nulls = None
    if scales is None and None in values:
        nulls = pa.array([v is not None for v in values], pa.bool_()).buffers()[1]
    return pa.Array.from_buffers(pa.decimal128(28, 10), len(full), [nulls, pa.py_buffer(data)])


_TENS = [10**i for i in range(SCALE + 1)]


def _lists(kind, sizes, values):
    import numpy as np
    import pyarrow as pa

    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets.tobytes())], children=[values])


def _struct(kind, columns: list, present: list | None = None):
    import pyarrow as pa

    mask = None if present is None else pa.array([not x for x in present], pa.bool_())
    return pa.StructArray.from_arrays(columns, fields=[kind.field(i) for i in range(kind.num_fields)], mask=mask)


class Columns:
    """Rows of plain transactions on their way out."""

    def __init__(self, schema, filename: str):
        self.schema, self.filename = schema, filename
        self.entries, self.keys, self.metas, self.postings, self.gained = [], [], [], [], []

    def add(self, row: tuple, key: tuple[int, int, int]) -> None:
        entry, metas, postings, gained = row
        self.entries.append(entry)
        self.keys.append(key)
        self.metas.append(metas)
        self.postings.append(postings)
        for account, one in gained:
            self.gained.append((entry[0], entry[6], account, pickle.dumps([one]), f"{account} {one[0]}"))

    def _batch(self, columns: dict, n: int):
        import pyarrow as pa

        given = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in self.schema]
        return pa.RecordBatch.from_arrays(given, schema=self.schema)

    def batches(self, least: int = 1):
        import pyarrow as pa

        if len(self.entries) < least:
            return
        kind = {f.name: f.type for f in self.schema}
        n = len(self.entries)
        date, flag, payee, narration, tags, links, line, accounts, text = map(list, zip(*self.entries, strict=True))
        pid, priority, rank = map(list, zip(*self.keys, strict=True))
        metas = [x for some in self.metas for x in some]
        key, sort, string, number = map(list, zip(*metas, strict=True)) if metas else ([], [], [], [])
        element, posting = kind["entry_meta"].value_type, kind["postings"].value_type
        at = lambda t, name: t.field(t.get_field_index(name)).type
        value = at(element, "value")
        objects = _struct(value, [pa.array(sort, pa.string()), pa.array(string, pa.string()), _decimals(number), pa.nulls(len(key), pa.date32()), pa.nulls(len(key), pa.bool_())])
        ps = [p for some in self.postings for p in some]
        account, mark, nth, units, scale, currency, cost, price = map(list, zip(*ps, strict=True)) if ps else ([] for _ in range(8))
        column = {"account": pa.array(account, pa.string()), "posting_flag": pa.array(mark, pa.string()), "posting_line": pa.array(nth, pa.int64()), "number": _decimals(units, scale), "scale": pa.array(scale, pa.int32()), "currency": pa.array(currency, pa.string())}
        c = [x or (0, 0, None, None) for x in cost]
        column["cost"] = _struct(at(posting, "cost"), [_decimals([x[0] for x in c], [x[1] for x in c]), pa.array([x[1] for x in c], pa.int32()), pa.array([x[2] for x in c], pa.string()), pa.array([x[3] for x in c], pa.date32()), pa.nulls(len(c), pa.string())], cost)
        c = [x or (0, 0, None) for x in price]
        column["price"] = _struct(at(posting, "price"), [_decimals([x[0] for x in c], [x[1] for x in c]), pa.array([x[1] for x in c], pa.int32()), pa.array([x[2] for x in c], pa.string())], price)
        column["posting_meta"] = pa.array([[]] * len(ps), at(posting, "posting_meta"))
        yield self._batch(
            {
                "part": pa.array(["entry"] * n, pa.string()), "pid": pa.array(pid, kind["pid"]), "priority": pa.array(priority, kind["priority"]), "rank": pa.array(rank, kind["rank"]), "date": pa.array(date, pa.date32()), "type": pa.array(["transaction"] * n, pa.string()), "flag": pa.array(flag, pa.string()), "payee": pa.array(payee, pa.string()),
                "narration": pa.array(narration, pa.string()), "tags": pa.array(tags, kind["tags"]), "links": pa.array(links, kind["links"]), "filename": pa.array([self.filename] * n, pa.string()), "lineno": pa.array(line, pa.int64()), "accounts": pa.array(accounts, kind["accounts"]), "is_valid": pa.array([True] * n, pa.bool_()),
                "text": pa.array(text, pa.string()), "entry_meta": _lists(kind["entry_meta"], [len(x) for x in self.metas], _struct(element, [pa.array(key, pa.string()), objects])),
                "postings": _lists(kind["postings"], [len(x) for x in self.postings], _struct(posting, [column[posting.field(i).name] for i in range(posting.num_fields)])),
            }, n,
        )
        if self.gained:
            date, line, account, payload, lots = map(list, zip(*self.gained, strict=True))
            yield self._batch({"part": pa.array(["gained"] * len(date), pa.string()), "date": pa.array(date, pa.date32()), "lineno": pa.array(line, pa.int64()), "account": pa.array(account, pa.string()), "payload": pa.array(payload, pa.binary()), "links": pa.array([[x] for x in lots], kind["links"])}, len(date))
        self.entries, self.keys, self.metas, self.postings, self.gained = [], [], [], [], []


def gained(payload: bytes):
    """What ``gain`` gave: (currency, units, number, cost's currency, date, label)."""
    for currency, units, number, *rest in pickle.loads(payload):
        yield currency, Decimal(units), Decimal(number), *rest
