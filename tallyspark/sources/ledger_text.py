"""Parser of plain-text ledgers: one file's text to a list of directives.

The text is cut into tokens once; tokens are grouped into logical lines (a string may span several
physical ones). A directive starts at a date or keyword in the first column; indented lines below it are its
metadata and postings. Lines that start with neither are outline headings and are passed over. The
first error fails the file.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from decimal import Decimal, DivisionByZero, InvalidOperation
from typing import NamedTuple


class ParseError(ValueError):
    def __init__(self, message: str, filename: str, line: int, column: int = 1):
        super().__init__(f"{filename}:{line}:{column}: {message}")
        self.message, self.filename, self.line, self.column = message, filename, line, column


@dataclass
class Amount:
    number: Decimal | None
    currency: str | None


@dataclass
class Cost:
    """A cost in braces: per unit, total (``{{}}``), both (``{a # b C}``) or merged (``{*}``)."""

    number: Decimal | None = None
    total: Decimal | None = None
    currency: str | None = None
    date: dt.date | None = None
    label: str | None = None
    merge: bool = False
    is_total: bool = False

    @property
    def empty(self) -> bool:
        return self.number is None and self.total is None and self.date is None and self.label is None and not self.merge


@dataclass
class Posting:
    account: str
    units: Amount | None = None
    cost: Cost | None = None
    price: Amount | None = None
    price_total: bool = False
    flag: str = ""
    meta: list = field(default_factory=list)
    line: int = 0


@dataclass
class Directive:
    kind: str
    date: dt.date
    filename: str
    line: int
    column: int = 1
    meta: list = field(default_factory=list)
    values: dict = field(default_factory=dict)
    postings: list[Posting] = field(default_factory=list)

    def __getattr__(self, name: str):
        try:
            return self.__dict__["values"][name]
        except KeyError:
            raise AttributeError(name) from None


@dataclass
class File:
    filename: str
    directives: list[Directive] = field(default_factory=list)
    options: list[tuple[str, str, int]] = field(default_factory=list)
    includes: list[tuple[str, int]] = field(default_factory=list)
    plugins: list[tuple[str, str | None]] = field(default_factory=list)


# fixed values: what may stand in a ledger
FLAGS = "*!#&?%PSTCURM"
KINDS = ("txn", "balance", "open", "close", "commodity", "pad", "note", "document", "price", "event", "query", "custom")
ACCOUNT = r"[A-Z\u0080-\U0010ffff][A-Za-z0-9\u0080-\U0010ffff-]*(?::[A-Z0-9\u0080-\U0010ffff][A-Za-z0-9\u0080-\U0010ffff-]*)+"
CURRENCY = r"[A-Z][A-Z0-9'._-]{0,22}[A-Z0-9]"
TOKENS = re.compile(
    rf"""
    (?P<newline>\r\n|\n|\r) | (?P<space>[ \t]+) | (?P<comment>;[^\r\n]*)
  | (?P<date>\d{{4}}[-/]\d{{2}}[-/]\d{{2}}(?![\d])) | (?P<string>"(?:[^"\\]|\\.)*")
  | (?P<number>\d{{1,3}}(?:,\d{{3}})+(?![\d,])(?:\.\d*)?|\d+(?:\.\d*)?|\.\d+)
  | (?P<account>{ACCOUNT}) | (?P<bool>TRUE\b|FALSE\b) | (?P<none>NULL\b) | (?P<currency>{CURRENCY}(?![a-z]))
  | (?P<key>[a-z][A-Za-z0-9_-]+:(?=[ \t\r\n]|$)) | (?P<word>[a-z]+) | (?P<tag>\#[A-Za-z0-9_/.-]+) | (?P<link>\^[A-Za-z0-9_/.-]+)
  | (?P<op>\{{\{{|\}}\}}|@@|[{{}}@*!+\-/(),~\#&?%|:=<>]) | (?P<flag>[A-Z](?=[ \t])) | (?P<other>.)
    """,
    re.X | re.S,
)
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
ESCAPES = {'"': '"', "\\": "\\", "n": "\n", "t": "\t", "r": "\r"}


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    column: int


def _logical_line(text: str, at: int, line: int) -> tuple[list[Token], int, int]:
    """The tokens of the logical line that starts at ``at``, where and at which line the next one starts."""
    current, start = [], at
    while at < len(text):
        m = TOKENS.match(text, at)
        kind, value = m.lastgroup, m[0]
        token = Token(kind, value, line, len(text[start:at].encode()) + 1)
        at = m.end()
        if kind == "newline":
            return current, at, line + 1
        if kind == "string" and ("\n" in value):
            line += value.count("\n")
            start = m.start() + value.rfind("\n") + 1
        if kind == "comment" or (kind == "space" and current):
            continue
        current.append(token)
    return current, at, line


def _tokens(text: str, line: int = 1) -> list[list[Token]]:
    """Logical lines of tokens; an indented line starts with a ``space`` token."""
    lines, at = [], 0
    while at < len(text):
        current, at, line = _logical_line(text, at, line)
        if current:
            lines.append(current)
    return lines


class _Line:
    def __init__(self, tokens: list[Token], filename: str):
        self.tokens, self.filename, self.at = tokens, filename, 0

    def peek(self, ahead: int = 0) -> Token | None:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else None

    def fail(self, what: str):
        t = self.peek() or self.tokens[-1]
        found = f"found {t.text!r}" if self.peek() else "the line ends"
        raise ParseError(f"expected {what}, {found}", self.filename, t.line, t.column)

    def take(self, kind: str, *texts: str) -> str | None:
        t = self.peek()
        if t and t.kind == kind and (not texts or t.text in texts):
            self.at += 1
            return t.text
        return None

    def need(self, kind: str, *texts: str) -> str:
        found = self.take(kind, *texts)
        if found is None:
            self.fail(" or ".join(texts) or f"a {kind}")
        return found

    def end(self) -> None:
        if self.peek():
            self.fail("the end of the line")

    def string(self) -> str:
        raw, t = self.need("string"), self.tokens[self.at - 1]
        if "\\" not in raw:
            return raw[1:-1]

        def one(m):
            if m[1] not in ESCAPES:
                raise ParseError(f"unknown escape \\{m[1]}", self.filename, t.line, t.column)
            return ESCAPES[m[1]]

        return re.sub(r"\\(.)", one, raw[1:-1], flags=re.S)

    def date(self) -> dt.date:
        raw, t = self.need("date"), self.tokens[self.at - 1]
        try:
            return dt.date.fromisoformat(raw.replace("/", "-"))
        except ValueError:
            raise ParseError(f"invalid date {raw}", self.filename, t.line, t.column) from None

    def starts_number(self) -> bool:
        t = self.peek()
        return bool(t) and (t.kind == "number" or (t.kind == "op" and t.text in "+-("))

    def number(self) -> Decimal:
        """Sums and products with parentheses; a plain number keeps the digits it was written with."""
        left = self._product()
        while op := self.take("op", "+", "-"):
            right = self._product()
            left = _short(left + right if op == "+" else left - right)
        return left

    def _product(self) -> Decimal:
        left = self._factor()
        while op := self.take("op", "*", "/"):
            t, right = self.peek(-1), self._factor()
            try:
                left = _short(left * right if op == "*" else left / right)
            except (DivisionByZero, InvalidOperation):
                raise ParseError("division by zero", self.filename, t.line, t.column) from None
        return left

    def _factor(self) -> Decimal:
        if self.take("op", "-"):
            return -self._factor()
        if self.take("op", "+"):
            return self._factor()
        if self.take("op", "("):
            inner = self.number()
            self.need("op", ")")
            return inner
        return Decimal(self.need("number").replace(",", "").rstrip("."))

    def amount(self) -> Amount:
        return Amount(self.number(), self.need("currency"))

    def partial_amount(self) -> Amount | None:
        number = self.number() if self.starts_number() else None
        currency = self.take("currency")
        return Amount(number, currency) if number is not None or currency else None

    def cost(self) -> Cost:
        out = Cost(is_total=self.need("op", "{", "{{") == "{{")
        close = "}}" if out.is_total else "}"
        while not self.take("op", close):
            t = self.peek()
            if t is None:
                self.fail(close)
            if self.take("op", "*"):
                out.merge = True
            elif t.kind == "date":
                out.date = self.date()
            elif t.kind == "string":
                out.label = self.string()
            elif self.starts_number() or t.kind == "currency" or t.text == "#":
                if self.starts_number():
                    out.number = self.number()
                if self.take("op", "#"):
                    out.total = self.number() if self.starts_number() else None
                out.currency = self.take("currency") or out.currency
            else:
                self.fail("a part of a cost")
            if not self.take("op", ",") and not (self.peek() and self.peek().text == close):
                self.fail(f"',' or {close!r}")
        return out

    def labels(self) -> tuple[list[str], list[str]]:
        tags, links = [], []
        while t := self.peek():
            if t.kind == "tag":
                tags.append(self.need("tag")[1:])
            elif t.kind == "link":
                links.append(self.need("link")[1:])
            else:
                break
        return tags, links

    def value(self):
        """A metadata or custom value as (kind, value)."""
        t = self.peek()
        if t is None:
            return ("none", None)
        if t.kind == "string":
            return ("string", self.string())
        if t.kind == "date":
            return ("date", self.date())
        if t.kind == "bool":
            return ("bool", self.need("bool") == "TRUE")
        if t.kind in ("account", "currency"):
            return (t.kind, self.need(t.kind))
        if t.kind in ("tag", "link"):
            return (t.kind, self.need(t.kind)[1:])
        if t.kind == "none":
            self.need("none")
            return ("none", None)
        if self.starts_number():
            number, currency = self.number(), self.take("currency")
            return ("amount", Amount(number, currency)) if currency else ("number", number)
        self.fail("a value")


def _short(x: Decimal) -> Decimal:
    text = format(round(x, 16), "f")
    return Decimal(text.rstrip("0").rstrip(".") if "." in text else text)


def _transaction(line: _Line, flag: str) -> dict:
    texts = []
    while line.peek() and line.peek().kind == "string":
        texts.append(line.string())
    if len(texts) > 2:
        line.fail("at most a payee and a narration")
    tags, links = line.labels()
    return {"flag": flag, "payee": texts[0] if len(texts) == 2 else "", "narration": texts[-1] if texts else "", "tags": tags, "links": links}


def _directive(line: _Line, kind: str) -> dict:
    match kind:
        case "open":
            out = {"account": line.need("account"), "currencies": []}
            while c := line.take("currency"):
                out["currencies"].append(c)
                if not line.take("op", ","):
                    break
            out["booking"] = line.string() if line.peek() else ""
        case "close":
            out = {"account": line.need("account")}
        case "commodity":
            out = {"currency": line.need("currency")}
        case "balance":
            out = {"account": line.need("account"), "number": line.number(), "tolerance": None}
            if line.take("op", "~"):
                out["tolerance"] = line.number()
            out["currency"] = line.need("currency")
        case "pad":
            out = {"account": line.need("account"), "source": line.need("account")}
        case "note":
            out = {"account": line.need("account"), "comment": line.string()}
        case "document":
            out = {"account": line.need("account"), "path": line.string()}
            out["tags"], out["links"] = line.labels()
        case "price":
            out = {"currency": line.need("currency"), "amount": line.amount()}
        case "event":
            out = {"name": line.string(), "value": line.string()}
        case "query":
            out = {"name": line.string(), "text": line.string()}
        case "custom":
            out = {"type": line.string(), "custom": []}
            while line.peek():
                out["custom"].append(line.value())
    return out


def _posting(line: _Line) -> Posting:
    first = line.peek()
    flag = line.take("op", "*", "!") or ""
    out = Posting(line.need("account"), flag=flag, line=first.line)
    out.units = line.partial_amount()
    if line.peek() and line.peek().text in ("{", "{{"):
        out.cost = line.cost()
    if at := line.take("op", "@", "@@"):
        out.price_total = at == "@@"
        out.price = line.partial_amount() or Amount(None, None)
    return out


# Lines of the commonest forms, each up to its line break; all others go by tokens.
_END = r"[ \t]*(?:\r\n|\n)"
_TEXT = r'"([^"\\\r\n]*(?:\\["\\ntr][^"\\\r\n]*)*)"'
_NUMBER = r"-?\d+(?:\.\d+)?"
_UNIT = rf"(?!(?:TRUE|FALSE|NULL)\b){CURRENCY}(?![a-z])"
_BLANK = re.compile(_END)
_PLAIN_HEAD = re.compile(rf"(\d{{4}}-\d{{2}}-\d{{2}})[ \t]+([*!PSTCURM])(?=[ \t\r\n])(?:[ \t]+{_TEXT})?(?:[ \t]+{_TEXT})?((?:[ \t]+[#^][A-Za-z0-9_/.-]+)*){_END}")
_PLAIN_POSTING = re.compile(
    rf"[ \t]+(?:([*!])[ \t]+)?({ACCOUNT})(?:[ \t]+(?:({_NUMBER})|(\([-+*/().\d \t]+?))[ \t]+({_UNIT})(?:[ \t]*(\{{(?:({_NUMBER})[ \t]+({_UNIT})(?:,[ \t]*(\d{{4}}-\d{{2}}-\d{{2}}))?|(\*))?\}}))?(?:[ \t]+@[ \t]+({_NUMBER})[ \t]+({_UNIT}))?)?{_END}"
)
_PLAIN_META = re.compile(rf'[ \t]+([a-z][A-Za-z0-9_-]+):[ \t]+(?:(\d+(?:\.\d+)?)|"([^"\\\r\n]*)"){_END}')

_SUM = re.compile(r"(?P<number>\d+(?:\.\d*)?|\.\d+)|(?P<op>[-+*/()])|(?P<other>\.)")


def _signed(raw: str) -> Decimal:
    return -Decimal(raw[1:]) if raw[0] == "-" else Decimal(raw)


def _plain_text(raw: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES[m[1]], raw) if "\\" in raw else raw


def _plain_head(m: re.Match, filename: str, line: int, pushed: list[str], metas: list) -> Directive | None:
    raw, flag, first, second, labels = m.groups()
    try:
        date = dt.date.fromisoformat(raw)
    except ValueError:
        return None
    payee, narration = (first, second) if second is not None else ("", first or "")
    labels = labels.split()
    tags = [x[1:] for x in labels if x[0] == "#"]
    values = {"flag": flag, "payee": _plain_text(payee), "narration": _plain_text(narration), "tags": tags, "links": [x[1:] for x in labels if x[0] == "^"]}
    tags += [x for x in pushed if x not in tags]
    return Directive("transaction", date, filename, line, 1, sorted(dict(metas).items()), values)


def _plain_posting(m: re.Match, line: int) -> Posting | None:
    flag, account, number, sum_, currency, braces, cost, cost_currency, cost_date, merge, price, price_currency = m.groups()
    out = Posting(account, flag=flag or "", line=line)
    if currency is None:
        return out
    try:
        if sum_:
            inner = _Line([Token(m.lastgroup, m[0], line, 1) for m in _SUM.finditer(sum_)], "")
            number = inner.number()
            inner.end()
        else:
            number = _signed(number)
        if braces:
            out.cost = Cost(_signed(cost) if cost else None, None, cost_currency, dt.date.fromisoformat(cost_date) if cost_date else None, None, bool(merge))
    except ValueError:
        return None
    out.units = Amount(number, currency)
    if price:
        out.price = Amount(_signed(price), price_currency)
    return out


def parse(text: str, filename: str = "<text>", start: int = 1, tags: Iterable[str] = (), metas: Iterable[tuple] = (), plain=None) -> File:
    """``start``, ``tags`` and ``metas``: line of the text's beginning in its file, and what is pushed there.
    ``plain`` takes blocks before the parser does; what it makes of one stands among the directives."""
    if wrong := _CONTROL.search(text):
        raise ParseError(f"control character {wrong[0]!r}", filename, text.count("\n", 0, wrong.start()) + start)
    out, tags, metas, owner = File(filename), list(tags), list(metas), None
    at, nth = 0, start
    while at < len(text):
        if m := _BLANK.match(text, at):
            at, nth = m.end(), nth + 1
            continue
        if text[at] not in " \t":
            if plain is not None and (taken := plain(text, at, nth, tags, metas)):
                at, nth, row = taken
                owner = None
                out.directives.append(row)
                continue
            if (m := _PLAIN_HEAD.match(text, at)) and (found := _plain_head(m, filename, nth, tags, metas)):
                owner, at, nth = found, m.end(), nth + 1
                out.directives.append(owner)
                continue
        elif owner is not None and owner.kind == "transaction":
            if (m := _PLAIN_POSTING.match(text, at)) and (posting := _plain_posting(m, nth)):
                owner.postings.append(posting)
                at, nth = m.end(), nth + 1
                continue
            if m := _PLAIN_META.match(text, at):
                target = owner.postings[-1] if owner.postings else owner
                target.meta.append((m[1], ("number", Decimal(m[2])) if m[2] else ("string", m[3])))
                at, nth = m.end(), nth + 1
                continue
        tokens, at, nth = _logical_line(text, at, nth)
        if not tokens:
            continue
        line, first = _Line(tokens, filename), tokens[0]
        if first.kind == "space":
            line.at = 1
            if line.peek() is None:
                continue
            if owner is None:
                continue
            _indented(line, owner)
            line.end()
            continue
        owner = None
        if first.kind == "date":
            owner = _dated(line, tags, metas)
            out.directives.append(owner)
        elif first.kind == "word" and first.text in ("option", "include", "plugin", "pushtag", "poptag"):
            line.at = 1
            if first.text == "option":
                out.options.append((line.string(), line.string(), first.line))
            elif first.text == "include":
                out.includes.append((line.string(), first.line))
            elif first.text == "plugin":
                out.plugins.append((line.string(), line.string() if line.peek() else None))
            elif first.text == "pushtag":
                tags.append(line.need("tag")[1:])
            else:
                tag = line.need("tag")[1:]
                if tag not in tags:
                    raise ParseError(f"poptag of #{tag}, which was not pushed", filename, first.line)
                tags.remove(tag)
        elif first.kind == "word" and first.text in ("pushmeta", "popmeta"):
            line.at = 1
            key = line.need("key")[:-1]
            if first.text == "pushmeta":
                metas.append((key, line.value()))
            else:
                if key not in [k for k, _ in metas]:
                    raise ParseError(f"popmeta of {key}, which was not pushed", filename, first.line)
                del metas[max(i for i, (k, _) in enumerate(metas) if k == key)]
        elif first.kind in ("word", "key", "account", "number", "string", "currency", "link"):
            line.fail("a directive")
        else:
            continue  # an outline heading or other line that is not ledger text
        line.end()
    return out


def line_breaks(text: str) -> int:
    """Line breaks as the parser counts them: in strings, line feeds only."""
    if "\r" not in text:
        return text.count("\n")
    found = [(m.lastgroup, m[0]) for m in TOKENS.finditer(text)]
    return sum(1 if kind == "newline" else value.count("\n") if kind == "string" else 0 for kind, value in found)


def pushes(text: str) -> list[tuple]:
    """(pushtag, tag), (pushmeta, (key, value)), (poptag, tag) and (popmeta, key) in their order, up to the first error."""
    out = []
    for tokens in _tokens(text):
        line, word = _Line(tokens, ""), tokens[0].text
        if tokens[0].kind == "word" and word in ("pushtag", "poptag", "pushmeta", "popmeta"):
            line.at = 1
            try:
                arg = line.need("tag")[1:] if word.endswith("tag") else line.need("key")[:-1]
                out.append((word, (arg, line.value()) if word == "pushmeta" else arg))
            except ParseError:
                break
    return out


def _dated(line: _Line, tags: list[str], metas: list) -> Directive:
    first, date = line.peek(), line.date()
    t = line.peek()
    if t is None:
        line.fail("a directive")
    column = first.column
    if t.kind == "word" and t.text in KINDS and t.text != "txn":
        line.at += 1
        out = Directive(t.text, date, line.filename, first.line, column, values=_directive(line, t.text))
    elif (t.kind == "word" and t.text == "txn") or (t.text in FLAGS and len(t.text) == 1):
        line.at += 1
        out = Directive("transaction", date, line.filename, first.line, column, values=_transaction(line, "*" if t.text == "txn" else t.text))
        out.values["tags"] += [x for x in tags if x not in out.values["tags"]]
    else:
        line.fail("a directive")
    out.meta += sorted(dict(metas).items())
    return out


def _indented(line: _Line, owner: Directive) -> None:
    t = line.peek()
    if t.kind == "key":
        key = line.need("key")[:-1]
        target = owner.postings[-1] if owner.postings else owner
        target.meta.append((key, line.value()))
    elif owner.kind == "transaction" and t.kind in ("tag", "link"):
        tags, links = line.labels()
        owner.values["tags"] += tags
        owner.values["links"] += links
    elif owner.kind == "transaction":
        owner.postings.append(_posting(line))
    else:
        line.fail("metadata")
