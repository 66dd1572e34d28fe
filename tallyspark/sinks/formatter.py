"""Formats ledger text: postings share one indent, numbers end and currencies start in one column.

The indent is the one most postings have (of equally frequent ones the widest), two spaces where there are none. The
column follows from the widest prefix and the widest number as written, before the indent is changed, counting display
columns (wide characters take two). Costs and prices are spaced evenly. Comments, blank lines, metadata and all other
lines stay as written, but for spaces at their ends and strings over several lines, whose line breaks become escapes.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.sources.ledger_text import ESCAPES, TOKENS

GAP = 2
INDENT, PREFIX, DIGITS, COLUMN = 2, 40, 10, 52  # where the text has no postings or amounts to go by
_ESCAPED = {value: "\\" + name for name, value in ESCAPES.items()}
_AMOUNT_OPS = frozenset("+-*/()")
STYLES = ("original", "escaped", "literal")


def width(text: str) -> int:
    """Display columns of a text."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


@dataclass
class _Line:
    """One logical line: what stands before its amount, the amount, and the tokens after it."""

    tokens: list[tuple[str, str]]
    indent: int = 0
    flag: str = ""
    head: str = ""
    number: str = ""
    rest: list[tuple[str, str]] | None = None
    tolerance: str = ""
    kind: str = "other"

    @property
    def prefix(self) -> int:
        return self.indent + (len(self.flag) + 1 if self.flag else 0) + width(self.head)


def _lines(text: str) -> list[_Line]:
    found, current = [], []
    for m in TOKENS.finditer(text):
        if m.lastgroup == "newline":
            found.append(_read(current))
            current = []
        else:
            current.append((m.lastgroup, m[0]))
    return [*found, _read(current)] if current else found


def _amount(tokens: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str]]]:
    """The number that tokens begin with, as written, and what follows it; no number: an empty text."""
    at, seen = 0, False
    while at < len(tokens) and (tokens[at][0] in ("number", "space") or (tokens[at][0] == "op" and tokens[at][1] in _AMOUNT_OPS)):
        seen |= tokens[at][0] == "number"
        at += 1
    return ("".join(v for _, v in tokens[:at]).strip(), tokens[at:]) if seen else ("", tokens)


def _read(tokens: list[tuple[str, str]]) -> _Line:
    while tokens and tokens[-1][0] == "space":
        tokens = tokens[:-1]
    line = _Line(tokens)
    kinds = [k for k, _ in tokens]
    if not tokens:
        line.kind = "blank"
    elif kinds[0] == "comment" or kinds == ["space", "comment"]:
        line.kind = "comment"
    elif kinds[0] == "space":
        body = tokens[1:]
        if len(body) > 2 and body[0][0] in ("op", "flag") and len(body[0][1]) == 1 and body[1][0] == "space":
            line.flag, body = body[0][1], body[2:]
        if body and body[0][0] == "account":
            line.kind, line.indent, line.head = "posting", len(tokens[0][1]), body[0][1]
            line.number, line.rest = _amount(body[1:])
    elif kinds[:5] in (["date", "space", "word", "space", "account"], ["date", "space", "word", "space", "currency"]):
        if (tokens[2][1], kinds[4]) in (("balance", "account"), ("price", "currency")):
            line.kind, line.head = "dated", f"{tokens[0][1]} {tokens[2][1]} {tokens[4][1]}"
            line.number, line.rest = _amount(tokens[5:])
            if line.rest and line.rest[0] == ("op", "~"):
                line.tolerance, line.rest = _amount(line.rest[1:])
    if line.number and (not line.rest or line.rest[0][0] != "currency"):
        line.number, line.rest, line.tolerance = "", None, ""  # not a whole amount
        line.kind = line.kind if line.kind == "posting" else "other"
    return line


def _string(raw: str, style: str) -> str:
    if style == "original" and "\n" not in raw and "\r" not in raw:
        return raw
    value = re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), raw[1:-1], flags=re.S)
    kept = _ESCAPED if style != "literal" else {c: _ESCAPED[c] for c in '"\\'}
    return '"' + "".join(kept.get(c, c) for c in value) + '"'


def _written(tokens: list[tuple[str, str]], style: str) -> str:
    return "".join(_string(v, style) if k == "string" else v for k, v in tokens)


def _spaced(tokens: list[tuple[str, str]], style: str) -> str:
    """What follows a number: single spaces, none inside the braces of a cost, two before metadata; comments as they stand."""
    out, depth, before = [], 0, ""
    for kind, value in tokens:
        if kind == "space":
            before = value
            continue
        last = out[-1] if out else ""
        if kind == "comment":
            space = before
        elif value in ("}", "}}", ",") and depth or last in ("{", "{{"):
            space = ""
        elif value in ("{", "{{", "@", "@@") or last in ("@", "@@") or (last == "," and depth):
            space = " "
        elif kind == "key":
            space = "  "
        else:
            space = " " if before else ""
        depth += (value in ("{", "{{")) - (value in ("}", "}}"))
        out += [space] * bool(out) + [_string(value, style) if kind == "string" else value]
        before = ""
    return "".join(out)


def formatted(
    text: str,
    column: int | None = None,
    prefix_width: int | None = None,
    num_width: int | None = None,
    indent: int | None = None,
    comments: bool = True,
    blanks: bool = True,
    style: str = "original",
) -> str:
    """``column``: where currencies start, counted from 1; else ``prefix_width`` and ``num_width`` give it, and what
    is not given is as wide as the widest line needs. ``indent``: of postings. ``comments``, ``blanks``: whether
    they are kept. ``style`` of strings: as written, all escaped, or with line breaks and tabs as they are (quotes
    and backslashes stay escaped, so that the text parses). An empty text stays empty; any other ends with a line break.
    """
    if style not in STYLES:
        raise ValueError(f"style is one of {', '.join(STYLES)}")
    lines = _lines(text)
    if indent is None:
        seen = Counter(x.indent for x in lines if x.kind == "posting")
        indent = max(seen, key=lambda n: (seen[n], n), default=INDENT)
    if column is None:
        sized = [x for x in lines if x.number]
        prefix = prefix_width or max((x.prefix for x in sized), default=PREFIX)
        digits = num_width or max((width(x.number) for x in sized), default=DIGITS)
        column = prefix + GAP + digits + 2 if sized or prefix_width or num_width else COLUMN
    out = []
    for x in lines:
        if x.kind == "blank":
            out += [""] * blanks
            continue
        if x.kind == "comment":
            inner = x.tokens[0][0] == "space"
            out += [" " * (indent * inner) + x.tokens[-1][1].rstrip()] * comments
            continue
        if not comments and x.tokens[-1][0] == "comment":
            x = _read(x.tokens[:-1])
        if x.kind not in ("posting", "dated"):
            out.append(_written(x.tokens, style).rstrip())
            continue
        x.indent = indent if x.kind == "posting" else 0
        line = " " * x.indent + (x.flag + " " if x.flag else "") + x.head
        if x.number:
            number = f"{x.number} ~ {x.tolerance}" if x.tolerance else x.number
            line += " " * max(GAP, column - x.prefix - width(number) - 2) + number + " " + _spaced(x.rest, style)
        else:
            at = next(i for i, t in enumerate(x.tokens) if t[0] in ("account", "currency"))
            line += _written(x.tokens[at + 1 :], style)
        out.append(line.rstrip())
    return "\n".join(out) + "\n" if out else ""


def format_files(files: DataFrame, **options) -> DataFrame:
    """path, content (bytes) to path, text: every file on its own, with the options of ``formatted``.

    A content that is null gives null; one that is not UTF-8 gives null too, since it cannot be read.
    """

    def run(batches):
        for rows in batches:
            texts = []
            for content in rows["content"]:
                try:
                    texts.append(None if content is None else formatted(bytes(content).decode(), **options))
                except UnicodeDecodeError:
                    texts.append(None)
            rows["text"] = texts
            yield rows[["path", "text"]]

    return files.select(F.col("path"), F.col("content")).mapInPandas(run, "path string, text string")
