"""Diagnostics as text with the lines around them, and as JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

from tallyspark.ledger import Ledger

BEFORE, AFTER, INDENT = 2, 2, "   "


def rendered(message: str, filename: str, line: int, source: str | None = None, column: int = 0) -> str:
    """Place and message, then the lines around the place, with a caret below its column if there is one."""
    head = f"{filename}:{line}: {message}" if filename else message
    if source is None or line < 1:
        return head
    lines, out = source.replace("\r\n", "\n").split("\n"), []
    for i in range(max(0, line - 1 - BEFORE), min(len(lines), line + AFTER)):
        out.append(f"{INDENT}{lines[i]}".rstrip())
        if i == line - 1 and column > 0:
            blank = "".join("\t" if c == "\t" else " " for c in lines[i][: column - 1])  # tabs keep the caret in place
            out.append(f"{INDENT}{blank}^")
    return "\n".join([head, "", *out])


def _rows(ledger: Ledger):
    return ledger.diagnostics.orderBy("filename", "lineno", "code", "message").toLocalIterator()


def errors_text(ledger: Ledger, sources: Mapping[str, str] | None = None) -> Iterator[str]:
    """Every diagnostic in order of file and line; ``sources``: text of the files to show lines of."""
    for r in _rows(ledger):
        yield rendered(f"{r.severity}: {r.message}", r.filename, r.lineno or 0, (sources or {}).get(r.filename))


def errors_json(ledger: Ledger) -> Iterator[str]:
    """One JSON object a diagnostic."""
    for r in _rows(ledger):
        place = {"filename": r.filename, "line": r.lineno}
        yield json.dumps({"type": r.code, "severity": r.severity, "message": r.message, "position": place, "date": str(r.date) if r.date else None, "account": r.account}, sort_keys=True)
