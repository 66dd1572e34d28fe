"""Command line: check, query, format and lex.

    python -m tallyspark.cli check [--json] LEDGER
    python -m tallyspark.cli query [-f text|csv] [-m] [-o FILE] LEDGER [QUERY]     (without a query: a shell on standard input)
    python -m tallyspark.cli format FILE
    python -m tallyspark.cli lex FILE
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from tallyspark.language.syntax import Print, QueryError, parse
from tallyspark.session import session
from tallyspark.sinks.errors import errors_json, errors_text
from tallyspark.sinks.formatter import STYLES, formatted
from tallyspark.sinks.layout import csv_lines, text_table
from tallyspark.sinks.printing import printed
from tallyspark.sources import ledger_text
from tallyspark.sources.loader import load


def check(args) -> int:
    ledger = load(session(args.master), args.ledger)
    names = [r.filename for r in ledger.diagnostics.select("filename").distinct().collect()]
    sources = {n: Path(n).read_text(errors="replace") for n in names if Path(n).is_file()}
    lines = errors_json(ledger) if args.json else (x + "\n" for x in errors_text(ledger, sources))
    for line in lines:
        print(line)
    return int(not ledger.diagnostics.filter("severity <> 'note'").isEmpty())


def query(args) -> int:
    ledger = load(session(args.master), args.ledger)
    out = open(args.output, "w", newline="") if args.output else sys.stdout
    try:
        if args.query is not None:
            answer(ledger, args.query, args, out)
        else:
            shell(ledger, args, sys.stdin, out)
    finally:
        if args.output:
            out.close()
    return 0


def answer(ledger, text: str, args, out) -> None:
    """The lines of one statement, or its error."""
    try:
        if isinstance(parse(text), Print):
            lines = (x + "\n" for x in printed(ledger, text))
        elif args.format == "csv" or args.numberify:
            lines = csv_lines(ledger.query(text), args.numberify)
        else:
            lines = (x + "\n" for x in text_table(ledger.query(text)))
        out.writelines(lines)
    except QueryError as e:
        out.write(f"ERROR: {e}\n")


def shell(ledger, args, lines, out) -> None:
    """Answers a statement a line until ``exit``, ``quit`` or the end of the input."""
    prompt = "tallyspark> " if getattr(lines, "isatty", lambda: False)() else ""
    while True:
        out.write(prompt)
        out.flush()
        line = lines.readline()
        text = line.strip()
        if not line or text.rstrip(";").lower() in ("exit", "quit", ".exit", ".quit"):
            return
        if text:
            answer(ledger, text, args, out)


def format_file(args) -> int:
    options = {"comments": not args.no_comments, "blanks": not args.no_blanks, "style": args.strings}
    sys.stdout.write(formatted(Path(args.file).read_text(), args.column, args.prefix_width, args.num_width, args.indent, **options))
    return 0


def lex(args) -> int:
    for line in ledger_text._tokens(Path(args.file).read_text()):
        for t in line:
            print(f"{t.line}:{t.column}\t{t.kind}\t{t.text!r}")
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="tallyspark")
    top.add_argument("--master", default="local[*]")
    commands = top.add_subparsers(required=True)
    c = commands.add_parser("check")
    c.add_argument("--json", action="store_true")
    c.add_argument("ledger")
    c.set_defaults(run=check)
    c = commands.add_parser("query")
    c.add_argument("-f", "--format", choices=("text", "csv"), default="text")
    c.add_argument("-m", "--numberify", action="store_true")
    c.add_argument("-o", "--output")
    c.add_argument("ledger")
    c.add_argument("query", nargs="?")
    c.set_defaults(run=query)
    c = commands.add_parser("format")
    for size in ("--column", "--prefix-width", "--num-width", "--indent"):
        c.add_argument(size, type=int)
    c.add_argument("--no-comments", action="store_true")
    c.add_argument("--no-blanks", action="store_true")
    c.add_argument("--strings", choices=STYLES, default="original")
    c.add_argument("file")
    c.set_defaults(run=format_file)
    c = commands.add_parser("lex")
    c.add_argument("file")
    c.set_defaults(run=lex)
    args = top.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
