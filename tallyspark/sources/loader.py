"""Ledger files to a Ledger: includes, checks and booking, as tables.

The driver only walks the names of included files; their contents stay on the executors. Every file is parsed where it
is read, on its own: the tags and metadata it pushes hold for it alone. Parsed files then meet by ledger: its
directives are checked and booked in order, which is one task per ledger; any number of ledgers (``load_many``) run
side by side. The result is written once, as one table of rows by part. A file that is null counts as empty.
"""

from __future__ import annotations

import datetime as dt
import pickle
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.ledger import Ledger
from tallyspark.operators.processing import Ledger as Process
from tallyspark.operators.processing import digits
from tallyspark.plans import values as V
from tallyspark.plans.rows import ENTRY, POSTING
from tallyspark.sources import ledger_text as T
from tallyspark.sources.config import config_of
from tallyspark.sources.printer import directive_text

FORM = {
    "part": "string", "ledger": "string", **POSTING, "text": "string", "base": "string", "quote": "string", "rate": V.NUMBER, "open": "date", "close": "date", "currencies": "array<string>", "booking": "string",
    "severity": "string", "code": "string", "message": "string", "detail": "string",
}
_SCHEMA = ", ".join(f"`{c}` {t}" for c, t in FORM.items())
_TEN = Decimal(1).scaleb(-10)
_DATED = re.compile(r"^(\d{4}-\d{2}-\d{2})\.")


def _number(x: Decimal | None) -> Decimal | None:
    return None if x is None else x.quantize(_TEN)


def _object(value) -> dict | None:
    kind, v = value
    if kind == "none":
        return None
    number = v.number if kind == "amount" else v if kind == "number" else None
    text = f"{v.number} {v.currency}" if kind == "amount" else str(v)
    return {"kind": "number" if kind == "number" else kind if kind in ("date", "bool") else "string", "s": text, "n": _number(number), "d": v if kind == "date" else None, "b": v if kind == "bool" else None}


def _meta(items: list) -> list[dict]:
    return [{"key": k, "value": _object(v)} for k, v in items]


@dataclass
class Unread:
    """A file that could not be parsed."""

    filename: str
    message: str
    line: int


def read_file(name: str, content: str | bytes | None, *start) -> T.File | Unread:
    """``start``: as of ``ledger_text.parse``, of a text that is a part of its file."""
    try:
        return T.parse(content if isinstance(content, str) else bytes(content or b"").decode(), name, *start)
    except UnicodeDecodeError as e:
        return Unread(name, f"the file is not UTF-8: {e.reason} at byte {e.start}", bytes(content).count(b"\n", 0, e.start) + 1)
    except T.ParseError as e:
        return Unread(e.filename, e.message, e.line)


def rows_of_directive(d: T.Directive, is_valid: bool) -> tuple[dict, dict, list[dict]]:
    """Columns of an entry but for its number, those that are not its postings' too, and what each posting adds."""
    is_txn = d.kind == "transaction"
    entry = {
        "date": d.date, "type": d.kind, "flag": d.flag if is_txn else None, "payee": d.payee if is_txn else None, "narration": d.narration if is_txn else None,
        "tags": sorted(set(d.tags)) if is_txn else None, "links": sorted(set(d.links)) if is_txn else None, "filename": d.filename, "lineno": d.line, "entry_meta": _meta(d.meta),
        "accounts": sorted({p.account for p in d.postings}), "is_valid": is_valid,
    }
    postings = []
    for p in d.postings:
        units = p.units or T.Amount(None, None)
        cost = None
        if p.cost is not None and p.cost.number is not None:
            cost = {"number": _number(p.cost.number), "scale": digits(p.cost.number), "currency": p.cost.currency, "date": p.cost.date, "label": p.cost.label}
        price = None
        if p.price is not None and p.price.number is not None:
            price = {"number": _number(p.price.number), "scale": digits(p.price.number), "currency": p.price.currency}
        postings.append({"account": p.account, "posting_flag": p.flag, "posting_line": p.line, "number": _number(units.number), "scale": digits(units.number) if units.number is not None else None, "currency": units.currency, "cost": cost, "price": price, "posting_meta": _meta(p.meta)})
    v = d.values
    more = {"account": v.get("account"), "text": directive_text(d), "currency": v.get("currency"), "number": _number(v.get("number")), "detail": v.get("source") or v.get("comment") or v.get("path") or v.get("value")}
    return entry, more, postings


def rows_of(
    ledger: str, files: list[T.File | Unread], existing: set[str] | None = None, extra: Iterable[T.Directive] = ()
) -> list[dict]:
    """All rows of one ledger; the first file is its root."""
    out: list[dict] = []

    def diagnostic(severity, code, message, filename="", line=0, date=None, account=None):
        found = {"severity": severity, "code": code, "message": message, "filename": filename, "lineno": line}
        out.append({"part": "diagnostic", **found, "date": date, "account": account})

    for f in files:
        if isinstance(f, Unread):
            diagnostic("error", "syntax", f.message, f.filename, f.line)
    parsed = [f for f in files if isinstance(f, T.File)]
    config, wrong = config_of(parsed[0].options if parsed else [])
    for line, message in wrong:
        diagnostic("error", "option", message, parsed[0].filename, line)
    for f in parsed[1:]:
        for name, _, line in f.options:
            if name not in ("title", "operating_currency"):
                diagnostic("note", "option", f"option {name!r} of an included file is not used", f.filename, line)
    process = Process(config, existing)
    directives = process.process([d for f in parsed for d in f.directives] + list(extra))
    for x in process.diagnostics:
        diagnostic(x.severity, x.code, x.message, x.filename, x.line, x.date, x.account)
    ord_ = 0
    for i, d in enumerate(directives):
        entry, more, postings = rows_of_directive(d, id(d) not in process.invalid)
        out.append({"part": "entry", "ord": i, "entry_id": i, **entry, **more})
        for p in postings:
            ord_ += 1
            out.append({"part": "posting", "ord": ord_, "entry_id": i, **entry, **p})
    for i, (date, base, quote, rate) in enumerate(process.prices):
        out.append({"part": "price", "ord": i, "date": date, "base": base, "quote": quote, "rate": _number(rate)})
    for name, a in process.accounts.items():
        out.append({"part": "account", "account": name, "open": a.opened, "close": a.closed, "currencies": list(a.currencies), "booking": a.booking})
    out.append({"part": "config", "accounts": list(config.roots), "currencies": config.currencies, "detail": config.title})
    return [{"ledger": ledger, **r} for r in out]


def _parse(batches):
    import pandas as pd

    for rows in batches:
        for ledger, nth, path, content in zip(rows["ledger"], rows["nth"], rows["path"], rows["content"], strict=True):
            yield pd.DataFrame({"ledger": [ledger], "nth": [nth], "parsed": [pickle.dumps(read_file(path, content))]})


def parse_files(files: DataFrame) -> DataFrame:
    """ledger, nth (0: the root), path, content to ledger, nth, parsed: each file where it is read, without a shuffle."""
    return files.mapInPandas(_parse, "ledger string, nth int, parsed binary")


def _book(existing: dict[str, set[str]] | None, extra: list[T.Directive]):
    def run(key, rows):
        import pandas as pd

        files = [pickle.loads(p) for p in rows.sort_values("nth")["parsed"]]
        made = rows_of(key[0], files, (existing or {}).get(key[0]), extra)
        return pd.DataFrame([[r.get(c) for c in FORM] for r in made], columns=list(FORM), dtype=object)

    return run


def booked(parsed: DataFrame, existing: dict[str, set[str]] | None = None, extra: list[T.Directive] | None = None) -> DataFrame:
    """What ``parse_files`` gives: all rows of all ledgers by part."""
    return parsed.groupBy("ledger").applyInPandas(_book(existing, extra or []), _SCHEMA)


def tables(files: DataFrame, existing: dict[str, set[str]] | None = None, extra: list[T.Directive] | None = None) -> DataFrame:
    """files: ledger, nth (0: the root), path, content. All rows of all ledgers by part."""
    return booked(parse_files(files), existing, extra)


def _includes(batches):
    import pandas as pd

    for rows in batches:
        found = []
        for path, content in zip(rows["path"], rows["content"], strict=True):
            f = read_file(path, content)
            found += [(path, n) for n, _ in f.includes] if isinstance(f, T.File) else []
        yield pd.DataFrame(found, columns=["path", "include"])


def closure(spark: SparkSession, root: str) -> list[str]:
    """The root and all files it includes, each once, in the order met; cycles do no harm."""
    seen, new = [], [root]
    while new:
        seen += new
        rows = spark.read.format("binaryFile").load(new).select("path", "content").mapInPandas(_includes, "path string, include string").collect()
        found = [i if i.startswith("/") or "://" in i else _beside(p, i) for p, i in [(r.path, r.include) for r in rows]]
        known = {_plain(s) for s in seen}
        new = [f for f in dict.fromkeys(map(_plain, found)) if f not in known]
    return seen


def _plain(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _beside(path: str, name: str) -> str:
    scheme, sep, rest = _plain(path).rpartition("://")
    parts: list[str] = []
    for part in (PurePosixPath(rest).parent / name).parts:
        if part == ".." and parts:
            parts.pop()
        elif part != ".":
            parts.append(part)
    return scheme + sep + str(PurePosixPath(*parts))


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Paths of all files below a folder: names only, a row a file; AnalysisException if there is no such folder."""
    return [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").collect()]


def documents(spark: SparkSession, folders: list[str], accounts: set[str]) -> list[T.Directive]:
    """Document directives of files named by date in folders named like accounts that the ledger mentions."""
    out = []
    for folder in folders:
        paths = listed(spark, folder)
        for path in sorted(map(_plain, paths)):
            inner = PurePosixPath(path).relative_to(_plain(folder))
            account, dated = ":".join(inner.parts[:-1]), _DATED.match(inner.name)
            if account in accounts and dated:
                try:
                    date = dt.date.fromisoformat(dated[1])
                except ValueError:
                    continue
                out.append(T.Directive("document", date, path, 0, values={"account": account, "path": path, "tags": [], "links": []}))
    return out


def as_ledger(rows: DataFrame) -> Ledger:
    """The tables of one ledger as a Ledger; ``diagnostics`` is added to it."""
    part = lambda name, *columns: rows.filter(F.col("part") == name).select(*columns)
    config = part("config", "accounts", "currencies", "detail").first()
    out = Ledger(
        postings=part("posting", *POSTING), entries=part("entry", "ord", *ENTRY, "text", "account", "number", "currency", "detail"), prices=part("price", "date", "base", "quote", "rate", "ord"),
        accounts=part("account", "account", "open", "close", "currencies", "booking"), roots=tuple(config.accounts),
    )
    out.diagnostics = part("diagnostic", "severity", "code", "message", "filename", "lineno", "date", "account")
    out.operating_currencies, out.title = list(config.currencies), config.detail
    return out


def _kept(spark: SparkSession, rows: DataFrame, keep: str | None) -> DataFrame:
    """Written to ``keep`` and read back, else held in memory and on disk."""
    if keep is None:
        return rows.persist()
    rows.write.mode("overwrite").partitionBy("part").parquet(keep)
    return spark.read.schema(rows.schema).parquet(keep)


def load(spark: SparkSession, path: str, keep: str | None = None, check_documents: bool = True) -> Ledger:
    """The ledger whose root file is ``path``; with ``keep`` its tables are written there."""
    paths = closure(spark, path)
    order = {p: i for i, p in enumerate(map(_plain, paths))}
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    nth = F.create_map(*[x for p, i in order.items() for x in (F.lit(p), F.lit(i))])
    files = files.select(F.lit(path).alias("ledger"), F.coalesce(F.try_element_at(nth, F.col("path")), F.lit(0)).alias("nth"), "path", "content", F.lit(uuid.uuid4().hex).alias("version"))  # else what an earlier load has cached would be taken
    parsed = parse_files(files).persist()
    first = booked(parsed).persist()  # booked once, unless documents must be looked up
    existing, extra, missing = None, [], []
    if check_documents:
        if not first.filter("part = 'entry' AND type = 'document'").isEmpty():
            existing = {path: set(map(_plain, listed(spark, str(PurePosixPath(_plain(path)).parent))))}
        root = files.filter("nth = 0").select("content").first()
        root = read_file(path, root.content)
        config, _ = config_of(root.options if isinstance(root, T.File) else [])
        if config.documents:
            accounts = {r.account for r in first.filter("part = 'account'").select("account").collect()}
            for folder in config.documents:
                try:
                    extra += documents(spark, [_beside(path, folder)], accounts)
                except AnalysisException:
                    missing.append(folder)
    again = existing is not None or extra
    out = as_ledger(_kept(spark, booked(parsed, existing, extra) if again else first, keep))
    if missing:
        found = [("error", "document", f"the folder {m} does not exist", path, 0) for m in missing]
        found = spark.createDataFrame(found, "severity string, code string, message string, filename string, lineno long")
        out.diagnostics = out.diagnostics.unionByName(found, allowMissingColumns=True)
    return out


def load_text(spark: SparkSession, text: str, name: str = "<text>") -> Ledger:
    """A ledger in one string, without includes."""
    files = spark.createDataFrame([(name, 0, name, bytearray(text.encode()))], "ledger string, nth int, path string, content binary")
    return as_ledger(_kept(spark, tables(files), None))


def load_many(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every file below a folder, each a ledger of its own; ``ledger`` is its path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return tables(files.select(F.col("path").alias("ledger"), F.lit(0).alias("nth"), "path", "content"))
