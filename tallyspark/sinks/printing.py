"""PRINT: entries that pass FROM, as ledger text, after OPEN, CLOSE and CLEAR.

OPEN replaces the transactions before its date by opening ones, which come first; CLOSE cuts at its date; CLEAR adds
transfers at the end. Entries and synthetic transactions are both read in order, a partition at a time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.language import syntax as Q
from tallyspark.operators import summarize
from tallyspark.plans import rows as R
from tallyspark.plans import values as V
from tallyspark.plans.planner import Planner
from tallyspark.sources.ledger_text import Amount, Cost, Directive, Posting
from tallyspark.sources.printer import directive_text


def _scaled(x, scale: int | None):
    """A number with as many digits as were written."""
    return x.quantize(x.__class__(1).scaleb(-(scale or 0))) if x is not None else None


def _texts(rows: DataFrame) -> Iterator[str]:
    """Text of transactions given by their postings."""
    rows = rows.select("ord", "entry_id", "date", "flag", "payee", "narration", "account", "number", "scale", "currency", "cost").orderBy("ord")
    for _, group in groupby(rows.toLocalIterator(), key=lambda r: r.entry_id):
        legs = []
        for r in group:
            cost = None if r.cost is None else Cost(_scaled(r.cost.number, r.cost.scale), None, r.cost.currency, r.cost.date, r.cost.label)
            legs.append(Posting(r.account, Amount(_scaled(r.number, r.scale), r.currency), cost))
        values = {"flag": r.flag, "payee": r.payee, "narration": r.narration, "tags": [], "links": []}
        yield directive_text(Directive("transaction", r.date, "", 0, values=values, postings=legs))


def printed(ledger, text: str, today: dt.date | None = None) -> Iterator[str]:
    """Lines of the directives in ledger order, transactions set off by an empty line before them."""
    statement = Q.parse(text)
    if not isinstance(statement, Q.Print):
        raise Q.QueryError("not a PRINT statement")
    source = statement.source or Q.Source()
    planner = Planner(ledger, today or dt.date.today())

    def passing(rows: DataFrame) -> DataFrame:
        if source.where is None:
            return rows
        planner.context.rows = rows
        keep = V.truth(planner.expression(source.where, R.ENTRY_COLUMNS, "FROM clause"))
        return planner.context.apply(rows).filter(keep).select(*rows.columns)

    entries = ledger.entries
    if source.open_on:
        entries = entries.filter((F.col("type") != "transaction") | (F.col("date") >= F.lit(source.open_on)))
    entries = summarize.close(entries, source.close_on)
    made = planner.rows(Q.Source(open_on=source.open_on, close_on=source.close_on, clear=source.clear)) if source.open_on or source.clear else None
    if source.open_on:
        for x in _texts(passing(made.filter(F.col("ord") < summarize.FIRST // 2))):
            yield from ("", *x.split("\n"))
    for row in passing(entries).select("ord", "type", "text").orderBy(F.col("ord")).toLocalIterator():
        if row.type == "transaction":
            yield ""
        yield from row.text.split("\n")
    if source.clear:
        for x in _texts(passing(made.filter(F.col("ord") >= summarize.LAST))):
            yield from ("", *x.split("\n"))
