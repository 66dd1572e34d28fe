"""A ledger as DataFrames: entries, postings, prices and accounts, and queries over them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import ROOTS
from tallyspark.operators.prices import PriceBook
from tallyspark.plans import planner
from tallyspark.plans.rows import ENTRY, POSTING, completed


@dataclass
class Ledger:
    """``postings`` and ``entries`` have the columns of ``plans.rows``; prices: date, base, quote, rate, ord;
    accounts: account, open, close."""

    postings: DataFrame
    entries: DataFrame
    prices: DataFrame
    accounts: DataFrame
    roots: tuple[str, ...] = ROOTS
    entries_derived: bool = False

    @classmethod
    def of(cls, postings: DataFrame, prices: DataFrame | None = None, entries: DataFrame | None = None, accounts: DataFrame | None = None, **more) -> "Ledger":
        """From tables that may lack columns; entries and accounts are derived where not given."""
        postings = completed(postings, POSTING)
        spark = postings.sparkSession
        if entries is None:
            more["entries_derived"] = True
            entries = postings.groupBy("entry_id").agg(*[F.first(c).alias(c) for c in ENTRY if c != "entry_id"])
        if prices is None:
            prices = spark.createDataFrame([], "date date, base string, quote string, rate decimal(28,10), ord bigint")
        if accounts is None:
            accounts = postings.groupBy("account").agg(F.min("date").alias("open"), F.lit(None).cast("date").alias("close"))
        return cls(postings, completed(entries, ENTRY), prices, accounts, **more)

    @cached_property
    def has_undated_costs(self) -> bool:
        """Whether any cost lacks a date, which it then takes from the lot it reduces."""
        return not self.postings.filter("cost IS NOT NULL AND cost.date IS NULL").isEmpty()

    def last_date(self, before: dt.date | None = None) -> dt.date | None:
        """Date of the last entry (before a date); entries that come from the postings have no others."""
        rows = (self.postings if self.entries_derived else self.entries).select("date")
        return (rows.filter(F.col("date") < F.lit(before)) if before else rows).agg(F.max("date")).first()[0]

    def checked(self) -> "Ledger":
        """This ledger, if every posting has an ``ord`` of its own (which running balances are joined by)."""
        if not self.postings.groupBy("ord").count().filter("count > 1 OR ord IS NULL").isEmpty():
            raise ValueError("several postings have the same ord, or none")
        return self

    @cached_property
    def price_book(self) -> PriceBook:
        return PriceBook(self.prices)

    def query(self, text: str, today: dt.date | None = None) -> planner.Result:
        return planner.run(self, text, today)
