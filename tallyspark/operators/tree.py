"""Balance trees: sums of accounts and of all their ancestors."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(account: Column) -> Column:
    """The account and everything above it, top first."""
    parts = F.split(account, ":")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ":"))


def balances(postings: DataFrame, start: dt.date | None = None, end: dt.date | None = None, types: tuple[str, ...] = ()) -> DataFrame:
    """account, currency, number of valid postings in [start, end]; equal dates: all up to that day."""
    if (start is None) != (end is None):
        raise ValueError("give both dates or none")
    rows = postings.filter("is_valid AND number IS NOT NULL")
    if end is not None:
        rows = rows.filter(F.col("date") <= F.lit(end))
        if start != end:
            rows = rows.filter(F.col("date") >= F.lit(start))
    if types:
        rows = rows.filter(F.substring_index("account", ":", 1).isin(*types))
    return rows.groupBy("account", "currency").agg(F.sum("number").alias("number"))


def tree(postings: DataFrame, accounts: DataFrame | None = None, start: dt.date | None = None, end: dt.date | None = None, types: tuple[str, ...] = ()) -> DataFrame:
    """name, account, depth, currency, number of every node; accounts without postings have a NULL currency.

    Leaves are summed before they are spread to their ancestors, so that only sums are exploded.
    """
    leaves = balances(postings, start, end, types)
    if accounts is not None:
        known = accounts.select("account")
        if types:
            known = known.filter(F.substring_index("account", ":", 1).isin(*types))
        leaves = leaves.unionByName(known.select("account", F.lit(None).cast("string").alias("currency"), F.lit(None).cast("decimal(38,10)").alias("number")))
    nodes = leaves.select(F.explode(ancestors(F.col("account"))).alias("account"), "currency", "number")
    sums = nodes.groupBy("account", "currency").agg(F.sum("number").alias("number"))
    return sums.select(F.substring_index("account", ":", -1).alias("name"), "account", (F.size(F.split("account", ":"))).alias("depth"), "currency", "number")


def balance_sheet(postings: DataFrame, roots: tuple[str, ...], **dates) -> DataFrame:
    return tree(postings, types=roots[:3], **dates)


def income_statement(postings: DataFrame, roots: tuple[str, ...], **dates) -> DataFrame:
    return tree(postings, types=roots[3:], **dates)


def as_json(nodes: DataFrame) -> DataFrame:
    """One JSON object a node: its name, account, depth and balance by currency."""
    held = F.map_from_entries(F.filter(F.collect_list(F.struct("currency", F.col("number").cast("string"))), lambda e: e["currency"].isNotNull()))
    one = nodes.groupBy("name", "account", "depth").agg(held.alias("balance"))
    return one.select(F.to_json(F.struct("name", "account", "depth", "balance")).alias("json"))


def parents(accounts: DataFrame) -> DataFrame:
    """account, parent (null at a root) of every account and of all accounts above it."""
    parts = F.split("account", ":")
    nodes = accounts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.slice(parts, 1, n))).alias("parts"))
    nodes = nodes.select(F.array_join("parts", ":").alias("account"), F.when(F.size("parts") > 1, F.array_join(F.slice("parts", 1, F.size("parts") - 1), ":")).alias("parent"))
    return nodes.distinct()


def children(accounts: DataFrame, parent: str) -> DataFrame:
    """The accounts directly below one."""
    return parents(accounts).filter(F.col("parent") == parent).select("account")
