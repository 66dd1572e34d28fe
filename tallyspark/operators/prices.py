"""Exchange rates as of a date: direct quotes, their inverses, and paths over several currencies.

The latest quote per directed pair counts (of one date's quotes the first declared); an inverse
of a newer quote beats an older direct one. Only the graph of one date, whose size is that of the
currencies in use, is ever walked in Python.
"""

from __future__ import annotations

import datetime as dt
from collections import deque
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATE = "decimal(18,10)"


def edges(prices: DataFrame) -> DataFrame:
    """prices: date, base, quote, rate, ord. Both directions: date, source, target, rate, ord."""
    good = prices.filter(F.col("rate").isNotNull() & (F.col("rate") != 0))
    rate = F.col("rate").cast("decimal(28,10)")
    there = good.select("date", F.col("base").alias("source"), F.col("quote").alias("target"), F.col("rate").try_cast(RATE).alias("rate"), (F.col("ord") * 2).alias("ord"))
    back = good.select("date", F.col("quote").alias("source"), F.col("base").alias("target"), F.try_divide(F.lit(1).cast("decimal(28,10)"), rate).try_cast(RATE).alias("rate"), (F.col("ord") * 2 + 1).alias("ord"))
    return there.unionByName(back).filter("rate IS NOT NULL AND source <> target")


def latest(all_edges: DataFrame, date: dt.date | Column | None = None) -> DataFrame:
    """source, target, rate, ord as of a date: per directed pair the newest, of a day's the first declared."""
    known = all_edges if date is None else all_edges.filter(F.col("date") <= F.lit(date))
    newest = F.struct(F.col("date"), -F.col("ord"))
    return known.groupBy("source", "target").agg(F.max_by("rate", newest).alias("rate"), F.min("ord").alias("ord"))


def paths(direct: list[tuple[str, str, Decimal, int]], wanted: str | None = None, starts: set[str] | None = None) -> dict[tuple[str, str], Decimal]:
    """Rates of all pairs joined by a path: fewest hops, then the order in which edges came. ``starts``: only from these."""
    out_of: dict[str, list[tuple[str, Decimal]]] = {}
    for source, target, rate, _ in sorted(direct, key=lambda e: e[3]):
        out_of.setdefault(source, []).append((target, Decimal(rate)))
    found = {}
    for start in out_of if starts is None else [x for x in out_of if x in starts]:
        best, queue = {start: Decimal(1)}, deque([start])
        while queue and wanted not in best:
            at = queue.popleft()
            for target, rate in out_of.get(at, ()):
                if target not in best:
                    best[target] = best[at] * rate
                    queue.append(target)
        found.update({(start, target): rate for target, rate in best.items() if target != start and wanted in (None, target)})
    return found


class PriceBook:
    """Rates of a table of prices, for one date (on the driver) or for many (a table)."""

    def __init__(self, prices: DataFrame):
        self.edges = edges(prices)
        self._at: dict[dt.date, dict[tuple[str, str], Decimal]] = {}

    def at(self, date: dt.date) -> dict[tuple[str, str], Decimal]:
        if date not in self._at:
            rows = latest(self.edges, date).collect()  # one row a pair of currencies
            self._at[date] = paths([(r.source, r.target, r.rate, r.ord) for r in rows])
        return self._at[date]

    def stats(self) -> dict[str, int]:
        """Numbers of currencies, directed pairs and quotes (each counts once in either direction)."""
        pair = self.edges.agg(F.countDistinct("source").alias("currencies"), F.countDistinct("source", "target").alias("pairs"), F.count(F.lit(1)).alias("quotes"))
        return pair.first().asDict()

    def pairs(self) -> DataFrame:
        return self.edges.groupBy("source", "target").agg(F.min("ord").alias("ord"))

    def direct_by_date(self, dates: DataFrame) -> DataFrame:
        """date, source, target, rate, ord of each asked date: quotes carried forward within the pair."""
        daily = self.edges.groupBy("source", "target", "date").agg(F.min_by("rate", "ord").alias("rate"))
        pairs = [(r.source, r.target, r.ord) for r in self.pairs().collect()]
        every = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("target"), F.lit(o).alias("ord")) for s, t, o in pairs])
        every = every if pairs else F.array().cast("array<struct<source:string,target:string,ord:bigint>>")
        asked = dates.select("date").filter("date IS NOT NULL").distinct().select("date", F.explode(every).alias("pair")).select("date", "pair.*", F.lit(None).cast(RATE).alias("rate"), F.lit(1).alias("asked"))
        known = daily.select("date", "source", "target", F.lit(None).cast("bigint").alias("ord"), "rate", F.lit(0).alias("asked"))
        order = Window.partitionBy("source", "target").orderBy("date", "asked").rowsBetween(Window.unboundedPreceding, 0)
        filled = known.unionByName(asked.select(known.columns)).withColumn("rate", F.last("rate", ignorenulls=True).over(order))
        return filled.filter("asked = 1 AND rate IS NOT NULL").drop("asked")

    def to_quote(self, dates: DataFrame, quote: str) -> DataFrame:
        """date, rates (source -> rate in ``quote``) of each asked date.

        A direct rate is the shortest path there is; only dates on which some currency has none are walked."""
        direct = self.direct_by_date(dates)
        one = direct.filter(F.col("target") == quote).select("date", "source", "rate")
        known, mine = F.collect_set("source"), F.collect_set(F.when(F.col("target") == quote, F.col("source")))
        lacking = F.array_except(known, F.concat(mine, F.array(F.lit(quote))))
        left = direct.groupBy("date").agg(lacking.alias("lacking")).filter(F.size("lacking") > 0)

        def walk(key, rows):
            import pandas as pd

            found = paths(list(rows[["source", "target", "rate", "ord"]].itertuples(index=False, name=None)), quote, set(rows["lacking"].iloc[0]))
            return pd.DataFrame([(key[0], s, round(r, 10)) for (s, _), r in found.items()], columns=["date", "source", "rate"])

        walked = direct.join(left, "date").groupBy("date").applyInPandas(walk, f"date date, source string, rate {RATE}")
        return one.unionByName(walked).groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("source", "rate"))).alias("rates"))

    def by_date(self, dates: DataFrame) -> DataFrame:
        """date, rates (target -> source -> rate) of each asked date."""

        def walk(key, rows):
            import pandas as pd

            found = paths(list(rows[["source", "target", "rate", "ord"]].itertuples(index=False, name=None)))
            return pd.DataFrame([(key[0], t, s, round(r, 10)) for (s, t), r in found.items()], columns=["date", "target", "source", "rate"])

        rows = self.direct_by_date(dates).groupBy("date").applyInPandas(walk, f"date date, target string, source string, rate {RATE}")
        one = rows.groupBy("date", "target").agg(F.map_from_entries(F.collect_list(F.struct("source", "rate"))).alias("rates"))
        return one.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("target", "rates"))).alias("rates"))
