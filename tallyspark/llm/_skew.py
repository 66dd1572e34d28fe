"""Joins with tables of keys that tell how many rows each key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HOT, LEAST_HOT = 1 << 16, 1 << 12


def join_keys(rows: DataFrame, keys: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` (``total`` of them) with ``keys``, one row a key, ``size`` of ``rows`` to each.

    Keys with more than total / MOST_HOT rows, of which there are at most MOST_HOT, are broadcast; the rows of
    all others are shuffled, so that no task gets more than such a share of the rows by one key."""
    limit = max(LEAST_HOT, total // MOST_HOT)
    hot = keys.filter(F.col(size) > limit)
    if hot.isEmpty():
        return rows.join(keys, on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keys.filter(F.col(size) <= limit), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)
