"""Dates of lots: a reduction written without one takes that of the earliest lot it can reduce."""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("account", "currency", "cost.currency", "cost.number")


def _fold(batches):
    """ord and date of the undated rows; rows come sorted by key and ord, and only the lots of one key are held.

    Dates of lots of a sign are in a heap, in which those stay that have no such units any more until they come first."""
    import pyarrow as pa

    key, lots, above = None, {}, {True: [], False: []}
    for batch in batches:
        ords, found = [], []
        columns = [batch.column(name).to_pylist() for name in ("key", "ord", "date", "number", "cost_date")]
        for its, ord_, date, n, cost_date in zip(*columns, strict=True):
            if its != key:
                key, lots, above = its, {}, {True: [], False: []}
            if cost_date is None:
                opposite = n <= 0
                heap = above[opposite]
                while heap and not (lots[heap[0]] and (lots[heap[0]] > 0) == opposite):
                    heappop(heap)
                cost_date = heap[0] if heap else date
                ords.append(ord_)
                found.append(cost_date)
            before = lots.get(cost_date, 0)
            lots[cost_date] = now = before + n
            if now and (not before or (before > 0) != (now > 0)):
                heappush(above[now > 0], cost_date)
        yield pa.RecordBatch.from_arrays([pa.array(ords, pa.int64()), pa.array(found, pa.date32())], ["ord", "found"])


def inherited_dates(rows: DataFrame) -> DataFrame:
    """``rows`` with every cost dated.

    Lots are kept per account, currency and unit cost, in ledger order. An undated cost takes the earliest
    date of a lot of the opposite sign, else its own entry's date. Only keys that have an undated cost are
    folded: their rows stream through in order, key after key, so that a task holds the lots of one key however many
    rows it has, and only undated rows come back. A key's rows depend on each other, so that one key is one
    task's work. ``ord`` must be unique; rows without a cost or number are left as they are.
    """
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(KEYS)])
    held = rows.filter("cost IS NOT NULL AND number IS NOT NULL").select(
        key.alias("keys"), "ord", "date", "number", F.col("cost.date").alias("cost_date")
    )
    # equal to null as well, so that keys without a currency or unit cost are folded like others
    held = held.select(F.sha2(F.to_json("keys", {"ignoreNullFields": "false"}), 256).alias("key"), "ord", "date", "number", "cost_date")
    held = held.join(held.filter("cost_date IS NULL").select("key").distinct(), "key", "left_semi")
    dated = held.repartition("key").sortWithinPartitions("key", "ord").mapInArrow(_fold, "ord long, found date")
    rows = rows.join(dated, "ord", "left")
    date = F.coalesce("cost.date", "found")
    return rows.withColumn("cost", F.when(F.col("cost").isNotNull(), F.col("cost").withField("date", date))).drop("found")
