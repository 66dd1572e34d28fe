"""Recomputes a ledger whenever a file of its folder changes.

A rate stream is the clock. Each of its batches lists the folder (path, time and length of each file; a row a
file) and reloads the whole ledger if the listing differs from the last one, since any change may move every balance
after it: a file stream would see new names only, not files written again. Results go to the caller through
``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyspark.ledger import Ledger
from tallyspark.sources.loader import load


def listing(spark: SparkSession, folder: str) -> list[tuple]:
    """What tells one state of a folder from another."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return sorted(tuple(r) for r in files.select("path", "modificationTime", "length").collect())


def watch(spark: SparkSession, folder: str, root: str, on_change: Callable[[Ledger, int], None], checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Calls ``on_change(ledger, batch)`` for the ledger as it is, and again after each change of a file.

    A file that disappears between listing and reading is looked for again with the next batch."""
    seen: list = []

    def reload(batch: DataFrame, number: int) -> None:
        try:
            now = listing(batch.sparkSession, folder)
        except AnalysisException:
            return  # the folder is not there at the moment
        if seen != [now]:
            seen[:] = [now]
            on_change(load(batch.sparkSession, root), number)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(reload).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
