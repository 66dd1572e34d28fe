"""Source files and accounts of a ledger as JSON values, and writing a file that nobody else has changed."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyspark.ledger import Ledger
from tallyspark.sources.loader import _plain, closure


class Conflict(ValueError):
    """The file is not what the caller has seen."""


def fingerprint(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()[:8]


def _allowed(spark: SparkSession, root: str, path: str | None) -> str:
    """The root or a file it includes; nothing else may be read or written."""
    wanted = _plain(path or root)
    if wanted not in {_plain(p) for p in closure(spark, root)}:
        raise PermissionError(f"{path} is no file of the ledger")
    return wanted


def source(spark: SparkSession, root: str, path: str | None = None) -> dict:
    wanted = _allowed(spark, root, path)
    content = bytes(spark.read.format("binaryFile").load(wanted).select("content").first().content)
    return {"filepath": wanted, "source": content.decode(errors="replace"), "fingerprint": fingerprint(content)}


def write_source(spark: SparkSession, root: str, text: str, seen: str, path: str | None = None) -> dict:
    """Replaces a file of the ledger if its fingerprint still is ``seen``."""
    now = source(spark, root, path)
    if now["fingerprint"] != seen:
        raise Conflict(f"{now['filepath']} has changed: {now['fingerprint']}, not {seen}")
    jvm, target = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(now["filepath"])
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    del jvm
    return source(spark, root, path)


def accounts(ledger: Ledger) -> list[dict]:
    """name, type, open and close of every account, by name."""
    kind = F.split("account", ":")[0]
    rows = ledger.accounts.select("account", kind.alias("kind"), "open", "close").orderBy("account").toLocalIterator()
    types = dict(zip(ledger.roots, ("assets", "liabilities", "equity", "income", "expenses"), strict=True))
    return [{"name": r.account, "type": types.get(r.kind), "open": str(r.open) if r.open else None, "close": str(r.close) if r.close else None} for r in rows]
