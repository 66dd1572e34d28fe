"""Packing documents into token sequences, shortest pack first over the length histogram.

A document's ids are those of a public tokenizer, then id 0. It is cut at multiples of the
sequence length: whole chunks fill a sequence each, and the rests are packed. The histogram of
rests (at most as many rows as the sequence length) comes to the driver; lengths are placed
longest first, each on the pattern with the least filled packs that still has room, and only
counts of patterns are kept. The patterns then say for every length which ranks go to which
sequence and offset, and are joined back by rank (a table whose size depends on the sequence length
only, hence broadcast). Ranks are counted in buckets of doc_id and shifted by the buckets' counts,
so that no task sees all documents of one length.

A sequence still open at 256 or 512 tokens would cost no padding; the patterns do not use this, as
they leave some thousandths of padding anyway.

Ids are those of the ``tokenizers`` library. A byte-level vocabulary of the usual form is encoded by
``tiktoken`` with the merges and the splitting of the same vocabulary file, which gives the same ids several times
faster and needs no memory beyond the text and its ids; other vocabularies, and texts with words or white space of
extreme length, go through ``tokenizers`` itself.
Nulls: a null text is empty (id 0 alone); a null doc_id is an ordinary one. Repeated rows are packed
one by one; ties of length go by doc_id. Very long texts: batches are read some megabytes at a time; what is
held of one document is its text and its ids. Empty table: empty result. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import _text
from tallyspark.llm._memory import trimmed
from tallyspark.llm._store import Scratch

LENGTH, END = 1024, 0
BUCKET_ROWS, LEAST_BUCKETS, BATCH_BYTES = 100_000, 64, 1 << 22
LONG_WORD, _LONG_SPACE = 1 << 16, re.compile(r"\s{1000}")
# Fixed by the byte-level form of vocabularies: how it splits texts, and which bytes stand for themselves in its alphabet.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PRINTED = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))


@cache
def tokenizer(vocabulary: str | None):
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return Encoder(vocabulary)


def _alphabet() -> dict[str, int]:
    printed = [b for r in _PRINTED for b in r]
    others = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}


def _fast(vocabulary: str):
    """A ``tiktoken`` encoding with the merges of a byte-level vocabulary file; None if the file has any other form."""
    with open(vocabulary, encoding="utf-8") as f:
        told = json.load(f)
    model, splitter = told["model"], told.get("pre_tokenizer") or {}
    plain = all(not model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    usual = splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space") and splitter.get("use_regex", True)
    added = told.get("added_tokens") or []
    if model.get("type") != "BPE" or not plain or not usual or told.get("normalizer") or told.get("post_processor"):
        return None
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        return None
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(x >= y for x, y in zip(merged, merged[1:], strict=False)):
        return None  # the order of the merges must be the order of ids
    import tiktoken

    byte, special = _alphabet(), {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte[c] for c in token): number for token, number in model["vocab"].items() if token not in special}
    return tiktoken.Encoding(name=vocabulary, pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Same ids as ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.model, self.fast = Tokenizer.from_file(vocabulary), _fast(vocabulary)

    def ids(self, text: str) -> np.ndarray:
        if self.fast and max(map(len, text.split()), default=0) < LONG_WORD and not _LONG_SPACE.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32)


def _tokens(vocabulary: str | None, length: int):
    def run(batches):
        encoder = tokenizer(vocabulary)
        for batch in batches:
            for part in _text.slices(batch, 1, BATCH_BYTES):
                tokens, crcs = [], []
                for text in part.column(1).to_pylist():
                    ids = np.append(encoder.ids(text or ""), np.uint32(END)).astype("<u4", copy=False)
                    tokens.append(len(ids))
                    crcs.append([zlib.crc32(ids[k : k + length]) for k in range(0, len(ids), length)])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "crcs"])

    return run


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a pack, number of such packs), shortest pack first, longest lengths first."""
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = max((r for r, packs in open_by_room.items() if packs), default=0)
            if room >= size:
                lengths, n = open_by_room[room].pop()
                used = min(n, left)
                if n > used:
                    open_by_room[room].append((lengths, n - used))
            else:
                room, lengths, used = length, (), left
            open_by_room[room - size].append(((*lengths, size), used))
            left -= used
    return [p for room in sorted(open_by_room) for p in open_by_room[room]]


def _slots(packs: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple], int]:
    """Per length: first ranks, first sequences and offsets of its places in the patterns; number of sequences."""
    taken: dict[int, int] = defaultdict(int)
    by: dict[int, tuple[list, list, list]] = defaultdict(lambda: ([], [], []))
    sequence = 0
    for lengths, n in packs:
        at = 0
        for size in lengths:
            for column, value in zip(by[size], (taken[size], sequence, at), strict=True):
                column.append(value)
            taken[size] += n
            at += size
        sequence += n
    return [(size, *columns) for size, columns in by.items()], sequence


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    store = Scratch(spark, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = store.table("tokens", rows.mapInArrow(trimmed(_tokens(vocabulary, length)), "doc_id long, doc_tokens long, crcs array<long>"))
    n = max(LEAST_BUCKETS, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("rest", F.col("doc_tokens") % length).withColumn("full", F.floor(F.col("doc_tokens") / length)).withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.element_at("crcs", 1)), F.lit(n)))
    counts = store.table("counts", rows.groupBy("bucket", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("chunks")))
    histogram = {r.rest: r.n for r in counts.filter("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    slots, sequences = _slots(patterns(histogram, length))
    store.keep("tokens", "counts")
    form = T.StructType([T.StructField("rest", T.LongType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("ranks", "sequences", "offsets")]])
    before = lambda *keys: Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("bucket", "rest", F.coalesce(F.sum("n").over(before("rest")), F.lit(0)).alias("rank0"))
    chunks = counts.groupBy("bucket").agg(F.sum("chunks").alias("chunks")).select("bucket", F.coalesce(F.sum("chunks").over(before()), F.lit(0)).alias("chunk0"))
    order = ["doc_id", "doc_tokens", "crcs"]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "rest").orderBy(*order)) - 1)
    rows = rows.withColumn("chunk", F.coalesce(F.sum("full").over(Window.partitionBy("bucket").orderBy(*order, "rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(shift, ["bucket", "rest"]).join(chunks, "bucket").join(F.broadcast(spark.createDataFrame(slots, form)), "rest", "left")
    rows = rows.withColumn("rank", F.col("rank") + F.col("rank0")).withColumn("slot", F.size(F.filter("ranks", lambda r: r <= F.col("rank"))))
    pieces = rows.select("*", F.posexplode("crcs").alias("piece", "crc"))
    whole = F.col("piece") < F.col("full")
    return pieces.select(
        "doc_id",
        (F.col("piece").cast("long") * length).alias("start"),
        F.when(whole, F.lit(length)).otherwise(F.col("rest")).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        F.when(whole, F.lit(sequences) + F.col("chunk0") + F.col("chunk") + F.col("piece")).otherwise(F.element_at("sequences", F.col("slot")) + F.col("rank") - F.element_at("ranks", F.col("slot"))).cast("long").alias("sequence_id"),
        F.when(whole, F.lit(0)).otherwise(F.element_at("offsets", F.col("slot"))).cast("long").alias("offset"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
