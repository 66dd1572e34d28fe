"""Substring dedup by relative Lempel-Ziv parsing at word level.

Reference blocks: every window of 50 words is assigned to its anchor, the 16-word gram in it with
the least hash, so that equal windows have equal anchors wherever they stand. Neighbouring windows
with the same anchor form a run. All runs of all documents are indexed; the index gives for each the first place
(smallest document, then position) that holds it. Where documents share an anchor but not the run (at
the ends of shared passages), the run's single windows are indexed and looked up as well, so that
factor boundaries are exact to the word.

The greedy parse walks each document from left to right. Where a window has an earlier reference, a
factor starts: a copy of a stretch of that document, which goes on as long as the index points to the
next words of the same reference. It ends at the last word that agrees; the next factor may
start within its last 49 words, since a window across the boundary can have a reference of its own. All
else is literal. Every piece of a factor, up to both of its boundaries, is compared by a
128-bit digest of its bytes. Factors of at least 50 words are the duplicate spans.

Anchors and runs in only one document are dropped before anything else is shuffled; texts are
shuffled only for documents with shared runs. Lookups of a passage that is everywhere are broadcast (``_skew``).

Nulls: a null text has no words; a null doc_id counts as the largest. Repeats within a document, and
rows with equal doc_id, do not remove each other's words; of equal references the first in order of (doc_id, text's hash,
position) is named. Texts with fewer than 50 words keep all. Very long texts (up to 2^28 words): batches are taken some
megabytes at a time, and what is held beyond a text is some numbers a word. Empty table: empty result. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import _text
from tallyspark.llm._memory import trimmed
from tallyspark.llm._skew import join_keys
from tallyspark.llm._store import Scratch

WINDOW, GRAM = 50, 16
LAST = 2**63 - 1
SENT_ROWS = 1 << 20
_PLACE = 28


def anchors(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: anchor's hash, first and last window."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    span = _text.rolling(words, 0xA0761D6478BD642F)
    at = np.arange(len(words) - gram + 1)
    grams = span(at, at + gram)
    least = grams >> np.uint64(_PLACE) << np.uint64(_PLACE) | at.astype(np.uint64)
    width, need = 1, window - gram + 1
    while width * 2 <= need:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[need - width : need - width + n])
    place = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    return grams[place[first]], first, last


def parse(n: int, at: np.ndarray, source: np.ndarray, place: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int | None, int | None]]:
    """Greedy parse of n words into phrases (start, length, source, place in the source), literals without a source.

    ``at``: windows with an earlier reference, each with its source and place (the first of several counts). A
    factor goes on while the next window's reference is the next window of the same source."""
    if not len(at):
        return [(0, n, None, None)] if n else []
    order = np.lexsort((place, source, at))
    at, source, place = at[order], source[order], place[order]
    first = np.concatenate([[True], at[1:] != at[:-1]])
    at, source, place = at[first], source[first], place[first]
    out, end = [], 0
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(source) != 0) | (np.diff(place) != 1)]))
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
        begin, stop = int(at[i]), int(at[j - 1]) + window
        if begin > end:
            out.append((end, begin - end, None, None))
        begin = max(begin, end)
        out.append((begin, stop - begin, int(source[i]), int(place[i]) + begin - int(at[i])))
        end = stop
    if end < n:
        out.append((end, n - end, None, None))
    return out


def _places(joined: bytes) -> tuple[list[int], list[int]]:
    """First byte and end of each word of words joined by single spaces."""
    if not joined:
        return [], []
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    return [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(joined)]


_RUN = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("anchor", pa.int64()), ("run", pa.binary()), ("first", pa.int64()), ("last", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string())])
RUNS = "id long, row long, anchor long, run binary, first long, last long, n_words long, sha string"


def _runs(window: int):
    """Per document a row without anchor (its words and digest), then one per run."""

    def run(batches):
        for batch in batches:
            for part in _text.slices(batch, 2):
                ids, rows, texts = (part.column(i).to_pylist() for i in range(3))
                data = [b" ".join((t or "").encode().split()) for t in texts]
                words, ends = _text.batch_word_hashes(data)
                starts = np.concatenate([[0], ends[:-1]])
                none = [pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.binary()), *[pa.nulls(len(ids), pa.int64())] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), *none, pa.array(ends - starts), pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string())], schema=_RUN)
                found, digests = [], []
                for joined, a, b in zip(data, starts, ends, strict=True):
                    found.append(anchors(words[a:b], window))
                    _, first, last = found[-1]
                    if len(first):
                        begin, end = _places(joined)
                        view = memoryview(joined)
                        digests += [xxhash.xxh3_128_digest(view[begin[i] : end[j + window - 1]]) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
                n = [len(f[0]) for f in found]
                columns = [np.concatenate([f[i] for f in found]) for i in range(3)]
                none = [pa.nulls(sum(n), pa.int64()), pa.nulls(sum(n), pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(ids, np.int64), n)), pa.array(np.repeat(np.array(rows, np.int64), n)), pa.array(columns[0].view(np.int64)), pa.array(digests, pa.binary()), pa.array(columns[1]), pa.array(columns[2]), *none],
                    schema=_RUN,
                )

    return run


def _windows(window: int):
    """One row per window of the spans given with each text."""
    names = ["id", "row", "window", "at"]

    def run(batches):
        for batch in batches:
            for part in _text.slices(batch, 2):
                for doc, row, text, spans in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    joined = b" ".join(text.encode().split())
                    begin, end = _places(joined)
                    view = memoryview(joined)
                    at = np.unique(np.concatenate([np.arange(s["first"], s["last"] + 1) for s in spans]))
                    for i in range(0, len(at), 1 << 16):
                        some = at[i : i + (1 << 16)]
                        digests = [xxhash.xxh3_128_digest(view[begin[j] : end[j + window - 1]]) for j in some.tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), doc)), pa.array(np.full(len(some), row)), pa.array(digests, pa.binary()), pa.array(some)], names=names)

    return run


_PHRASE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", pa.int64()), ("place", pa.int64())])
_PARSED = "id long, row long, n_removed long, sha string, kept_text string, phrases array<struct<start:long,length:long,source:long,place:long>>"


def _parse(window: int):
    names = [x.split()[0] for x in _PARSED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(_PHRASE)]

    def run(batches):
        for batch in batches:
            for part in _text.slices(batch, 2):
                out = [[] for _ in names]
                for doc, row, text, spans in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    words = text.encode().split()
                    size = [s["last"] - s["first"] + 1 for s in spans]
                    step = np.concatenate([np.arange(n) for n in size])
                    at, place = (np.repeat([s[c] for s in spans], size) + step for c in ("first", "place"))
                    sources = sorted({(s["reference"], s["reference_row"]) for s in spans})
                    number = {s: i for i, s in enumerate(sources)}
                    source = np.repeat([number[s["reference"], s["reference_row"]] for s in spans], size)
                    phrases = parse(len(words), at, source, place, window)
                    left = b" ".join([w for a, n, s, _ in phrases if s is None for w in words[a : a + n]])
                    gone = sum(n for _, n, s, _ in phrases if s is not None)
                    told = [{"start": a, "length": n, "source": None if s is None else sources[s][0], "place": p} for a, n, s, p in phrases]
                    for column, value in zip(out, (doc, row, gone, hashlib.sha256(left).hexdigest(), left.decode(), told), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return run


def _only(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df with a key in ``keys`` (distinct, written): by broadcast up to SENT_ROWS keys, else shuffled."""
    few = keys.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    return df.join(F.broadcast(keys) if few else keys, on, "left_semi")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", kept_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256; with kept_text also kept_text and phrases, the parse (null where nothing was removed)."""
    store = Scratch(docs.sparkSession, "substring")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scan = store.table("runs", rows.mapInArrow(trimmed(_runs(window)), RUNS))
    runs = scan.filter("anchor IS NOT NULL").select("id", "row", "anchor", "run", "first", "last")
    shared = store.table("anchors", runs.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("anchor"))
    runs = store.table("shared", _only(runs, shared, ["anchor"]))
    where = F.min(F.struct("id", "row", "first")).alias("head")
    firsts = store.table("firsts", runs.groupBy("anchor", "run").agg(where, F.count(F.lit(1)).alias("n")))
    mixed = store.table("mixed", firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("runs")).filter("runs > 1").select("anchor"))
    found = store.table("found", join_keys(runs, firsts, ["anchor", "run"], "n", runs.count()).drop("n"))
    reference = [F.col("head.id").alias("reference"), F.col("head.row").alias("reference_row")]
    whole = found.filter("head.id < id").select("id", "row", "first", "last", *reference, F.col("head.first").alias("place"))
    ends = _only(found.filter("head.id = id"), mixed, ["anchor"]).groupBy("id", "row").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    ends = store.table("ends", ends)
    some = _only(rows, store.table("ids", ends.select("id", "row")), ["id", "row"]).dropDuplicates(["id", "row"])
    windows = store.table("windows", some.join(ends, ["id", "row"]).select("id", "row", "text", "spans").mapInArrow(trimmed(_windows(window)), "id long, row long, window binary, at long"))
    where = F.min(F.struct("id", "row", "at")).alias("head")
    heads = windows.groupBy("window").agg(where, F.max("id").alias("latest"), F.count(F.lit(1)).alias("n"))
    heads = store.table("heads", heads.filter("head.id < latest").drop("latest"))
    single = join_keys(windows, heads, ["window"], "n", windows.count()).filter("head.id < id")
    single = single.select("id", "row", F.col("at").alias("first"), F.col("at").alias("last"), *reference, F.col("head.at").alias("place"))
    span = F.struct("first", "last", "reference", "reference_row", "place")
    cut = store.table("cut", whole.unionByName(single).groupBy("id", "row").agg(F.collect_set(span).alias("spans")))
    some = _only(rows, store.table("cut-ids", cut.select("id", "row")), ["id", "row"]).dropDuplicates(["id", "row"])
    parsed = some.join(cut, ["id", "row"]).select("id", "row", "text", "spans").mapInArrow(trimmed(_parse(window)), _PARSED).withColumnRenamed("sha", "cut_sha")
    parsed = store.table("parsed", parsed if kept_text else parsed.select("id", "row", "n_removed", "cut_sha"))
    store.keep("runs", "parsed")
    out = scan.filter("anchor IS NULL").select("id", "row", "n_words", "sha").join(parsed, ["id", "row"], "left")
    return out.select(
        F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"), *(["kept_text", "phrases"] if kept_text else [])
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d WHERE len(w) >= {WINDOW}),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS reference FROM k GROUP BY h),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT k.doc_id, k.i, unnest(range(0, {WINDOW})) AS j FROM k JOIN m USING (h) WHERE reference < doc_id)),
u AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
l AS (SELECT u.doc_id, string_agg(w[u.p], ' ' ORDER BY u.p) AS kept, count(*) AS n FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.p = c.p GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(l.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(l.kept, '')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""
