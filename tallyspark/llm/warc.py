"""WARC archives: a normaliser for monolithic gzip files.

``write_raw`` stores pages as WARC records, many to one gzip stream (what a crawler that
compresses whole files leaves behind). ``normalise`` inflates every such file once, from start to
end, and rewrites each record as a gzip member of its own, with a sidecar index of offsets, so
that any record can later be read alone; on the way, records whose payload another record has
already become revisits of it. ``read_back`` reads the members by the index and checks length and
digest of every payload. Only digests and positions are shuffled, never payloads: the revisits
are written by file, and each file is one task's work (as many tasks as files). Payloads are equal if their
length, SHA-1 and SHA-256 are.

Of records with equal payloads of at least ``least`` bytes that with the smallest page_id is the
response (a null page_id sorts last; of repeated rows with the same page_id the first written).
Nulls: a null html is an empty payload; a null url leaves out WARC-Target-URI. Very long payloads: a record is held
whole, some times over, while it is written or read, and never more than one beside some megabytes of a batch. Extra
columns are ignored, whatever their names. Empty table: no files, empty result. Files are named by task and attempt; the table of records, committed by
Spark, says which of them count, so that a lost executor leaves at most unused files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import _files, _text
from tallyspark.llm._skew import join_keys
from tallyspark.llm._store import Scratch

DATE = "2020-01-01T00:00:00Z"
FILE_BYTES = 1 << 30
_CHUNK = 1 << 20
_URI_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))
RAW = "file string, seq long, page_id long, payload_bytes long, digest binary"
DONE = "archive string, index string, records long"
BACK = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, payload_bytes: int, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_URI_SAFE)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one whole record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers.get("content-length", 0))]


def page_of(identifier: str | None) -> int | None:
    text = (identifier or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def inflate(stream):
    """Decompressed chunks of a gzip file, of one member or many."""
    inflater = zlib.decompressobj(31)
    while chunk := stream.read(_CHUNK):
        while chunk:
            if inflater.eof:
                inflater = zlib.decompressobj(31)
            if out := inflater.decompress(chunk, _CHUNK):
                yield out
            chunk = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
    if tail := inflater.flush():
        yield tail


def records(chunks):
    """Whole raw records of a stream of chunks; holds one record and one chunk at a time."""
    buffer, need = bytearray(), None
    for chunk in chunks:
        buffer += chunk
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                sizes = [x.partition(b":")[2] for x in bytes(buffer[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:")]
                need = end + 4 + int(sizes[0]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer.strip():
        raise ValueError("the archive ends within a record")


def member(raw: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _write_raw(folder: str, file_bytes: int):
    def write(batches):
        task = TaskContext.get()
        name, number, out = f"{folder}/{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex[:8]}", 0, None
        for batch in (part for whole in batches for part in _text.slices(whole, 2)):
            rows: dict[str, list] = {"file": [], "seq": [], "page_id": [], "payload_bytes": [], "digest": []}
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                payload = (html or "").encode()
                if out is None:
                    uri, seq, size, packer = f"{name}-{number:04d}.warc.gz", 0, 0, zlib.compressobj(1, zlib.DEFLATED, 31)
                    out, number = _files.create(uri), number + 1
                digest = hashlib.sha1(payload).digest()
                raw = record("response", page_id, url, base32(digest), payload, len(payload))
                out.write(packer.compress(raw))
                for key, value in zip(rows, (uri, seq, page_id, len(payload), digest + hashlib.sha256(payload).digest()), strict=True):
                    rows[key].append(value)
                seq, size = seq + 1, size + len(raw)
                if size >= file_bytes:
                    out.write(packer.flush())
                    out.close()
                    out = None
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("file", pa.string()), ("seq", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.binary())]))
        if out is not None:
            out.write(packer.flush())
            out.close()

    return write


def write_raw(pages: DataFrame, store: Scratch, file_bytes: int = FILE_BYTES, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Monolithic archives of all pages; returns the table of their records."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return store.table("raw", rows.mapInArrow(_write_raw(f"{store.path}/archives-raw", file_bytes), RAW))


def revisits(raw: DataFrame, store: Scratch, least: int = 0) -> DataFrame:
    """(file, seq, refers_to) of the records that repeat the payload of another."""
    where = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "seq")
    firsts = raw.filter(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = store.table("firsts", firsts.filter("n > 1"))
    again = join_keys(raw, firsts, ["digest", "payload_bytes"], "n", raw.count()).filter((F.col("file") != F.col("first.file")) | (F.col("seq") != F.col("first.seq")))
    return again.select("file", "seq", F.col("first.page_id").alias("refers_to"))


def normalise_file(source: str, archive: str, index: str, repeats: dict[int, int | None]) -> int:
    """Rewrites one monolithic file; ``repeats``: response page of the records that become revisits."""
    n = offset = 0
    with _files.open_stream(source) as stream, _files.create(archive) as out, _files.create(index) as side:
        for n, raw in enumerate(records(inflate(stream)), 1):
            headers, block = parse(raw)
            if n - 1 in repeats:
                http, _, payload = block.partition(b"\r\n\r\n")
                raw = record("revisit", page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-payload-digest"].removeprefix("sha1:"), b"", len(payload), repeats[n - 1])
            packed = member(raw)
            out.write(packed)
            entry = {"offset": offset, "length": len(packed), "id": headers.get("warc-record-id"), "digest": headers.get("warc-payload-digest")}
            side.write(json.dumps(entry).encode() + b"\n")
            offset += len(packed)
    return n


def _normalise(folder: str, repeats: str):
    def run(batches):
        for batch in batches:
            for source, number in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                name = f"{folder}/{source.rpartition('/')[2].removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}"
                known: dict[int, int | None] = {}
                for system, path in _files.parquet_files(f"{repeats}/file_number={number}"):
                    with system.open_input_file(path) as f:
                        for part in pq.ParquetFile(f).iter_batches(columns=["seq", "refers_to"]):
                            known.update(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
                n = normalise_file(source, f"{name}.warc.gz", f"{name}.idx", known)
                yield pa.RecordBatch.from_pydict({"archive": [f"{name}.warc.gz"], "index": [f"{name}.idx"], "records": [n]})

    return run


def normalise(raw: DataFrame, repeats: DataFrame, store: Scratch) -> DataFrame:
    """Normalised archives of all files of ``raw``; returns archive, index, records."""
    order = F.row_number().over(Window.orderBy("file")).cast("long")  # one row a file of a gigabyte
    files = store.table("files", raw.select("file").distinct().select("file", order.alias("file_number")))
    n = max(1, files.count())
    repeats = repeats.join(files, "file").select("seq", "refers_to", "file_number")
    repeats.repartition("file_number").write.mode("overwrite").partitionBy("file_number").parquet(f"{store.path}/repeats")
    dealt = files.select("file", "file_number").coalesce(1).repartition(n)  # one row to each partition
    return store.table("archives", dealt.mapInArrow(_normalise(f"{store.path}/archives-normal", f"{store.path}/repeats"), DONE))


def _read_back(batches):
    for batch in batches:
        for archive, index in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            with _files.open_stream(index) as side:
                entries = [json.loads(x) for x in side.read().splitlines()]
            with _files.open_random(archive) as stream:
                for at in range(0, len(entries), 1000):
                    rows = [_read_one(stream, archive, e) for e in entries[at : at + 1000]]
                    names = BACK.replace(" long", "").replace(" string", "").split(", ")
                    types = [pa.string() if x.endswith("string") else pa.int64() for x in BACK.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _read_one(stream, archive: str, entry: dict) -> tuple:
    headers, block = parse(zlib.decompress(stream.read_at(entry["length"], entry["offset"]), 31))
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).partition(b":")[2])
    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
    if kind == "response" and (len(payload) != said or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"{archive} at {entry['offset']}: the payload differs from its digest")
    refers = page_of(headers.get("warc-refers-to"))
    return page_of(headers["warc-record-id"]), said, digest, kind, refers, archive, entry["offset"], entry["length"]


def read_back(archives: DataFrame) -> DataFrame:
    """One row per record of the archives, each read alone by the sidecar index."""
    return archives.select("archive", "index").coalesce(1).repartition(max(1, archives.count())).mapInArrow(_read_back, BACK)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Scratch(spark, "warc")
    raw = write_raw(spark.read.parquet(f"{sf_dir}/pages.parquet"), store)
    archives = normalise(raw, revisits(raw, store), store)
    store.drop("archives-raw")
    store.keep("archives")
    return read_back(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGIT = " || ".join(f"substr('{_ABC}', CAST((CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT) >> {s}) & 31 AS BIGINT) + 1, 1)" for s in (15, 10, 5, 0))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT *, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id ASC NULLS LAST) AS first_id,
             row_number() OVER (PARTITION BY html ORDER BY page_id ASC NULLS LAST) AS nth FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 8), lambda i: {_DIGIT}), 'string_agg', '') AS payload_digest,
       CASE nth WHEN 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN first_id END AS refers_to FROM w
"""
