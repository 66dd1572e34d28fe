"""Subword-bag embeddings averaged into a softmax, trained jointly by stochastic gradient descent in numpy.

A text's features are its words and the character n-grams of its words (their ends marked by the
white space around them), each hashed to a row of one embedding table. The mean of a text's
feature vectors goes through a linear softmax; table and softmax are learnt together with
per-row adaptive steps. Once trained, table times softmax is one number a feature, so that scoring
a text of any length means averaging numbers looked up in an array of ``2**bits`` floats: that array
is all that is sent to the tasks.

Training reads a bounded sample of labelled rows (``SAMPLE`` a class, the smallest by hash of
doc_id, texts of at most ``MOST_CHARS``, ``SAMPLE_CHARS`` a class together, which bounds what comes to the
driver); scoring reads all rows and whole texts, in blocks, some megabytes of a batch at a time.
Loss weights per class, and a calibration on rows kept out of training, are options of the ``Shape``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm import _text
from tallyspark.llm._memory import trim, trimmed

SAMPLE, MOST_CHARS, SAMPLE_CHARS = 2500, 20_000, 6_000_000
_BASE = np.uint32(0x01000193)


@dataclass(frozen=True)
class Shape:
    bits: int = 16
    grams: tuple[int, ...] = (3, 4, 5)
    lower: bool = False
    words: int = 1  # word n-grams up to so many words
    dim: int = 8
    gain: float = 40.0
    epochs: int = 4
    steps: int = 16_000  # at least so many; a small sample is passed more often
    smooth: float = 30.0  # features of no meaning added to each text, so that a few odd ones don't decide
    rate: float = 0.15
    seed: int = 5
    balance: float = 0.5  # 1: both classes weigh the same in the loss, 0: each row does
    calibrated: bool = False  # whether every fifth row is kept out of training to fit scale and offset of the log odds


def _code() -> np.ndarray:
    codes = np.random.default_rng(11).integers(1, 1 << 32, 256, dtype=np.uint32)
    codes[list(_text.SPACES)] = codes[0x20]
    return codes


_CODE = _code()


def _slots(x: np.ndarray, salt: int, bits: int) -> np.ndarray:
    x = x ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x >> np.uint32(32 - bits)


def _block_features(block: bytes, shape: Shape) -> np.ndarray:
    raw = np.frombuffer(b" " + block + b" ", np.uint8)
    if shape.lower:
        raw = _text._LOWER[raw]
    code, space = _CODE[raw], _text._SPACE[raw]
    words = _text._block_words(block, shape.lower)
    out = [_slots(words.astype(np.uint32) ^ (words >> np.uint64(32)).astype(np.uint32), 1, shape.bits)]
    gram = words
    for n in range(2, shape.words + 1):
        gram = gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 :]
        out.append(_slots(gram.astype(np.uint32) ^ (gram >> np.uint64(32)).astype(np.uint32), 64 + n, shape.bits))
    up_to = np.concatenate([[0], np.cumsum(space)])
    power, total, n = np.uint32(1), np.zeros(len(raw), np.uint32), 0
    for want in sorted(shape.grams):
        while n < want:
            total = total[: len(raw) - n] + code[n:] * power
            power = power * _BASE
            n += 1
        inside = up_to[n - 1 :][: len(total)] - up_to[1:][: len(total)]
        out.append(_slots(total[inside == 0], want, shape.bits))
    return np.concatenate(out)


def features(data: bytes, shape: Shape):
    """Feature numbers of one text, a block at a time."""
    with np.errstate(over="ignore"):
        for block in _text._blocks(data):
            yield _block_features(block, shape)


def histogram(data: bytes, shape: Shape) -> np.ndarray:
    out = np.zeros(1 << shape.bits, np.int64)
    for part in features(data, shape):
        out += np.bincount(part, minlength=1 << shape.bits)
    return out


def calibrate(z: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Scale and offset of log odds by weighted logistic regression, with a weak pull to (1, 0)."""
    a, b = 1.0, 0.0
    x = np.stack([z, np.ones(len(z))], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        slope = x.T @ (weights * (p - labels)) + np.array([a - 1, 0.1 * b])
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag([1.0, 0.1])
        step = np.linalg.solve(curve, slope)
        a, b = max(0.05, a - float(np.clip(step[0], -2, 2))), b - float(np.clip(step[1], -2, 2))
    return a, b


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], shape: Shape, totals: dict[int, int] | None = None) -> tuple[np.ndarray, float]:
    """(log odds a feature, log odds of no features) from (feature numbers, counts) of each text; ``totals``: labelled
    rows of each class, of which the bags are a sample (for the calibration)."""
    if shape.calibrated and len(bags) >= 50:
        aside = np.arange(len(bags)) % 5 == 4
        odds, bias = _train([b for b, x in zip(bags, aside, strict=True) if not x], [y for y, x in zip(labels, aside, strict=True) if not x], shape)
        kept = [(b, y) for b, y, x in zip(bags, labels, aside, strict=True) if x]
        z = np.array([bias + float(odds[at] @ counts) / (shape.smooth + float(counts.sum(dtype=np.int64))) for (at, counts), _ in kept])
        y = np.array([y for _, y in kept], np.float64)
        share = [(totals or {}).get(c, 1) / max(1, labels.count(c)) if totals else 1.0 for c in (0, 1)]
        weights = np.where(y > 0, share[1], share[0])
        a, b = calibrate(z, y, weights / weights.mean())
        return a * odds, a * bias + b
    return _train(bags, labels, shape)


def _train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], shape: Shape) -> tuple[np.ndarray, float]:
    rng = np.random.default_rng(shape.seed)
    table = rng.normal(0, 1e-3, (1 << shape.bits, shape.dim)).astype(np.float32)
    soft = rng.normal(0, 0.5, (2, shape.dim)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen, soft_seen, bias_seen = np.full(1 << shape.bits, 1e-8, np.float32), np.full_like(soft, 1e-4), np.full(2, 1e-4, np.float32)
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    epochs = max(shape.epochs, -(-shape.steps // max(1, len(bags))))
    for epoch in range(epochs if bags else 0):
        rate = shape.rate * (1 - epoch / epochs)
        for i in rng.permutation(len(bags)):
            at, counts = bags[i]
            weight = counts.astype(np.float32) / np.float32(shape.smooth + counts.sum(dtype=np.int64))
            mean = weight @ table[at]
            z = shape.gain * (soft @ mean) + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= np.float32(0.5 / max(share[labels[i]], 1e-3)) ** shape.balance
            pull = shape.gain * (p @ soft)
            size = weight * np.float32(np.sqrt((pull**2).mean()))
            seen[at] += size**2
            table[at] -= (rate * weight / np.sqrt(seen[at]))[:, None] * pull
            g = shape.gain * np.outer(p, mean)
            soft_seen += g**2
            soft -= 0.1 * rate * g / np.sqrt(soft_seen)
            bias_seen += p**2
            bias -= rate * p / np.sqrt(bias_seen)
    return shape.gain * (table @ (soft[1] - soft[0])).astype(np.float64), float(bias[1] - bias[0])


def score(data: bytes, odds: np.ndarray, bias: float, shape: Shape) -> float:
    total, n = 0.0, 0
    for part in features(data, shape):
        total += float(odds[part].sum())
        n += len(part)
    z = bias + total / max(shape.smooth + n, 1e-9)
    return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def _bags(shape: Shape):
    """label, bag: distances of feature numbers and their counts, compressed."""

    def run(batches):
        for whole in batches:
            for batch in _text.slices(whole, 1):
                bags = []
                for text in batch.column(1).to_pylist():
                    counts = histogram((text or "").encode(), shape)
                    at = np.flatnonzero(counts)
                    bags.append(zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + np.minimum(counts[at], 65535).astype("<u2").tobytes(), 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(bags, pa.binary())], names=["label", "bag"])

    return run


def _bag(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(data)
    n = len(data) // 6
    return np.cumsum(np.frombuffer(data, "<u4", n), dtype=np.uint32), np.frombuffer(data, "<u2", n, 4 * n).copy()


def fit(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, shape: Shape, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Model from the labelled rows for which ``learn`` (a condition on doc_id) holds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).filter(learn).groupBy("doc_id").agg(F.max("label").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()} if shape.calibrated else None
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.filter("label = 0").orderBy(*order).limit(sample).unionByName(known.filter("label = 1").orderBy(*order).limit(sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.char_length("text").cast("long").alias("chars")).filter(F.col("chars") <= MOST_CHARS)
    texts = texts.join(F.broadcast(chosen), "doc_id")
    by = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", "chars", F.xxhash64("text"))
    sizes = texts.select("doc_id", "label", "chars", F.xxhash64("text").alias("mark"), F.row_number().over(by).alias("nth"), F.sum("chars").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"))
    sizes = sizes.filter((F.col("nth") <= sample) & (F.col("sum") <= SAMPLE_CHARS)).select("doc_id", "mark").distinct()
    texts = texts.withColumn("mark", F.xxhash64("text")).join(F.broadcast(sizes), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    rows = texts.select("label", "text").mapInArrow(trimmed(_bags(shape)), "label int, bag binary").collect()
    rows.sort(key=lambda r: (r.label, r.bag), reverse=True)  # the same order whatever the partitions
    bags, marks = [], []
    while rows:  # each row goes as its bag comes
        row = rows.pop()
        bags.append(_bag(row.bag))
        marks.append(row.label)
    trim()
    model = train(bags, marks, shape, totals)
    del bags
    trim()
    return model


def scored(docs: DataFrame, model: tuple[np.ndarray, float], shape: Shape) -> DataFrame:
    """All rows of ``docs`` with their columns and ``score`` put last."""
    odds, bias = model
    sent = docs.sparkSession.sparkContext.broadcast((odds.astype(np.float32), bias))
    n = len(docs.columns)

    def run(batches):
        odds, bias = sent.value
        for whole in batches:
            for batch in _text.slices(whole, n):
                scores = pa.array([score((t or "").encode(), odds, bias, shape) for t in batch.column(n).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], scores], schema=pa.schema([*[batch.schema.field(i) for i in range(n)], pa.field(names[-1], pa.float64())]))

    names = [f"__{i}" for i in range(n)] + ["__score"]
    rows = docs.select(*[F.col(f"`{c}`").alias(names[i]) for i, c in enumerate(docs.columns)], F.col("text").alias("__text"))
    schema = rows.drop("__text").schema.add("__score", "double")
    out = rows.mapInArrow(trimmed(run), schema)
    return out.select(*[F.col(names[i]).alias(c) for i, c in enumerate(docs.columns)], F.col("__score").alias("score"))
