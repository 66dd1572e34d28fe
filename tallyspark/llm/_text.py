"""Vectorised word, shingle and character n-gram hashing over UTF-8 bytes.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; these six bytes never occur
inside a multi-byte UTF-8 sequence, so splitting bytes and splitting characters agree.
Texts of any length are hashed in blocks that end at white space: memory beyond the
8 bytes kept per word stays bounded by the block (or by one single word, if that is longer).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def slices(batch: pa.RecordBatch, text: int, most: int = 1 << 22):
    """Stretches of a batch whose texts have about ``most`` bytes together (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    ends, at = np.cumsum(size), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    up = _powers(_BASE, 1)
    down = _powers(_BASE_INVERSE, 1)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _blocks(data: bytes):
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + BLOCK)
        if end < n:
            cut = max(data.rfind(bytes([s]), at, end) for s in SPACES)
            if cut <= at:  # one word fills the block: take it whole
                later = [c for c in (data.find(bytes([s]), end) for s in SPACES) if c >= 0]
                cut = min(later) if later else n
            end = cut
        yield data[at:end]
        at = end


def _block_words(block: bytes, lower: bool) -> np.ndarray:
    raw = np.frombuffer(block, np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _SPACE[raw]
    start = np.flatnonzero(space[:-1] & ~space[1:])
    if not len(start):
        return np.empty(0, np.uint64)
    end = np.flatnonzero(~space[:-1] & space[1:])
    up, down = _Tables.of(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[_LOWER[raw] if lower else raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(data: bytes, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word of one text, in order."""
    parts = [_block_words(b, lower) for b in _blocks(data)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint64)


def batch_word_hashes(texts: list[bytes], lower: bool = False):
    """(hashes of all words of all texts, end of each text in them); many short texts are hashed at once."""
    out, ends, n, i = [], [], 0, 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < BLOCK):
            size += len(texts[j]) + 1
            j += 1
        if j == i + 1:
            words = word_hashes(texts[i], lower)
            ends.append([n + len(words)])
        else:
            joined = b"\n".join(texts[i:j])
            raw = np.frombuffer(joined, np.uint8)
            space = np.ones(len(raw) + 1, bool)
            space[1:] = _SPACE[raw]
            count = np.cumsum(space[:-1] & ~space[1:])
            last = np.cumsum([len(t) + 1 for t in texts[i:j]]) - 2
            words = _block_words(joined, lower)
            at = np.where(last >= 0, count[np.maximum(last, 0)], 0) if len(raw) else np.zeros(j - i, np.int64)
            ends.append(n + at)
        out.append(words)
        n += len(words)
        i = j
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(ends).astype(np.int64)


def windows(words: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each k consecutive words (none if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, power = np.zeros(n, np.uint64), 1
    for i in range(k):
        out += words[i : i + n] * np.uint64(power)
        power = power * base % (1 << 64)
    return mix(out)


_KEPT: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _KEPT or len(_KEPT[base][0]) < n:
        size = max(n, 1 << 15)
        _KEPT[base] = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
    return _KEPT[base]


def rolling(words: np.ndarray, base: int):
    """Prefix form of a polynomial hash: span(start, end) hashes any stretch of words in O(1)."""
    up, down = _tables(base, len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])

    def span(start, end):
        return mix((total[end] - total[start]) * down[start] + np.asarray(end - start).astype(np.uint64))

    return span


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Distinct k-word shingles, sorted; fewer words form one shingle; none form none."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(windows(words, min(k, len(words))))
