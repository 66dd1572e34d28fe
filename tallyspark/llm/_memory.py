"""Giving memory back to the system: Python workers are reused, and would keep what a task has freed."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from functools import cache, wraps

import pyarrow as pa


@cache
def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: arrays from a MiB on are mapped, and unmapped when freed
        return libc if hasattr(libc, "malloc_trim") else None
    except (OSError, AttributeError):
        return None  # another C library than glibc


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """A task's function (an iterator over batches) that gives memory back when it ends."""

    @wraps(run)
    def task(batches):
        _libc()
        yield from run(batches)
        trim()

    return task


def trimmed_group(run: Callable) -> Callable:
    """The same for a function of one group."""

    @wraps(run)
    def group(table):
        out = run(table)
        trim()
        return out

    return group
