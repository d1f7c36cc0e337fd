"""Whole UTF-8 texts as flat numpy arrays: words, rolling fingerprints, bounded chunks.

Everything here runs inside tasks. A record batch is cut into chunks of about
half a megabyte of text; a longer text is a chunk of its own, never a prefix.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
FIELD = np.uint64
MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def worker_cache(key: str, build: Callable[[], Any]) -> Any:
    """``build()``, kept in the Python worker for its later tasks."""
    store = sys.modules.setdefault("_leakatlas_worker_cache", types.ModuleType("_leakatlas_worker_cache"))
    if not hasattr(store, key):
        setattr(store, key, build())
    return getattr(store, key)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the n + 1 places where they begin; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return flat, at - at[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with up to ``limit`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for row, size in enumerate(sizes):
        if row > first and held + size > limit:
            yield batch.slice(first, row - first)
            first, held = row, 0
        held += int(size)
    yield batch.slice(first)


def spaces(data: np.ndarray) -> np.ndarray:
    """Where a byte is one of space, tab, line feed, vertical tab, form feed, carriage return."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text number of every word; words never cross texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~spaces(data)
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    edges = at[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finish)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> FIELD(30))) * FIELD(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> FIELD(27))) * FIELD(0x94D049BB133111EB)
        return x ^ (x >> FIELD(31))


def byte_values(seed: int, fold_case: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with ``fold_case`` A-Z count as a-z."""
    table = mix(np.arange(1, 257, dtype=FIELD) * FIELD(0xD6E8FEB86659FD93) + FIELD(seed))
    if fold_case:
        table[65:91] = table[97:123]
    return table


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def build(size: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for base in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)):
            steps = np.full(size, base, FIELD)
            steps[0] = 1
            out.append(np.cumprod(steps))
        return out[0], out[1]

    have = worker_cache("powers", lambda: build(2 * CHUNK_BYTES))
    if len(have[0]) <= n:
        return build(n + 1)
    return have


class Fingerprints:
    """64-bit fingerprints of any spans of a text in constant time each."""

    def __init__(self, data: np.ndarray, values: np.ndarray):
        self.up, self.down = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, FIELD)
        np.cumsum(values[data] * self.up[: len(data)], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal spans; spread by ``mix``, with the length."""
        with np.errstate(over="ignore"):
            h = (self.sums[end] - self.sums[start]) * self.down[start]
            return mix(h + (end - start).astype(FIELD) * FIELD(0xC2B2AE3D27D4EB4F))


def per_text(counts_at: np.ndarray, n: int) -> np.ndarray:
    """How many of the text numbers ``counts_at`` fall on each of ``n`` texts."""
    return np.bincount(counts_at, minlength=n).astype(np.int64)
