"""Whole batches of texts as numpy arrays: words, lines and their hashes.

Words are runs of bytes other than space and the five control characters
9 to 13. Hashes are 64 bits wide: a polynomial over the bytes or words, made
from running sums so that any span costs one subtraction, then mixed.
"""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
POWER_STEP = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
BYTE_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def per_worker(key, make: Callable):
    """What make() gives, made once for each Python worker process. Spark uses a
    worker for many tasks, so vocabularies and caches need not be built for each;
    what is kept must be bounded and not change results."""
    kept = sys.modules.setdefault("storyhub_worker_state", types.ModuleType("storyhub_worker_state")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def drop_worker_state() -> None:
    """Lets go of what operators before kept in this worker, for tasks that need the
    memory themselves."""
    sys.modules.pop("storyhub_worker_state", None)
    gc.collect()
    free_unused()


def free_unused() -> None:
    """Gives freed memory back to the system; else a worker keeps its peaks for good."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a hash so that all its bits depend on all bits of x."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = -(-n // POWER_STEP) * POWER_STEP
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base & _MASK, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def running_sums(values: np.ndarray) -> np.ndarray:
    """What hashes of spans are made from."""
    up, _ = _power_tables(len(values) + 1)
    running = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], dtype=np.uint64, out=running[1:])
    return running


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every span."""
    return spans_of(running_sums(values), starts, ends)


def spans_of(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same from running sums, which spans of several kinds can share."""
    _, down = _power_tables(len(running))
    out = (running[ends] - running[starts]) * down[starts]
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and where each text starts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches between rows so that each piece holds about `limit` bytes of
    text or one row; a text is never cut."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = text_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def find_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each text's first word."""
    texts = len(at) - 1
    inside = ~WHITE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(texts + 1, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = at[1:][at[:-1] < at[1:]] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(BYTE_VALUES[data], starts, ends)


def window_hashes(words: np.ndarray, word_at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of `size` words inside one text."""
    counts = np.maximum(np.diff(word_at) - size + 1, 0)
    first = np.repeat(word_at[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    return first, span_hashes(words, first, first + size)


def per_text(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of marks over each text."""
    running = np.zeros(len(marks) + 1, np.int64 if marks.dtype != np.float64 else np.float64)
    np.cumsum(marks, out=running[1:])
    return running[at[1:]] - running[at[:-1]]


def text_of(at: np.ndarray) -> np.ndarray:
    """Index of the text each element belongs to."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def met_twice(keys: np.ndarray) -> np.ndarray:
    """Whether a key occurs twice or more."""
    order = np.argsort(keys)
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    np.equal(ordered[1:], ordered[:-1], out=same[1:-1])
    found = np.empty(len(keys), bool)
    found[order] = same[1:] | same[:-1]
    return found


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a key occurs twice or more, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = ordered[1:] == ordered[:-1]
    either = same.copy()
    either[:-1] |= same[1:]
    found, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    found[order], again[order] = either, same
    return found, again
