"""Runs of repeated words: stretches in which a sequence of words occurs at least
three times in a row, found exactly with an enhanced suffix array.

All texts of a batch share one suffix array whose suffixes end with their text:
words of different texts never compare equal. Ranks by the first 1, 2, 4, ... words
are kept; they give the array, the longest common prefixes (LCP) of neighbours and,
read backwards, how far two places agree to the left.

Branching tandem test. A run with period d ends in a square w w, |w| = d, that is
not followed by its own first word, so its halves are suffixes in two children of
the LCP interval of depth d. Each interval therefore looks, for the suffixes i of
all but its largest child, whether i + d or i - d lies in the interval (by the
inverse array) but not in the child of i. Rotating a square to the left as long as
words agree gives the start of its run; of several periods found for one stretch
the smallest is its own.

Intervals come from the nearest smaller LCP values to both sides, no tree is built.
An interval of depth d that holds a run of at least `least` words and `repeats`
periods has at least max(repeats, least // d) suffixes; others are passed over.

Texts are worked whole and by themselves, so Spark spreads them freely; a task
holds a batch of some megabytes or one text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyhub.llm import arrays

LEAST, REPEATS = 24, 3


def _dense(order: np.ndarray, new: np.ndarray, size: int) -> np.ndarray:
    out = np.empty(size, np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def rank_levels(keys: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until all differ.
    `keys` names the words, differently in every text; `ends` is the end of the
    text of each word. Equal ranks mean equal words inside the text."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    # The rank of a group is the place of its first suffix, so groups can be split one by one.
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    levels, step = [rank], 1
    sizes = np.diff(np.append(first, n))
    open_ = order[np.repeat(sizes > 1, sizes)]
    while len(open_):
        after = open_ + step
        # A suffix that ends here comes first; it is the only one of its group that does.
        inside = after < ends[open_]
        second = np.where(inside, rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, rank[open_]))
        open_, second = open_[by], second[by]
        group = rank[open_]
        head = np.ones(len(open_), bool)
        head[1:] = group[1:] != group[:-1]
        new = head.copy()
        new[1:] |= second[1:] != second[:-1]
        starts = np.flatnonzero(new)
        heads = np.flatnonzero(head)
        place = np.arange(len(open_)) - np.repeat(heads, np.diff(np.append(heads, len(open_))))
        sizes = np.diff(np.append(starts, len(open_)))
        rank = rank.copy()
        rank[open_] = np.repeat(group[starts] + place[starts], sizes)
        levels.append(rank)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        step *= 2
    return levels


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of words in which the suffixes at a and b (of one text) agree."""
    out = np.zeros(len(a), np.int64)
    n = len(ends)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        inside = (x < ends[a]) & (y < ends[b])
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        out[same] += 1 << k
    return out


def common_suffix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of words in which the stretches that end before a and b (a < b, of
    one text) agree."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a - out - (1 << k), b - out - (1 << k)
        inside = x >= starts[a]
        same = inside & (levels[k][np.maximum(x, 0)] == levels[k][np.maximum(y, 0)])
        out[same] += 1 << k
    return out


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place with a value above 0 the nearest one before it with a smaller
    value; the first value is below 1. Places jump along the answers of others."""
    at = np.arange(len(values)) - 1
    open_ = np.flatnonzero(values > 0)
    while len(open_):
        open_ = open_[values[at[open_]] >= values[open_]]
        at[open_] = at[at[open_]]
    return at


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def find_runs(keys: np.ndarray, text_at: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """Rows (start, end, period) of all runs of at least `least` words and
    `repeats` (two or more) periods, sorted by start and period. Places count over the whole batch."""
    none = np.zeros((0, 3), np.int64)
    n = len(keys)
    if n < 2:
        return none
    sizes = np.diff(text_at)
    starts, ends = np.repeat(text_at[:-1], sizes), np.repeat(text_at[1:], sizes)
    levels = rank_levels(keys, ends)
    place = levels[-1]
    array = np.empty(n, np.int64)
    array[place] = np.arange(n)
    # lcp[k] belongs to suffixes k - 1 and k; both ends are walls.
    lcp = np.full(n + 1, -1, np.int64)
    linked = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]])
    lcp[1:n] = 0
    lcp[linked + 1] = common_prefix(levels, array[linked], array[linked + 1], ends)
    left = smaller_before(lcp)
    right = n - smaller_before(lcp[::-1])[::-1]
    at = np.flatnonzero(lcp > 0)
    low, high, depth = left[at], right[at] - 1, lcp[at]
    wide = high - low + 1 >= np.maximum(repeats, least // depth)
    at, low, high, depth = at[wide], low[wide], high[wide], depth[wide]
    if not len(at):
        return none
    # Splits of one interval side by side: its children lie between them.
    by = np.lexsort((at, high, low))
    at, low, high, depth = at[by], low[by], high[by], depth[by]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    number = np.cumsum(fresh) - 1
    heads = np.flatnonzero(fresh)
    # One child before each split, and one after the last.
    last = np.append(heads[1:], len(at)) - 1
    child_low = np.concatenate((np.where(fresh, low, np.append(0, at[:-1])), at[last]))
    child_high = np.concatenate((at - 1, high[last]))
    owner = np.concatenate((number, number[last]))
    size = child_high - child_low + 1
    by = np.lexsort((child_low, -size, owner))
    top = np.ones(len(by), bool)
    top[1:] = owner[by][1:] != owner[by][:-1]
    small = by[~top]
    low, high, depth = low[heads], high[heads], depth[heads]
    ranks = _ranges(child_low[small], size[small])
    child = np.repeat(small, size[small])
    node = owner[child]
    i, d = array[ranks], depth[node]
    found = []
    for j, first in ((i + d, i), (i - d, i - d)):
        inside = (j >= starts[i]) & (j < ends[i])
        other = place[np.where(inside, j, 0)]
        hit = inside & (other >= low[node]) & (other <= high[node]) & ((other < child_low[child]) | (other > child_high[child]))
        found.append(np.stack((first[hit], d[hit]), axis=1))
    squares = np.unique(np.concatenate(found), axis=0)
    if not len(squares):
        return none
    begin, period = squares[:, 0], squares[:, 1]
    end = begin + 2 * period
    start = begin - common_suffix(levels, begin, begin + period, starts)
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    own = np.ones(len(by), bool)
    own[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    own &= end - start >= np.maximum(least, repeats * period)
    start, end, period = start[own], end[own], period[own]
    by = np.lexsort((period, start))
    return np.stack((start[by], end[by], period[by]), axis=1)


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text, if its id plants a
    period in it (one id in ten does, none without id), else None."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + np.arange(n - a) % p
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The (start, length, period) with the greatest exact length by period; the
    smallest start, then period, on ties. Runs are sorted by start and period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


REPORT = """doc_id long, n_runs long, start long, length long, period long, exponent_milli long,
runs_sha256 string, collapsed_sha256 string"""
FULL = ", runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _report_batch(piece: pa.RecordBatch, plant: bool, least: int, repeats: int, full: bool) -> pa.RecordBatch:
    data, at = arrays.text_bytes(piece.column("text"))
    starts, ends, word_at = arrays.find_words(data, at)
    words = arrays.word_hashes(data, starts, ends)
    ids = piece.column("doc_id").to_pylist()
    sizes = np.diff(word_at).tolist()
    orders: dict[int, np.ndarray] = {}
    if plant:
        orders = {k: x for k, (d, n) in enumerate(zip(ids, sizes, strict=True)) if (x := planted_order(d, n)) is not None}
        for k, x in orders.items():
            words[word_at[k] : word_at[k + 1]] = words[word_at[k] + x]
    owner = arrays.text_of(word_at).astype(np.uint64)
    runs = find_runs(arrays.mix(words + owner * np.uint64(0x9E3779B97F4A7C15)), word_at, least, repeats)
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.subtract.at(dropped, runs[:, 1], 1)
    dropped = np.cumsum(dropped[:-1]) > 0
    cuts = np.searchsorted(runs[:, 0], word_at).tolist()
    raw = data.tobytes()
    empty = hashlib.sha256(b"").hexdigest()
    out = []
    for k, doc_id in enumerate(ids):
        own = [(s - int(word_at[k]), e - s, p) for s, e, p in runs[cuts[k] : cuts[k + 1]].tolist()]
        # Bytes split at space and 9 to 13, as the words do.
        tokens = raw[at[k] : at[k + 1]].split()
        if k in orders:
            tokens = [tokens[x] for x in orders[k].tolist()]
        row = [doc_id, len(own), None, None, None, None, empty]
        if own:
            tokens = [w for w, gone in zip(tokens, dropped[word_at[k] : word_at[k + 1]].tolist(), strict=True) if not gone]
            start, length, period = strongest(own)
            listed = "".join(f"{s},{m},{p}\n" for s, m, p in own)
            row[2:] = [start, length, period, 1000 * length // period, hashlib.sha256(listed.encode()).hexdigest()]
        kept = b" ".join(tokens)
        row.append(hashlib.sha256(kept).hexdigest())
        if full:
            row += [[{"start": s, "length": m, "period": p} for s, m, p in own], kept.decode()]
        out.append(row)
    types = [pa.int64()] * 6 + [pa.string()] * 2
    names = [f.split()[0] for f in REPORT.replace("\n", " ").split(", ")]
    if full:
        span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        types, names = [*types, pa.list_(span), pa.string()], [*names, "runs", "collapsed"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def periodic_runs(
    docs: DataFrame, plant: bool = False, least: int = LEAST, repeats: int = REPEATS, full: bool = True
) -> DataFrame:
    """One row per document: how many runs it has, the strongest one, digests of
    all runs and of the text with every run cut down to one period; with `full`
    also the runs and that text (kept words joined by one space).

    `plant` first repeats a stretch of words in one document of ten, chosen by id,
    so that results can be checked on any table; documents without id stay as they are.
    Null, empty and blank texts have no runs. Runs may overlap: a word goes if
    any run holds it after that run's first period. Repeated rows are judged one
    by one. Other columns are ignored; no documents give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrays.slices(batches):
            yield _report_batch(piece, plant, least, repeats, full)

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, REPORT + (FULL if full else ""))
