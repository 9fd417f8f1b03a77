"""Removal of repeated passages by level-wise doubling.

A window of 2w words can only repeat if the windows of w words at its start and
at its middle repeat. So windows of the shortest level are hashed everywhere;
positions whose window repeats are candidates, and two candidates w words apart
are extended to a window of twice the length, named by the pair of their names.
Levels end when the asked length is reached or no candidate survives.

Exact copies of a word sequence are one class from the start, and a task sends
each distinct window name once, however often its texts hold it: a passage or
copy shared by very many documents reaches a bucket at most once per task.
Positions stay where their class is; only names and the smallest document that
holds them are exchanged.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyhub.llm import arrays
from storyhub.session import materialize

BUCKET_NAMES = 2_500_000
"""Window names a bucket should hold; sets the number of buckets."""
LOW48 = np.uint64((1 << 48) - 1)


def _pack48(x: np.ndarray) -> bytes:
    """48-bit names, low and high parts apart."""
    return x.astype("<u4").tobytes() + (x >> np.uint64(32)).astype("<u2").tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) | (np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32))


def _pack_positions(x: np.ndarray) -> bytes:
    """Positions as two planes of 16 bits; the high one hardly changes and is
    compressed away by the shuffle."""
    return (x & 0xFFFF).astype("<u2").tobytes() + (x >> 16).astype("<u2").tobytes()


def _unpack_positions(raw: bytes) -> np.ndarray:
    n = len(raw) // 4
    return np.frombuffer(raw, "<u2", n).astype(np.int64) | (np.frombuffer(raw, "<u2", n, 2 * n).astype(np.int64) << 16)


def _class_of(words: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    """Name of each text's word sequence: 64 bits, signed."""
    return arrays.span_hashes(words, word_at[:-1], word_at[1:]).view(np.int64)


def _words(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, at = arrays.text_bytes(piece.column("text"))
    starts, ends, word_at = arrays.find_words(data, at)
    return arrays.word_hashes(data, starts, ends), word_at


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in arrays.slices(batches):
        words, word_at = _words(piece)
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), piece.column("text_hash"), pa.array(_class_of(words, word_at)), pa.array(np.diff(word_at))],
            ["doc_id", "text_hash", "class", "n_words"],
        )


BLOBS = "kind string, bucket int, names binary, classes binary, counts binary, positions binary"
"""Rows of window names. kind "new": names one task holds once, with class and
position, to be compared; "seen": the same with names known to repeat; "name":
a name without a place, sent for comparison only."""


def _blob_rows(kind: str, bucket: np.ndarray, names: np.ndarray, cls: np.ndarray, pos: np.ndarray):
    """One row per bucket; entries must come by class."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        at = order[lo:hi]
        c = cls[at]
        runs = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        counts = np.diff(np.append(runs, len(c)))
        yield (kind, int(bucket[at[0]]), _pack48(names[at]), c[runs].astype("<i8").tobytes(), counts.astype("<u4").tobytes(), _pack_positions(pos[at]))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _first_level(size: int, least: int, buckets: int):
    """Names of all windows of `size` words in texts of `least` words or more.
    Names held twice by one task are known to repeat: their places are passed on
    as "seen" and the name goes out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for piece in arrays.slices(batches):
            words, word_at = _words(piece)
            cls = _class_of(words, word_at)
            use = np.diff(word_at) >= least
            for k in np.flatnonzero(use):
                if int(cls[k]) in met:
                    use[k] = False
                else:
                    met.add(int(cls[k]))
            first, hashes = arrays.window_hashes(words, word_at, size)
            doc = np.searchsorted(word_at, first, side="right") - 1
            keep = use[doc]
            first, names, doc = first[keep], hashes[keep] & LOW48, doc[keep]
            pos, owner = first - word_at[doc], cls[doc]
            found, again = arrays.repeated(names)
            bucket = (names % np.uint64(buckets)).astype(np.int64)
            rows = [*_blob_rows("new", bucket[~found], names[~found], owner[~found], pos[~found])]
            # Repeats travel by class: that is where they will be needed.
            home = owner[found] % buckets
            rows += _blob_rows("seen", home, names[found], owner[found], pos[found])
            once = found & ~again
            none = np.zeros(int(once.sum()), np.int64)
            rows += _blob_rows("name", bucket[once], names[once], none, none)
            if rows:
                yield _batch(rows, BLOBS)

    return run


def _read(table: pa.Table, kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    names, classes, positions = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for kind, n, c, k, p in zip(*(table.column(x).to_pylist() for x in ("kind", "names", "classes", "counts", "positions")), strict=True):
        if kind in kinds:
            names.append(_unpack48(n))
            classes.append(np.repeat(np.frombuffer(c, "<i8"), np.frombuffer(k, "<u4")))
            positions.append(_unpack_positions(p))
    return np.concatenate(names), np.concatenate(classes), np.concatenate(positions)


def _repeats(buckets: int):
    """Of a bucket's names, the places of those that are held more than once."""

    def run(table: pa.Table) -> pa.Table:
        names, cls, pos = _read(table, ("new",))
        bare, _, _ = _read(table, ("name",))
        found, _ = arrays.repeated(np.concatenate((names, bare)))
        found = found[: len(names)]
        names, cls, pos = names[found], cls[found], pos[found]
        order = np.lexsort((pos, cls))
        rows = [*_blob_rows("seen", cls[order] % buckets, names[order], cls[order], pos[order])]
        kept = table.filter(pc.equal(table.column("kind"), "seen"))
        return pa.concat_tables([pa.Table.from_batches([_batch(rows, BLOBS)]), kept.cast(pa.schema([(f.name, f.type) for f in _batch([], BLOBS).schema]))])

    return run


def _pairs(table: pa.Table, size: int) -> tuple[np.ndarray, ...]:
    """Candidates of a block of classes that extend to windows of twice `size`:
    name of first and second half, class, position; ordered by class, position."""
    names, cls, pos = _read(table, ("seen",))
    order = np.lexsort((pos, cls))
    names, cls, pos = names[order], cls[order], pos[order]
    # Number every word of the block's classes, `size` words of gap between classes.
    fresh = np.concatenate(([True], cls[1:] != cls[:-1])) if len(cls) else np.zeros(0, bool)
    index = np.cumsum(fresh) - 1
    longest = np.maximum.reduceat(pos, np.flatnonzero(fresh)) + size + 1 if len(cls) else np.zeros(0, np.int64)
    line = pos + (np.cumsum(longest) - longest)[index] if len(cls) else pos
    at = np.searchsorted(line, line + size)
    ok = (at < len(line)) & (line[np.minimum(at, max(len(line) - 1, 0))] == line + size) if len(line) else np.zeros(0, bool)
    return names[ok], names[at[ok]], cls[ok], pos[ok]


PAIRS = "block int, bucket int, left binary, right binary, low binary, high binary"


def _group_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal pairs together, and where each group starts."""
    order = np.lexsort((right, left))
    a, b = left[order], right[order]
    return order, np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)


def _smallest(table: pa.Table, wanted: np.ndarray) -> np.ndarray:
    ids, low = table.column("class").to_numpy(), table.column("doc_id").to_numpy()
    order = np.argsort(ids)
    return low[order][np.searchsorted(ids[order], wanted)]


def _double(size: int, buckets: int):
    """Each distinct pair of a block with the smallest and largest document that holds it."""

    def run(key, seen: pa.Table, classes: pa.Table) -> pa.Table:
        left, right, cls, _ = _pairs(seen, size)
        rows = []
        if len(left):
            doc = _smallest(classes, cls)
            order, heads = _group_pairs(left, right)
            low, high = np.minimum.reduceat(doc[order], heads), np.maximum.reduceat(doc[order], heads)
            a, b = left[order][heads], right[order][heads]
            bucket = (arrays.mix(a * np.uint64(3) + b) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                at = by[lo:hi]
                rows.append((key[0].as_py(), int(bucket[at[0]]), _pack48(a[at]), _pack48(b[at]), low[at].astype("<i8").tobytes(), high[at].astype("<i8").tobytes()))
        return pa.Table.from_batches([_batch(rows, PAIRS)])

    return run


def _settle(table: pa.Table) -> pa.Table:
    """The smallest document of every pair that more than one document holds,
    told to each block that holds the pair."""
    blocks, lefts, rights, lows, highs = ([] for _ in range(5))
    for block, a, b, low, high in zip(*(table.column(x).to_pylist() for x in ("block", "left", "right", "low", "high")), strict=True):
        lefts.append(_unpack48(a))
        rights.append(_unpack48(b))
        lows.append(np.frombuffer(low, "<i8"))
        highs.append(np.frombuffer(high, "<i8"))
        blocks.append(np.full(len(lows[-1]), block))
    left, right, block = np.concatenate(lefts), np.concatenate(rights), np.concatenate(blocks)
    order, heads = _group_pairs(left, right)
    low = np.minimum.reduceat(np.concatenate(lows)[order], heads)
    high = np.maximum.reduceat(np.concatenate(highs)[order], heads)
    group = np.cumsum(np.bincount(heads, minlength=len(order))) - 1
    low, more = low[group], (low < high)[group]
    a, b, block = left[order][more], right[order][more], block[order][more]
    low = low[more].astype("<i8")
    rows = []
    by = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.diff(block[by], prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        at = by[lo:hi]
        rows.append((int(block[at[0]]), 0, _pack48(a[at]), _pack48(b[at]), low[at].tobytes(), b""))
    return pa.Table.from_batches([_batch(rows, PAIRS)])


def _known(told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    col = lambda x, f: np.concatenate([f(v) for v in told.column(x).to_pylist()]) if told.num_rows else f(b"")
    return col("left", _unpack48), col("right", _unpack48), col("low", lambda v: np.frombuffer(v, "<i8"))


def _look_up(seen: pa.Table, told: pa.Table, size: int):
    """Pairs of a block that repeat, with the smallest document of each."""
    left, right, cls, pos = _pairs(seen, size)
    a, b, low = _known(told)
    key = lambda x, y: arrays.mix(x * np.uint64(3) + y) ^ arrays.mix(y)
    asked, known = key(left, right), key(a, b)
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known[order], asked), max(len(known) - 1, 0))
    hit = known[order][at] == asked if len(known) else np.zeros(len(asked), bool)
    at = order[at[hit]] if len(known) else np.zeros(0, np.int64)
    return asked[hit] & LOW48, cls[hit], pos[hit], low[at]


def _next_level(size: int):
    def run(key, seen: pa.Table, told: pa.Table) -> pa.Table:
        names, cls, pos, _ = _look_up(seen, told, size)
        block = np.full(len(cls), key[0].as_py())
        return pa.Table.from_batches([_batch([*_blob_rows("seen", block, names, cls, pos)], BLOBS)])

    return run


RANGES = "class long, spans binary"


def _marks(size: int):
    """Words of each class covered by windows that start in a smaller document,
    as ascending (start, end) pairs."""

    def run(key, left: pa.Table, classes: pa.Table) -> pa.Table:
        seen = left.filter(pc.equal(left.column("kind"), "seen"))
        told = left.filter(pc.equal(left.column("kind"), "told"))
        told = told.select(["names", "classes", "positions"]).rename_columns(["left", "right", "low"])
        _, cls, pos, low = _look_up(seen, told, size)
        rows = []
        if len(cls):
            marked = low < _smallest(classes, cls)
            cls, pos = cls[marked], pos[marked]
        if len(cls):
            fresh = (np.diff(cls, prepend=cls[0] - 1) != 0) | (np.diff(pos, prepend=-(1 << 40)) > 2 * size)
            heads = np.flatnonzero(fresh)
            tails = np.append(heads[1:], len(pos)) - 1
            spans = np.stack((pos[heads], pos[tails] + 2 * size), axis=1).astype("<i8")
            owner = cls[heads]
            edges = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                rows.append((int(owner[lo]), spans[lo:hi].tobytes()))
        return pa.Table.from_batches([_batch(rows, RANGES)])

    return run


def repeated_spans(docs: DataFrame, window: int = 50, levels: int = 1) -> DataFrame:
    """doc_id, text_hash, `copy` (of a smaller document) and `spans` (binary pairs of 64-bit word numbers) to be
    removed: words covered by a window of `window` words whose sequence also
    starts in a document with a smaller id. `window` must be a multiple of
    2**levels; the shortest level has window / 2**levels words."""
    if window % (1 << levels) or levels < 1:
        raise ValueError("window must be a multiple of 2**levels, with one level or more")
    known = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    known = materialize(known.mapInArrow(_classes, "doc_id long, text_hash long, class long, n_words long"))
    smallest = known.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"))
    smallest = materialize(smallest.filter(F.col("n_words") >= window))
    buckets = math.ceil((smallest.agg(F.sum("n_words")).first()[0] or 1) / BUCKET_NAMES)
    buckets = max(buckets, docs.sparkSession.sparkContext.defaultParallelism)
    block = F.pmod("class", F.lit(buckets)).cast("int").alias("bucket")
    smallest = smallest.select("class", "doc_id", block)
    size = window >> levels
    seen = docs.mapInArrow(_first_level(size, window, buckets), BLOBS).groupBy("bucket").applyInArrow(_repeats(buckets), BLOBS)
    seen = materialize(seen)
    told = None
    for level in range(levels):
        pairs = seen.groupBy("bucket").cogroup(smallest.groupBy("bucket")).applyInArrow(_double(size, buckets), PAIRS)
        told = materialize(pairs.groupBy("bucket").applyInArrow(_settle, PAIRS))
        if level < levels - 1:
            seen = materialize(
                seen.groupBy("bucket").cogroup(told.groupBy("block")).applyInArrow(_next_level(size), BLOBS)
            )
            size *= 2
    answers = told.select(
        F.lit("told").alias("kind"), F.col("block").alias("bucket"), F.col("left").alias("names"), F.col("right").alias("classes"),
        F.lit(None).cast("binary").alias("counts"), F.col("low").alias("positions"),
    )
    spans = (
        seen.unionByName(answers).groupBy("bucket").cogroup(smallest.groupBy("bucket")).applyInArrow(_marks(size), RANGES)
    )
    # A copy of a smaller document is covered whole.
    firsts = smallest.select("class", F.col("doc_id").alias("first"))
    return (
        known.join(firsts, "class", "left")
        .join(spans, "class", "left")
        .select(
            "doc_id",
            "text_hash",
            F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy"),
            "spans",
        )
        .filter("copy or spans is not null")
        .dropDuplicates(["doc_id", "text_hash"])
    )


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in arrays.slices(batches):
        others = [n for n in piece.schema.names if n.startswith("own_")]
        data, at = arrays.text_bytes(piece.column("text"))
        starts, ends, word_at = arrays.find_words(data, at)
        raw, rows = data.tobytes(), []
        columns = zip(piece.column("doc_id").to_pylist(), piece.column("copy").to_pylist(), piece.column("spans").to_pylist(), strict=True)
        for k, (doc_id, copy, spans) in enumerate(columns):
            lo, hi = word_at[k], word_at[k + 1]
            keep = np.ones(hi - lo, bool)
            if copy:
                keep[:] = False
            elif spans:
                for a, b in np.frombuffer(spans, "<i8").reshape(-1, 2):
                    keep[a:b] = False
            if keep.all():
                text = b" ".join(raw[at[k] : at[k + 1]].translate(None, b"") .split())
            else:
                text = b" ".join(raw[s:e] for s, e in zip(starts[lo:hi][keep].tolist(), ends[lo:hi][keep].tolist(), strict=True))
            rows.append((doc_id, int(hi - lo), int((~keep).sum()), hashlib.sha256(text).hexdigest(), text.decode()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        yield pa.RecordBatch.from_arrays(
            columns + [piece.column(n) for n in others], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", *others]
        )


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _removed(docs: DataFrame, window: int, levels: int, own: list[str]) -> DataFrame:
    """RESULT and the columns `own` of docs, renamed to own_0, own_1, ..."""
    passed = [F.col(c).alias(f"own_{k}") for k, c in enumerate(own)]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *passed)
    spans = repeated_spans(docs.filter("doc_id is not null"), window, levels)
    joined = docs.withColumn("text_hash", F.xxhash64("text")).join(spans, ["doc_id", "text_hash"], "left").drop("text_hash")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name.startswith("own_")]
    return joined.mapInArrow(_cutter, ", ".join([RESULT, *fields]))


def remove_repeats(docs: DataFrame, window: int = 50, levels: int = 1) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept words joined by one
    space, per document.

    Null and empty texts have no words. Rows that repeat a doc_id are one
    document to the rule (neither is smaller): their windows remove nothing in
    each other. Rows without doc_id are kept whole and remove nothing. Windows
    are judged on the input. Other columns are ignored.
    """
    return _removed(docs, window, levels, [])


def strip_repeats(docs: DataFrame, window: int = 50, levels: int = 1) -> DataFrame:
    """The documents without their repeated words. A text that loses none stays
    as it is, any other is its kept words joined by one space; n_chars follows.
    All rows and columns stay, whatever the names of the others."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = [F.col(f"`{c}`").alias(f"kept_{k}") for k, c in enumerate(others)]
    plain = docs.select("doc_id", "text", *kept, F.col("text").alias("whole"))
    found = _removed(plain, window, levels, [*[f"kept_{k}" for k in range(len(others))], "whole"])
    whole = F.col(f"own_{len(others)}")
    out = found.select(
        "doc_id",
        F.when(F.col("n_removed") == 0, whole).otherwise(F.col("kept")).alias("text"),
        *[F.col(f"own_{k}").alias(c) for k, c in enumerate(others)],
    )
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
