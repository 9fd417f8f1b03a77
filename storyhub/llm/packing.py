"""Packing along a space-filling curve.

The token counts of a document, hashed to a vector, are projected to three
dimensions; the Hilbert key of that point orders the documents, so documents
with like words are near each other. Spark sorts by range of key, running totals
give every document its place in one long stream of tokens, and the stream is
cut every `size` tokens. Neighbours on the curve share sequences and only the
last sequence can need padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyhub.llm import arrays, tokens
from storyhub.session import materialize

DIMS, BITS, HASHED = 3, 10, 256
_rng = np.random.default_rng(11)
SIGNS = _rng.choice(np.array([-1.0, 1.0]), 1 << 12)
PROJECTION = _rng.normal(size=(HASHED, DIMS))


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index of each grid point (rows of non-negative integers below 2**bits)
    along the Hilbert curve; Skilling, "Programming the Hilbert curve" (2004)."""
    x = [points[:, d].astype(np.int64).copy() for d in range(points.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for d in range(len(x)):
            high = (x[d] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[d] = x[d] ^ swap
        q >>= 1
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(len(x)):
            key = (key << 1) | (((x[d] ^ t) >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hilbert key of each document from its token ids."""
    docs = len(at) - 1
    # Column and sign of every id, looked up by id.
    mixed = arrays.mix(np.arange(int(ids.max(initial=0)) + 1))
    column = (mixed & np.uint64(HASHED - 1)).astype(np.int64)
    sign = SIGNS[(mixed >> np.uint64(40)).astype(np.int64) & (len(SIGNS) - 1)]
    slots = np.repeat(np.arange(docs) * HASHED, np.diff(at)) + column[ids]
    vectors = np.bincount(slots, sign[ids], docs * HASHED).reshape(docs, HASHED)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    low = vectors / np.maximum(norms, 1e-12) @ PROJECTION
    # A unit vector projects to about normal values; the logistic curve spreads them over the grid.
    return hilbert_keys(np.minimum((1 << BITS) / (1 + np.exp(-1.7 * low)), (1 << BITS) - 1))


def _encoder(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.tokenizer(path)
        end = np.array([end_id], coder.kind).tobytes()
        for piece in arrays.slices(batches):
            found = [x + end for x in coder.encode_column(piece.column("text"))]
            sizes = np.array([len(x) for x in found], np.int64) // coder.kind.itemsize
            at = np.concatenate(([0], np.cumsum(sizes)))
            keys = curve_keys(np.frombuffer(b"".join(found), coder.kind), at)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array(sizes),
                    pa.array(keys),
                    pa.array(np.full(len(found), coder.kind.itemsize, np.int32)),
                    pa.array(found, pa.binary()),
                ],
                ["doc_id", "n", "key", "width", "ids"],
            )

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        ends = total + np.cumsum(n)
        total = int(ends[-1]) if len(n) else total
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("part"), batch.column("n"), pa.array(ends - n)],
            ["row", "part", "n", "before"],
        )


def _cutter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "width", "at", "ids")), strict=True)
            for doc_id, n, width, at, ids in rows:
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                start = 0
                while start < n:
                    place = at + start
                    length = min(size - place % size, n - start)
                    raw = wide[start : start + length].tobytes()
                    out.append((doc_id, start, length, zlib.crc32(raw), n, place // size, place % size, raw))
                    start += length
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            types = [pa.int64()] * 7 + [pa.binary()]
            columns = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


PIECES = """doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long,
offset long, ids binary"""


def pack_documents(docs: DataFrame, path: str, size: int = 4096, end_id: int = tokens.END_ID) -> DataFrame:
    """One row per piece of a document in a sequence, with its ids.

    Null and empty texts are the end id alone. Repeated rows are packed one by
    one. Equal keys are ordered by doc_id, so a key shared by many documents can
    be split over tasks. Other columns are ignored; no documents give no pieces.
    """
    schema = "doc_id long, n long, key long, width int, ids binary"
    encoded = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _encoder(path, end_id), schema
    )
    encoded = materialize(encoded.withColumn("row", F.monotonically_increasing_id()))
    spark = docs.sparkSession
    sorted_rows = (
        encoded.select("key", "doc_id", "row", "n")
        .repartitionByRange("key", "doc_id", "row")
        .sortWithinPartitions("key", "doc_id", "row")
        .select("row", F.spark_partition_id().alias("part"), "n")
    )
    placed = materialize(sorted_rows.mapInArrow(_running, "row long, part int, n long, before long"))
    # One row per range of keys.
    base, total = [], 0
    for r in placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        base.append((r["part"], total))
        total += r["n"]
    bases = spark.createDataFrame(base, "part int, base long")
    places = placed.join(bases, "part").select("row", (F.col("base") + F.col("before")).alias("at"))
    pieces = encoded.join(places, "row").select("doc_id", "n", "width", "at", "ids")
    return pieces.mapInArrow(_cutter(size), PIECES)


def sequences(pieces: DataFrame, size: int = 4096, pad_id: int = 0) -> DataFrame:
    """sequence_id and its ids, padded to `size` unless the length is a power of two."""
    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column("p").to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").tolist()
                if len(ids) & (len(ids) - 1):
                    ids += [pad_id] * (size - len(ids))
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(out, pa.list_(pa.int64()))], ["sequence_id", "ids"])

    return whole.mapInArrow(run, "sequence_id long, ids array<long>")
