"""Packed columns of whole numbers, and tables that tasks read part by part.

A sorted column is stored as differences. Numbers are laid out as planes of
bytes, low bytes first, and compressed, so that small numbers cost next to nothing
and hashes of known order cost only the bits that their order doesn't give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from storyhub.llm import arrays
from storyhub.llm.warc import open_folder
from storyhub.session import batches_bounded, materialize, scratch_path, shuffles_freed

PART_BYTES = 10 << 20
PIECE_BYTES = 1 << 20
"""Bytes of text that are worked at once: sums and marks take up to 100 bytes for each."""


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on."""
    values = np.ascontiguousarray(values, np.uint64)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(values).to_bytes(8, "little") + bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(block: bytes) -> np.ndarray:
    n, width = int.from_bytes(block[:8], "little"), block[8]
    out = np.zeros((n, 8), np.uint8)
    if n and width:
        planes = pa.decompress(block[9:], decompressed_size=n * width, codec="zstd", asbytes=True)
        out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.uint64)


def pack_sorted(values: np.ndarray, base: int = 0) -> bytes:
    """Whole numbers in ascending order, none below base."""
    return pack(np.diff(values, prepend=np.uint64(base)))


def unpack_sorted(block: bytes, base: int = 0) -> np.ndarray:
    return np.cumsum(unpack(block), dtype=np.uint64) + np.uint64(base)


def pack_bits(marks: np.ndarray) -> bytes:
    return len(marks).to_bytes(8, "little") + pa.compress(np.packbits(marks).tobytes(), codec="zstd", asbytes=True)


def unpack_bits(block: bytes) -> np.ndarray:
    n = int.from_bytes(block[:8], "little")
    bits = pa.decompress(block[8:], decompressed_size=-(-n // 8), codec="zstd", asbytes=True)
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in ascending order, a place of each in keys, and the key of
    each place; in little memory, so which of several equal places is taken is open."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    which = np.empty(len(keys), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], order[new], which


def borders(slots: int, bits: int) -> np.ndarray:
    """First value of each of so many even ranges of numbers of that many bits."""
    return np.array([(k << bits) // slots for k in range(slots)], np.uint64)


def parts(batches: Iterator[pa.RecordBatch], part_bytes: int = PART_BYTES) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Number and slices of each part of this task: about part_bytes of text, or one
    longer text. Numbers repeat when the same rows are read again in the same splits."""
    arrays.drop_worker_state()
    base, held, size = TaskContext.get().partitionId() << 32, [], 0
    for piece in arrays.slices(batches, limit=PIECE_BYTES):
        _, at = arrays.text_bytes(piece.column("text"))
        if held and size + at[-1] > part_bytes:
            yield base, held
            base, held, size = base + 1, [], 0
        held.append(piece)
        size += int(at[-1])
    if held:
        yield base, held


def by_part(work: Callable[[int, list[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task that works its parts one after another and frees each before the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pieces in parts(batches):
            yield from work(part, pieces)
            del pieces
            arrays.free_unused()

    return run


def repeatable(docs: DataFrame) -> DataFrame:
    """docs itself where reading it again gives the same rows in the same splits, which
    a plan without a shuffle does; else a stored copy."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return materialize(docs) if "Exchange" in plan or "rand(" in plan else docs


def store_by_part(rows: DataFrame) -> str:
    """Write rows into one folder for each value of `part`; gives the path."""
    path = scratch_path(rows.sparkSession, "parts")
    with shuffles_freed(rows.sparkSession), batches_bounded(rows.sparkSession):
        rows.repartition("part").write.partitionBy("part").option("compression", "none").parquet(path)
    return path


def read_part(path: str, part: int, columns: list[str]) -> pa.Table:
    """All rows stored for a part. Every part has some: none means that the input was
    not read in the same splits again, which is an error."""
    system, root = open_folder(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/part={part}", allow_not_found=True))
    tables = []
    for info in found:
        if info.base_name.endswith(".parquet"):
            with system.open_input_file(info.path) as file:
                tables.append(pq.ParquetFile(file).read(columns))
    if not tables:
        raise RuntimeError(f"the input changed between two readings: no answer for part {part}")
    return pa.concat_tables(tables)
