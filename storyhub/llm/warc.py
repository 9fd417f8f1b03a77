"""WARC archives: writing, normalising and reading.

A crawl part is written as one gzip stream over many records. The normaliser
inflates such a stream once from front to back and writes every record again as
a gzip member of its own, next to a sidecar file with the offset and length of
each member; readers then seek to any record. Of equal payloads one record stays
a response and the others become revisits of it.

Files go to any folder pyarrow can write, which all executors must share. Their
names hold a random part, and only rows of finished tasks name them, so a task
that is run again leaves at most an unused file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyhub.llm import arrays
from storyhub.session import materialize, scratch_path

GZIP = 31
DATE = "2024-01-01T00:00:00Z"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: dict[str, object], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def response_record(page_id: int | None, url: str | None, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    headers = {
        "WARC-Type": "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
        "Content-Type": "application/http; msgtype=response",
    }
    return record_bytes(headers, http.encode() + payload)


def revisit_record(record: tuple[dict[str, str], bytes], refers_to: int | None) -> bytes:
    """The revisit that stands in for a response whose payload is known."""
    headers, block = record
    http, _, payload = block.partition(b"\r\n\r\n")
    kept = {k: v for k, v in headers.items() if k != "Content-Length"}
    kept |= {
        "WARC-Type": "revisit",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "WARC-Refers-To": f"<urn:page:{'' if refers_to is None else refers_to}>",
        "X-Payload-Length": len(payload),
    }
    return record_bytes(kept, http + b"\r\n\r\n")


def inflate(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip stream piece by piece, over all its members."""
    engine = zlib.decompressobj(GZIP)
    while chunk := stream.read(size):
        while chunk:
            yield engine.decompress(chunk)
            chunk = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(GZIP)


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records (headers, block) of a stream of bytes."""
    data, pieces = bytearray(), iter(pieces)

    def need(n: int) -> bool:
        while len(data) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            data.extend(piece)
        return True

    while need(1):
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not need(len(data) + 1):
                raise ValueError("a record ends within its headers")
        lines = data[:end].decode().split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        stop = end + 4 + int(headers["Content-Length"])
        if not need(stop + 4):
            raise ValueError("a record ends within its block")
        yield headers, bytes(data[end + 4 : stop])
        del data[: stop + 4]


def _writer(folder: str, part_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        system.create_dir(root)
        out, packer, name, at, size = None, None, "", 0, 0
        for piece in arrays.slices(batches, "html"):
            rows = []
            columns = (piece.column(c).to_pylist() for c in ("page_id", "url", "html"))
            for page_id, url, html in zip(*columns, strict=True):
                if out is None or size >= part_bytes:
                    if out is not None:
                        out.write(packer.flush())
                        out.close()
                    name, at, size = f"crawl-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    packer = zlib.compressobj(1, zlib.DEFLATED, GZIP)
                payload = (html or "").encode()
                record = response_record(page_id, url, payload)
                out.write(packer.compress(record))
                rows.append((name, at, page_id, digest_of(payload), len(payload)))
                at, size = at + 1, size + len(record)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)],
                ["file", "at", "page_id", "digest", "size"],
            )
        if out is not None:
            out.write(packer.flush())
            out.close()

    return run


def write_monolithic(pages: DataFrame, folder: str, part_bytes: int = 64 << 20) -> DataFrame:
    """Write pages as whole-file gzip streams; one row per record: file, at
    (place in the file), page_id, digest, size."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    schema = "file string, at long, page_id long, digest string, size long"
    return materialize(pages.mapInArrow(_writer(folder, part_bytes), schema))


def mark_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """records with `response`: the page_id of the response each one revisits,
    and `is_revisit`. The smallest page_id of equal payloads stays a response;
    rows that repeat it follow by place."""
    order = F.struct(F.coalesce("page_id", F.lit((1 << 63) - 1)).alias("id"), "file", "at")
    first = records.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min(order).alias("first"))
    return records.join(first, "digest", "left").select(
        "file",
        "at",
        "page_id",
        F.coalesce(F.col("first") != order, F.lit(False)).alias("is_revisit"),
        F.expr("if(first.id = 9223372036854775807, null, first.id)").alias("response"),
    )


INDEX = "file string, offset long, length long, page_id long"


def _normaliser(source: str, target: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        name = table.column("file")[0].as_py()
        refers = dict(
            (at, to) for at, to, again in zip(*(table.column(c).to_pylist() for c in ("at", "response", "is_revisit")), strict=True) if again
        )
        ids = table.column("page_id").to_pylist()
        (system, root), (_, out_root) = open_folder(source), open_folder(target)
        system.create_dir(out_root)
        new = f"{out_root}/part-{uuid.uuid4().hex}.warc.gz"
        rows, offset = [], 0
        with system.open_input_stream(f"{root}/{name}", compression=None) as stream, system.open_output_stream(new, compression=None) as out:
            for at, record in enumerate(parse(inflate(stream))):
                raw = revisit_record(record, refers[at]) if at in refers else record_bytes({k: v for k, v in record[0].items() if k != "Content-Length"}, record[1])
                member = zlib.compress(raw, 6, GZIP)
                out.write(member)
                rows.append((new, offset, len(member), ids[at]))
                offset += len(member)
        with system.open_output_stream(f"{new}.idx", compression=None) as out:
            out.write("".join(json.dumps({"offset": r[1], "length": r[2], "page_id": r[3]}) + "\n" for r in rows).encode())
        columns = zip(*rows, strict=True)
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["file", "offset", "length", "page_id"])

    return run


def normalise(marked: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite every file with one gzip member per record and a sidecar
    `<file>.idx`; returns the same offsets as rows. A file is one group: its
    size is bounded by the writer and it is streamed, not held."""
    return materialize(by_file(marked).groupBy("file").applyInArrow(_normaliser(source, target), INDEX))


def by_file(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """Rows dealt out by file to one task for each file (`most` tasks at most, with
    several files each). The rows are few bytes beside the files they name, so
    without a number Spark would put them all into one task."""
    files = rows.select("file").distinct().count()
    return rows.repartition(max(1, min(files, most)), "file")


READ = """page_id long, url string, payload_bytes long, payload_digest string, record_type string,
refers_to long, payload binary"""


def _page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, opened, stream = [], None, None
        columns = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
        for file, offset, length in zip(*columns, strict=True):
            if file != opened:
                stream, opened = open_folder(file)[0].open_input_file(open_folder(file)[1]), file
            stream.seek(offset)
            headers, block = next(parse(iter([zlib.decompress(stream.read(length), GZIP)])))
            payload = block.partition(b"\r\n\r\n")[2]
            again = headers["WARC-Type"] == "revisit"
            rows.append(
                (
                    _page_of(headers["WARC-Record-ID"]),
                    headers["WARC-Target-URI"],
                    int(headers["X-Payload-Length"]) if again else len(payload),
                    headers["WARC-Payload-Digest"].removeprefix("sha1:") if again else digest_of(payload),
                    headers["WARC-Type"],
                    _page_of(headers["WARC-Refers-To"]) if again else None,
                    None if again else payload,
                )
            )
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in READ.replace("\n", " ").split(", ")]
        )


def read_records(index: DataFrame) -> DataFrame:
    """Records of normalised archives by offset: payload (null for a revisit),
    its size and digest, record_type and refers_to."""
    ordered = by_file(index.select("file", "offset", "length")).sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_reader, READ)


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write pages, normalise the archives, read them back.

    Null html is an empty payload, a null url an empty target, a null page_id a
    record without number that no revisit can name. Rows with one page_id are
    records of their own. Other columns are ignored; no pages give no files.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    records = write_monolithic(pages, f"{folder}/crawl")
    index = normalise(mark_revisits(records, least_bytes), f"{folder}/crawl", f"{folder}/archive")
    return read_records(index)
