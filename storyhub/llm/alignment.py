"""Alignment of two tokenizers over whole texts.

Tokenizer A reads a space and the text, B the text, to which it adds the space
itself; both give token bytes that join to the same string. Places where tokens of
both end cut the string into groups; tokens that overlap are linked, and every pair
of ids is counted over the whole corpus.

Identity map. For every id of A the id of B with the same bytes is looked up once.
Groups of one token on each side that the map foretells are counted in a vector as
long as A's vocabulary, one per task. Only the links of other groups become pairs
that Spark shuffles and adds up.

Chunks. No token of either side crosses a space or line end that is followed by
a plain letter, digit or mark (for a space: and not preceded by one). Texts are cut
there, and each different chunk of a batch is encoded and aligned once; ids, groups
and links of a text are those of its chunks in order.

Counts go back to the documents by part, some megabytes of text: a part names each
pair once, joins the totals and adds them up over the links its documents hold.
The map, and the highest count of each id of B, are no longer than the
vocabularies and are broadcast.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyhub.llm import arrays
from storyhub.llm.bpe import byte_letters
from storyhub.session import materialize

CACHE_CHUNKS = 120_000
JOINED_CHUNKS = 256
CACHED_BYTES = 256
PART_BYTES = 16 << 20
WORD_MARK = "▁"

# Bytes that begin a character which is no white space for any rule.
PLAIN_HEAD = np.zeros(256, bool)
PLAIN_HEAD[0x21:0x7F] = True
PLAIN_HEAD[0xC3] = True


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        byte_of = {c: bytes([k]) for k, c in enumerate(byte_letters())}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in vocab.items():
            self.bytes_a[i] = b"".join(byte_of.get(c, c.encode()) for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(WORD_MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        if max(len(self.bytes_a), len(pieces)) > 1 << 16:
            raise ValueError("ids of both vocabularies must fit 16 bits")
        # A byte's own token stands for what has no piece, so pieces win.
        named = {self.bytes_b[i]: i for i in sorted(range(len(pieces)), key=self.b.is_byte, reverse=True) if not self.b.is_control(i)}
        self.same = np.array([named.get(x, -1) if x else -1 for x in self.bytes_a], np.int64)
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        # Decimal ids with what can follow: another id, B's ids, the next group.
        self.spelled = [b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(1 << 16)]
        self.mark = self.b.piece_to_id(WORD_MARK)
        self.cuttable = not any(WORD_MARK in p.lstrip(WORD_MARK) or "\n" in p for p in pieces)
        # Two generations: what is asked for again moves to the newer one.
        self.cache: dict[int, tuple | None] = {}
        self.older: dict[int, tuple | None] = {}

    def starts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where chunks begin."""
        cut = np.zeros(len(data), bool)
        if self.cuttable and len(data) > 1:
            before = PLAIN_HEAD[data[1:]]
            cut[:-1] = before & ((data[:-1] == 32) | (data[:-1] == 10))
            cut[1:] &= ~((data[1:] == 32) & (data[:-1] == 32))
            # The last byte of a text has nothing after it.
            cut[at[1:][at[1:] > at[:-1]] - 1] = False
        cut[at[:-1][at[1:] > at[:-1]]] = True
        return np.flatnonzero(cut)

    def encode(self, text: str, raw: bytes) -> tuple[list[int], list[int]] | None:
        """Ids of a text that begins with a space or a line end, or None where the
        bytes of a side differ."""
        a = self.a.encode(text, add_special_tokens=False).ids
        if text[0] != " ":
            b = self.b.encode(text)[1:]
        else:
            b = self.b.encode(text[1:]) if len(text) > 1 else [self.mark]
        same = all(b"".join(map(z.__getitem__, x)) == raw for x, z in ((a, self.bytes_a), (b, self.bytes_b)))
        return (a, b) if same else None

    def align(self, raws: list[bytes], a, b) -> list[tuple]:
        """For chunks and lists of their ids, with the same bytes on both sides: groups as text, links as
        keys (those of regular groups first), number of regular ones, number of A's
        and B's ids and of groups. Done for all chunks at once: laid end to end, both
        sides still end together where a chunk does."""
        ends = np.cumsum([len(x) for x in raws])
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        # Between two neighbouring ends of any token lies one link.
        every = np.union1d(end_a, end_b)
        i, j = np.searchsorted(end_a, every), np.searchsorted(end_b, every)
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        group = np.searchsorted(shared, every)
        keys = ids_a[i] << 16 | ids_b[j]
        regular = (np.bincount(group, minlength=len(shared))[group] == 1) & (self.same[ids_a[i]] == ids_b[j])
        chunk = np.searchsorted(ends, every)
        keys = keys[np.lexsort((~regular, chunk))].astype("<u4").tobytes()
        cut = np.concatenate(([0], np.searchsorted(every, ends, side="right") * 4)).tolist()
        sure = np.bincount(chunk[regular], minlength=len(raws)).tolist()
        # Tokens by group, A's before B's; a mark after each says what follows.
        of_a, of_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        mark_a = np.where(end_a == shared[of_a], 1 << 16, 0)
        mark_b = np.where(end_b == shared[of_b], 2 << 16, 0)
        by = np.argsort(np.concatenate((of_a * 2, of_b * 2 + 1)), kind="stable")
        told = np.concatenate((ids_a + mark_a, ids_b + mark_b))[by].tolist()
        told = list(map(self.spelled.__getitem__, told))
        counts = [np.diff(np.searchsorted(x, ends, side="right"), prepend=0) for x in (end_a, end_b, shared)]
        at = np.concatenate(([0], np.cumsum(counts[0] + counts[1]))).tolist()
        texts = [b"".join(told[x:y])[:-1] for x, y in zip(at[:-1], at[1:], strict=True)]
        links = [keys[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
        return list(zip(texts, links, sure, *(c.tolist() for c in counts), strict=True))

    def chunks(self, names: np.ndarray, raws: list[bytes]) -> list[tuple | None]:
        """What `align` gives for each chunk; None where a tokenizer changes its bytes."""
        if len(self.cache) > CACHE_CHUNKS:
            self.older, self.cache = self.cache, {}
        keys = names.tolist()
        found = [self.cache.get(k, False) for k in keys]
        older = self.older.pop
        for k, x in enumerate(found):
            if x is False and (x := older(keys[k], False)) is not False:
                found[k] = self.cache[keys[k]] = x
        new = [k for k, x in enumerate(found) if x is False]
        # Chunks that could be cut from one text are encoded as one.
        plain = [k for k in new if len(raws[k]) > 1 and PLAIN_HEAD[raws[k][1]]] if self.cuttable else []
        groups = [plain[x : x + JOINED_CHUNKS] for x in range(0, len(plain), JOINED_CHUNKS)]
        groups += [[k] for k in sorted(set(new) - set(plain))]
        good, ids = [], []
        while groups:
            group = groups.pop()
            raw = b"".join([raws[k] for k in group])
            both = self.encode(raw.decode(), raw)
            if both:
                good += group
                ids.append(both)
            elif len(group) > 1:
                groups += [[k] for k in group]
            else:
                found[group[0]] = None
        if good:
            a, b = zip(*ids, strict=True)
            for k, x in zip(good, self.align([raws[k] for k in good], a, b), strict=True):
                found[k] = x
        for k in new:
            if len(raws[k]) <= CACHED_BYTES:
                self.cache[keys[k]] = found[k]
        return found


def aligner(path_a: str, path_b: str) -> Aligner:
    return arrays.per_worker(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))


def _spaced(column: pa.Array) -> pa.Array:
    """A space before every text that is not empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))


class Batch:
    """Ids, groups and links of the texts of one batch."""

    def __init__(self, piece: pa.RecordBatch, tool: Aligner):
        data, at = arrays.text_bytes(_spaced(piece.column("text")))
        starts = tool.starts(data, at)
        ends = np.append(starts[1:], len(data))
        names, first, which = np.unique(
            arrays.span_hashes(arrays.BYTE_VALUES[data], starts, ends), return_index=True, return_inverse=True
        )
        raw = data.tobytes()
        found = tool.chunks(names, [raw[starts[k] : ends[k]] for k in first.tolist()])
        cuts = np.searchsorted(starts, at)
        texts = len(at) - 1
        # Texts whose bytes do not come back have no tokens at all.
        self.whole = np.ones(texts, bool)
        bad = np.array([x is None for x in found], bool)
        if bad.any():
            self.whole = arrays.per_text(bad[which].astype(np.int64), cuts) == 0
            found = [x or (b"", b"", 0, 0, 0, 0) for x in found]
        counts = np.array([x[2:] for x in found], np.int64).reshape(-1, 4)
        self.sizes = [np.where(self.whole, arrays.per_text(counts[which, k], cuts), 0) for k in (1, 2, 3)]
        spelled = [x[0] for x in found]
        order = which.tolist()
        self.groups = [
            b";".join([spelled[x] for x in order[a:b]]) if good else b""
            for a, b, good in zip(cuts[:-1].tolist(), cuts[1:].tolist(), self.whole.tolist(), strict=True)
        ]
        # Each different chunk of a text once, with how often it stands there.
        owner = np.repeat(np.arange(texts), np.diff(cuts))
        good = self.whole[owner]
        seen, times = np.unique(owner[good] * len(found) + which[good], return_counts=True)
        text, chunk = seen // max(len(found), 1), seen % max(len(found), 1)
        flat = np.frombuffer(b"".join(x[1] for x in found), "<u4").astype(np.int64)
        size = np.array([len(x[1]) // 4 for x in found], np.int64)
        begin = np.cumsum(size) - size
        each = size[chunk]
        inner = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        keys = flat[np.repeat(begin[chunk], each) + inner]
        times = np.repeat(times, each)
        regular = inner < np.repeat(counts[chunk, 0], each)
        self.regular = keys[regular], times[regular]
        self.other = keys[~regular], times[~regular]
        links, which = np.unique(np.repeat(text, each) << 32 | keys, return_inverse=True)
        self.times = np.bincount(which, times, len(links)).astype(np.int64)
        self.link_at = np.searchsorted(links, np.arange(texts + 1) << 32)
        self.keys = links & 0xFFFFFFFF


DOCS = "part long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
ROWS = DOCS + ", groups binary, links binary, a long, b long, n long"
NAMES = [f.split()[0] for f in ROWS.split(", ")]
KINDS = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()] + [pa.int64()] * 3


def _rows(rows: int, **columns) -> pa.RecordBatch:
    """Rows of ROWS with nulls in all columns not given."""
    out = [pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in zip(NAMES, KINDS, strict=True)]
    return pa.RecordBatch.from_arrays(out, NAMES)


def _pair_rows(part: int | None, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 100_000):
        k = keys[at : at + 100_000]
        yield _rows(len(k), part=[part] * len(k), a=k >> 16, b=k & 0xFFFF, n=counts[at : at + 100_000])


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    out, which = np.unique(np.concatenate(keys), return_inverse=True)
    return out, np.bincount(which, np.concatenate(counts), len(out)).astype(np.int64)


def _reader(path_a: str, path_b: str, full: bool):
    """Rows of three kinds: documents with their links; per part its other pairs
    (a, b, n); per task the vector of regular groups (a, b, n without a part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        vector = np.zeros(len(tool.same), np.int64)
        part, size, keys, counts = TaskContext.get().partitionId() << 32, 0, [], []
        for piece in arrays.slices(batches):
            batch = Batch(piece, tool)
            a = batch.regular[0] >> 16
            vector += np.bincount(a, batch.regular[1], len(vector)).astype(np.int64)
            if size > PART_BYTES:
                yield from _pair_rows(part, *_summed(keys, counts))
                part, size, keys, counts = part + 1, 0, [], []
            held = _summed([batch.other[0]], [batch.other[1]])
            keys.append(held[0])
            counts.append(held[1])
            size += piece.nbytes
            raw, cut = batch.keys.astype("<u4"), batch.link_at.tolist()
            times = batch.times.astype("<u4")
            columns = dict(
                part=[part] * piece.num_rows,
                doc_id=piece.column("doc_id"),
                n_a=batch.sizes[0], n_b=batch.sizes[1], n_groups=batch.sizes[2],
                n_links=arrays.per_text(batch.times, batch.link_at),
                groups_sha256=[hashlib.sha256(x).hexdigest() if x else "" for x in batch.groups],
                links=[raw[x:y].tobytes() + times[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)],
            )
            if full:
                columns["groups"] = batch.groups
            yield _rows(piece.num_rows, **columns)
        if keys:
            yield from _pair_rows(part, *_summed(keys, counts))
        hit = np.flatnonzero(vector)
        yield from _pair_rows(None, hit << 16 | tool.same[hit], vector[hit])

    return run


def _answer(regular, best, full: bool):
    """Counts of a part's pairs added up over the links of its documents. `regular`
    are keys, sorted, and counts of the identity map; `best` the highest count of each id of B."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        keys = (told["a"].to_numpy().astype(np.int64) << 16) | told["b"].to_numpy().astype(np.int64)
        counts = told["count"].to_numpy().astype(np.int64)
        # A pair may be on both lists, with the same total.
        keys, first = np.unique(np.concatenate((keys, regular.value[0])), return_index=True)
        counts = np.concatenate((counts, regular.value[1]))[first]
        sums, tops = [], []
        for raw in docs["links"].to_pylist():
            links, times = np.frombuffer(raw, "<u4").astype(np.int64).reshape(2, -1)
            found = counts[np.searchsorted(keys, links)] if len(links) else links
            sums.append(int((found * times).sum()))
            tops.append(int(times[found == best.value[links & 0xFFFF]].sum()))
        kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        out = [docs[c].cast(pa.int64()) for c in kept] + [pa.array(tops, pa.int64()), pa.array(sums, pa.int64()), docs["groups_sha256"].cast(pa.string())]
        names = [*kept, "n_best", "count_sum", "groups_sha256"]
        if full:
            out, names = [*out, docs["groups"].cast(pa.string())], [*names, "groups"]
        return pa.Table.from_arrays(out, names)

    return run


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, full: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).

    documents: one row each with numbers of ids, groups and links, `n_best`, the links
    whose pair has its B id's highest count (ties included), `count_sum`, the
    counts of all its links, a digest of the groups, and with `full` the groups
    as text. pairs: a, b and the number of links that hold them.

    Null and empty texts, and texts whose bytes either tokenizer changes, have no
    tokens: zeros and an empty string. Special tokens inside a text are plain text.
    Rows are taken one by one, so repeated or missing ids do no harm; other
    columns are ignored; no documents give no rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    read = materialize(slim.mapInArrow(_reader(path_a, path_b, full), ROWS))
    vector = read.filter("a is not null and part is null").groupBy("a", "b").agg(F.sum("n").alias("n"))
    other = read.filter("a is not null and part is not null").select("part", "a", "b", "n")
    pairs = materialize(
        other.select("a", "b", "n").unionByName(vector).groupBy("a", "b").agg(F.sum("n").alias("count"))
    )
    # Both are bounded by a vocabulary.
    known = vector.select("a", "b").join(pairs, ["a", "b"]).orderBy("a", "b").toArrow()
    keys = (known["a"].to_numpy().astype(np.int64) << 16) | known["b"].to_numpy().astype(np.int64)
    regular = spark.sparkContext.broadcast((keys, known["count"].to_numpy().astype(np.int64)))
    tops = pairs.groupBy("b").agg(F.max("count").alias("top")).toArrow()
    best = np.zeros(1 << 16, np.int64)
    best[tops["b"].to_numpy().astype(np.int64)] = tops["top"].to_numpy()
    told = other.select(F.col("part").alias("told_part"), "a", "b").join(pairs, ["a", "b"])
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    schema += ", groups string" if full else ""
    asked = read.filter("a is null").select("part", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", *(["groups"] if full else []))
    report = asked.groupBy("part").cogroup(told.groupBy("told_part")).applyInArrow(
        _answer(regular, spark.sparkContext.broadcast(best), full), schema
    )
    return report, pairs
