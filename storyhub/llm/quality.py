"""Quality rules: base counts of a text and a perplexity band per language.

Model. Words are predicted from the word before them by modified Kneser-Ney
smoothing (three discounts per order from counts of counts, words by their
number of distinct left neighbours). The pairs of words of all texts are
counted, per language name, so the tables grow with the corpus; they stay in
Spark and are looked up by joins. A word that is new falls back on its spelling:
n-grams of three byte classes over all texts, a table of fixed size.

A text must not be judged by itself: its hash puts it into one of two halves, and
it is scored under the model of the other half of its language. Copies share a
half.

Look-up. Texts are not copied but read again, in parts of bounded size. A part sends
the hashes of its word pairs, each once, as sorted packed blocks, one for each
range of hashes; a task merges a range and answers with counts in the order of
the block. One part of those that hold a pair tallies it for its two words; words are
merged and answered in the same way.

Bands. The perplexity of a text is the mean negative log probability of its bytes
under the model of its language. See `quality_verdicts` for the limits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyhub.llm import arrays, blocks
from storyhub.session import materialize

SLOTS = 64
"""Slots of the spelling model by language name; texts are scored with the one after
the last, which is made of all texts together."""

# Byte classes; every byte not named falls into a class by rule below.
MARKS = [".", ",", ";:", "'\"", "!", "?", "-", "()[]{}", "|", "#*$%&", "<>", "/\\", "_=+~^@`"]
SYMBOLS = "#*$%&|<>"


def _classes() -> np.ndarray:
    """0 is the start of a text; then letters, capitals, digits, blank, line
    end, other white space, kinds of marks, parts of multi-byte letters."""
    out = np.zeros(256, np.uint8)
    for k in range(26):
        out[ord("a") + k] = 1 + k
        out[ord("A") + k] = 27
    for k in range(10):
        out[ord("0") + k] = 28
    out[:32] = 31
    out[127] = 31
    out[ord(" ")], out[ord("\n")] = 29, 30
    for k, marks in enumerate(MARKS):
        for mark in marks:
            out[ord(mark)] = 32 + k
    base = 32 + len(MARKS)
    for byte in range(128, 192):
        out[byte] = base + (byte >> 5 & 1)
    out[192:224], out[224:] = base + 2, base + 3
    return out


CLASS_OF = _classes()
A = int(CLASS_OF.max()) + 1
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in SYMBOLS]] = True


def slot_of(lang: str | None) -> int:
    return zlib.crc32((lang or "").encode()) % SLOTS


def _codes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The three classes that end at each byte, as one number; before a text stands class 0."""
    c = CLASS_OF[data].astype(np.int32)
    one, two = np.zeros_like(c), np.zeros_like(c)
    one[1:], two[2:] = c[:-1], c[:-2]
    heads = at[:-1][at[:-1] < at[1:]]
    one[heads] = two[heads] = 0
    seconds = heads[heads + 1 < len(c)] + 1
    two[seconds] = 0
    # In place, as there is a number for every byte of a slice.
    two *= A
    two += one
    two *= A
    two += c
    return two


def _langs(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([slot_of(x) for x in batch.column("lang").to_pylist()], np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrays.drop_worker_state()
    totals: dict[int, np.ndarray] = {}
    for piece in arrays.slices(batches, limit=blocks.PIECE_BYTES):
        data, at = arrays.text_bytes(piece.column("text"))
        slots, which = np.unique(_langs(piece), return_inverse=True)
        keys = _codes(data, at)
        keys += np.repeat((which * A**3).astype(np.int32), np.diff(at))
        counts = np.bincount(keys, minlength=len(slots) * A**3).reshape(len(slots), -1)
        for k, slot in enumerate(slots):
            totals[int(slot)] = totals.get(int(slot), 0) + counts[k]
    for slot, counts in totals.items():
        codes = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(codes), slot, np.int32)), pa.array(codes.astype(np.int32)), pa.array(counts[codes])],
            ["slot", "code", "n"],
        )


def _discounts(grams: DataFrame) -> DataFrame:
    """d1, d2, d3 of each slot from its counts of counts; where those are not
    in falling order (too few texts, or all n-grams frequent) 0.5, 1, 1.5."""
    counts = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.expr("n1 / (n1 + 2 * n2)")
    d = [
        1 - 2 * y * F.expr("n2 / n1"),
        2 - 3 * y * F.expr("n3 / n2"),
        3 - 4 * y * F.expr("n4 / n3"),
    ]
    ok = F.expr("n1 > 0 and n2 > 0 and n3 > 0 and n4 > 0")
    return grams.groupBy("slot").agg(*counts).select(
        "slot",
        *[
            F.when(ok, F.greatest(F.lit(0.0), F.least(x, F.lit(float(k))))).otherwise(F.lit(0.5 * k)).alias(f"d{k}")
            for k, x in enumerate(d, 1)
        ],
    )


def _order(grams: DataFrame, history) -> DataFrame:
    """Discounted share of each n-gram after its history, and the history's
    backoff weight."""
    w = Window.partitionBy("slot", "history")
    n_with = lambda test: F.sum(F.when(test, 1).otherwise(0)).over(w)
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    return (
        grams.join(_discounts(grams), "slot")
        .withColumn("history", history)
        .withColumn("total", F.sum("n").over(w))
        .withColumn("share", (F.col("n") - cut) / F.col("total"))
        .withColumn(
            "back",
            (
                F.col("d1") * n_with(F.col("n") == 1)
                + F.col("d2") * n_with(F.col("n") == 2)
                + F.col("d3") * n_with(F.col("n") >= 3)
            )
            / F.col("total"),
        )
        .select("slot", "code", "history", "share", "back")
    )


def kneser_ney(docs: DataFrame, by_language: bool = True) -> DataFrame:
    """The spelling model of all texts together, and by slot of languages if asked: slot, n (order), code, prob, back. `prob` is the
    smoothed probability of the last class after the ones before it; `back` the
    weight this n-gram, taken as a history, passes on to the shorter order."""
    counted = docs.select("text", "lang").mapInArrow(_count, "slot int, code int, n long")
    own = counted.groupBy("slot", "code").agg(F.sum("n").alias("n"))
    every = F.explode(F.array("slot", F.lit(SLOTS)) if by_language else F.array(F.lit(SLOTS))).alias("slot")
    tri = materialize(own.select(every, "code", "n").groupBy("slot", "code").agg(F.sum("n").alias("n")))
    bi = tri.groupBy("slot", (F.col("code") % (A * A)).alias("code")).agg(F.count("*").alias("n"))
    uni = bi.groupBy("slot", (F.col("code") % A).alias("code")).agg(F.count("*").alias("n"))
    three = _order(tri, (F.col("code") / A).cast("int"))
    two = _order(bi, (F.col("code") / A).cast("int"))
    one = _order(uni, F.lit(0))
    p1 = one.select("slot", "code", (F.col("share") + F.col("back") / A).alias("prob"))
    p2 = two.join(p1.withColumnRenamed("code", "low"), (two.code % A == F.col("low")) & (two.slot == p1.slot)).select(
        two.slot, two.code, (F.col("share") + F.col("back") * F.col("prob")).alias("prob")
    )
    p3 = three.join(
        p2.withColumnRenamed("code", "low"), (three.code % (A * A) == F.col("low")) & (three.slot == p2.slot)
    ).select(three.slot, three.code, (F.col("share") + F.col("back") * F.col("prob")).alias("prob"))
    back = lambda x: x.groupBy("slot", F.col("history").alias("code")).agg(F.max("back").alias("back"))
    out = (
        p3.withColumn("back", F.lit(1.0)).withColumn("n", F.lit(3))
        .unionByName(p2.join(back(three), ["slot", "code"], "full").withColumn("n", F.lit(2)))
        .unionByName(p1.join(back(two), ["slot", "code"], "full").withColumn("n", F.lit(1)))
        .unionByName(
            one.groupBy("slot").agg(F.max("back").alias("back")).withColumns(
                {"n": F.lit(0), "code": F.lit(0), "prob": F.lit(None).cast("double")}
            )
        )
    )
    return out.select("slot", "n", "code", "prob", "back")


def _key(slot, n, code) -> np.ndarray:
    packed = (np.asarray(slot, np.uint64) << np.uint64(40)) | (np.asarray(n, np.uint64) << np.uint64(32))
    return arrays.mix(packed | np.asarray(code, np.uint64))


class SortedModel:
    """N-gram hashes in ascending order beside probability and backoff arrays."""

    def __init__(self, keys: np.ndarray, prob: np.ndarray, back: np.ndarray):
        self.keys, self.prob, self.back = keys, prob, back

    @staticmethod
    def arrays_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        col = lambda c, kind: rows[c].to_numpy().astype(kind)
        keys = _key(col("slot", np.int64), col("n", np.int64), col("code", np.int64))
        order = np.argsort(keys)
        return keys[order], col("prob", np.float64)[order], col("back", np.float64)[order]

    def find(self, slot: int, n: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability (nan: unseen) and backoff weight (1: unseen) of n-grams."""
        keys = _key(slot, n, codes)
        if not len(self.keys):
            return np.full(len(codes), np.nan), np.ones(len(codes))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.prob[at], np.nan), np.where(hit & ~np.isnan(self.back[at]), self.back[at], 1.0)

    def surprise(self, slot: int) -> np.ndarray:
        """Negative log probability of every possible n-gram of a slot, each
        looked up once, so that texts are scored by position."""
        every = np.arange(A**3)
        p1, b1 = self.find(slot, 1, np.arange(A))
        _, b0 = self.find(slot, 0, np.zeros(1, np.int64))
        p1 = np.where(np.isnan(p1), b0[0] / A, p1)
        p2, b2 = self.find(slot, 2, np.arange(A * A))
        p2 = np.where(np.isnan(p2), b1[np.arange(A * A) // A] * p1[np.arange(A * A) % A], p2)
        p3, _ = self.find(slot, 3, every)
        p3 = np.where(np.isnan(p3), b2[every // A] * p2[every % (A * A)], p3)
        return -np.log(np.maximum(p3, 1e-12))


PAIR_MIX = np.uint64(0xD6E8FEB86659FD93)
RANGE_BYTES = 8 << 20
"""Text bytes for each range of pair hashes; a range is merged by one task."""
CLASS_SIZE = np.bincount(CLASS_OF, minlength=A)
ASKED = "part long, slot int, keys binary, n binary, odd binary, n1 binary"
GIVEN = "part long, slot int, mark long, n0 binary, n1 binary, lead binary"
TALLIED = "part long, lang_key long, slot int, words binary, tallies binary"
TOLD = "part long, lang_key long, slot int, counts binary, model int, totals array<double>"
TALLIES = ["rest", "h1", "h2", "h3", "h4", "h5", "left"]
COUNTS = ["rest", "h1", "h2", "hm", "left"]
"""Pairs of a word as history that come once, twice and so on (h5: five times or more,
hm: three or more) and its left neighbours. Its total is stored as what is more than the
least that these numbers allow, which is mostly 0."""
PARAMS = ["d1", "d2", "d3", "e1", "e2", "e3", "all_left", "last_back"]


def key_bits(size: int) -> int:
    """Width of the hashes of words and pairs: at least 48, and so wide that among the
    pairs of so many bytes of text at most one in 8,000 shares its hash with another."""
    return min(64, max(48, (size // 2).bit_length() + 13))


def _word_keys(piece) -> tuple[np.ndarray, ...]:
    """Half and language of each text; first byte, key and key of the word before for each
    word; `running` are the sums that hashes of the bytes are made from."""
    data, at = arrays.text_bytes(piece.column("text"))
    starts, ends, word_at = arrays.find_words(data, at)
    letters, lang_at = arrays.text_bytes(piece.column("lang"))
    lang = arrays.word_hashes(letters, lang_at[:-1], lang_at[1:])
    running = arrays.running_sums(arrays.BYTE_VALUES[data])
    fold = (arrays.spans_of(running, at[:-1], at[1:]) & np.uint64(1)).astype(np.int32)
    owner = arrays.text_of(word_at)
    words = arrays.spans_of(running, starts, ends)
    b = arrays.mix(words + lang[owner])
    a = np.empty_like(b)
    a[1:] = b[:-1]
    heads = word_at[:-1][word_at[:-1] < word_at[1:]]
    a[heads] = arrays.mix(lang[owner[heads]] + PAIR_MIX)
    return data, at, running, starts, words, word_at, owner, fold, lang, a, b


class PartPairs:
    """The word pairs of a part, each once, by ascending hash.

    keys, n0, n1: hash of each pair and its counts in the halves; which: the pair of
    each word of the part; a, b, lang: the words and the language of each pair, kept as
    its place (lang_at) in langs, which ascend.
    """

    def __init__(self, pieces: list[pa.RecordBatch], bits: int, with_words: bool = True):
        cut = np.uint64(64 - bits)
        pairs, odd, seconds, heads, opened, langs, done = [], [], [], [], [], [], 0
        for piece in pieces:
            word_at, owner, fold, lang, a, b = _word_keys(piece)[-6:]
            pairs.append(arrays.mix(arrays.mix(a) * PAIR_MIX + b) >> cut)
            odd.append(fold[owner] == 1)
            if with_words:
                full = np.flatnonzero(word_at[:-1] < word_at[1:])
                seconds.append(b >> cut)
                heads.append(word_at[full] + done)
                opened.append(a[word_at[full]] >> cut)
                langs.append(lang[full])
            done += len(b)
        pairs, odd = np.concatenate(pairs), np.concatenate(odd)
        self.keys, first, self.which = blocks.distinct(pairs)
        del pairs
        self.n1 = np.bincount(self.which[odd], minlength=len(self.keys)).astype(np.int32)
        self.n0 = np.bincount(self.which, minlength=len(self.keys)).astype(np.int32)
        self.n0 -= self.n1
        if with_words:
            # The word before is the first of the pair, but for words that open a text.
            seconds, heads, opened = (np.concatenate(x) for x in (seconds, heads, opened))
            self.langs, lang = np.unique(np.concatenate(langs), return_inverse=True)
            text = np.searchsorted(heads, first, side="right") - 1
            self.lang_at = lang.astype(np.int32)[text]
            opens = heads[text] == first
            self.b = seconds[first]
            first -= 1
            self.a = seconds[first]
            self.a[opens] = opened[text[opens]]

    @property
    def lang(self) -> np.ndarray:
        return self.langs[self.lang_at]

    def words(self) -> None:
        """Adds the words by language and hash: word, word_lang, and the places of a
        and b among them (at_a, at_b)."""
        size = len(self.a)
        word, first, at = blocks.distinct(np.concatenate((self.a, self.b)))
        langs = self.lang_at[first % max(size, 1)]
        del first
        # Words are in ascending order within a language.
        order = np.argsort(langs, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.word, self.word_lang = word[order], self.langs[langs[order]]
        self.at_a, self.at_b = place[at[:size]], place[at[size:]]

    def answers(self, path: str, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of each pair in the halves of all texts, and whether this part is the
        one of all that hold the pair in which it is tallied. Of a pair tallied elsewhere
        only the counts that texts of the part are scored by are whole."""
        told = blocks.read_part(path, part, ["slot", "mark", "n0", "n1", "lead"]).sort_by("slot")
        more0, more1 = (np.concatenate([blocks.unpack(x) for x in told[c].to_pylist()]).astype(np.int64) for c in ("n0", "n1"))
        lead = np.concatenate([blocks.unpack_bits(x) for x in told["lead"].to_pylist()])
        marks = np.bitwise_xor.reduce(told["mark"].to_numpy().view(np.uint64))
        if len(lead) != len(self.keys) or marks != np.bitwise_xor.reduce(self.keys):
            raise RuntimeError(f"the input changed between two readings: part {part} holds other pairs")
        return self.n0 + more0, self.n1 + more1, lead


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [name for name, _ in fields])


def _as_long(x) -> int:
    return int(np.uint64(x).view(np.int64))


def _ask_pairs(slots: int, bits: int):
    """Each part's pairs, sorted, one block for each range of hashes."""
    edges = blocks.borders(slots, bits)

    def ask(part: int, pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PartPairs(pieces, bits, with_words=False)
        cuts = np.append(np.searchsorted(own.keys, edges), len(own.keys))
        rows = []
        for k in range(slots):
            here = slice(cuts[k], cuts[k + 1])
            if cuts[k] < cuts[k + 1] or not k:
                n1 = own.n1[here]
                counts = blocks.pack(own.n0[here] + n1 - 1), blocks.pack_bits(n1 & 1), blocks.pack(n1 >> 1)
                rows.append((part, k, blocks.pack_sorted(own.keys[here], edges[k]), *counts))
        yield _rows(rows, ASKED)

    return blocks.by_part(ask)


def _merge_pairs(slots: int, bits: int):
    """Counts of a range over all parts, told to each part in the order it asked."""
    edges = blocks.borders(slots, bits)

    def merge(table: pa.Table) -> pa.Table:
        asked = table.sort_by("part").to_pylist()
        keys = [blocks.unpack_sorted(r["keys"], edges[r["slot"]]) for r in asked]
        at = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        each, first, which = blocks.distinct(np.concatenate(keys))
        lead = np.zeros(at[-1], bool)
        lead[first] = True
        n1 = np.concatenate([2 * blocks.unpack(r["n1"]).astype(np.int64) + blocks.unpack_bits(r["odd"]) for r in asked])
        n0 = np.concatenate([blocks.unpack(r["n"]).astype(np.int64) + 1 for r in asked]) - n1
        # A part knows its own counts and needs those of the other half, and both where it tallies.
        more0 = np.where(lead | (n1 > 0), np.bincount(which, n0, len(each)).astype(np.int64)[which] - n0, 0)
        more1 = np.where(lead | (n0 > 0), np.bincount(which, n1, len(each)).astype(np.int64)[which] - n1, 0)
        rows = []
        for k, r in enumerate(asked):
            here = slice(at[k], at[k + 1])
            mark = _as_long(np.bitwise_xor.reduce(keys[k]))
            rows.append((r["part"], r["slot"], mark, blocks.pack(more0[here]), blocks.pack(more1[here]), blocks.pack_bits(lead[here])))
        return pa.Table.from_batches([_rows(rows, GIVEN)])

    return merge


def _spans(lang: np.ndarray, word: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, slice]]:
    """Language, range and place of each run of words of one language and range."""
    slot = np.searchsorted(edges, word, side="right") - 1
    cuts = np.flatnonzero((lang[1:] != lang[:-1]) | (slot[1:] != slot[:-1])) + 1 if len(word) else []
    for start, end in zip([0, *cuts], [*cuts, len(word)]):
        if start < end:
            yield _as_long(lang[start]), int(slot[start]), slice(start, end)


def _tally_words(path: str, slots: int, bits: int):
    """What the pairs tallied in a part say of their words, in both models, and all
    words of the part, one block for each language and range of hashes."""
    edges = blocks.borders(slots, bits)

    def tally(part: int, pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PartPairs(pieces, bits)
        if not len(own.keys):
            return
        own.words()
        *counts, lead = own.answers(path, part)
        del own.a, own.b, own.lang_at, own.which, own.keys, own.n0, own.n1
        size, wide = len(own.word), len(TALLIES)
        both = np.empty((2 * wide, size), np.int64)
        for m, n in enumerate(counts):
            heads = lambda test: np.bincount(own.at_a[lead & test], minlength=size)
            rest, *each, left = both[m * wide : (m + 1) * wide]
            rest[:] = np.bincount(own.at_a[lead], n[lead], size)
            for k, x in enumerate(each, 1):
                x[:] = heads(n == k if k < 5 else n >= 5)
                rest -= k * x
            left[:] = np.bincount(own.at_b[lead & (n > 0)], minlength=size)
        yield _rows(
            [
                (part, lang, k, blocks.pack_sorted(own.word[here], edges[k]), blocks.pack(both[:, here].ravel()))
                for lang, k, here in _spans(own.word_lang, own.word, edges)
            ],
            TALLIED,
        )

    return blocks.by_part(tally)


def _merge_words(slots: int, bits: int):
    """Tallies of a range of words over all parts, told to each part in the order it
    asked; and the sums for each language and model that discounts are made of."""
    edges, wide = blocks.borders(slots, bits), len(TALLIES)

    def merge(table: pa.Table) -> pa.Table:
        asked = table.select(["part", "lang_key", "slot", "words", "tallies"]).to_pylist()
        keys = [blocks.unpack_sorted(r["words"], edges[r["slot"]]) for r in asked]
        at = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        _, first, which = blocks.distinct(np.concatenate(keys))
        sums = np.zeros((2 * wide, len(first)), np.int64)
        for k, r in enumerate(asked):
            # A word comes once in a block.
            sums[:, which[at[k] : at[k + 1]]] += blocks.unpack(r["tallies"]).astype(np.int64).reshape(2 * wide, -1)
        told = []
        for m in (0, 1):
            rest, h1, h2, h3, h4, h5, left = sums[m * wide : (m + 1) * wide]
            told += [rest + h4 + 2 * h5, h1, h2, h3 + h4 + h5, left]
        told = np.array(told)
        rows = [
            (r["part"], r["lang_key"], r["slot"], blocks.pack(told[:, which[at[k] : at[k + 1]]].ravel()), None, None)
            for k, r in enumerate(asked)
        ]
        langs, group = np.unique(np.repeat([r["lang_key"] for r in asked], np.diff(at))[first], return_inverse=True)
        for model in (0, 1):
            own = dict(zip(TALLIES, sums[model * wide : (model + 1) * wide]))
            left = own["left"]
            seen = [left, left == 1, left == 2, left >= 3, left == 3, left == 4, *(own[f"h{k}"] for k in "1234")]
            totals = np.array([np.bincount(group, x.astype(np.float64), len(langs)) for x in seen])
            rows += [(None, int(lang), None, None, model, totals[:, g].tolist()) for g, lang in enumerate(langs)]
        return pa.Table.from_batches([_rows(rows, TOLD)])

    return merge


def _discount(c: str) -> list[str]:
    """SQL of the three discounts from the tallies named c1, c2, c3 and c4; 0.5, 1, 1.5
    where one of them would not lie above zero, so that every history backs off."""
    y = f"{c}1 / ({c}1 + 2 * {c}2)"
    own = [f"({k} - {k + 1} * {y} * {c}{k + 1} / {c}{k})" for k in (1, 2, 3)]
    ok = " and ".join([f"{c}{k} > 0" for k in (1, 2, 3, 4)] + [f"{x} > 0" for x in own])
    return [f"if({ok}, {x}, {k * 0.5}D)" for k, x in enumerate(own, 1)]


def word_model(docs: DataFrame, ranges: int, bits: int) -> tuple[str, str]:
    """Paths of the model as each part of docs asks for it: the counts of its pairs,
    and those of its words with the discounts of their language (d of pairs, e of left
    neighbours), for the models of both halves.

    docs must give the same splits at every reading; that is checked by part.
    """
    few = -(-ranges // 4)
    asked = docs.mapInArrow(_ask_pairs(ranges, bits), ASKED)
    pairs = blocks.store_by_part(asked.groupBy("slot").applyInArrow(_merge_pairs(ranges, bits), GIVEN))
    tallied = docs.mapInArrow(_tally_words(pairs, few, bits), TALLIED)
    told = tallied.groupBy("slot").applyInArrow(_merge_words(few, bits), TOLD)
    names = ["all_left", "u1", "u2", "um", "u3", "u4", "c1", "c2", "c3", "c4"]
    sums = told.filter("part is null").groupBy("lang_key", "model").agg(
        *[F.sum(F.col("totals")[k]).alias(c) for k, c in enumerate(names)]
    )
    d, e = _discount("c"), _discount("u")
    sums = sums.select(
        "lang_key", "model", "all_left", "u1", "u2", "um",
        *[F.expr(x).alias(f"d{k}") for k, x in enumerate(d, 1)], *[F.expr(x).alias(f"e{k}") for k, x in enumerate(e, 1)],
    ).withColumn("last_back", F.expr("if(all_left > 0, (e1 * u1 + e2 * u2 + e3 * um) / all_left, 1D)"))
    by_lang = sums.groupBy("lang_key").agg(
        *[F.max(F.when(F.col("model") == m, F.array(*PARAMS))).alias(f"params{m}") for m in (0, 1)]
    )
    words = told.filter("part is not null").select("part", "lang_key", "slot", "counts").join(by_lang, "lang_key")
    return pairs, blocks.store_by_part(words)


SCORED = """doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long,
n_repeat_words long, surprise double"""


def _dup_lines(data: np.ndarray, at: np.ndarray, sums: np.ndarray) -> np.ndarray:
    breaks = np.flatnonzero(data == 10)
    texts = len(at) - 1
    owner = np.searchsorted(at, breaks, side="right") - 1
    inner = breaks + 1 < at[owner + 1]
    full = np.flatnonzero(at[:-1] < at[1:])
    starts = np.concatenate((at[full], breaks[inner] + 1))
    doc = np.concatenate((full, owner[inner]))
    order = np.argsort(starts, kind="stable")
    starts, doc = starts[order], doc[order]
    stops = np.concatenate((breaks, [np.iinfo(np.int64).max]))[np.searchsorted(breaks, starts)]
    ends = np.minimum(stops, at[doc + 1])
    running = np.concatenate(([0], np.cumsum(~arrays.WHITE[data])))
    worded = running[ends] > running[starts]
    starts, ends, doc = starts[worded], ends[worded], doc[worded]
    hashes = arrays.spans_of(sums, starts, ends)
    _, again = arrays.repeated(arrays.mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return np.bincount(doc[again], minlength=texts)


def _repeat_words(words: np.ndarray, word_at: np.ndarray, size: int = 8) -> np.ndarray:
    first, hashes = arrays.window_hashes(words, word_at, size)
    doc = np.searchsorted(word_at, first, side="right") - 1
    found = arrays.met_twice(arrays.mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    edge = np.zeros(len(words) + 1, np.int64)
    edge[first[found]] += 1
    np.subtract.at(edge, first[found] + size, 1)
    return arrays.per_text((np.cumsum(edge[:-1]) > 0).astype(np.int64), word_at)


class PartModel:
    """The model for the words of one part, as sorted arrays."""

    def __init__(self, own: PartPairs, part: int, pairs: str, words: str):
        own.words()
        n0, n1, _ = own.answers(pairs, part)
        self.own, self.n = own, (n0, n1)
        told = blocks.read_part(words, part, ["lang_key", "slot", "counts", "params0", "params1"]).to_pylist()
        told.sort(key=lambda r: (np.int64(r["lang_key"]).view(np.uint64), r["slot"]))
        counts = np.concatenate([blocks.unpack(r["counts"]).astype(np.float64).reshape(2 * len(COUNTS), -1) for r in told], axis=1)
        if counts.shape[1] != len(own.word):
            raise RuntimeError(f"the input changed between two readings: part {part} holds other words")
        wide = len(COUNTS)
        self.counts = [dict(zip(COUNTS, counts[m * wide : (m + 1) * wide])) for m in (0, 1)]
        for c in self.counts:
            c["total"] = c["rest"] + c["h1"] + 2 * c["h2"] + 3 * c["hm"]
        self.params = {r["lang_key"]: (r["params0"], r["params1"]) for r in told}

    def loss(self, which: np.ndarray, fold: np.ndarray, lang: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Negative log probability of words, given by their pairs, under the model of the
        half their text is not in; `spelled` is that of their spelling."""
        out = np.empty(len(which))
        each, group = np.unique(lang, return_inverse=True)
        for model in (0, 1):
            here = fold == 1 - model
            if not here.any():
                continue
            table = np.array([self.params[_as_long(x)][model] for x in each])
            p = dict(zip(PARAMS, table[group[here]].T))
            pair = which[here]
            n, counts = self.n[model][pair].astype(np.float64), self.counts[model]
            history = {c: counts[c][self.own.at_a[pair]] for c in ("total", "h1", "h2", "hm")}
            left = counts["left"][self.own.at_b[pair]]
            cut = np.where(n == 1, p["d1"], np.where(n == 2, p["d2"], p["d3"]))
            total = np.maximum(history["total"], 1.0)
            own = np.where(n > 0, (n - cut) / total, 0.0)
            back = np.where(history["total"] > 0, (p["d1"] * history["h1"] + p["d2"] * history["h2"] + p["d3"] * history["hm"]) / total, 1.0)
            taken = np.where(left == 1, p["e1"], np.where(left == 2, p["e2"], p["e3"]))
            share = np.where(left > 0, (left - taken) / np.maximum(p["all_left"], 1.0), 0.0)
            with np.errstate(divide="ignore"):
                out[here] = -np.logaddexp(np.log(own + back * share), np.log(back * p["last_back"]) - spelled[here])
        return out


def _scorer(shared, pairs: str, told: str, bits: int):
    def score(spelling: np.ndarray, part: int, pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PartPairs(pieces, bits)
        model = PartModel(own, part, pairs, told) if len(own.keys) else None
        if model:
            # Scoring needs the places of words only.
            del own.a, own.b, own.lang_at, own.keys, own.n0, own.n1
        done = 0
        for piece in pieces:
            data, at, running, starts, words, word_at, owner, fold, lang = _word_keys(piece)[:-2]
            dup_lines = _dup_lines(data, at, running)
            del running
            letters = ~arrays.WHITE[data] & ((data & 0xC0) != 0x80)
            loss = np.concatenate(([0.0], np.cumsum(spelling[_codes(data, at)])))
            # A word is spelled with the white space after it; white space before the first word counts by itself.
            stops = np.append(starts[1:], len(data))
            full = np.flatnonzero(word_at[:-1] < word_at[1:])
            stops[word_at[full + 1] - 1] = at[full + 1]
            total = loss[at[1:]] - loss[at[:-1]]
            if len(starts):
                which = own.which[done : done + len(starts)]
                each = model.loss(which, fold[owner], lang[owner], loss[stops] - loss[starts])
                total[full] = loss[starts[word_at[full]]] - loss[at[full]] + arrays.per_text(each, word_at)[full]
                done += len(starts)
            sizes = np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    piece.column("lang"),
                    pa.array(np.diff(word_at)),
                    pa.array(arrays.per_text(letters, at)),
                    pa.array(arrays.per_text(SYMBOL[data], at)),
                    pa.array(dup_lines),
                    pa.array(_repeat_words(words, word_at)),
                    pa.array(np.where(sizes > 0, total / np.maximum(sizes, 1), 0.0)),
                ],
                [f.split()[0] for f in SCORED.replace("\n", " ").split(", ")],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last class of a code tells among how many bytes it stands.
        spelling = SortedModel(*shared.value).surprise(SLOTS) + np.log(np.maximum(CLASS_SIZE, 1))[np.arange(A**3) % A]
        yield from blocks.by_part(partial(score, spelling))(batches)

    return run


def quality_verdicts(
    docs: DataFrame,
    low: float = 3.0, high: float = 3.0, least: tuple[float, float] = (1.6, 0.0), spread_words: int = 100,
    min_words: int = 20,
) -> DataFrame:
    """One row per document: the base counts, `perplexity`, the band of its
    language and `kept`.

    The band is the median of log perplexity of the language minus `low` (plus
    `high`) times the distance from the median to the quartile, but at least
    `least` wide below and above: near copies of good texts lie far below, and
    they are left to de-duplication. The width above grows for short texts, whose
    mean spreads more, by sqrt(1 + spread_words / words). Documents that fail the
    base rules do not shape the bands, though their words are counted.

    Null or empty text: zero counts, base_failed. Null language: a group of its
    own. Repeated rows are judged one by one. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    docs = blocks.repeatable(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spelling = kneser_ney(docs, by_language=False)
    shared = spark.sparkContext.broadcast(SortedModel.arrays_of(spelling.toArrow()))
    bits = key_bits(size)
    pairs, words = word_model(docs, -(-size // RANGE_BYTES) or 1, bits)
    scored = materialize(docs.mapInArrow(_scorer(shared, pairs, words, bits), SCORED)).withColumn(
        "base_failed", F.expr(f"n_words < {int(min_words)} or 100 * n_repeat_words > 30 * n_words")
    )
    bands = (
        scored.filter("not base_failed")
        .groupBy(F.coalesce("lang", F.lit("")).alias("group"))
        .agg(F.percentile_approx("surprise", [0.25, 0.5, 0.75], 1000).alias("q"))
        .select(
            "group",
            F.expr(f"q[1] - greatest({least[0]}D, {low}D * (q[1] - q[0]))").alias("low"),
            F.col("q")[1].alias("mid"),
            F.expr(f"greatest({least[1]}D, {high}D * (q[2] - q[1]))").alias("above"),
        )
    )
    out = scored.withColumn("group", F.coalesce("lang", F.lit(""))).join(bands, "group", "left").withColumn(
        "high", F.expr(f"mid + above * sqrt(1 + {int(spread_words)} / greatest(n_words, 1))")
    )
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.expr("not base_failed and surprise between low and high").alias("kept"),
        F.exp("surprise").alias("perplexity"), F.exp("low").alias("low_limit"), F.exp("high").alias("high_limit"),
    )
