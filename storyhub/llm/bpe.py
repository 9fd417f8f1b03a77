"""Byte pair encoding and decoding of whole texts.

The merges of a word are found with a segment tree over the ranks of adjacent
pairs: every leaf is a pair, every inner node the smaller of its two children,
so the root is the leftmost pair of lowest rank. A merge changes at most three
leaves, each updated in logarithmic time, until the root holds no pair.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyhub.llm import arrays
from storyhub.llm.tokens import LETTER, PLAIN, SPACE

NONE = 1 << 62
CACHE_WORDS = 500_000

# How a text is cut into words, in lower case.
ANY_WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
)
PLAIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^{SPACE}{LETTER}0-9]+")


def byte_letters() -> list[str]:
    """The printable stand-in of every byte: itself where printable in Latin-1,
    else the next free letter from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class WordCache(dict):
    """Ids of words met so far; a new word is encoded when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.encode(word)
        return found


class PairEncoder:
    """Encoder for a vocabulary file of lower-case words with word-end marks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + end] for x in letters]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 20 | vocab[b]] = len(self.made)
            self.made.append(vocab[a + b])
        self.cache = WordCache(self.word)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply merges to a word until no adjacent pair can be merged."""
        n = len(symbols)
        if n < 2:
            return symbols
        rank, made = self.rank.get, self.made
        size = 1 << (n - 2).bit_length()
        tree = [NONE] * (2 * size)
        node, a = size, symbols[0]
        for b in symbols[1:]:
            r = rank(a << 20 | b)
            if r is not None:
                tree[node] = r << 32 | (node - size)
            a = b
            node += 1
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        while tree[1] != NONE:
            top = tree[1]
            i = top & 0xFFFFFFFF
            j = after[i]
            symbols[i] = made[top >> 32]
            symbols[j] = -1
            k = after[i] = after[j]
            before[k] = i
            p = before[i]
            changed = [(j, NONE)] if j < n - 1 else []
            changed.append((i, rank(symbols[i] << 20 | symbols[k], NONE) if k < n else NONE))
            if p >= 0:
                changed.append((p, rank(symbols[p] << 20 | symbols[i], NONE)))
            for at, value in changed:
                node = size + at
                if value != NONE:
                    value = value << 32 | at
                if tree[node] == value:
                    continue
                tree[node] = value
                while node > 1:
                    other = tree[node ^ 1]
                    low = value if value < other else other
                    node >>= 1
                    if tree[node] == low:
                        break
                    tree[node] = value = low
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> bytes:
        raw = word.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return array("I", self.merge(symbols)).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        out, at = [], 0
        for found in self.cut.finditer(text) if self.special and "<" in text else ():
            out.append(self._part(text[at : found.start()]))
            out.append(np.array([self.special[found[0]]], "<u4").tobytes())
            at = found.end()
        out.append(self._part(text[at:] if at else text))
        return b"".join(out)

    def _part(self, text: str) -> bytes:
        if PLAIN.fullmatch(text):
            words = PLAIN_WORDS.findall(text.lower())
        else:
            text = unicodedata.normalize("NFC", text)
            # Letter by letter: a final sigma has no form of its own here.
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
            words = ANY_WORDS.findall(text)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        return b"".join(map(self.cache.__getitem__, words))

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space, as the library does for a vocabulary
        file that names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256,
    decoded_sha256, and the ids and decoded text themselves if `ids` is set.

    Null and empty texts have no tokens. Rows are handled one by one, so
    repeated ids and other columns do no harm. A word of any length is merged
    whole.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids binary, decoded string" if ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = arrays.per_worker(("pairs", path), lambda: PairEncoder(path))
        for piece in arrays.slices(batches):
            rows = []
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                raw = coder.encode(text)
                plain = coder.decode(raw)
                row = [doc_id, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()]
                rows.append(row + [raw, plain] if ids else row)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
