"""Token ids of whole texts by the tokenizers library, with a bounded word cache.

The two byte-level kinds of vocabulary cut a text into pieces before any merge,
and a piece always has the same ids. Pieces of texts in plain Latin letters are
therefore found with one regular expression and each new one is encoded by the
library; any other text, and any text that holds a special token's string, goes
through the library whole. Both ways give the library's ids.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa

from storyhub.llm import arrays

END_ID = 2
CACHE_WORDS = 900_000
JOINED_WORDS = 512

PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
# How the two vocabularies cut a text, for plain Latin letters.
SPACE = r"\t\n\x0b\x0c\r "
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
BYTE_PIECES = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^{SPACE}{LETTER}0-9]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
WORD_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^{SPACE}{LETTER}0-9]+"


def tokenizer(path: str) -> "CachedTokenizer":
    """The tokenizer of a file, one for each worker process."""
    return arrays.per_worker(("tokenizer", path), lambda: CachedTokenizer(path))


# Kinds of bytes in a plain text: white space, letters, digits, all others.
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[ord("a") : ord("z") + 1] = 1
KIND[128:] = 1
KIND[ord("0") : ord("9") + 1] = 2


def _lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plain Latin letters in lower case, and a mark at bytes that need the
    library or the regular expression: other letters, apostrophes, and marks
    with which a special token begins."""
    before = np.zeros_like(data)
    before[1:] = data[:-1]
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    second = before == 0xC3
    low = np.where(second & (data >= 0x80) & (data <= 0x9E), data + 32, low).astype(np.uint8)
    other = (data >= 0x80) & (data != 0xC3) & ~(second & (data < 0xC0) & (data != 0x97) & (data != 0xB7))
    return low, other | ((data == 0xC3) & second) | (data == 39) | ((data == 124) & (before == 60)) | ((data >= 28) & (data < 32))


class CachedTokenizer:
    """Ids as little-endian bytes of the narrowest kind that holds the vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.kind = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.lower = spec["normalizer"] is not None
        self.pieces = re.compile(WORD_PIECES if self.lower else BYTE_PIECES).findall
        self.cache: dict[str, bytes] = {}
        self.named: dict[int, bytes] = {}
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.library.get_vocab_size(), bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single pieces. Where a word's last token says so, many pieces
        are encoded as one text and told apart afterwards."""
        if self.ends is None:
            return self._whole(words)
        groups = [words[k : k + JOINED_WORDS] for k in range(0, len(words), JOINED_WORDS)]
        out: list[bytes] = []
        for group, ids in zip(groups, self._whole([" ".join(g) for g in groups]), strict=True):
            last = np.flatnonzero(self.ends[np.frombuffer(ids, self.kind)]) + 1
            if len(last) != len(group):
                out += self._whole(group)
                continue
            cuts = [0, *(last * self.kind.itemsize).tolist()]
            out += [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        code = "H" if self.kind.itemsize == 2 else "I"
        return [array(code, x.ids).tobytes() for x in found]

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """As encode, for a column of texts at once: pieces of plain texts are
        cut and named by hash as arrays, and each different one is looked up
        once."""
        if not self.lower:
            return self.encode(column.to_pylist())
        data, at = arrays.text_bytes(column)
        low, odd = _lowered(data)
        slow = np.flatnonzero(arrays.per_text(odd, at) > 0)
        kind = KIND[low]
        edge = np.ones(len(low), bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        edge[at[:-1][at[:-1] < at[1:]]] = True
        heads = np.flatnonzero(edge)
        tails = np.append(heads[1:], len(low))
        inside = kind[heads] != 0
        heads, tails = heads[inside], tails[inside]
        names, first, which = np.unique(
            arrays.span_hashes(arrays.BYTE_VALUES[low], heads, tails), return_index=True, return_inverse=True
        )
        if len(self.named) > CACHE_WORDS:
            self.named.clear()
        keys, get = names.tolist(), self.named.get
        found = list(map(get, keys))
        new = [k for k, x in enumerate(found) if x is None]
        if new:
            raw = low.tobytes()
            # Pieces of texts that go another way may not be whole letters.
            words = [raw[heads[first[k]] : tails[first[k]]].decode(errors="replace") for k in new]
            for k, ids in zip(new, self._words(words), strict=True):
                found[k] = self.named[keys[k]] = ids
        width = self.kind.itemsize
        flat = np.frombuffer(b"".join(found), self.kind)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // width
        begin = np.cumsum(sizes) - sizes
        each = sizes[which]
        ends = np.cumsum(each)
        place = np.repeat(begin[which] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)
        raw = flat[place].tobytes()
        cuts = np.concatenate(([0], ends))[np.searchsorted(heads, at)] * width
        out = [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for k, ids in zip(slow.tolist(), self.encode(column.take(pa.array(slow)).to_pylist()), strict=True):
            out[k] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null is empty."""
        out: list[bytes] = [b""] * len(texts)
        other, cut, new = [], [], set()
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        known = self.cache.keys()
        for k, text in enumerate(texts):
            if not text:
                continue
            if PLAIN.fullmatch(text) is None or any(x in text for x in self.special):
                other.append(k)
                continue
            words = self.pieces(text.lower() if self.lower else text)
            new.update(words)
            cut.append((k, words))
        fresh = list(new - known)
        if fresh:
            self.cache.update(zip(fresh, self._words(fresh), strict=True))
        get = self.cache.__getitem__
        for k, words in cut:
            out[k] = b"".join(map(get, words))
        for k, ids in zip(other, self._whole([texts[k] for k in other]) if other else [], strict=True):
            out[k] = ids
        return out
