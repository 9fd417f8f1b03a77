"""The perplexity model against plain loops over the definition."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyhub.llm import arrays, blocks, quality

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def discounts(counts):
    """Three discounts from the counts of counts; see `_discount`."""
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    if all(n):
        y = n[0] / (n[0] + 2 * n[1])
        d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
        if min(d) > 0:
            return d
    return [0.5, 1.0, 1.5]


def cut(d, n):
    return d[min(n, 3) - 1]


def spelling_loop(texts):
    """Negative log probability of a byte after the two classes before it."""
    classes = [[0, 0, *quality.CLASS_OF[np.frombuffer(t, np.uint8)].tolist()] for t in texts]
    grams = Counter(tuple(c[k - 2 : k + 1]) for c in classes for k in range(2, len(c)))
    orders = [grams, Counter(g[1:] for g in grams)]
    orders.append(Counter(g[1:] for g in orders[1]))

    def found(n):
        # The discounts of this model are bounded by their place, not tested for falling.
        c = [sum(x == k for x in n) for k in (1, 2, 3, 4)]
        if not all(c):
            return [0.5, 1.0, 1.5]
        y = c[0] / (c[0] + 2 * c[1])
        return [max(0.0, min(float(k), k - (k + 1) * y * c[k] / c[k - 1])) for k in (1, 2, 3)]

    ds = [found(list(o.values())) for o in orders]
    after = [defaultdict(list) for _ in orders]
    for k, o in enumerate(orders):
        for g, n in o.items():
            after[k][g[:-1]].append(n)

    def prob(g, k=0):
        if k == 3:
            return 1 / quality.A
        ns = after[k].get(g[:-1])
        if not ns:
            return prob(g[1:], k + 1)
        own = orders[k].get(g, 0)
        share = (own - cut(ds[k], own)) / sum(ns) if own else 0.0
        return share + sum(cut(ds[k], n) for n in ns) / sum(ns) * prob(g[1:], k + 1)

    sizes = np.bincount(quality.CLASS_OF, minlength=quality.A)
    return lambda c, k: -math.log(max(prob(tuple(c[k - 2 : k + 1])), 1e-12)) + math.log(sizes[c[k]])


def surprise_loop(rows):
    """Mean negative log probability of the bytes of each text."""
    data = [(t or "").encode() for _, t, _ in rows]
    spelled = spelling_loop(data)
    pieces = np.array([int(h) & 1 for h in text_hashes(data)])
    counts = defaultdict(Counter)
    for t, (_, _, lang), half in zip(data, rows, pieces):
        words = [None, *WORD.findall(t)]
        counts[lang or "", half].update(zip(words, words[1:]))
    models = {}
    for key, pairs in counts.items():
        heads, left = defaultdict(list), Counter(b for _, b in pairs)
        for (a, _), n in pairs.items():
            heads[a].append(n)
        models[key] = pairs, heads, left, discounts(list(pairs.values())), discounts(list(left.values()))
    out = []
    for t, (_, _, lang), half in zip(data, rows, pieces):
        pairs, heads, left, d, e = models.get((lang or "", 1 - half), ({}, {}, {}, None, None))
        c = [0, 0, *quality.CLASS_OF[np.frombuffer(t, np.uint8)].tolist()]
        loss = [spelled(c, k) for k in range(2, len(c))]
        spans = [m.span() for m in WORD.finditer(t)]
        total = sum(loss[: spans[0][0]]) if spans else sum(loss)
        before = None
        for k, (start, end) in enumerate(spans):
            word, stop = t[start:end], spans[k + 1][0] if k + 1 < len(spans) else len(t)
            low = math.exp(-sum(loss[start:stop]))
            if left:
                all_left = sum(left.values())
                share = (left[word] - cut(e, left[word])) / all_left if left[word] else 0.0
                low = share + sum(cut(e, n) for n in left.values()) / all_left * low
            if ns := heads.get(before):
                n = pairs[before, word]
                own = (n - cut(d, n)) / sum(ns) if n else 0.0
                low = own + sum(cut(d, n) for n in ns) / sum(ns) * low
            total -= math.log(low)
            before = word
        out.append(total / len(t) if t else 0.0)
    return out


def text_hashes(data):
    at = np.concatenate(([0], np.cumsum([len(t) for t in data]))).astype(np.int64)
    return arrays.word_hashes(np.frombuffer(b"".join(data), np.uint8), at[:-1], at[1:])


def some_texts():
    rng = np.random.default_rng(5)
    bag = [f"{a}{b}{'' if k % 3 else a.upper()}" for k, (a, b) in enumerate((a, b) for a in "abcdeé" for b in "xyz7.")]
    share = 1 / np.arange(1, len(bag) + 1)
    texts = []
    for k in range(120):
        words = rng.choice(bag, size=int(rng.integers(0, 60)), p=share / share.sum())
        texts.append((k, "  " * (k % 2) + ("\n" if k % 5 == 0 else " ").join(words) + " " * (k % 3), ["en", "fr", None][k % 3]))
    return [*texts, (120, None, "en"), (121, "", None), (122, "lone words here", "only"), (3, texts[3][1], texts[3][2])]


@pytest.mark.parametrize("ranges", [None, 20])
def test_perplexity_equals_the_plain_loop(spark, monkeypatch, ranges):
    """All parts and ranges together give the perplexities of the definition."""
    rows = some_texts()
    want = sorted(zip([r[0] for r in rows], surprise_loop(rows)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if ranges:
        # Two ranges of words and many of pairs.
        whole = quality.word_model
        monkeypatch.setattr(quality, "word_model", lambda docs, _, bits: whole(docs, ranges, bits))
    got = sorted((r["doc_id"], math.log(r["perplexity"])) for r in quality.quality_verdicts(df).collect())
    assert [d for d, _ in got] == [d for d, _ in want]
    assert max(abs(x - y) for (_, x), (_, y) in zip(got, want)) < 1e-9


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for values in ([], [0], [0, 0, 0], [7], rng.integers(0, 1 << 63, 1000), [(1 << 64) - 1, 3]):
        values = np.array(values, np.uint64)
        assert (blocks.unpack(blocks.pack(values)) == values).all()
        ordered = np.sort(values)
        base = int(ordered[0]) if len(ordered) else 5
        assert (blocks.unpack_sorted(blocks.pack_sorted(ordered, base), base) == ordered).all()
    for n in (0, 1, 8, 1001):
        marks = rng.integers(0, 2, n).astype(bool)
        assert (blocks.unpack_bits(blocks.pack_bits(marks)) == marks).all()
    # A sorted column of hashes costs only what its order does not give.
    hashes = np.sort(rng.integers(0, 1 << 56, 1 << 16, dtype=np.uint64))
    assert len(blocks.pack_sorted(hashes)) < 5.5 * len(hashes)


def test_changed_input_is_an_error(spark):
    """A part that holds other rows at the second reading is found by its mark."""
    df = spark.createDataFrame(some_texts(), SCHEMA).coalesce(1)
    pairs, _ = quality.word_model(df, 2, 48)
    other = df.withColumn("text", F.concat("text", F.lit(" more")))
    with pytest.raises(Exception, match="the input changed"):
        other.mapInArrow(quality._tally_words(pairs, 1, 48), quality.TALLIED).count()
