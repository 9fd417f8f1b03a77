"""What the quality operator saves in passes changes no result."""

from __future__ import annotations

import tracemalloc
import weakref
from functools import partial

import numpy as np
import pyarrow as pa

from storyhub.llm import arrays, blocks, quality
from storyhub.session import BATCH_BYTES, materialize


def test_met_twice_is_the_first_half_of_repeated():
    rng = np.random.default_rng(3)
    for n, kinds in ((0, 1), (1, 1), (2, 1), (500, 40), (5000, 4000)):
        keys = rng.integers(0, kinds, n).astype(np.uint64)
        assert (arrays.met_twice(keys) == arrays.repeated(keys)[0]).all()


def test_bytes_of_a_slice_are_summed_once(monkeypatch):
    calls, sums = [], arrays.running_sums
    monkeypatch.setattr(arrays, "running_sums", lambda values: (calls.append(len(values)), sums(values))[1])
    texts = ["one two one two\none two", "", None, "  three  ", "one two one two\none two\n\nx"]
    piece = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en", None, "de", "en", "en"])], ["text", "lang"])
    data, at, running, starts, words, word_at, *_ = quality._word_keys(piece)
    found = quality._dup_lines(data, at, running)
    assert calls.count(len(data)) == 1
    assert found.tolist() == [0, 0, 0, 0, 0]
    ends = arrays.find_words(data, at)[1]
    assert (words == arrays.word_hashes(data, starts, ends)).all()


def test_spelling_counts_take_few_bytes_for_a_byte_of_text():
    """Counts by language equal those of each text by itself, in less than 20 bytes a byte."""
    texts, langs = ["Some words, and 12 more.\n" * 80_000, "x", None, "a b" * 9], ["en", None, "de", "de"]
    piece = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(langs)], ["text", "lang"])
    list(quality._count(iter([piece])))
    tracemalloc.start()
    try:
        counted = list(quality._count(iter([piece])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20 * len(texts[0])
    found = {b.column("slot")[0].as_py(): sum(b.column("n").to_pylist()) for b in counted}
    assert found == {quality.slot_of("en"): len(texts[0]), quality.slot_of(None): 1, quality.slot_of("de"): 27}


def _noisy_part(size: int) -> list[pa.RecordBatch]:
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(30_000)])
    texts = [" ".join(words[rng.integers(0, len(words), 300)]) for _ in range(size)]
    texts[3:6] = ["", "alone", " two  words\n"]
    langs = ["en" if k % 3 else None for k in range(size)]
    return pa.Table.from_pydict({"text": texts, "lang": langs}).to_batches(max_chunksize=size // 4)


def test_word_pairs_of_a_part_are_those_of_its_texts():
    pieces, bits = _noisy_part(60), 48
    own, cut = quality.PartPairs(pieces, bits), np.uint64(64 - bits)
    own.words()
    want, done = {}, 0
    for piece in pieces:
        owner, fold, lang, a, b = quality._word_keys(piece)[-5:]
        keys = arrays.mix(arrays.mix(a) * quality.PAIR_MIX + b) >> cut
        assert (own.keys[own.which[done : done + len(keys)]] == keys).all()
        done += len(keys)
        for k, x, y, z, odd in zip(keys.tolist(), a >> cut, b >> cut, lang[owner], fold[owner], strict=True):
            counts = want.setdefault(k, [x, y, z, 0, 0])
            counts[3 + odd] += 1
    assert done == len(own.which) and own.keys.tolist() == sorted(want)
    for k, key in enumerate(own.keys.tolist()):
        found = [own.word[own.at_a[k]], own.word[own.at_b[k]], own.word_lang[own.at_b[k]], own.n0[k], own.n1[k]]
        assert found == want[key] and own.word_lang[own.at_a[k]] == want[key][2]


def test_word_pairs_of_a_part_take_few_bytes_for_a_word():
    pieces = _noisy_part(4000)
    quality.PartPairs(pieces[:1], 48).words()
    tracemalloc.start()
    try:
        own = quality.PartPairs(pieces, 48)
        own.words()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 120 * len(own.which)


def test_stored_tables_hand_python_small_batches(spark):
    """4 MB at a time, as long as the session has no limit of its own."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    docs = spark.range(0, 9000, numPartitions=1).selectExpr("repeat(cast(id as string), 500) as text")
    largest = lambda: max(r["size"] for r in materialize(docs.mapInArrow(sizes, "size long")).collect())
    assert largest() < 5 << 20
    assert spark.conf.get(BATCH_BYTES, None) is None
    spark.conf.set(BATCH_BYTES, str(1 << 20))
    try:
        assert largest() < 2 << 20
        assert spark.conf.get(BATCH_BYTES) == str(1 << 20)
    finally:
        spark.conf.unset(BATCH_BYTES)


def test_parts_let_go_of_what_other_operators_kept(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(blocks, "TaskContext", Task)
    made = []
    kept = lambda: arrays.per_worker("a table of another operator", lambda: made.append(1))
    kept(), kept()
    assert len(made) == 1
    assert len(list(blocks.parts(iter(_noisy_part(8))))) == 1
    kept()
    assert len(made) == 2


def test_a_part_is_freed_before_the_next_is_worked(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    class Held:
        pass

    seen = []

    def work(part, pieces):
        assert not any(x() for x in seen)
        held = Held()
        seen.append(weakref.ref(held))
        yield pieces[0]

    monkeypatch.setattr(blocks, "TaskContext", Task)
    monkeypatch.setattr(blocks, "parts", partial(blocks.parts, part_bytes=1000))
    assert len(list(blocks.by_part(work)(iter(_noisy_part(8))))) == len(seen) > 1
