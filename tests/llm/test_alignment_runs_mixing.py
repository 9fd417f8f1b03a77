"""Token alignment, periodic runs and fair mixing against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from test_operators import docs, none, odd, pairs, path, same  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0d]+")
TABLES = ["docs", "odd"]


# Alignment


def loop_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    from storyhub.llm.bpe import byte_letters

    A = Tokenizer.from_file(path("byte_bpe_50k.json"))
    A.encode_special_tokens = True
    B = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    letters = {c: k for k, c in enumerate(byte_letters())}

    def bytes_b(i):
        return bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()

    def spans(tokens):
        ends = np.cumsum([len(t) for t in tokens]).tolist()
        return list(zip([0, *ends], ends, strict=False))

    rows, count = [], Counter()
    for doc_id, text in texts:
        a, b, groups, links = [], [], [], []
        if text:
            raw = (" " + text).encode()
            a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
            at = [bytes(letters[c] for c in A.id_to_token(i)) for i in a]
            bt = [bytes_b(i) for i in b]
            if b"".join(at) != raw or b"".join(bt) != raw:
                a, b = [], []
            else:
                sa, sb = spans(at), spans(bt)
                low = 0
                for high in sorted({e for _, e in sa} & {e for _, e in sb}):
                    groups.append(([i for i, (s, e) in enumerate(sa) if s >= low and e <= high], [j for j, (s, e) in enumerate(sb) if s >= low and e <= high]))
                    links += [(a[i], b[j]) for i in groups[-1][0] for j in groups[-1][1] if sa[i][0] < sb[j][1] and sb[j][0] < sa[i][1]]
                    low = high
        count.update(links)
        rows.append((doc_id, a, b, groups, links))
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for doc_id, a, b, groups, links in rows:
        told = ";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[j]) for j in y) for x, y in groups)
        out.append(
            (doc_id, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
             hashlib.sha256(told.encode()).hexdigest() if told else "", told)
        )
    return out, count


EDGES = ["a  b\n\nc \n d\n", " lead", "\nfoo\n\nbar \nbaz\r\n\tq", " ", "x▁y ok", "\x00a \x1c b c　d", "  \n  ", " \n", "word,\nNext\n\nThen  two   three    four ",
         "\t\tx \t y", "<|endoftext|> <s> </s> <0x0A>", "Ａ ﬁ \x85next", "ab÷cd Ô ×x"]


def test_alignment_of_odd_texts(spark):
    from storyhub.llm.alignment import align_tokenizers

    rng = random.Random(4)
    letters = " \n\t\r aàéÀab'sS.,;1 2 ▁漢<|>\x0b "
    texts = list(enumerate(EDGES + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(300)]))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows, counted = align_tokenizers(df, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    want, count = loop_alignment(texts)
    same([tuple(r) for r in rows.collect()], want)
    assert {(r["a"], r["b"]): r["count"] for r in counted.collect()} == dict(count)


@pytest.mark.parametrize("name", TABLES)
def test_alignment(name, request):
    from storyhub.llm.alignment import align_tokenizers

    df = request.getfixturevalue(name)
    if name == "docs":
        df = df.filter("length(text) < 2000")  # the plain loop is quadratic
    got = align_tokenizers(df, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), full=False)[0]
    texts = [(d, t if name == "docs" or not t or len(t) < 2000 else t) for d, t in pairs(df)]
    if name == "odd":  # one word of 70,000 letters: too much for the loop, so compared by counts alone
        long = {d for d, t in texts if t and len(t) > 20_000}
        assert all(r["n_a"] > 0 and r["n_links"] >= max(r["n_a"], r["n_b"]) for r in got.collect() if r["doc_id"] in long)
        df = df.filter("text is null or length(text) <= 20000")
        texts = [x for x in texts if x[0] not in long]
        got = align_tokenizers(df, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), full=False)[0]
    same([tuple(r) for r in got.collect()], [r[:-1] for r in loop_alignment(texts)[0]])


def test_alignment_chunks_do_not_change_with_the_cache(monkeypatch):
    import pyarrow as pa

    from storyhub.llm import alignment

    monkeypatch.setattr(alignment, "CACHE_CHUNKS", 3)
    tool = alignment.Aligner(path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    batch = pa.RecordBatch.from_pydict({"text": ["one two three", "two three four five", "one six two", None, ""]})
    first = alignment.Batch(batch, tool)
    for _ in range(3):
        again = alignment.Batch(batch, tool)
        assert again.groups == first.groups and (again.keys == first.keys).all() and (again.times == first.times).all()


# Runs


def loop_runs(words, least=24, repeats=3):
    found = {}
    for p in range(1, len(words) // repeats + 1):
        j = 0
        while j + p < len(words):
            if words[j] != words[j + p]:
                j += 1
                continue
            s = j
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - s >= max(least, repeats * p):
                found.setdefault((s, j + p - s), p)
    return sorted((s, m, p) for (s, m), p in found.items())


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def loop_report(doc_id, text, plant):
    words = WORD.findall(text or "")
    words = planted(doc_id, words) if plant else words
    runs = loop_runs(words)
    gone = {k for s, m, p in runs for k in range(s + p, s + m)}
    row = [doc_id, len(runs), None, None, None, None]
    if runs:
        s, m, p = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        row[2:] = [s, m, p, 1000 * m // p]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (*row, digest("".join(f"{s},{m},{p}\n" for s, m, p in runs)), digest(kept), runs, kept)


@pytest.mark.parametrize("least,repeats", [(24, 3), (6, 3), (2, 2), (10, 4)])
def test_runs_of_random_words(least, repeats):
    from storyhub.llm import arrays, periodic

    rng = random.Random(least)
    for _ in range(80):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, letters = rng.choice([0, 1, 2, 10, 60, 150]), rng.choice([1, 2, 3, 30])
            w = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), rng.randint(1, 1 + n // 3)
                w[a:] = [w[a + k % min(p, n - a)] for k in range(n - a)]
            texts.append(w * rng.choice([1, 1, 4]))
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        flat = np.array([x for t in texts for x in t], np.uint64)
        keys = arrays.mix(flat + arrays.text_of(at).astype(np.uint64) * np.uint64(1000))
        got = periodic.find_runs(keys, at, least, repeats)
        want = [(int(at[k]) + s, int(at[k]) + s + m, p) for k, t in enumerate(texts) for s, m, p in loop_runs(t, least, repeats)]
        assert list(map(tuple, got.tolist())) == sorted(want, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("name", TABLES)
@pytest.mark.parametrize("plant", [True, False])
def test_runs(name, plant, request):
    from storyhub.llm.periodic import periodic_runs

    df = request.getfixturevalue(name)
    got = [(*r[:8], [tuple(x) for x in r["runs"]] if r["runs"] else [], r["collapsed"]) for r in periodic_runs(df, plant).collect()]
    same(got, [loop_report(d, t, plant) for d, t in pairs(df)])


def test_runs_ties_and_long_texts(spark):
    from storyhub.llm.periodic import periodic_runs

    texts = [
        (1, "a b c " * 8 + "x " + "d e f " * 8),  # equal exponents: the first start
        (2, "a " * 30_000),
        (3, " ".join(f"w{k % 997}" for k in range(20_000))),
        (4, "a b " * 11 + "a"),  # 23 words: too short
        (5, "a b " * 12),
    ]
    got = {r["doc_id"]: r for r in periodic_runs(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (got[1]["n_runs"], got[1]["start"], got[1]["length"], got[1]["period"]) == (2, 0, 24, 3)
    assert (got[2]["length"], got[2]["period"], got[2]["collapsed"]) == (30_000, 1, "a")
    assert (got[3]["length"], got[3]["period"], got[3]["exponent_milli"]) == (20_000, 997, 20060)
    assert got[4]["n_runs"] == 0 and got[5]["collapsed"] == "a b"


# Mixing


def loop_targets(sizes):
    """Resharing round by round, as the task words it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, target = Fraction(3, 2) * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * left / total > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * left / total for s in open_}
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def check_mix(rows, got):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = Counter((d, len(WORD.findall(t or "")), sizes[s], round(float(loop_targets(sizes)[s]), 6)) for d, t, s in rows)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == want
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) == sum(sizes.values()) * 3 // 2


@pytest.mark.parametrize("name", TABLES)
def test_mixing(name, request):
    from storyhub.llm import mixing

    df = request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    got = mixing.mix_report(df).collect()
    check_mix(rows, got)
    same(got, mixing.mix_report(df.repartition(7)).collect())
    if name == "docs":
        source = {d: s for d, _, s in rows}
        taken, target = Counter(), {}
        for r in got:
            taken[source[r["doc_id"]]] += r["taken"]
            target[source[r["doc_id"]]] = r["target"]
        assert all(abs(taken[s] - target[s]) <= mixing.PARCEL for s in target)


def test_mixing_order_serves_by_weight(spark):
    from storyhub.llm import mixing

    rows = [(k, "w " * 50, f"s{k % 3}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = sorted(mixing.mix_documents(df, share=0.3).collect(), key=lambda r: r["finish"])
    assert len({(r["doc_id"], r["copy"]) for r in mix}) == len(mix)
    for head in (80, 120, len(mix)):
        taken = Counter()
        for r in mix[:head]:
            taken[r["source"]] += r["taken"]
        total = sum(taken.values())
        for s, weight in (("s0", 5), ("s1", 2), ("s2", 1)):
            assert abs(taken[s] / total - weight / 8) < 0.03


@pytest.mark.parametrize("text", [None, "", " \n"])
def test_mixing_without_words(spark, text):
    from storyhub.llm import mixing

    df = spark.createDataFrame([(1, text, "a"), (None, text, None)], "doc_id long, text string, source string")
    same([tuple(r) for r in mixing.mix_report(df).collect()], [(1, 0, 0, 0.0, 0), (None, 0, 0, 0.0, 0)])


def test_no_documents(none):  # noqa: F811
    from storyhub.llm import alignment, mixing, periodic

    assert mixing.mix_report(none).count() == 0 and mixing.mix_documents(none).count() == 0
    assert periodic.periodic_runs(none).count() == 0
    rows, counted = alignment.align_tokenizers(none, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    assert rows.count() == 0 and counted.count() == 0
