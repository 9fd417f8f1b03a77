"""Distributed forms against single loops, at every size tier."""

import random

import pytest
from pyspark.sql import functions as F

import loops
from storyhub.functions import text
from storyhub.operators import clustering, components, dedup, features, similarity
from storyhub.sources import tables as tb

VOCAB = [f"w{c}{d}" for c in "abcdefghij" for d in "xyz"] + ["it", "of"]


def random_items(seed, n, near=0.5):
    rng = random.Random(seed)
    rows, titles = [], []
    for i in range(n):
        if titles and rng.random() < near:
            ws = list(rng.choice(titles))
            for _ in range(rng.choice([0, 0, 1, 2])):
                ws[rng.randrange(len(ws))] = rng.choice(VOCAB)
        else:
            ws = [rng.choice(VOCAB) for _ in range(rng.choice([1, 4, 8, 9, 12, 16]))]
        titles.append(ws)
        at = None if rng.random() < 0.05 else 1704067200 + rng.randrange(0, 12 * 3600, 300)
        rows.append(
            dict(ord=2**60 + i * 7 + 3, item_id=i, title=" ".join(ws), norm=" ".join(ws), at=at, publisher=rng.choice(["", "p1", "p2", "p3 "]),
                 url=rng.choice([None, f"https://u/{rng.randrange(n)}"]))
        )
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(
        [(r["ord"], r["item_id"], r["title"], r["url"], r["at"], r["publisher"]) for r in rows],
        "ord long, item_id long, title string, url string, at long, publisher string",
    )
    return df.withColumn("published_at", F.timestamp_seconds("at")).drop("at")


def assigned(df):
    return {r["ord"]: (r["hub_ord"], r["role"], r["merged_into"]) for r in df.collect()}


@pytest.mark.parametrize("method", ["grouped", "components", "rounds"])
@pytest.mark.parametrize("seed", [1, 2])
def test_clustering_equals_loop(spark, seed, method):
    rows = random_items(seed, 70)
    token_texts = [r["norm"] for r in rows]
    for r, v in zip(rows, features.hash_vectors(token_texts)):
        r["embedding"] = [float(x) for x in v]
    rows[5]["embedding"] = [0.0] * 384
    df = frame(spark, rows).join(
        spark.createDataFrame([(r["ord"], r["embedding"]) for r in rows], "ord long, embedding array<double>"), "ord"
    )
    got = assigned(clustering.cluster_vectors(df, method=method))
    assert got == loops.cluster(rows)


def test_clustering_of_copies_without_long_words(spark):
    rows = [dict(ord=i, item_id=i, title="ab cd", norm="ab cd", at=1704067200, publisher="p", url=f"u{i}", embedding=[1.0, 0.0]) for i in range(9)]
    rows += [dict(ord=20 + i, item_id=20 + i, title="ab cd", norm="ab cd", at=1704067200, publisher=f"q{i}", url=f"v{i}", embedding=[1.0, 0.0]) for i in range(4)]
    df = frame(spark, rows).join(spark.createDataFrame([(r["ord"], r["embedding"]) for r in rows], "ord long, embedding array<double>"), "ord")
    want = loops.cluster(rows)
    for method in clustering.METHODS:
        assert assigned(clustering.cluster_vectors(df, method=method)) == want


def test_members_reach_threshold_and_runs_are_separate(spark):
    items = tb.story_items(spark, "/root/testdata/sf0.001").drop("cluster_id").withColumn("source_name", F.lit(None).cast("string"))
    items = items.withColumn("run", F.floor(F.unix_seconds("published_at") / 172800).cast("string")).cache()
    out = clustering.cluster_items(items, scope="run").cache()
    assert out.count() == items.count()
    assert out.filter("cluster_id IS NULL").count() == 0
    assert out.groupBy("hub_ord").agg(F.countDistinct("run").alias("n")).filter("n > 1").count() == 0
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        again = clustering.cluster_items(items, scope="run")
        assert again.select("item_id", "cluster_id", "role").exceptAll(out.select("item_id", "cluster_id", "role")).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("method", ["grouped", "rounds"])
@pytest.mark.parametrize("seed", [3, 4])
def test_aggregator_dedup_equals_loop(spark, seed, method):
    rows = random_items(seed, 120)
    agg, direct = rows[::2], rows[1::2]
    unique, log = dedup.dedup_aggregator(frame(spark, agg), frame(spark, direct), method=method)
    # The loop appends aggregator rows after all direct rows; give it that order.
    base = max(r["ord"] for r in rows) + 1
    moved = [dict(r, ord=r["ord"] + base) for r in agg]
    want = loops.dedup(moved, direct)
    back = {o - base: (h - base if h >= base else h) for o, h in want.items()}
    got = {r["ord"]: r["matched_ord"] for r in log.collect()}
    assert got == back
    assert {r["ord"] for r in unique.collect()} == {r["ord"] for r in agg} - set(back)


@pytest.mark.parametrize("method", ["grouped", "rounds"])
def test_hub_duplicates_equal_loop(spark, method):
    rows = random_items(9, 80)
    df = frame(spark, rows).withColumn("cluster_id", (F.col("item_id") % 3).cast("string"))
    got = {r["ord"]: r["matched_ord"] for r in dedup.hub_duplicates(df, method=method).collect()}
    want = {}
    for k in range(3):
        want.update(loops.dedup([r for r in rows if r["item_id"] % 3 == k], [], band=None, min_title=1))
    assert got == want


def test_near_title_keys_are_complete(spark):
    rows = random_items(11, 150, near=0.8)
    df = dedup.with_title_key(frame(spark, rows))
    got = {(r["key_a"], r["key_b"]) for r in dedup.near_title_keys(df.select("title_key", "words")).collect()}
    sets = {"w:" + " ".join(sorted(loops.words_of(r["norm"]))): loops.words_of(r["norm"]) for r in rows if loops.words_of(r["norm"])}
    want = {(a, b) for a in sets for b in sets if a != b and loops.overlap(sets[a], sets[b]) >= 0.85}
    assert got == want and want


def test_hot_title_needs_no_pairs(spark):
    # A third of the rows share one title; the match must still find the first row in the band.
    rows = [dict(ord=i, item_id=i, title="same long headline again", norm="same long headline again", at=1704067200 + i * 60, publisher="", url=None) for i in range(300)]
    q = frame(spark, rows[:150]).withColumn("ord", F.col("ord") + 10000)
    got = {r["ord"]: r["matched_ord"] for r in dedup.match_duplicates(q, frame(spark, rows)).collect()}
    for r in rows[:150]:
        assert got[r["ord"] + 10000] == max(0, r["ord"] - 120)


def test_pairs_by_blocks_and_components(spark):
    rng = random.Random(5)
    vecs = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(90)]
    df = spark.createDataFrame([(i, vecs[i]) for i in range(90)], "id long, embedding array<double>")
    got = {(r["a"], r["b"]) for r in similarity.similar_pairs(df, 0.8, block_rows=20).collect()}
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if loops.cosine(vecs[i], vecs[j]) >= 0.8}
    assert got == want
    parent = list(range(90))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in want:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    edges = spark.createDataFrame(list(want), "a long, b long")
    labels = {r["node"]: r["component"] for r in components.connected_components(edges, df.select("id")).collect()}
    assert labels == {i: root(i) for i in range(90)}


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(1, 40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    edges = spark.createDataFrame(path + star, "a long, b long")
    labels = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert {labels[i] for i in range(1, 41)} == {1} and {labels[100 + i] for i in range(60)} == {100}


def test_lines_and_chunks_equal_loops(spark):
    docs = tb.table(spark, "/root/testdata/sf0.001", "documents").select(
        "doc_id", "text", text.prompt_lines("text").alias("lines")
    ).withColumn("kept", text.distinct_lines("lines")).withColumn("chunks", text.sentence_chunks("text", max_chunks=4))
    for r in docs.collect():
        assert r["kept"] == loops.keep_lines(r["lines"])
        assert r["chunks"] == loops.chunks(r["text"])


def test_full_hub_refuses_items_far_from_its_lead(spark):
    import math

    rows = []
    for i in range(9):
        a = math.radians(30 * i)
        rows.append(dict(ord=i, item_id=i, title=f"headline number{i}", norm=f"headline number{i}", at=1704067200, publisher=f"p{i}", url=f"u{i}",
                         embedding=[math.cos(a), math.sin(a)]))
    want = loops.cluster(rows)
    assert len({h for h, _, _ in want.values()}) > 1
    df = frame(spark, rows).join(spark.createDataFrame([(r["ord"], r["embedding"]) for r in rows], "ord long, embedding array<double>"), "ord")
    for method in clustering.METHODS:
        assert assigned(clustering.cluster_vectors(df, method=method)) == want


def test_no_grouped_pass_above_the_bound(spark, monkeypatch):
    """Components above the bound are worked slice by slice, others in one pass, with
    the result of the loop; no pass holds more rows than the bound."""
    monkeypatch.setattr(clustering, "GROUP_ROWS", 16)
    rows = random_items(3, 60)
    for r, v in zip(rows, features.hash_vectors([r["norm"] for r in rows])):
        r["embedding"] = [float(x) for x in v]
    gathered = []
    plain = clustering._told

    def watched(part, kind, **given):
        if kind == "item":
            gathered.append(part.groupBy("component").count().agg(F.max("count").alias("n")).first()["n"])
        return plain(part, kind, **given)

    monkeypatch.setattr(clustering, "_told", watched)
    df = frame(spark, rows).join(
        spark.createDataFrame([(r["ord"], r["embedding"]) for r in rows], "ord long, embedding array<double>"), "ord"
    )
    assert assigned(clustering.cluster_vectors(df)) == loops.cluster(rows)
    assert gathered and all(n is None or n <= 16 for n in gathered)
    with pytest.raises(ValueError):
        clustering.cluster_vectors(df, method="grouped")


def test_pass_is_told_few_hubs_of_an_item(spark, monkeypatch):
    """However many hubs lie near an item, a pass is told a fixed number of them, and
    gives the result of the loop; passes that would need more end early."""
    rng = random.Random(10)
    monkeypatch.setattr(clustering, "GROUP_ROWS", 16)
    monkeypatch.setattr(clustering, "NEAR_HUBS", 2, raising=False)
    rows = random_items(9, 48, near=0.3)
    for r in rows:
        # Vectors around one direction: with few publishers most items found hubs that lie near all others.
        r["embedding"] = [1.0] + [rng.gauss(0, 0.41) for _ in range(10)]
        r["publisher"] = rng.choice(["p1", "p2", "p3"])
    told, passes = [], []
    plain = clustering._told

    def watched(part, kind, **given):
        if kind == "near":
            told.append(part.groupBy("component", "ord").count().agg(F.max("count")).first()[0] or 0)
        if kind == "item":
            passes.append(part.count())
        return plain(part, kind, **given)

    monkeypatch.setattr(clustering, "_told", watched)
    assert assigned(clustering.cluster_vectors(with_vectors(spark, rows))) == loops.cluster(rows)
    assert max(told) == 2
    assert sum(passes) > len(rows)


def test_aggregator_queries_gather_no_scope(spark, monkeypatch):
    """The default and the registered queries never take the grouped pass, which
    refuses scopes above its bound."""
    from storyhub.plans import load_all

    def refuse(*args):
        raise AssertionError("grouped pass")

    direct, agg = random_items(7, 12), random_items(8, 40)
    with monkeypatch.context() as m:
        m.setattr(dedup, "_settle_grouped", refuse)
        dedup.dedup_aggregator(frame(spark, agg), frame(spark, direct))
        for name in ("K2_aggregator_unique", "K2_hit_log", "A14_dedup_report"):
            load_all()[name].run(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(dedup, "GROUP_ROWS", 3)
    with pytest.raises(ValueError):
        dedup.dedup_aggregator(frame(spark, agg), frame(spark, direct), method="grouped")


def with_vectors(spark, rows):
    df = frame(spark, rows)
    return df.join(spark.createDataFrame([(r["ord"], r["embedding"]) for r in rows], "ord long, embedding array<double>"), "ord")


@pytest.mark.parametrize("late", [False, True])
def test_carried_hubs_equal_loop(spark, monkeypatch, late):
    """Items clustered against the hubs of an earlier load: as one load in that order. The
    earlier items may have higher numbers, as load order is newest first."""
    monkeypatch.setattr(clustering, "GROUP_ROWS", 16)
    rows = random_items(6, 60)
    for r, v in zip(rows, features.hash_vectors([r["norm"] for r in rows])):
        r["embedding"] = [float(x) for x in v]
    old, new = (rows[30:], rows[:30]) if late else (rows[:30], rows[30:])
    shift = 2**61 if late else 0
    want = loops.cluster([dict(r, ord=r["ord"] - shift) for r in old] + new)
    back = lambda o: o + shift if o is not None and o < 0 else o
    first = loops.cluster(old)
    carried = with_vectors(spark, [r for r in old if first[r["ord"]][1] != "duplicate"]).join(
        spark.createDataFrame([(o, h) for o, (h, _, _) in first.items()], "ord long, hub long"), "ord"
    )
    got = assigned(clustering.cluster_vectors(with_vectors(spark, new), carried=carried))
    assert got == {o: (back(h), role, back(m)) for o, (h, role, m) in want.items() if o in {r["ord"] for r in new}}
    assert any(h in {r["ord"] for r in old} for h, _, _ in got.values())


def test_carried_hubs_keep_their_ids(spark):
    base = dict(title="river floods the old town again", raw_summary="", source_name="a", published_at=None)
    schema = "ord long, url string, title string, raw_summary string, source_name string"
    row = lambda o, url, source: (o, url, base["title"], "", source)
    first = clustering.cluster_items(spark.createDataFrame([row(5, "u5", "a")], schema))
    second = clustering.cluster_items(spark.createDataFrame([row(1, "u1", "b"), (2, "u5", "quite another matter of tax law", "", "c")], schema), carried=first)
    ids = {r["ord"]: (r["cluster_id"], r["hub_ord"], r["role"], r["merged_into"]) for r in second.collect()}
    kept = first.first()["cluster_id"]
    assert ids[1] == (kept, 5, "duplicate", 5)
    # The url of a carried lead leads a new hub here: it must get an id of its own.
    assert ids[2][2] == "lead" and ids[2][0] != kept
    with pytest.raises(ValueError):
        clustering.cluster_items(spark.createDataFrame([row(1, "u1", "b")], schema), carried=first, method="grouped")


def test_near_long_titles(spark):
    """Sets on both sides of the size at which the kind of mark changes, and very long ones."""
    rng = random.Random(12)
    sets = []
    for size in [30, 40, 41, 46, 47, 48, 49, 55, 60, 300, 700]:
        first = rng.sample(range(5000), size)
        sets.append(first)
        for change in (1, size // 14, size // 12, size // 11, size // 5):
            sets += [first[change:] + rng.sample(range(5000, 9000), change), first[change:], first + rng.sample(range(5000, 9000), change)]
    words = [frozenset(f"word{x}" for x in s) for s in sets]
    rows = list({("w:" + " ".join(sorted(w)), tuple(sorted(w))) for w in words})
    df = spark.createDataFrame([(k, list(w)) for k, w in rows], "title_key string, words array<string>")
    got = {(r["key_a"], r["key_b"]): r["similarity"] for r in dedup.near_title_keys(df).collect()}
    want = {(a, b): loops.overlap(set(v), set(w)) for a, v in rows for b, w in rows if a != b and loops.overlap(set(v), set(w)) >= 0.85}
    assert got == want and len({len(k[0].split()) for k in got}) > 10


@pytest.mark.parametrize("seconds,width", [(60, 600), (60, 45), (7, 1000)])
def test_block_usage_equals_loop(spark, seconds, width):
    """Counters that begin anew; one model holds a third of the calls, with gaps over many slices."""
    from storyhub.operators import quota

    rng = random.Random(seconds)
    rows, n = [], 0
    for model, calls in (("hot", 300), ("b", 90), ("c", 60), ("lone", 1)):
        at = 1704067200
        for _ in range(calls):
            at += rng.choice([0, 1, 3, 20, seconds - 1, seconds, seconds + 1, 5000])
            rows.append((n, model, at, rng.randrange(100)))
            n += 1
    want = {}
    for model in {r[1] for r in rows}:
        start, sums = None, {}
        for _, _, at, tokens in [r for r in rows if r[1] == model]:
            if start is None or at - start >= seconds:
                start, requests, used = at, 0, 0
            requests, used = requests + 1, used + tokens
            sums[at] = (start, requests, used)  # calls at one time count together
        want |= {i: sums[at] for i, m, at, _ in rows if m == model}
    df = spark.createDataFrame(rows, "event_id long, model string, at long, tokens long").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    df = df.unionByName(spark.createDataFrame([(-1, "hot", 5, None)], "event_id long, model string, tokens long, ts timestamp"))
    got = {r["event_id"]: (int(r["block_start"].timestamp()), r["minute_requests"], r["minute_tokens"]) for r in quota.block_usage(df, seconds, width).collect()}
    assert got == want


def test_shared_urls_are_whole_urls(spark):
    from storyhub.operators import digest

    c = spark.createDataFrame([("e", h, "2024-01-10 02:00:00") for h in "abc"], "edition string, hub_id string, as_of string").withColumn("as_of", F.to_timestamp("as_of"))
    urls = [("a", "https://s/1"), ("b", "https://s/1"), ("b", "https://s/2"), ("c", "https://s/3")]
    i = spark.createDataFrame(urls, "cluster_id string, url string").withColumn("published_at", F.to_timestamp(F.lit("2024-01-10 01:00:00")))
    assert {r["hub_id"]: r["overlaps"] for r in digest.shared_urls(c, i).collect()} == {"a": ["b"], "b": ["a"]}


@pytest.mark.parametrize("rows", [5, 40, 1000])
def test_similar_classes_equal_loop(spark, monkeypatch, rows):
    """Links and classes without pairs, over cells of one and of many blocks, with copies and zero vectors."""
    import numpy as np

    monkeypatch.setattr(similarity.cell_links, "__defaults__", (rows,))
    rng = np.random.default_rng(rows)
    vectors = rng.normal(size=(60, 6)).tolist()
    vectors += vectors[:20] + [[0.0] * 6] * 2
    df = spark.createDataFrame([(k, "ab"[k % 2], v) for k, v in enumerate(vectors)], "id long, scope string, embedding array<double>")
    got = {r["id"]: (r["links"], r["class"]) for r in similarity.similar_classes(df, 0.75, "scope").collect()}
    units = similarity.unit_rows(vectors)
    near = {a: {b for b in range(82) if b != a and a % 2 == b % 2 and units[a] @ units[b] >= 0.75} for a in range(82)}
    want = {}
    for a in near:
        seen, open_ = {a}, [a]
        while open_:
            fresh = near[open_.pop()] - seen
            seen |= fresh
            open_ += fresh
        want[a] = (len(near[a]), min(seen))
    assert got == want and any(n > 2 for n, _ in want.values())


@pytest.mark.parametrize("same", [True, False])
def test_spanning_links_keep_components(same):
    import numpy as np

    linked = np.random.default_rng(4).random((50, 50 if same else 30)) < 0.03
    if same:
        linked |= linked.T
        np.fill_diagonal(linked, False)
    pairs = [(i, j if same else j + 50) for i, j in zip(*(x.tolist() for x in np.nonzero(linked)))]
    found = similarity.spanning_links(linked, same)

    def classes(edges):
        label = list(range(80))
        for _ in label:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert classes(found) == classes(pairs) and 0 < len(found) < 80


def test_query_vectors_are_every_50th(spark):
    from storyhub.plans import load_all

    got = load_all()["J5_match_hubs_batch"].run(spark, "/root/testdata/sf0.001").collect()
    assert got and all(r["query_id"] % 50 == 0 for r in got)
