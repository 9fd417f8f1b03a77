"""Landed files, sinks, digest cases and stream = batch."""

import json
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from storyhub.operators import clustering, digest, quota, views
from storyhub.sources import feeds, sinks
from storyhub.sources import tables as tb
from storyhub.streaming import stream as st

RSS = """<rss xmlns:media="m"><channel><title>C</title>
<item><title>Tom & Jerry again</title><link>https://x.org/1</link><pubDate>Wed, 03 Jan 2024 10:00:00 GMT</pubDate><description>A &lt;b&gt;bold&lt;/b&gt; text</description><enclosure url="https://i/1.png" type="x/y"/></item>
<item><guid isPermaLink="true">https://x.org/2</guid><description>No title</description><media:content url="https://i/2"/></item>
<item><title>Bad link</title><link>mailto:x</link></item></channel></rss>"""
ATOM = """<feed><entry><title>From atom</title><link href="https://news.google.com/3"/><updated>2024-01-03T11:00:00Z</updated><content>Body</content></entry></feed>"""


def test_feed_files(spark, tmp_path):
    (tmp_path / "7.xml").write_text(RSS)
    (tmp_path / "8.xml").write_text(ATOM)
    names = F.concat(F.lit("Source "), "source_id")
    payloads = feeds.read_payloads(spark, str(tmp_path)).withColumn("source_name", names).withColumn("lane", F.lit("mainstream"))
    got = {r["url"]: r for r in feeds.news_items(payloads, "2024-01-04 00:00:00").collect()}
    assert set(got) == {"https://x.org/1", "https://x.org/2", "https://news.google.com/3"}
    assert got["https://x.org/1"]["title"] == "Tom & Jerry again" and got["https://x.org/1"]["og_image"] == "https://i/1.png"
    assert got["https://x.org/1"]["raw_summary"] == "A bold text" and got["https://x.org/1"]["source_id"] == "7"
    assert got["https://x.org/2"]["title"] == "Untitled Article" and got["https://x.org/2"]["og_image"] == "https://i/2"
    assert str(got["https://x.org/2"]["published_at"]) == "2024-01-04 00:00:00"
    assert got["https://news.google.com/3"]["via_google_news"] and str(got["https://news.google.com/3"]["published_at"]) == "2024-01-03 11:00:00"
    assert feeds.read_items_xml(spark, str(tmp_path / "7.xml")).count() == 3


def test_stream_of_feed_files_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.xml").write_text(RSS.replace("x.org", f"x{i}.org"))

    def items(payloads):
        tagged = payloads.withColumn("source_name", F.lit("S")).withColumn("lane", F.lit("mainstream"))
        return feeds.news_items(tagged, "2024-01-04 00:00:00", cap=None).select("url", "title", "published_at")

    stream = items(st.landed_payloads(spark, str(tmp_path / "in"), per_trigger=1))
    st.run_once(stream, str(tmp_path / "ck"), path=str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = items(feeds.read_payloads(spark, str(tmp_path / "in")))
    assert sorted(got.collect()) == sorted(batch.collect()) and got.count() == 6


def test_first_n_cap_and_guard_order(spark):
    body = "".join(f"<item><title>Story number {i}</title><link>{'x' if i == 0 else 'https://x/' + str(i)}</link></item>" for i in range(40))
    payloads = spark.createDataFrame([("a", "S", "mainstream", f"<rss><channel>{body}</channel></rss>")], "source_id string, source_name string, lane string, payload string")
    got = feeds.news_items(payloads, "2024-01-04")
    assert got.count() == 29  # 30 first items, one of them without an http link


def test_upsert_stream_over_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        rows = [{"url": f"u{k}", "ord": i * 10 + k, "v": i} for k in range(i, i + 3)]
        landed = tmp_path / "in" / f"{i}.json"
        landed.write_text("\n".join(map(json.dumps, rows)))
        os.utime(landed, (1704067200 + i, 1704067200 + i))  # files are read in landing order
    stream = st.landed_files(spark, str(tmp_path / "in"), "url string, ord long, v long", "json", per_trigger=1)
    st.run_once(stream, str(tmp_path / "ck"), sink=st.upsert_sink(str(tmp_path / "state"), compact_every=2))
    got = {r["url"]: r["v"] for r in st.read_state(spark, str(tmp_path / "state")).collect()}
    assert got == {"u0": 0, "u1": 1, "u2": 2, "u3": 2, "u4": 2}


def test_cluster_stream_equals_batch(spark, tmp_path):
    items = tb.items(spark, "/root/testdata/sf0.01").withColumn("source_name", F.lit(None).cast("string"))
    recent = items.filter(F.col("published_at") >= "2024-01-28").select("ord", "item_id", "title", "url", "raw_summary", "published_at", "source_name")
    recent.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = st.landed_files(spark, str(tmp_path / "in"), recent.schema, per_trigger=1)
    st.run_once(stream, str(tmp_path / "ck"), sink=st.cluster_sink(str(tmp_path / "state")))
    newest = recent.agg(F.max("published_at")).first()[0]
    kept = recent.filter(F.col("published_at") >= F.lit(newest) - F.expr("INTERVAL 48 HOURS"))
    want = clustering.cluster_items(kept).select("item_id", "cluster_id", "role")
    got = st.read_state(spark, str(tmp_path / "state"), key=None).select("item_id", "cluster_id", "role")
    # A hub whose items aged out between batches is gone from both.
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_carried_cluster_stream_keeps_ids_over_batches(spark, tmp_path):
    items = tb.items(spark, "/root/testdata/sf0.01").withColumn("source_name", F.col("source_id").cast("string"))
    recent = items.filter(F.col("published_at") >= "2024-01-30").select("ord", "item_id", "title", "url", "raw_summary", "published_at", "source_name")
    for k in range(3):
        recent.filter(F.col("item_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = st.landed_files(spark, str(tmp_path / "in"), recent.schema, per_trigger=1)
    st.run_once(stream, str(tmp_path / "ck"), sink=st.carry_sink(str(tmp_path / "state")))
    states = [
        {r["item_id"]: (r["cluster_id"], r["role"]) for r in st.read_state(spark, str(tmp_path / "state"), key=None, before=k).collect()} for k in (1, 2, 3)
    ]
    assert len(states[0]) < len(states[1]) < len(states[2])
    for early, late in zip(states, states[1:]):
        assert all(late[i] == found for i, found in early.items())
    placed = recent.withColumn("ord", F.col("item_id") % 3 * F.lit(10**18) + F.col("ord"))
    firsts = placed.groupBy("url").agg(F.min("ord").alias("ord")).select("ord")
    want = clustering.cluster_items(placed.join(firsts, "ord", "left_semi"))
    assert states[2] == {r["item_id"]: (r["cluster_id"], r["role"]) for r in want.collect()}


def test_first_match_waits_for_its_band(spark, tmp_path):
    """A hot title gives one row an aggregator item; a direct item that lands later but comes
    first in load order wins; items whose band is still open are not answered."""
    title = "the same long headline"
    late = [("agg", 900, title, 600, 1)]
    batches = [
        [("agg", i, title, 0, 100 + i) for i in range(40)] + [("direct", 500, title, 10, 5), ("direct", 501, title, 10, 4)],
        [("direct", 502, title, 30, 2), ("direct", 503, title, 61, 0), ("agg", 800, "another headline", 30, 7)],
        late,
    ]
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(batches):
        landed = tmp_path / "in" / f"{k}.json"
        landed.write_text("\n".join(json.dumps(dict(kind=a, item_id=i, title=t, minute=m, ord=o)) for a, i, t, m, o in rows))
        os.utime(landed, (1704067200 + k, 1704067200 + k))
    stream = st.landed_files(spark, str(tmp_path / "in"), "kind string, item_id long, title string, minute long, ord long", "json", per_trigger=1)
    stream = stream.withColumn("published_at", F.timestamp_seconds(F.lit(1704067200) + F.col("minute") * 60))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = st.first_match_stream(stream.filter("kind = 'direct'"), stream.filter("kind = 'agg'"), band_hours=1)
        st.run_once(out, str(tmp_path / "ck"), path=str(tmp_path / "out"))
    finally:
        spark.conf.set(provider, before)
    got = sorted((r["agg_item"], r["direct_item"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(i, 502) for i in range(40)]


def test_first_in_band_equals_loop():
    rng = random.Random(3)
    direct = sorted((rng.randrange(300), rng.randrange(50), k) for k in range(80))
    asked = sorted(rng.randrange(-20, 340) for _ in range(200))
    want = [min(((o, i) for t, o, i in direct if abs(t - at) <= 9), default=(0, None))[1] for at in asked]
    assert st.first_in_band(asked, direct, 9) == want and None in want


def test_replay_reads_folders_of_files(spark, tmp_path):
    """Large tables are folders: each stream query sees all rows, as for one file."""
    from storyhub.plans import load_all

    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("T1_stream_ingest", "T4_tumbling_counts", "T5_stream_upsert"):
        got, want = (load_all()[name].run(spark, p) for p in (str(tmp_path), "/root/testdata/sf0.001"))
        assert got.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_scan_partitions_are_asked_for(spark):
    plain = tb.table(spark, "/root/testdata/sf0.001", "documents")
    spark.conf.set(tb.SCAN_PARTITIONS, "3")
    try:
        dealt = tb.table(spark, "/root/testdata/sf0.001", "documents")
        assert dealt.rdd.getNumPartitions() == 3 and dealt.exceptAll(plain).count() == 0
    finally:
        spark.conf.unset(tb.SCAN_PARTITIONS)
    assert tb.table(spark, "/root/testdata/sf0.001", "documents").rdd.getNumPartitions() == plain.rdd.getNumPartitions()


def test_cache_files_log_and_truncate(spark, tmp_path):
    (tmp_path / "hubs.json").write_text(json.dumps([{"id": "a", "n": 1}, {"id": "b", "n": 2}]))
    assert sinks.read_json(spark, str(tmp_path / "hubs.json")).count() == 2
    row = spark.createDataFrame([("a", 1)], "id string, n int")
    for _ in range(2):
        sinks.append_log(row, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    sinks.truncate(spark, str(tmp_path / "log"))
    emptied = spark.read.parquet(str(tmp_path / "log"))
    assert emptied.count() == 0 and emptied.columns == ["id", "n"]


def _digest_rows(spark, stories):
    """stories: (hub, title, hours old, [(url, source, hours old)]) at the edition of 2024-01-10 02:00."""
    end = 1704852000
    hubs = [(h, t, end - int(age * 3600), len(items)) for h, t, age, items in stories]
    items = [(h, u, s, "mainstream", end - int(a * 3600), i) for h, _, _, its in stories for i, (u, s, a) in enumerate(its)]
    hub_df = spark.createDataFrame(hubs, "hub_id string, title string, at long, item_count long").withColumn("last_updated_at", F.timestamp_seconds("at"))
    item_df = spark.createDataFrame(items, "cluster_id string, url string, source_name string, lane string, at long, ord long").withColumn("published_at", F.timestamp_seconds("at"))
    return hub_df, item_df


def test_digest_skips_repeats_and_stale(spark):
    stories = [
        ("h1", "River bridge opens after long delay", 2, [("u1", "A", 2), ("u2", "B", 3), ("u3", "C", 3)]),
        ("h2", "River bridge opens after long delay - Post", 2, [("u4", "A", 2), ("u5", "B", 2)]),
        ("h3", "River bridge finally opens after delay", 2, [("u6", "A", 2), ("u7", "B", 2)]),
        ("h4", "Quite another thing", 2, [("u1", "A", 2), ("u8", "B", 2)]),
        ("h5", "Market falls sharply today", 4, [("u9", "A", 4), ("u10", "B", 4)]),
        ("h6", "Old but updated news item", 1, [("u11", "A", 72), ("u12", "B", 1)]),
        ("h7", "Third good story arrives", 5, [("u13", "A", 5), ("u14", "B", 6)]),
    ]
    hubs, items = _digest_rows(spark, stories)
    got = digest.select_digest(hubs, items).filter("edition = '2024-01-10'").orderBy("slot").collect()
    assert [r["hub_id"] for r in got] == ["h1", "h5", "h7"] and {r["stage"] for r in got} == {"primary"}


def test_digest_falls_back_to_single_source(spark):
    stories = [("h1", "Only one outlet has this", 3, [("u1", "A", 3)]), ("h2", "Two outlets report that", 30, [("u2", "A", 30), ("u3", "B", 30)])]
    hubs, items = _digest_rows(spark, stories)
    got = digest.select_digest(hubs, items).filter("edition = '2024-01-10'").orderBy("slot").collect()
    assert [(r["hub_id"], r["stage"]) for r in got] == [("h2", "single"), ("h1", "single")]


def test_waterfall_splits_25(spark):
    due = spark.createDataFrame([(f"r{i:02d}@x.org", None) for i in range(25)], "email string, last_sent_at timestamp")
    sent = spark.createDataFrame([("a", 5)], "provider string, sent long")
    got = digest.waterfall(due, sent, {"a": 15, "b": 10}, ["a", "b"])
    counts = {r["provider"]: r["n"] for r in got.groupBy("provider").agg(F.count("*").alias("n")).collect()}
    assert counts == {"a": 10, "b": 10, "deferred": 5}
    assert digest.provider_order(["gmail", "brevo", "resend"]) == ["resend", "gmail", "brevo"]
    assert digest.provider_order(["gmail"]) == ["resend", "gmail"]


def test_background_is_refused_above_the_buffer(spark):
    limits = quota.model_limits(spark).filter("model = 'groq:openai/gpt-oss-20b'")
    usage = spark.createDataFrame([("groq:openai/gpt-oss-20b", 900, 0, 0.0, 0, 0, None)], "model string, requests_used long, tokens_used long, units_used double, minute_requests long, minute_tokens long, cooling_until timestamp")
    asked = spark.createDataFrame([("groq:openai/gpt-oss-20b", 100, 110, p, False) for p in ("background", "interactive")], "model string, input_tokens long, output_tokens long, priority string, sensitive boolean")
    got = {r["priority"]: r["reason"] for r in quota.admission(asked, usage, limits, "2024-01-01 20:00:00").collect()}
    assert got == {"background": "reserved_for_interactive_emergency_buffer_rpd", "interactive": None}


def test_clustering_cases(spark):
    boiler = "Get the latest stories from every district in one place, day and night"
    rows = [(i, t, f"https://t/{i}", boiler, "Telugu Daily") for i, t in enumerate(
        ["వర్షాలు కురిసే అవకాశం", "సినిమా విడుదల తేదీ", "బంగారం ధర తగ్గింది", "క్రికెట్ జట్టు ప్రకటన", "రైలు ఆలస్యం కారణం"])]
    rows += [
        (10, "Supreme Court stays demolition drive in coastal town", "https://a/1", "The bench asked the state to reply within two weeks", "Alpha"),
        (11, "Supreme Court stays coastal town demolition drive", "https://b/1", "Bench asks the state for a reply in two weeks", "Beta"),
        (12, "Supreme Court stays demolition drive in coastal town", "https://c/1", "The bench asked the state to reply within two weeks, the court record shows", "Gamma"),
        (13, "Spinach prices double in winter market", "https://d/1", "Traders blame fog", "Delta"),
    ]
    df = spark.createDataFrame(rows, "ord long, title string, url string, raw_summary string, source_name string").withColumn("og_image", F.when(F.col("ord") == 12, "https://i/12"))
    out = {r["ord"]: r for r in clustering.cluster_items(df).collect()}
    assert len({out[i]["cluster_id"] for i in range(5)}) == 5
    assert out[10]["cluster_id"] == out[11]["cluster_id"] == out[12]["cluster_id"] != out[13]["cluster_id"]
    # The reworded title has the same words, so it repeats the first one too.
    assert out[12]["role"] == "duplicate" and out[12]["merged_into"] == 10
    lead = [r for r in clustering.merge_duplicates(clustering.cluster_items(df)).collect() if r["ord"] == 10][0]
    assert lead["og_image"] == "https://i/12" and lead["raw_summary"].endswith("record shows")


def test_rolling_usage_across_slices(spark):
    calls = [(i, 1704067200 + i * 17, 5) for i in range(600)]
    df = spark.createDataFrame(calls, "event_id long, s long, tokens long").withColumn("ts", F.timestamp_seconds("s")).withColumn("model", F.lit("m"))
    got = {r["event_id"]: (r["minute_requests"], r["minute_tokens"]) for r in quota.rolling_usage(df, slice_seconds=300).collect()}
    for i, s, _ in calls:
        n = sum(1 for _, x, _ in calls[max(0, i - 5): i + 1] if s - 60 <= x <= s)
        assert got[i] == (n, 5 * n)


def test_entry_runs_from_another_folder(tmp_path):
    repo = Path(__file__).resolve().parents[1]
    code = (
        f"import sys; sys.path.insert(0, {str(repo)!r}); import __spark_entry__ as e; from pyspark.sql import SparkSession; "
        "s = SparkSession.builder.master('local[4]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '4').getOrCreate(); "
        "print('rows', e.entry(s).count(), e.queries()['K3_digest_selection'](s, '/root/testdata/sf0.001').count())"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "rows " in done.stdout, done.stderr[-2000:]


def test_run_folder_leaves_nothing(spark):
    from storyhub.plans import load_all
    from storyhub.session import run_folder

    with run_folder(spark) as folder:
        assert load_all()["K2_aggregator_unique"].run(spark, "/root/testdata/sf0.001").count() > 0
        assert list(Path(folder.removeprefix("file:")).iterdir())
    assert not Path(folder.removeprefix("file:")).exists()


def test_registry_is_complete():
    import __spark_entry__ as entry

    from storyhub.plans import load_all

    names, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(names)
    assert set(load_all()) <= set(twins)


def test_nested_items_are_ordered_and_paged(spark):
    items = tb.story_items(spark, "/root/testdata/sf0.001")
    items = items.unionByName(items.filter("item_id < 40").withColumn("cluster_id", F.lit("hot")).withColumn("ord", F.col("ord") + 1))
    found = {}
    for r in sorted(views.nest_items(items, 3).collect(), key=lambda r: (r["cluster_id"], r["page"])):
        ords = [i["ord"] for i in r["items"]]
        assert ords == sorted(ords) and 1 <= len(ords) <= 3
        assert r["page"] * 3 == len(found.setdefault(r["cluster_id"], []))
        found[r["cluster_id"]] += ords
    want = {}
    for r in items.select("cluster_id", "ord").orderBy("ord").collect():
        want.setdefault(r["cluster_id"], []).append(r["ord"])
    assert found == want


def test_cap_takes_the_first_payloads_of_a_source(spark):
    from storyhub.sources import feeds

    payload = "<rss><channel>{}</channel></rss>"
    item = "<item><title>story number {0}</title><link>https://x.org/{0}</link></item>"
    rows = [(k, 1, "s", "mainstream", payload.format(item.format(2 * k) + item.format(2 * k + 1))) for k in range(9)]
    df = spark.createDataFrame(rows, "payload_pos long, source_id int, source_name string, lane string, payload string").repartition(5)
    got = {r["url"] for r in feeds.news_items(df, "2024-01-10 00:00:00", cap=5).collect()}
    assert got == {f"https://x.org/{k}" for k in range(5)}
