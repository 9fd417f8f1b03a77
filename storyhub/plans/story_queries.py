"""Joins, rollups, windows, top lists, filters and set queries over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyhub.functions import lexicon as lx
from storyhub.functions import times, topics
from storyhub.operators import ranking, rollups, views
from storyhub.plans import twins as t
from storyhub.plans.catalog import query, view
from storyhub.sources import tables as tb

AS_OF = tb.AS_OF
NOW = str(tb.AS_OF_SECONDS)


def joined(spark, path):
    return views.join_sources(tb.story_items(spark, path), tb.sources(spark, path))


def seconds(df, *names):
    for n in names:
        df = df.withColumn(n, F.unix_seconds(n))
    return df


def page(spark, path):
    return views.front_page(tb.hubs(spark, path), joined(spark, path), AS_OF)


view(
    "v_cards",
    f"""SELECT cluster_id AS hub_id, count(*) AS item_count,
      count(*) FILTER (lane IN ('mainstream', 'aggregator')) AS mainstream_count,
      count(*) FILTER (lane = 'grassroots') AS grassroots_count,
      count(*) FILTER (lane = 'discourse') AS discourse_count,
      min({t.effective_time('pub_s', 'fetch_s', NOW)}) AS first_s, max({t.effective_time('pub_s', 'fetch_s', NOW)}) AS last_s,
      arg_min(og_image, ord) FILTER (og_image IS NOT NULL) AS og_image,
      coalesce(arg_min(source_name, ord) FILTER (og_image IS NOT NULL), arg_min(source_name, ord)) AS first_source_name,
      coalesce(arg_min(region, ord) FILTER (region <> 'national'), arg_min_null(region, ord)) AS source_region,
      coalesce(arg_min(language, ord) FILTER (og_image IS NOT NULL), arg_min(language, ord)) AS language,
      greatest(count(DISTINCT source_name), count(*), 1) AS source_count, false AS via_google_news
    FROM v_joined GROUP BY 1""",
)
view(
    "v_langs",
    """SELECT cluster_id AS hub_id, string_agg(language, ',' ORDER BY o) AS languages
    FROM (SELECT cluster_id, language, min(ord) AS o FROM v_joined GROUP BY 1, 2) GROUP BY 1""",
)
view(
    "v_page",
    f"""SELECT h.title, h.ai_summary, c.*, l.languages, {t.topic('h.title')} AS topic, {t.region('h.title', 'c.source_region')} AS region
    FROM v_hubs h JOIN v_cards c USING (hub_id) JOIN v_langs l USING (hub_id)""",
)


@query(
    "flagship_latest_stories",
    """SELECT p.hub_id, p.title, p.item_count, p.mainstream_count, p.grassroots_count, p.discourse_count, p.source_count, p.last_s AS last_updated_at
    FROM v_page p ORDER BY p.last_s DESC, p.hub_id LIMIT 200""",
)
def flagship(spark, path):
    cols = ["hub_id", "title", "item_count", "mainstream_count", "grassroots_count", "discourse_count", "source_count", "last_updated_at"]
    stories = rollups.hub_cards(joined(spark, path), AS_OF).withColumnRenamed("cluster_id", "hub_id")
    return seconds(ranking.top_n(stories, [F.col("last_updated_at").desc(), F.col("hub_id")], 200).select(*cols), "last_updated_at")


# -- joins -------------------------------------------------------------------


@query("J1_item_source", "SELECT item_id, source_id, source_name, lane, type, region FROM v_joined")
def j1(spark, path):
    return joined(spark, path).select("item_id", "source_id", "source_name", "lane", "type", "region")


@query(
    "J2_hub_items",
    "SELECT h.hub_id, h.title AS hub_title, i.item_id, i.title AS item_title, i.ord FROM v_hubs h JOIN v_story i ON h.hub_id = i.cluster_id",
)
def j2(spark, path):
    i = tb.story_items(spark, path).select("cluster_id", "item_id", "title", "ord")
    out = views.attach_items(tb.hubs(spark, path).select("hub_id", "title"), i)
    return out.withColumnRenamed("title", "hub_title")


@query(
    "J2_nested_items",
    """SELECT cluster_id AS hub_id, n // 4 AS page, string_agg(item_id, ',' ORDER BY ord) AS items FROM
    (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ord) - 1 AS n FROM v_story) GROUP BY 1, 2""",
)
def j2n(spark, path):
    out = views.nest_items(tb.story_items(spark, path), 4)
    ids = F.array_join(F.transform("items", lambda x: x["item_id"].cast("string")), ",")
    return out.select(F.col("cluster_id").alias("hub_id"), "page", ids.alias("items"))


@query(
    "J6_orphan_hubs",
    f"""SELECT hub_id FROM v_hubs WHERE last_s >= {NOW} - 604800 AND hub_id NOT IN
    (SELECT hub_id FROM v_hubs WHERE item_count > 1)""",
)
def j6(spark, path):
    from storyhub.operators.retention import orphan_hubs

    h = tb.hubs(spark, path)
    return orphan_hubs(h, h.filter("item_count > 1"), AS_OF, hours=168).select("hub_id")


@query(
    "J7_ghost_hubs",
    "SELECT hub_id FROM v_hubs WHERE hub_id NOT IN (SELECT cluster_id FROM v_story WHERE item_id % 3 = 0)",
)
def j7(spark, path):
    from storyhub.operators.retention import ghost_hubs

    referring = tb.story_items(spark, path).filter("item_id % 3 = 0")
    return ghost_hubs(tb.hubs(spark, path), referring).select("hub_id")


@query(
    "J8_summary_carry_over",
    f"""WITH d AS (SELECT lower(trim(title)) AS k, arg_min(raw_summary, pub_s * 1000000000 + item_id) AS s FROM v_items
      WHERE item_id % 2 = 0 AND pub_s >= {NOW} - 172800 AND {t.valid_summary('raw_summary')} GROUP BY 1),
    f AS (SELECT lower(trim(title)) AS k, arg_min('File: ' || raw_summary, ord) AS s FROM v_items
      WHERE {t.valid_summary("'File: ' || raw_summary")} GROUP BY 1)
    SELECT hub_id, coalesce(d.s, f.s) AS ai_summary FROM v_hubs h LEFT JOIN d ON lower(trim(h.title)) = d.k LEFT JOIN f ON lower(trim(h.title)) = f.k""",
)
def j8(spark, path):
    from storyhub.operators.summaries import carry_over

    i = tb.items(spark, path)
    stored = i.filter("item_id % 2 = 0").select(
        F.col("item_id").alias("hub_id"), "title", F.col("raw_summary").alias("ai_summary"), F.col("published_at").alias("last_updated_at")
    )
    cached = i.select("title", F.concat(F.lit("File: "), "raw_summary").alias("ai_summary"), "ord")
    made = tb.hubs(spark, path).withColumn("ai_summary", F.lit(None).cast("string"))
    return carry_over(made, stored, cached, AS_OF).select("hub_id", "ai_summary")


@query(
    "J9_items_of_hubs",
    "SELECT item_id, cluster_id FROM v_story WHERE cluster_id IN (SELECT hub_id FROM v_hubs WHERE item_count > 1)",
)
def j9(spark, path):
    keys = tb.hubs(spark, path).filter("item_count > 1").select("hub_id")
    return views.items_of_hubs(tb.story_items(spark, path), keys).select("item_id", "cluster_id")


@query(
    "J10_test_recipients",
    """SELECT upper(c_name) || '@EXAMPLE.COM' AS email, CASE WHEN c_custkey % 2 = 0 THEN unsubscribe_token ELSE 'test-token' END AS token
    FROM customer JOIN v_subscribers ON c_custkey = subscriber_id WHERE c_acctbal > 5000""",
)
def j10(spark, path):
    from storyhub.operators.digest import resolve_recipients

    asked = tb.table(spark, path, "customer").filter("c_acctbal > 5000").select(
        F.concat(F.upper("c_name"), F.lit("@EXAMPLE.COM")).alias("email")
    )
    known = tb.subscribers(spark, path).filter("subscriber_id % 2 = 0")
    return resolve_recipients(asked, known).select("email", "token")


@query(
    "J11_keyword_join",
    r"""SELECT item_id, kw FROM v_items, (VALUES ('the', '\bthe\b'), ('and', '\band\b'), ('est', '\best\b'), ('tion', 'tion'), ('é', 'é')) k(kw, pattern)
    WHERE regexp_matches(lower(title), pattern)""",
)
def j11(spark, path):
    # A user-supplied keyword table, small by nature, becomes one array literal
    # per row pass: no join at all. Each keyword follows the keyword rule.
    words = ("the", "and", "est", "tion", "é")
    hits = F.array_compact(F.array(*[F.when(topics.matches_keywords("title", [w]), F.lit(w)) for w in words]))
    return tb.items(spark, path).select("item_id", F.explode(hits).alias("kw"))


@query(
    "J12_cache_lookup",
    f"""WITH r AS (SELECT item_id, sha256('v|short_medium|s|' || lower({t.strip('title')})) AS h FROM v_items),
    c AS (SELECT h, arg_min(item_id, item_id) AS cached FROM r JOIN v_items USING (item_id)
      WHERE item_id % 2 = 0 AND pub_s + 86400 * 20 > {NOW} GROUP BY h)
    SELECT r.item_id, c.cached, c.h IS NULL AS miss FROM r LEFT JOIN c USING (h)""",
)
def j12(spark, path):
    from storyhub.functions.text import content_hash
    from storyhub.operators.summaries import cache_lookup

    i = tb.items(spark, path)
    key = content_hash(F.lit("v"), F.lit("short_medium"), F.lit("s"), "title")
    asked = i.select("item_id", key.alias("content_hash"))
    cache = i.filter("item_id % 2 = 0").select(
        key.alias("content_hash"), F.col("item_id").cast("string").alias("text"),
        (F.col("published_at") + F.expr("INTERVAL 20 DAY")).alias("expires_at"), F.col("item_id").alias("ord"),
    )
    out = cache_lookup(asked, cache, AS_OF)
    return out.select("item_id", F.col("cached_text").cast("bigint").alias("cached"), F.col("cached_text").isNull().alias("miss"))


# -- rollups -------------------------------------------------------------------


@query(
    "A1_lane_counts",
    """SELECT cluster_id AS hub_id, count(*) AS item_count, count(*) FILTER (lane = 'mainstream') AS mainstream_count,
      count(*) FILTER (lane = 'grassroots') AS grassroots_count, count(*) FILTER (lane = 'discourse') AS discourse_count FROM v_joined GROUP BY 1""",
)
def a1(spark, path):
    return rollups.lane_counts(joined(spark, path)).withColumnRenamed("cluster_id", "hub_id")


@query(
    "A2_home_lane_counts",
    """WITH c AS (SELECT cluster_id AS hub_id, count(*) AS n, count(*) FILTER (lane IN ('mainstream', 'aggregator')) AS m,
      count(*) FILTER (lane = 'grassroots') AS g, count(*) FILTER (lane = 'discourse') AS d FROM
      (SELECT cluster_id, CASE WHEN source_id = 0 THEN 'unlisted' ELSE lane END AS lane FROM v_joined) GROUP BY 1)
    SELECT hub_id, CASE WHEN m + g + d = 0 THEN n ELSE m END AS mainstream_count, g AS grassroots_count, d AS discourse_count FROM c""",
)
def a2(spark, path):
    i = joined(spark, path).withColumn("lane", F.when(F.col("source_id") == 0, "unlisted").otherwise(F.col("lane")))
    cards = rollups.hub_cards(i, AS_OF).withColumnRenamed("cluster_id", "hub_id")
    return cards.select("hub_id", "mainstream_count", "grassroots_count", "discourse_count")


@query(
    "A3_hub_times",
    f"""SELECT cluster_id AS hub_id, min({t.effective_time('pub_s', 'fetch_s', str(tb.AS_OF_SECONDS - 864000))}) AS first_seen_at,
      max({t.effective_time('pub_s', 'fetch_s', str(tb.AS_OF_SECONDS - 864000))}) AS last_updated_at FROM v_story GROUP BY 1""",
)
def a3(spark, path):
    now = F.timestamp_seconds(F.lit(tb.AS_OF_SECONDS - 864000))
    out = rollups.hub_times(tb.story_items(spark, path), now).withColumnRenamed("cluster_id", "hub_id")
    return seconds(out, "first_seen_at", "last_updated_at")


@query("A4_source_count", "SELECT hub_id, source_count FROM v_cards")
def a4(spark, path):
    return rollups.hub_cards(joined(spark, path), AS_OF).select(F.col("cluster_id").alias("hub_id"), "source_count")


@query(
    "A5_A6_publishers",
    """SELECT cluster_id AS hub_id, count(DISTINCT CASE WHEN item_id % 5 = 0 THEN 'src' || source_id || '.example.com' ELSE lower(source_name) END) AS publisher_count,
      count(DISTINCT lane) AS lane_count FROM v_joined GROUP BY 1""",
)
def a5(spark, path):
    i = joined(spark, path).withColumn("source_name", F.when(F.col("item_id") % 5 != 0, F.col("source_name")))
    return rollups.publishers(i).withColumnRenamed("cluster_id", "hub_id")


@query(
    "A7_first_picks",
    """SELECT c.hub_id, og_image, first_source_name, source_region, language, english_gloss FROM v_cards c JOIN
    (SELECT cluster_id AS hub_id, arg_min(english_gloss, ord) FILTER (english_gloss <> '') AS english_gloss FROM v_story GROUP BY 1) USING (hub_id)""",
)
def a7(spark, path):
    c = rollups.hub_cards(joined(spark, path), AS_OF).withColumnRenamed("cluster_id", "hub_id")
    return c.select("hub_id", "og_image", "first_source_name", "source_region", "language", "english_gloss")


@query("A8_languages", "SELECT hub_id, languages FROM v_langs")
def a8(spark, path):
    out = rollups.hub_languages(joined(spark, path)).withColumnRenamed("cluster_id", "hub_id")
    return out.withColumn("languages", F.array_join("languages", ","))


@query(
    "A9_syndicated",
    "SELECT cluster_id AS hub_id, bool_or(item_id % 4 = 0) AS via_google_news FROM v_story GROUP BY 1",
)
def a9(spark, path):
    via = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("https://news.google.com/"), "url")).otherwise(F.col("url"))
    c = rollups.hub_cards(joined(spark, path).withColumn("url", via), AS_OF)
    return c.select(F.col("cluster_id").alias("hub_id"), "via_google_news")


@query(
    "A10_category_counts",
    f"SELECT category, count(*) AS item_count FROM (SELECT {t.topic('title', 'lane', 'source_name')} AS category FROM v_joined) GROUP BY 1",
)
def a10(spark, path):
    from storyhub.functions.topics import topic_of

    return rollups.category_counts(joined(spark, path).select(topic_of("title", "source_name", "lane").alias("category")))


@query(
    "A10_source_health",
    """SELECT s.source_id, count(i.item_id) AS article_count, CASE WHEN s.source_id % 7 = 0 THEN 'error' ELSE 'healthy' END AS last_status,
      CASE WHEN s.source_id % 7 = 0 THEN repeat('x', 500) END AS last_error
    FROM v_sources s LEFT JOIN v_items i ON s.source_id = i.source_id AND s.source_id <> 3 GROUP BY 1""",
)
def a10b(spark, path):
    s = tb.sources(spark, path)
    attempts = s.select("source_id", F.when(F.col("source_id") % 7 == 0, F.repeat(F.lit("x"), 600)).alias("error"))
    out = rollups.source_health(s, tb.items(spark, path).filter("source_id <> 3"), attempts)
    return out.select("source_id", "article_count", "last_status", "last_error")


SEND_DAY = "1998-03-15 20:00:00"


@query(
    "A11_sends_today",
    """WITH d AS (SELECT * FROM v_sends WHERE sent_at >= TIMESTAMP '1998-03-15 18:30:00')
    SELECT provider, CAST(sum(n) AS BIGINT) AS sent FROM (
      SELECT 'gmail' AS provider, gmail_count AS n FROM d WHERE gmail_count IS NOT NULL
      UNION ALL SELECT 'brevo', brevo_count FROM d WHERE gmail_count IS NOT NULL
      UNION ALL SELECT 'resend', resend_count FROM d WHERE gmail_count IS NOT NULL
      UNION ALL SELECT 'gmail', map_gmail FROM d WHERE gmail_count IS NULL
      UNION ALL SELECT 'ses', map_ses FROM d WHERE gmail_count IS NULL) GROUP BY 1""",
)
def a11(spark, path):
    return rollups.sends_today(tb.send_log(spark, path), SEND_DAY)


@query(
    "A15_totals",
    """SELECT (SELECT count(*) FROM v_sources) AS sources, (SELECT count(*) FROM v_items) AS items, (SELECT count(*) FROM v_hubs) AS hubs,
      (SELECT count(*) FROM v_hubs WHERE item_count >= 2) AS hubs_with_2, (SELECT count(*) FROM v_hubs WHERE item_count >= 3) AS hubs_with_3""",
)
def a15(spark, path):
    return rollups.total_counts(tb.sources(spark, path), tb.items(spark, path), tb.hubs(spark, path))


@query("A16_sources_per_lane", "SELECT lane, count(*) AS sources FROM v_sources GROUP BY 1")
def a16(spark, path):
    return tb.sources(spark, path).groupBy("lane").agg(F.count("*").alias("sources"))


@query(
    "A17_coverage_split",
    """SELECT hub_id, CAST(round(100.0 * mainstream_count / item_count) AS INTEGER) AS mainstream_pct,
      CAST(round(100.0 * grassroots_count / item_count) AS INTEGER) AS grassroots_pct, CAST(round(100.0 * discourse_count / item_count) AS INTEGER) AS discourse_pct FROM v_cards""",
)
def a17(spark, path):
    c = rollups.lane_counts(joined(spark, path), aggregator_as="mainstream").withColumnRenamed("cluster_id", "hub_id")
    return rollups.coverage_split(c).select("hub_id", "mainstream_pct", "grassroots_pct", "discourse_pct")


@query(
    "A18_story_cards",
    """WITH n AS (SELECT cluster_id, source_name, min(ord) AS o FROM v_joined GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY o) AS rn FROM n)
    SELECT hub_id, c.og_image AS image, item_count AS total_sources, 'https://news.example.org/hub/' || hub_id AS hub_url,
      (SELECT string_agg(source_name, ',' ORDER BY o) FROM r WHERE r.cluster_id = c.hub_id AND rn <= 3) AS source_names FROM v_cards c""",
)
def a18(spark, path):
    h = tb.hubs(spark, path).select("hub_id")
    out = rollups.story_cards(h, joined(spark, path), "https://news.example.org/")
    return out.withColumn("source_names", F.array_join("source_names", ","))


@query(
    "A19_hub_text",
    "SELECT hub_id, 0::BIGINT AS ord, title AS body FROM v_hubs UNION ALL SELECT cluster_id, ord, concat_ws(' ', title, english_gloss, raw_summary, og_description) FROM v_story",
)
def a19(spark, path):
    return rollups.hub_text_rows(tb.hubs(spark, path), tb.story_items(spark, path))


# -- windows and top lists -----------------------------------------------------


@query(
    "W1_first_per_source",
    "SELECT item_id, source_id, rn AS position FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ord) AS rn FROM v_items) WHERE rn <= 30",
)
def w1(spark, path):
    out = ranking.first_n(tb.items(spark, path).select("item_id", "source_id", "ord"), "source_id", "ord", 30, rank="position")
    return out.select("item_id", "source_id", F.col("position").cast("bigint").alias("position"))


@query(
    "W2_lane_balanced",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source_id, lane ORDER BY ord) AS lr, count(*) OVER (PARTITION BY source_id) AS n,
      CASE lane WHEN 'mainstream' THEN 0 WHEN 'grassroots' THEN 1 WHEN 'discourse' THEN 2 ELSE 3 END AS ln
      FROM (SELECT item_id, ord, source_id // 4 AS source_id, lane FROM v_joined)),
    p AS (SELECT *, n > 6 AND ln < 3 AND lr <= 2 AS picked FROM r),
    o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY picked DESC, CASE WHEN picked THEN ln ELSE 3 END, ord) AS position FROM p)
    SELECT source_id AS hub, item_id, position FROM o WHERE position <= 6""",
)
def w2(spark, path):
    i = joined(spark, path).select("item_id", "ord", "lane", F.floor(F.col("source_id") / 4).alias("hub"))
    out = ranking.lane_balanced(i, hub="hub")
    return out.select("hub", "item_id", F.col("position").cast("bigint").alias("position")).withColumn("hub", F.col("hub").cast("int"))


@query(
    "W3_one_per_url",
    """SELECT url, arg_min(item_id, ord) AS first_item, arg_max(item_id, ord) AS last_item FROM v_items GROUP BY 1""",
)
def w3(spark, path):
    i = tb.items(spark, path).select("url", "item_id", "ord")
    first = ranking.one_per_key(i, "url").select("url", F.col("item_id").alias("first_item"))
    last = ranking.one_per_key(i, "url", keep="last").select("url", F.col("item_id").alias("last_item"))
    return first.join(last, "url")


def _section_sql():
    hits = " UNION ALL ".join(
        f"SELECT {t.q(n)} AS section, hub_id, title, source_count, last_s, lanes FROM p WHERE "
        + t.keyword_match("title", lx.TOPIC_WORDS.get(n, [n.lower()]), "none")
        for n in lx.SECTION_NAMES
    )
    return f"""WITH p AS (SELECT *, (mainstream_count > 0)::INT + (grassroots_count > 0)::INT + (discourse_count > 0)::INT AS lanes FROM v_page),
    names AS (SELECT unnest([{', '.join(t.q(n) for n in lx.SECTION_NAMES)}]) AS section),
    hits AS ({hits}), cnt AS (SELECT n.section, count(h.hub_id) AS c FROM names n LEFT JOIN hits h USING (section) GROUP BY 1),
    shown AS (SELECT c.section, h.* EXCLUDE (section) FROM cnt c JOIN hits h USING (section) WHERE c.c >= 3
      UNION ALL SELECT c.section, p.hub_id, p.title, p.source_count, p.last_s, p.lanes FROM cnt c, p WHERE c.c < 3),
    s AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY last_s DESC, hub_id) AS position FROM shown),
    disp AS (SELECT * FROM s WHERE position <= 3),
    pool0 AS (SELECT c.section, h.* EXCLUDE (section) FROM cnt c JOIN hits h USING (section) WHERE c.c > 0
      UNION ALL SELECT c.section, p.hub_id, p.title, p.source_count, p.last_s, p.lanes FROM cnt c, p WHERE c.c = 0),
    pool AS (SELECT *, EXISTS (SELECT 1 FROM disp d WHERE d.section = pool0.section AND d.hub_id = pool0.hub_id) AS seen FROM pool0),
    k AS (SELECT *, count(*) FILTER (NOT seen) OVER (PARTITION BY section) AS fresh FROM pool),
    l AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY source_count, lanes, last_s DESC, hub_id) AS position FROM k WHERE fresh < 2 OR NOT seen)
    SELECT section, 'latest' AS part, position, hub_id, title FROM disp
    UNION ALL SELECT section, 'less covered', position, hub_id, title FROM l WHERE position <= 2"""


@query("W5_topic_sections", _section_sql())
def w5(spark, path):
    out = views.topic_sections(page(spark, path))
    return out.withColumn("position", F.col("position").cast("bigint"))


@query(
    "W7_hero_and_rest",
    """WITH r AS (SELECT hub_id, row_number() OVER (ORDER BY last_s DESC, hub_id) AS rn FROM v_hubs) SELECT hub_id, rn = 1 AS is_hero, rn > 1 AS is_rest FROM r""",
)
def w7(spark, path):
    return ranking.hero_and_rest(tb.hubs(spark, path)).select("hub_id", "is_hero", "is_rest")


@query("Ka_latest_hubs", "SELECT hub_id, last_s AS last_updated_at FROM v_hubs ORDER BY last_s DESC, hub_id LIMIT 200")
def ka(spark, path):
    out = ranking.top_n(tb.hubs(spark, path), [F.col("last_updated_at").desc(), F.col("hub_id")], 200)
    return seconds(out.select("hub_id", "last_updated_at"), "last_updated_at")


@query(
    "Kb_briefing_and_most_covered",
    """SELECT * FROM (SELECT 'briefing' AS list, hub_id FROM v_page ORDER BY last_s DESC, hub_id LIMIT 4)
    UNION ALL SELECT * FROM (SELECT 'most covered' AS list, hub_id FROM v_page ORDER BY source_count DESC, last_s DESC, hub_id LIMIT 5)""",
)
def kb(spark, path):
    p = rollups.hub_cards(joined(spark, path), AS_OF).select(F.col("cluster_id").alias("hub_id"), "last_updated_at", "source_count")
    latest = [F.col("last_updated_at").desc(), F.col("hub_id")]
    return (
        ranking.top_n(p, latest, 4).select(F.lit("briefing").alias("list"), "hub_id")
        .unionByName(ranking.top_n(p, [F.col("source_count").desc(), *latest], 5).select(F.lit("most covered").alias("list"), "hub_id"))
    )


@query(
    "Ke_subscriber_order",
    "SELECT email FROM v_subscribers WHERE is_active ORDER BY last_sent_at ASC NULLS FIRST, email LIMIT 100",
)
def ke(spark, path):
    from storyhub.operators.digest import subscriber_order

    active = tb.subscribers(spark, path).filter("is_active")
    return ranking.top_n(active, subscriber_order(), 100).select("email")


@query("Kf_paging", "SELECT hub_id FROM v_hubs ORDER BY last_s DESC, hub_id LIMIT 12 OFFSET 12")
def kf(spark, path):
    return ranking.top_n(tb.hubs(spark, path), [F.col("last_updated_at").desc(), F.col("hub_id")], 12, skip=12).select("hub_id")


_BIGGEST = "(SELECT hub_id FROM v_hubs ORDER BY item_count DESC, hub_id LIMIT 1)"


@query(
    "Kg_P10_hub_detail",
    f"SELECT hub_id, item_id, pub_s AS published_at FROM v_hubs JOIN v_story ON hub_id = cluster_id WHERE hub_id = {_BIGGEST}",
)
def kg(spark, path):
    # The reader opens one hub page: here that of the biggest hub.
    h = tb.hubs(spark, path).select("hub_id", "item_count")
    wanted = ranking.top_n(h, [F.col("item_count").desc(), F.col("hub_id")], 1).first()["hub_id"]
    out = views.hub_with_items(
        tb.hubs(spark, path).select("hub_id", "title"),
        tb.story_items(spark, path).select("cluster_id", "item_id", "published_at"), wanted,
    )
    return seconds(out.select("hub_id", "item_id", "published_at"), "published_at")


@query(
    "Kh_summarising_order",
    f"SELECT hub_id, item_count FROM v_hubs WHERE last_s >= {NOW} - 172800 ORDER BY item_count DESC, hub_id",
)
def kh(spark, path):
    from storyhub.operators.summaries import summarising_order

    return summarising_order(tb.hubs(spark, path), AS_OF).select("hub_id", "item_count")


@query("Ki_registry_listing", "SELECT source_id, lane, name FROM v_sources ORDER BY lane, name")
def ki(spark, path):
    return ranking.top_n(tb.sources(spark, path), ["lane", "name"]).select("source_id", "lane", "name")


# -- filters -------------------------------------------------------------------


@query(
    "P1_normalize_items",
    """SELECT item_id, CASE WHEN item_id % 3 = 2 THEN 'mainstream' ELSE lane END AS lane, CASE WHEN item_id % 3 = 2 THEN 'Unknown' ELSE source_name END AS source_name,
      CASE WHEN item_id % 3 = 2 THEN 'en' ELSE source_language END AS language, CASE WHEN item_id % 3 <> 2 THEN region END AS region, item_id % 4 = 0 AS via_google_news FROM v_joined""",
)
def p1(spark, path):
    j = joined(spark, path)
    src = F.struct(F.col("source_name").alias("name"), "lane", "region", F.col("source_language").alias("language"))
    m = F.col("item_id") % 3
    via = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("https://news.google.com/"), "url")).otherwise(F.col("url"))
    nothing = F.lit(None)
    raw = j.select(
        "item_id", via.alias("url"), F.when(m == 0, F.array(src)).alias("sources"), F.when(m == 1, src).alias("source"),
        nothing.cast("string").alias("lane"), nothing.cast("string").alias("source_name"),
        nothing.cast("string").alias("language"), nothing.cast("boolean").alias("via_google_news"),
    )
    return views.normalize_items(raw).drop("url")


@query(
    "P2_freshness",
    f"""WITH a AS (SELECT v.*, s.type, v.og_description IS NOT NULL AS is_static, contains(url, 'youtube.com') OR s.type = 'youtube' AS is_video,
      CASE WHEN item_id % 11 = 0 AND item_id % 33 <> 0 THEN fetch_s - (item_id % 240) * 3600 END AS rep FROM v_videos v JOIN v_sources s USING (source_id))
    SELECT item_id, CASE WHEN is_static THEN 'purged' WHEN is_video THEN CASE WHEN coalesce(rep >= {NOW} - 604800, false) THEN 'kept' ELSE 'purged' END
      WHEN pub_s >= {NOW} - 172800 THEN 'kept' ELSE 'stale' END AS status, CASE WHEN is_video THEN rep ELSE pub_s END AS published_at FROM a""",
)
def p2(spark, path):
    rows = tb.video_rows(spark, path).join(tb.sources(spark, path).select("source_id", "type"), "source_id")
    return seconds(views.freshness(rows, AS_OF).select("item_id", "status", "published_at"), "published_at")


@query(
    "P3_item_guards",
    "SELECT item_id FROM v_items WHERE (item_id % 9 <> 0) AND length(title) > 5",
)
def p3(spark, path):
    from storyhub.sources.feeds import valid_items

    url = F.when(F.col("item_id") % 9 != 0, F.col("url")).otherwise("ftp://x")
    return valid_items(tb.items(spark, path).withColumn("url", url), min_title=5).select("item_id")


@query(
    "P4_fact_checks",
    "SELECT item_id, source_name FROM v_joined WHERE contains(lower(source_name), 'factly') ORDER BY ord LIMIT 3",
)
def p4(spark, path):
    return views.fact_check_items(joined(spark, path)).select("item_id", "source_name")


def _kw_sql(text_expr, asked):
    ws = [w for n, k in lx.TOPIC_WORDS.items() if asked in n.lower() or n.lower() in asked for w in k]
    return t.keyword_match(text_expr, ws, "none") if ws else "false"


def _query_sql(q):
    a = t.q(q)
    fc = ""
    if q in views.FACT_CHECK_QUERIES:
        fc = (
            f" OR regexp_matches(lower(first_source_name), '{'|'.join(lx.FACT_CHECK_FILTER_SOURCES)}')"
            f" OR regexp_matches(lower(title), '{'|'.join(lx.FACT_CHECK_TITLE_PHRASES)}')"
        )
    return (
        f"contains(lower(title), {a}) OR coalesce(contains(lower(ai_summary), {a}), false) OR contains(lower(first_source_name), {a})"
        f" OR contains(lower(topic), {a}) OR contains({a}, lower(topic)) OR {_kw_sql("concat_ws(' ', title, ai_summary)", q)}"
        f" OR contains(lower(region), {a}) OR contains({a}, lower(region)){fc}"
    )


@query(
    "P5_query_filter",
    " UNION ALL ".join(f"SELECT {t.q(q)} AS q, hub_id FROM v_page WHERE {_query_sql(q)}" for q in ("sports", "fact check", "mumbai kerala", "the")),
)
def p5(spark, path):
    p = page(spark, path)
    asked = ("sports", "fact check", "mumbai kerala", "the")
    # The page is built once; each hub lists the queries it answers.
    hits = F.array_compact(F.array(*[F.when(views.matches_query(q), F.lit(q)) for q in asked]))
    return p.select(F.explode(hits).alias("q"), "hub_id")


@query(
    "P6_topic_filter",
    f"SELECT hub_id FROM v_page WHERE contains(lower(topic), 'technology') OR contains(lower(title), 'technology') OR {_kw_sql('title', 'technology')}",
)
def p6(spark, path):
    return views.filter_front_page(page(spark, path), topic="Technology").select("hub_id")


@query(
    "P7_language_filter",
    "SELECT hub_id FROM v_page WHERE language = 'fr' OR list_contains(string_split(languages, ','), 'fr')",
)
def p7(spark, path):
    return views.filter_front_page(page(spark, path), language="FR").select("hub_id")


@query(
    "P8_search",
    """SELECT * FROM (SELECT 'hub' AS kind, hub_id AS id FROM v_hubs WHERE title ILIKE '%th_r%' OR coalesce(ai_summary ILIKE '%th_r%', false) ORDER BY last_s DESC, hub_id LIMIT 50)
    UNION ALL SELECT * FROM (SELECT 'item' AS kind, item_id::VARCHAR AS id FROM v_items WHERE title ILIKE '%th_r%' ORDER BY pub_s DESC, item_id LIMIT 50)""",
)
def p8(spark, path):
    h, i = views.search(tb.hubs(spark, path), tb.items(spark, path), " th_r ", limit=80)
    return h.select(F.lit("hub").alias("kind"), F.col("hub_id").alias("id")).unionByName(
        i.select(F.lit("item").alias("kind"), F.col("item_id").cast("string").alias("id"))
    )


@query(
    "P9_item_filter",
    """SELECT hub_id FROM v_hubs h WHERE (contains(lower(title), 'factly') OR coalesce(contains(lower(ai_summary), 'factly'), false)
      OR EXISTS (SELECT 1 FROM v_joined i WHERE i.cluster_id = h.hub_id AND (contains(lower(i.title), 'factly') OR contains(lower(i.source_name), 'factly')))) AND contains(lower(title), 'the')""",
)
def p9(spark, path):
    return views.filter_hubs_by_items(tb.hubs(spark, path), joined(spark, path), "Factly", "The").select("hub_id")


@query(
    "P11_folded_lanes",
    """SELECT cluster_id AS hub_id, CASE WHEN lane IN ('grassroots', 'discourse') THEN lane ELSE 'mainstream' END AS lane, count(*) AS items FROM v_joined GROUP BY 1, 2""",
)
def p11(spark, path):
    i = joined(spark, path).select(F.col("cluster_id").alias("hub_id"), views.fold_lane().alias("lane"))
    return i.groupBy("hub_id", "lane").agg(F.count("*").alias("items"))


@query(
    "P12_fallback_hubs",
    "SELECT cluster_id AS hub_id, title, raw_summary AS ai_summary, pub_s AS last_updated_at, 1::BIGINT AS item_count FROM v_story ORDER BY ord LIMIT 60",
)
def p12(spark, path):
    out = views.fallback_hubs(tb.story_items(spark, path)).drop("first_seen_at")
    return seconds(out, "last_updated_at")


@query(
    "P14_hub_status",
    f"""SELECT hub_id, CASE WHEN item_count > 1 THEN CASE WHEN {t.valid_summary('trim(ai_summary)')} THEN 'valid' ELSE 'multi' END
      ELSE CASE WHEN coalesce(length(trim(ai_summary)) > 10, false) THEN 'valid' ELSE 'single' END END AS status FROM v_hubs""",
)
def p14(spark, path):
    from storyhub.operators.summaries import hub_status

    return tb.hubs(spark, path).select("hub_id", hub_status().alias("status"))


SUB_DAY = "1998-06-01 12:00:00"


@query(
    "P15_due_subscribers",
    "SELECT email FROM v_subscribers WHERE is_active AND (last_sent_at IS NULL OR last_sent_at < TIMESTAMP '1998-05-31 18:30:00')",
)
def p15(spark, path):
    from storyhub.operators.digest import due_subscribers

    return due_subscribers(tb.subscribers(spark, path), SUB_DAY).select("email")


@query(
    "P16_once_a_day",
    """SELECT d::VARCHAR AS run_at, EXISTS (SELECT 1 FROM v_sends WHERE status IN ('sent', 'partial')
      AND sent_at >= date_trunc('day', d + INTERVAL 330 MINUTE) - INTERVAL 330 MINUTE) AS blocked
    FROM (VALUES (TIMESTAMP '1998-03-15 20:00:00'), (TIMESTAMP '2030-01-01 00:00:00')) r(d)""",
)
def p16(spark, path):
    from storyhub.operators.digest import run_guard

    log = tb.send_log(spark, path)
    first = run_guard(log, "1998-03-15 20:00:00").withColumn("run_at", F.lit("1998-03-15 20:00:00"))
    return first.unionByName(run_guard(log, "2030-01-01 00:00:00").withColumn("run_at", F.lit("2030-01-01 00:00:00")))


# -- set operations --------------------------------------------------------------


@query(
    "U1_lane_union",
    "SELECT lane, count(*) AS items, count(og_image) AS with_image FROM v_joined WHERE lane <> 'discourse' OR item_id % 2 = 0 GROUP BY 1",
)
def u1(spark, path):
    from storyhub.sources.feeds import union_items

    j = joined(spark, path).select("item_id", "lane", "og_image")
    parts = [j.filter(F.col("lane").isin("mainstream", "grassroots")), j.filter((F.col("lane") == "discourse") & (F.col("item_id") % 2 == 0))]
    out = union_items(*parts, j.filter("lane = 'aggregator'"))
    return out.groupBy("lane").agg(F.count("*").alias("items"), F.count("og_image").alias("with_image"))


@query(
    "U2_window_union",
    f"""WITH u AS (SELECT * FROM v_videos WHERE pub_s >= {NOW} - 172800 UNION ALL SELECT * FROM v_videos WHERE url ILIKE '%youtube.com%' AND pub_s >= {NOW} - 604800)
    SELECT url, arg_min(item_id, ord) AS item_id FROM u GROUP BY 1""",
)
def u2(spark, path):
    from storyhub.operators.clustering import window_items

    return window_items(tb.video_rows(spark, path), AS_OF).select("url", "item_id")


@query(
    "U3_candidate_union",
    f"""WITH a AS (SELECT hub_id FROM v_hubs WHERE last_s >= {NOW} - 86400 ORDER BY item_count DESC, hub_id LIMIT 40),
    b AS (SELECT hub_id FROM v_hubs WHERE last_s >= {NOW} - 129600 ORDER BY last_s DESC, hub_id LIMIT 60)
    SELECT hub_id FROM a UNION ALL SELECT hub_id FROM b""",
)
def u3(spark, path):
    from storyhub.operators.digest import candidate_hubs

    h = tb.hubs(spark, path)
    return candidate_hubs(h, AS_OF, fallback=False).select("hub_id").union(candidate_hubs(h, AS_OF, fallback=True).select("hub_id"))


@query(
    "U4_except",
    "SELECT hub_id FROM v_hubs WHERE hub_id NOT IN (SELECT hub_id FROM v_hubs ORDER BY last_s DESC, hub_id LIMIT 3)",
)
def u4(spark, path):
    h = tb.hubs(spark, path).select("hub_id", "last_updated_at")
    shown = ranking.top_n(h, [F.col("last_updated_at").desc(), F.col("hub_id")], 3)
    return h.join(shown, "hub_id", "left_anti").select("hub_id")
