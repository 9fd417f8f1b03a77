"""Queries of the text, time, topic and page expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyhub.functions import lexicon as lx
from storyhub.functions import media, text, times, topics
from storyhub.operators import summaries
from storyhub.plans import folds
from storyhub.plans import twins as t
from storyhub.plans.catalog import query, view
from storyhub.sources import tables as tb

# Phrases put in front of titles so that every topic, region and script occurs.
SAMPLES = [
    "", "Cricket world cup final", "भारत में चुनाव", "UP police arrest two", "Cup upset as Bandhan opens",
    "Bandh called in Pune", "வானிலை", "Fact check: viral video", "RBI repo rate", "Bangalore tech hub",
    "मुंबईत पाऊस आहे", "తెలంగాణ", "Hospital in Delhi", "কলকাতা বন্যা", "Movie trailer", "കേരള മഴ",
    "White House on trade", "ગુજરાત", "ಬೆಂಗಳೂರು", "ਪੰਜਾਬ", "Flood in Patna",
]


def tagged(spark, path):
    j = tb.items(spark, path).join(tb.sources(spark, path).select("source_id", "name", "lane", "region"), "source_id")
    return j.withColumn(
        "headline", F.concat_ws(" ", tb._pick(F.col("item_id") % len(SAMPLES), SAMPLES), F.col("title"))
    )


view(
    "v_tagged",
    f"""SELECT i.*, s.name, s.lane, s.region,
      {t.pick(f'item_id % {len(SAMPLES)}', SAMPLES)} || ' ' || title AS headline
    FROM v_items i JOIN v_sources s USING (source_id)""",
)


@query("F1_normalize_title", f"SELECT doc_id, {t.norm('split_part(text, chr(10), 1)')} AS norm_title FROM documents")
def f1(spark, path):
    d = tb.table(spark, path, "documents")
    return d.select("doc_id", text.normalize_title(F.substring_index("text", "\n", 1)).alias("norm_title"))


@query(
    "F2_word_jaccard",
    f"""WITH n AS (SELECT item_id, {t.words('norm_title')} AS a, {t.words(t.norm('raw_summary'))} AS b FROM v_story)
    SELECT item_id, round({t.jaccard('a', 'b')}, 6) AS similarity FROM n""",
)
def f2(spark, path):
    i = tb.story_items(spark, path)
    body = text.normalize_title("raw_summary")
    return i.select("item_id", F.round(text.title_jaccard("norm_title", body), 6).alias("similarity"))


def _feature_text_sql(title, body):
    b = t.rx(body, "<[^>]*>?", " ")
    for p in lx.FEATURE_BOILERPLATE:
        b = t.rx(b, p, " ", "gi")
    b = t.squeeze(t.cut_tail(t.rx(b, r"^[^—]{1,120}\s+—\s+", "", "")))
    return f"""WITH a AS (SELECT item_id, ord, {title} AS raw, {t.squeeze(t.cut_tail(title))} AS cut, {b} AS body FROM v_items),
    h AS (SELECT *, CASE WHEN length(cut) < 3 THEN {t.strip('raw')} ELSE cut END AS head FROM a),
    k AS (SELECT *, {t.rx('lower(head)', r'[^\p{L}\p{M}\p{N}]')} AS kh, {t.rx('lower(body)', r'[^\p{L}\p{M}\p{N}]')} AS kb FROM h)
    SELECT item_id, ord, CASE WHEN length(body) < 15 OR kb = kh OR kb = '' THEN head
      ELSE head || '. ' || head || '. ' || body END AS feature_text FROM k"""


view("v_feature_text", _feature_text_sql("title", "raw_summary"))
_STOP = "[" + ", ".join(t.q(w) for w in lx.FEATURE_STOP_WORDS) + "]"
view(
    "v_feature_words",
    f"""SELECT item_id, ord, list_filter(regexp_split_to_array({t.rx('lower(feature_text)', r'[^\p{L}\p{M}\p{N}\s]', ' ')}, '\\s+'),
      lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w)) AS words FROM v_feature_text""",
)


@query("F3_feature_text", "SELECT item_id, feature_text FROM v_feature_text")
def f3(spark, path):
    return tb.items(spark, path).select("item_id", text.feature_text("title", "raw_summary").alias("feature_text"))


@query("F4_feature_tokens", "SELECT item_id, array_to_string(words, ' ') AS tokens FROM v_feature_words")
def f4(spark, path):
    body = text.feature_text("title", "raw_summary")
    return tb.items(spark, path).select("item_id", F.array_join(text.feature_tokens(body), " ").alias("tokens"))


@query(
    "F9_category",
    f"SELECT item_id, {t.topic('headline', 'lane', 'name')} AS topic, {t.region('headline', 'region')} AS region FROM v_tagged",
)
def f9(spark, path):
    return tagged(spark, path).select(
        "item_id",
        topics.topic_of("headline", "name", "lane").alias("topic"),
        topics.region_of("headline", "region").alias("region"),
    )


@query(
    "F10_keyword_rule",
    "SELECT item_id, "
    + ", ".join(f"{t.keyword_match('headline', w)} AS k{i}" for i, w in enumerate([["up"], ["bandh"], ["cup"], ["फ"], ["tech"]]))
    + " FROM v_tagged",
)
def f10(spark, path):
    probes = [["up"], ["bandh"], ["cup"], ["फ"], ["tech"]]
    return tagged(spark, path).select(
        "item_id", *[topics.matches_keywords("headline", w).alias(f"k{i}") for i, w in enumerate(probes)]
    )


@query("F11_region", f"SELECT item_id, {t.region('headline')} AS region FROM v_tagged")
def f11(spark, path):
    return tagged(spark, path).select("item_id", topics.region_of("headline").alias("region"))


def _script_sql(e, lang):
    marks = "|".join(lx.MARATHI_MARKS)
    cases = [f"WHEN regexp_matches({e}, '[\\x{{{a}}}-\\x{{{b}}}]') THEN '{c}'" for a, b, c, _ in lx.SCRIPT_BLOCKS]
    cases.append(
        f"WHEN regexp_matches({e}, '[\\x{{0900}}-\\x{{097F}}]') THEN "
        f"CASE WHEN {lang} = 'mr' OR regexp_matches({e}, '{marks}') THEN 'mr' ELSE 'hi' END"
    )
    return "CASE " + " ".join(cases) + f" WHEN {lang} NOT IN ('en', 'all') THEN {lang} ELSE 'en' END"


@query(
    "F12_script_language",
    f"WITH s AS (SELECT item_id, {_script_sql('headline', 'language')} AS code FROM v_tagged) "
    "SELECT item_id, code, code <> 'en' AS is_non_english FROM s",
)
def f12(spark, path):
    lang = topics.script_language("headline", "language")
    return tagged(spark, path).select(
        "item_id", lang["code"].alias("code"), lang["is_non_english"].alias("is_non_english")
    )


_NOISY_TITLE = "'\"' || title || ' &amp; more - ' || name || ' as reported by desk'"


@query(
    "F13_clean_headline",
    f"WITH n AS (SELECT item_id, {_NOISY_TITLE} AS a, title || ' - ' || name AS b FROM v_tagged) "
    f"SELECT item_id, {t.headline('a')} AS h1, {t.headline('b')} AS h2 FROM n",
)
def f13(spark, path):
    noisy = F.concat(F.lit('"'), "title", F.lit(" &amp; more - "), "name", F.lit(" as reported by desk"))
    return tagged(spark, path).select(
        "item_id",
        text.clean_headline(noisy).alias("h1"),
        text.clean_headline(F.concat("title", F.lit(" - "), "name")).alias("h2"),
    )


@query(
    "F14_clean_summary",
    "WITH n AS (SELECT doc_id, '<p>' || text || '</p> &quot;end&quot; ' || "
    "CASE WHEN doc_id % 3 = 0 THEN 'Read more here' ELSE '' END AS a FROM documents) "
    f"SELECT doc_id, {t.summary('a')} AS summary FROM n",
)
def f14(spark, path):
    raw = F.concat(
        F.lit("<p>"), "text", F.lit("</p> &quot;end&quot; "),
        F.when(F.col("doc_id") % 3 == 0, "Read more here").otherwise(""),
    )
    return tb.table(spark, path, "documents").select("doc_id", text.clean_summary(raw).alias("summary"))


_REPLIES = ["", "# ", "/", "Word count ok ", "Briefing: ", "<think>plan</think> ", "constraint: "]


@query(
    "F15_valid_summary",
    f"WITH n AS (SELECT item_id, {t.pick('item_id % 7', _REPLIES)} || title AS a FROM v_items) "
    f"SELECT item_id, {t.valid_summary('a')} AS valid FROM n",
)
def f15(spark, path):
    reply = F.concat(tb._pick(F.col("item_id") % 7, _REPLIES), "title")
    return tb.items(spark, path).select("item_id", text.is_valid_summary(reply).alias("valid"))


def _generated_sql(e):
    e = t.quotes(t.rx(t.rx(e, "<think>.*?</think>", "", "gis"), "<think>.*$", "", "is"))
    e = t.rx(e, r"^(?:neutral briefing|briefing|summary):\s*", "", "i")
    e = t.rx(e, r"^Mainstream media coverage highlights\s*", "", "i")
    return t.strip(t.rx(e, r"\s*as reported by.*$", "", "i"))


@query(
    "F16_clean_generated",
    f"WITH n AS (SELECT item_id, {t.pick('item_id % 7', _REPLIES)} || title || ' as reported by x' AS a FROM v_items) "
    f"SELECT item_id, {_generated_sql('a')} AS cleaned FROM n",
)
def f16(spark, path):
    reply = F.concat(tb._pick(F.col("item_id") % 7, _REPLIES), "title", F.lit(" as reported by x"))
    return tb.items(spark, path).select("item_id", text.clean_generated(reply).alias("cleaned"))


_TRANSLATED = ["Translation: ", "ENGLISH:  headline: ", "<think>which one? </think>", "translation:english: ", "<think>open "]


@query(
    "F16_clean_translation",
    f"""WITH n AS (SELECT item_id, coalesce({t.pick('item_id % 6', _TRANSLATED)}, '') || title AS a FROM v_items),
    r AS (SELECT item_id, {t.rx(t.quotes(t.strip(t.rx(t.rx('a', '<think>.*?</think>', '', 'gis'), '<think>.*$', '', 'gis'))), '^translation:\\s*', '', 'i')} AS b FROM n)
    SELECT item_id, {t.strip(t.rx(t.rx('b', '^english:\\s*', '', 'i'), '^headline:\\s*', '', 'i'))} AS cleaned FROM r""",
)
def f16t(spark, path):
    reply = F.concat(F.coalesce(tb._pick(F.col("item_id") % 6, _TRANSLATED), F.lit("")), "title")
    return tb.items(spark, path).select("item_id", text.clean_translation(reply).alias("cleaned"))


_TOLD = ["", "Mob violence in town. ", "Dharna at the gate. ", "Bandhan Bank. ", "मोर्चा निकला. "]


@query(
    "F17_sensitive_and_protest",
    f"""WITH n AS (SELECT cluster_id AS hub_id, bool_or(regexp_matches(lower(a), {t.q('|'.join(lx.SENSITIVE_PHRASES))})) AS sensitive,
      bool_or({t.keyword_match('b', lx.PROTESTS_WORDS, 'all')}) AS protest
      FROM (SELECT cluster_id, concat_ws(' ', {t.pick('item_id % 5', _TOLD)} || title, english_gloss, raw_summary) AS a,
        concat_ws(' ', {t.pick('item_id % 5', _TOLD)} || title, english_gloss, raw_summary, og_description) AS b FROM v_story) GROUP BY 1)
    SELECT * FROM n""",
)
def f17(spark, path):
    items = tb.story_items(spark, path).withColumn("title", F.concat(tb._pick(F.col("item_id") % 5, _TOLD), "title"))
    return (
        items.select(
            F.col("cluster_id").alias("hub_id"),
            topics.is_sensitive(summaries.told(items)).alias("s"),
            topics.is_protest(summaries.told(items, with_page=True)).alias("p"),
        )
        .groupBy("hub_id")
        .agg(F.bool_or("s").alias("sensitive"), F.bool_or("p").alias("protest"))
    )


_SKEW = "CASE WHEN item_id % 10 = 0 THEN NULL ELSE pub_s + (item_id % 9) * 3600 END"


@query(
    "F18_effective_time",
    f"WITH n AS (SELECT item_id, {_SKEW} AS p, fetch_s FROM v_items) "
    f"SELECT item_id, {t.effective_time('p', 'fetch_s', str(tb.AS_OF_SECONDS - 36000))} AS effective_s FROM n",
)
def f18(spark, path):
    now = F.timestamp_seconds(F.lit(tb.AS_OF_SECONDS - 36000))
    skewed = F.timestamp_seconds(F.unix_seconds("published_at") + F.col("item_id") % 9 * 3600)
    published = F.when(F.col("item_id") % 10 != 0, skewed)
    return tb.items(spark, path).select(
        "item_id", F.unix_seconds(times.effective_time(published, "fetched_at", now)).alias("effective_s")
    )


@query(
    "F19_time_ago",
    f"""WITH a AS (SELECT item_id, pub_s, {tb.AS_OF_SECONDS} - pub_s AS s FROM v_items)
    SELECT item_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago'
      WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 604800 THEN (s // 86400) || 'd ago'
      ELSE strftime(to_timestamp(pub_s) AT TIME ZONE 'UTC', '%-d %b') END AS age FROM a""",
)
def f19(spark, path):
    return tb.items(spark, path).select("item_id", times.time_ago("published_at", tb.AS_OF).alias("age"))


_UNITS = ["seconds", "min", "hrs", "days", "wk", "months", "yr", "moons"]


@query(
    "F20_relative_time",
    f"""WITH n AS (SELECT item_id, fetch_s, item_id % 50 AS n, item_id % 8 AS u FROM v_items)
    SELECT item_id, fetch_s - n * {t.pick('u', ['1'] * 8).replace("'1'", "1")} * CASE u WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600
      WHEN 3 THEN 86400 WHEN 4 THEN 604800 WHEN 5 THEN 2592000 WHEN 6 THEN 31536000 END AS at_s FROM n""",
)
def f20(spark, path):
    words = F.concat(
        F.lit("Streamed "), (F.col("item_id") % 50).cast("string"), F.lit(" "),
        tb._pick(F.col("item_id") % 8, _UNITS), F.lit(" ago"),
    )
    return tb.items(spark, path).select(
        "item_id", F.unix_seconds(times.relative_time(words, F.col("fetched_at"))).alias("at_s")
    )


@query("F21_feed_time", "SELECT item_id, pub_s AS rfc_s, pub_s AS iso_s FROM v_items")
def f21(spark, path):
    rfc = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    iso = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return tb.items(spark, path).select(
        "item_id",
        F.unix_seconds(times.feed_time(rfc)).alias("rfc_s"),
        F.unix_seconds(times.feed_time(iso)).alias("iso_s"),
    )


@query(
    "F22_channel_match",
    """WITH n AS (SELECT source_id, lower(name) AS n, lower(v) AS v FROM v_sources,
      (VALUES ('Factly Official'), ('Desk TV'), ('Source 3'), ('Other News')) c(v)),
    k AS (SELECT *, regexp_replace(v, '[^a-z0-9]', '', 'g') AS kv, regexp_replace(n, '[^a-z0-9]', '', 'g') AS kn,
      list_filter(regexp_split_to_array(n, '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ('the','by','india','bharat','news','network','official','we','are','tv','main','bhi')) AS toks FROM n)
    SELECT source_id, v AS channel, contains(kv, kn) OR contains(kn, kv) OR len(list_filter(toks, lambda w: contains(kv, w))) > 0 AS matches FROM k""",
)
def f22(spark, path):
    channels = F.explode(F.array(*[F.lit(c) for c in ("Factly Official", "Desk TV", "Source 3", "Other News")]))
    s = tb.sources(spark, path).select("source_id", "name", channels.alias("channel"))
    return s.select(
        "source_id", F.lower("channel").alias("channel"), media.channel_matches("channel", "name").alias("matches")
    )


@query(
    "F23_video_query",
    "SELECT source_id, CASE WHEN source_id % 2 = 0 THEN 'daily show ' || source_id ELSE name || ' India news' END AS words FROM v_sources",
)
def f23(spark, path):
    sid = F.col("source_id").cast("string")
    url = F.when(
        F.col("source_id") % 2 == 0, F.concat(F.lit("https://www.youtube.com/results?search_query=daily+show%20"), sid)
    ).otherwise(F.col("feed_url"))
    return tb.sources(spark, path).select("source_id", media.video_query(url, "name").alias("words"))


@query(
    "F24_video_embed",
    "SELECT item_id, 'https://www.youtube.com/embed/' || nullif(regexp_extract(url, 'youtube\\.com/watch\\?v=([\\w-]{11})', 1), '') AS embed_url FROM v_videos",
)
def f24(spark, path):
    return tb.video_rows(spark, path).select("item_id", media.video_embed_url("url").alias("embed_url"))


def _article_sql():
    e = t.rx("html", "<!--.*?-->", "", "gs")
    for el in lx.ARTICLE_DROPPED_ELEMENTS:
        e = t.rx(e, f"<{el}.*?</{el}>", "", "gis")
    para = t.squeeze(t.rx(t.entities(t.rx("p", "<[^>]*>?")), r"&#\d+;"))
    bad = "|".join(lx.ARTICLE_BOILERPLATE)
    return f"""WITH c AS (SELECT page_id, html, {e} AS clean FROM pages),
    b AS (SELECT page_id, html, coalesce(nullif(regexp_extract(clean, '(?is)<article[^>]*>(.*?)</article>', 1), ''),
      nullif(regexp_extract(clean, '(?is)<main[^>]*>(.*?)</main>', 1), ''), clean) AS body FROM c),
    p AS (SELECT page_id, html, unnest(regexp_extract_all(body, '(?is)<p[^>]*>.*?</p>')) AS p,
      generate_subscripts(regexp_extract_all(body, '(?is)<p[^>]*>.*?</p>'), 1) AS n FROM b),
    x AS (SELECT page_id, n, {para} AS txt FROM p),
    k AS (SELECT * FROM x WHERE length(txt) >= 45 AND NOT regexp_matches(lower(txt), '{bad}')),
    r AS (SELECT *, coalesce(sum(length(txt)) OVER (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
    j AS (SELECT page_id, trim(substr(string_agg(txt, ' ' ORDER BY n), 1, 1800)) AS body FROM r WHERE before < 1500 GROUP BY page_id)
    SELECT page_id, CASE WHEN length(html) >= 500 AND length(body) > 60 THEN body END AS article FROM pages LEFT JOIN j USING (page_id)"""


@query("F25_article_text", _article_sql())
def f25(spark, path):
    return tb.pages(spark, path).select("page_id", media.article_text("html").alias("article"))


def _prompt_lines_sql(source, key, raw):
    e = raw
    for el in ("script", "style", "nav", "footer"):
        e = t.rx(e, f"<{el}.*?</{el}>", " ", "gis")
    e = t.entities(t.rx(e, "<[^>]*>?", " "))
    e = t.rx(e, "(?:" + "|".join(lx.PROMPT_CUT_PHRASES) + ").*$", "", "is")
    return f"""SELECT {key}, list_filter(list_transform(regexp_split_to_array({e}, '\\r?\\n'), lambda x: {t.squeeze('x')}), lambda x: x <> '') AS lines FROM {source}"""


@query(
    "F26_prompt_lines",
    f"WITH p AS ({_prompt_lines_sql('pages', 'page_id', 'html')}) SELECT page_id, array_to_string(lines, chr(10)) AS body FROM p",
)
def f26(spark, path):
    return tb.pages(spark, path).select("page_id", F.array_join(text.prompt_lines("html"), "\n").alias("body"))


@query("F27_token_estimate", f"SELECT conv_id, turn, {t.tokens('text')} AS tokens FROM conversations")
def f27(spark, path):
    return tb.table(spark, path, "conversations").select("conv_id", "turn", text.estimate_tokens("text").alias("tokens"))


@query(
    "F28_content_hash",
    f"SELECT conv_id, turn, sha256('v2.2-compact|short_medium|Neutral editor.|' || lower({t.strip('text')})) AS hash FROM conversations",
)
def f28(spark, path):
    h = text.content_hash(F.lit("v2.2-compact"), F.lit("short_medium"), F.lit(" Neutral editor. "), "text")
    return tb.table(spark, path, "conversations").select("conv_id", "turn", h.alias("hash"))


@query(
    "F29_reset_header",
    """SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN ceil(value * 1000) WHEN 1 THEN ceil((event_id % 60) * 60000.0 + value * 1000.0)
      WHEN 2 THEN event_id % 1000 END AS BIGINT) AS reset_ms FROM events""",
)
def f29(spark, path):
    v, e = F.format_string("%.2f", "value"), F.col("event_id")
    header = (
        F.when(e % 4 == 0, v)
        .when(e % 4 == 1, F.concat((e % 60).cast("string"), F.lit("m"), v, F.lit("s")))
        .when(e % 4 == 2, F.concat((e % 1000).cast("string"), F.lit("ms")))
        .otherwise("soon")
    )
    return tb.table(spark, path, "events").select("event_id", times.reset_header_ms(header).alias("reset_ms"))


@query(
    "F30_next_daily_reset",
    """WITH n AS (SELECT event_id, ts, epoch_us(date_trunc('day', ts)) // 1000000 AS d, epoch_us(ts) AS u FROM events)
    SELECT event_id, d + 86400 AS midnight_s, CASE WHEN (d + 25200) * 1000000 > u THEN d + 25200 ELSE d + 111600 END AS pacific_s FROM n""",
)
def f30(spark, path):
    ts = F.col("ts").cast("timestamp")
    return tb.table(spark, path, "events").select(
        "event_id",
        F.unix_seconds(times.next_daily_reset(ts, None)).alias("midnight_s"),
        F.unix_seconds(times.next_daily_reset(ts, 7)).alias("pacific_s"),
    )


@query(
    "F31_ist_day_start",
    "SELECT event_id, epoch_us(date_trunc('day', ts + INTERVAL 330 MINUTE)) // 1000000 - 19800 AS start_s FROM events",
)
def f31(spark, path):
    ts = F.col("ts").cast("timestamp")
    return tb.table(spark, path, "events").select("event_id", F.unix_seconds(times.ist_day_start(ts)).alias("start_s"))


@query(
    "F32_ist_long_date",
    "SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%A, %-d %B %Y') AS long_date FROM events",
)
def f32(spark, path):
    ts = F.col("ts").cast("timestamp")
    return tb.table(spark, path, "events").select("event_id", times.ist_long_date(ts).alias("long_date"))


_MAILS = ["reader.name@site.org", "ab@site.org", "x@site.org", "no-at-sign", "@site.org", ""]


@query(
    "F33_mask_email",
    """SELECT subscriber_id, substr(email, 1, 1) || '***' || substr(split_part(email, '@', 1), -1, 1) || '@example.com' AS masked,
      CASE subscriber_id % 6 WHEN 0 THEN 'r***e@site.org' WHEN 1 THEN 'a***@site.org' WHEN 2 THEN 'x***@site.org' ELSE '***' END AS probe FROM v_subscribers""",
)
def f33(spark, path):
    probe = tb._pick(F.col("subscriber_id") % 6, _MAILS)
    return tb.subscribers(spark, path).select(
        "subscriber_id", text.mask_email("email").alias("masked"), text.mask_email(probe).alias("probe")
    )


@query(
    "F34_mail_headers",
    """SELECT subscriber_id, '<https://news.example.org/api/newsletter/unsubscribe?token=' || unsubscribe_token || '>, <mailto:desk@example.org?subject=Unsubscribe%20'
      || replace(replace(email, '#', '%23'), '@', '%40') || '>' AS unsubscribe, 'List-Unsubscribe=One-Click' AS post FROM v_subscribers""",
)
def f34(spark, path):
    h = text.compliance_headers("email", "unsubscribe_token", "https://news.example.org/", "desk@example.org")
    return tb.subscribers(spark, path).select(
        "subscriber_id", h["List-Unsubscribe"].alias("unsubscribe"), h["List-Unsubscribe-Post"].alias("post")
    )


_ERRORS = ["550 5.4.5 Daily limit", "user unknown", "timeout", "Sending limit exceeded", "mailbox busy", "odd limit"]


@query(
    "F35_bounce_class",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 3) THEN 'quota' WHEN o_orderkey % 6 = 5 AND o_orderkey % 4 = 0 THEN 'quota'
      WHEN o_orderkey % 6 = 1 OR o_orderkey % 4 < 2 THEN 'permanent' ELSE 'temporary' END AS class FROM orders""",
)
def f35(spark, path):
    k = F.col("o_orderkey")
    code = F.when(k % 4 == 0, 550).when(k % 4 == 1, 553).when(k % 4 == 2, 421)
    return tb.table(spark, path, "orders").select(
        "o_orderkey", text.bounce_class(tb._pick(k % 6, _ERRORS), code).alias("class")
    )


@query(
    "F36_fallback_summary",
    f"""WITH n AS (SELECT item_id, {t.headline('title')} AS h, {t.summary('raw_summary')} AS s FROM v_items),
    f AS (SELECT *, {t.sentence('s')} AS lead FROM n)
    SELECT item_id, CASE WHEN length(substr(lead, 1, 180)) > 25 AND lower(substr(lead, 1, 180)) <> lower(h) THEN substr(lead, 1, 180) ELSE h END AS fallback,
      CASE WHEN length(trim(lead)) > 25 THEN substr(trim(lead), 1, 160) ELSE h END AS single FROM f""",
)
def f36(spark, path):
    return tb.items(spark, path).select(
        "item_id",
        text.fallback_summary("title", "raw_summary").alias("fallback"),
        text.single_item_summary("title", "raw_summary").alias("single"),
    )


view(
    "v_report_lines",
    f"""SELECT item_id, CASE WHEN s <> '' AND lower(s) <> lower(h) AND NOT contains(lower(h), substr(lower(s), 1, 35))
      THEN '- ' || h || ': ' || s ELSE '- ' || h END AS line
    FROM (SELECT item_id, {t.headline('title')} AS h, substr({t.summary('raw_summary')}, 1, 110) AS s FROM v_items)""",
)


@query("F37_report_line", "SELECT item_id, line FROM v_report_lines")
def f37(spark, path):
    return tb.items(spark, path).select("item_id", text.report_line("title", "raw_summary").alias("line"))


_TEMPLATE = 'Read about "{title}" in every lane.'


@query(
    "F38_meta_description",
    f"""WITH n AS (SELECT hub_id, coalesce(nullif({t.strip("coalesce(ai_summary, '')")}, ''), 'Read about "' || {t.strip('title')} || '" in every lane.') AS d FROM v_hubs)
    SELECT hub_id, CASE WHEN length(d) > 158 THEN substr(d, 1, 155) || '...' ELSE d END AS description FROM n""",
)
def f38(spark, path):
    return tb.hubs(spark, path).select(
        "hub_id", text.meta_description("ai_summary", "title", _TEMPLATE).alias("description")
    )


@query(
    "P13_bad_summaries",
    f"""WITH n AS (SELECT item_id, title, CASE WHEN item_id % 4 = 0 THEN raw_summary || ' as reported by X' ELSE raw_summary END AS s FROM v_items),
    b AS (SELECT *, regexp_matches(lower(s), 'mainstream media coverage|as reported by|highlights') AS bad FROM n)
    SELECT item_id, bad, CASE WHEN NOT bad THEN s END AS emptied, CASE WHEN bad THEN {t.headline('title')} ELSE s END AS replaced FROM b""",
)
def p13(spark, path):
    from storyhub.operators.summaries import repair_summaries

    noisy = F.when(F.col("item_id") % 4 == 0, F.concat("raw_summary", F.lit(" as reported by X"))).otherwise(
        F.col("raw_summary")
    )
    d = tb.items(spark, path).select("item_id", "title", noisy.alias("ai_summary"))
    return repair_summaries(d).select("item_id", "bad", "emptied", "replaced")


_HOSTS = ["localhost", "10.0.0.8", "172.20.1.1", "172.40.1.1", "cdn.local", "img.example.com", "192.168.3.4", "www.site.org"]


@query(
    "P17_private_hosts",
    "SELECT page_id, page_id % 8 IN (0, 1, 2, 4, 6) AS private_probe, false AS private_page FROM pages",
)
def p17(spark, path):
    probe = F.concat(F.lit("http://"), tb._pick(F.col("page_id") % 8, _HOSTS), F.lit("/a.png"))
    return tb.pages(spark, path).select(
        "page_id", text.is_private_host(probe).alias("private_probe"), text.is_private_host("url").alias("private_page")
    )


@query(
    "P18_format_checks",
    """SELECT subscriber_id, regexp_full_match(email, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') AS email_ok,
      regexp_matches(unsubscribe_token, '^[0-9a-f]{8}-') AS token_is_uuid, true AS uuid_ok FROM v_subscribers""",
)
def p18(spark, path):
    from storyhub.functions.ids import hub_uuid

    return tb.subscribers(spark, path).select(
        "subscriber_id",
        text.is_email("email").alias("email_ok"),
        text.is_uuid("unsubscribe_token").alias("token_is_uuid"),
        text.is_uuid(hub_uuid("email")).alias("uuid_ok"),
    )


view("v_doc_lines", _prompt_lines_sql("documents", "doc_id", "text"))


@query("K5_distinct_lines", folds.distinct_lines("v_doc_lines", "doc_id", "lines"))
def k5(spark, path):
    d = tb.table(spark, path, "documents")
    return d.select("doc_id", F.array_join(text.distinct_lines(text.prompt_lines("text")), "\n").alias("kept"))


@query("W8_sentence_chunks", folds.CHUNKS)
def w8(spark, path):
    d = tb.table(spark, path, "documents").select("doc_id", F.explode(text.sentence_chunks("text")).alias("chunk"))
    return d.select("doc_id", "chunk", text.estimate_tokens("chunk").alias("tokens"))
