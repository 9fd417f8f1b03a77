"""DuckDB text of the shared views and cleaners, used by the SQL twins only."""

from __future__ import annotations

from storyhub.functions import lexicon as lx
from storyhub.plans.catalog import view
from storyhub.sources.tables import AS_OF_SECONDS, EPOCH, SPAN_MINUTES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(expr: str, pattern: str, replacement: str = "", flags: str = "g") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(replacement)}, '{flags}')"


def squeeze(expr: str) -> str:
    return f"trim({rx(expr, r'\s+', ' ')})"


def strip(expr: str) -> str:
    return rx(expr, r"^\s+|\s+$")


TAIL = r"\s*[\-–—|]\s*[^–—\-|\s]+.*$"
SIGNED = r"\s+-\s+[A-Z][A-Za-z0-9\s.&'-]{2,35}$"


def cut_tail(expr: str) -> str:
    return rx(expr, TAIL)


def norm(expr: str) -> str:
    return squeeze(f"lower({rx(cut_tail(expr), r'[^\p{L}\p{M}\p{N}\s]', ' ')})")


def words(expr: str) -> str:
    return f"list_distinct(list_filter(string_split({expr}, ' '), lambda w: length(w) > 2))"


def jaccard(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return (
        f"CASE WHEN len({a}) > 0 AND len({b}) > 0 "
        f"THEN {inter} / (len({a}) + len({b}) - {inter}) ELSE 0.0 END"
    )


def entities(expr: str) -> str:
    for code, char in lx.HTML_ENTITIES:
        expr = f"replace({expr}, {q(code)}, {q(char)})"
    return expr


def quotes(expr: str) -> str:
    return rx(expr, "^[\"'“‘]+|[\"'”’]+$")


def headline(expr: str) -> str:
    t = strip(quotes(expr))
    t = rx(rx(t, r"\s*\|\s*.*$"), SIGNED)
    t = rx(rx(t, r"^Mainstream media coverage highlights\s*", "", "i"), r"\s*as reported by.*$", "", "i")
    return strip(entities(t))


def summary(expr: str) -> str:
    t = squeeze(entities(rx(expr, "<[^>]*>?", " ")))
    return strip(rx(t, "(?:" + "|".join(lx.SUMMARY_CUT_PHRASES) + r").*$", "", "is"))


def sentence(expr: str) -> str:
    """First sentence: up to the first [.?!] followed by white space."""
    return f"coalesce(nullif(regexp_extract({expr}, '(?s)^(.*?[.?!])\\s', 1), ''), {expr})"


def tokens(expr: str) -> str:
    rate = f"CASE WHEN regexp_matches({expr}, '[\\x{{0900}}-\\x{{0D7F}}]') THEN 2.2 ELSE 3.8 END"
    return f"CAST(CASE WHEN {expr} = '' THEN 0 ELSE greatest(1, ceil(length({expr}) / ({rate})::DOUBLE)) END AS BIGINT)"


def keyword_match(text: str, kws, whole=None) -> str:
    import re

    parts = []
    for w in dict.fromkeys(k.lower().strip() for k in kws):
        esc = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", w)
        bounded = whole == "all" or (whole is None and (w in lx.WHOLE_WORD_KEYWORDS or len(w) <= 3))
        parts.append(rf"\b{esc}\b" if w.isascii() and bounded else esc)
    return f"regexp_matches(lower({text}), {q('|'.join(parts))})"


def topic(title: str, lane: str | None = None, name: str | None = None) -> str:
    cases = []
    if name:
        cases.append(f"WHEN regexp_matches(lower({name}), {q('|'.join(lx.FACT_CHECK_TAG_SOURCES))}) THEN 'Fact-Check'")
    for key, kws in lx.TOPIC_WORDS.items():
        cases.append(f"WHEN {keyword_match(title, kws)} THEN {q(key)}")
    if lane:
        cases.append(f"WHEN {lane} = 'discourse' THEN 'Discourse & Civic'")
    return "CASE " + " ".join(cases) + " ELSE 'General' END"


def region(title: str, code: str | None = None) -> str:
    cases = []
    if code:
        cases += [f"WHEN {code} = {q(k)} THEN {q(v)}" for k, v in lx.REGION_NAMES.items()]
    for name, frags in lx.REGION_TITLE_RULES:
        pat = "|".join([rf"\b{w}\b" for w in lx.REGION_WHOLE_WORDS.get(name, [])] + frags)
        cases.append(f"WHEN regexp_matches(lower({title}), {q(pat)}) THEN {q(name)}")
    return "CASE " + " ".join(cases) + f" ELSE {q(lx.DEFAULT_REGION)} END"


def valid_summary(expr: str) -> str:
    leaks = " OR ".join(f"contains(lower({expr}), {q(p)})" for p in lx.LEAK_PHRASES)
    return (
        f"coalesce(length({expr}) >= 20 AND substr({expr}, 1, 1) NOT IN ('/', '*', '#') AND NOT ({leaks}), false)"
    )


def effective_time(pub: str, fetch: str, now: str) -> str:
    """Epoch seconds; null publication uses the fetch time."""
    return (
        f"CASE WHEN {pub} IS NULL THEN CASE WHEN {fetch} IS NOT NULL THEN least({fetch}, {now}) END "
        f"WHEN {pub} <= {now} + 60 THEN {pub} WHEN {pub} - 19800 <= {now} + 60 THEN {pub} - 19800 "
        f"ELSE coalesce(least({fetch}, {now}), {now}) END"
    )


AS_OF = str(AS_OF_SECONDS)


def pick(key: str, values) -> str:
    return "CASE " + " ".join(f"WHEN {key} = {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"


view(
    "v_sources",
    f"""SELECT source_id,
      CASE WHEN source_id % 10 = 7 THEN 'Factly Desk ' || source_id ELSE 'Source ' || source_id END AS name,
      {pick('source_id % 4', ['mainstream', 'grassroots', 'discourse', 'aggregator'])} AS lane,
      {pick('source_id % 5', ['rss', 'rss', 'api', 'reddit', 'youtube'])} AS type,
      CASE WHEN source_id % 5 = 3 THEN 'https://www.reddit.com/r/' || source || '/.rss'
           ELSE 'https://' || source || '.example.com/rss' END AS feed_url,
      {pick('source_id % 4', ['en', 'fr', 'de', 'es'])} AS language,
      {pick('source_id % 5', ['national', 'maharashtra', 'kerala', 'delhi'])} AS region,
      true AS is_active
    FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS source_id FROM documents)""",
)
view(
    "v_items",
    f"""SELECT doc_id AS item_id, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS source_id,
      split_part(text, chr(10), 1) AS title,
      'https://' || source || '.example.com/' || md5(text) AS url,
      {EPOCH} + ((doc_id * 97) % {SPAN_MINUTES}) * 60 AS pub_s,
      text AS raw_summary,
      CASE WHEN doc_id % 3 = 0 THEN 'https://img.example.com/' || doc_id || '.jpg' END AS og_image,
      CASE WHEN doc_id % 9 = 0 THEN 'Dharna near ' || source || ', ' || doc_id END AS og_description,
      CASE WHEN lang <> 'en' AND doc_id % 4 = 1 THEN 'Gloss: ' || split_part(text, chr(10), 1) END AS english_gloss,
      lang AS language,
      {EPOCH} + ((doc_id * 97) % {SPAN_MINUTES}) * 60 + 300 AS fetch_s,
      ({SPAN_MINUTES} - (doc_id * 97) % {SPAN_MINUTES}) * 10000000000000 + doc_id AS ord
    FROM documents""",
)
view("v_story", f"SELECT *, md5(norm_title) AS cluster_id FROM (SELECT *, {norm('title')} AS norm_title FROM v_items)")
view(
    "v_joined",
    """SELECT i.*, s.name AS source_name, s.lane, s.type, s.region, s.language AS source_language
    FROM v_story i LEFT JOIN v_sources s USING (source_id)""",
)
view(
    "v_hubs",
    """SELECT cluster_id AS hub_id, arg_min(title, ord) AS title,
      CASE WHEN count(*) > 1 THEN arg_min(raw_summary, ord) END AS ai_summary,
      min(pub_s) AS first_s, max(pub_s) AS last_s, count(*) AS item_count
    FROM v_story GROUP BY cluster_id""",
)
view(
    "v_videos",
    """SELECT item_id, source_id, title,
      CASE WHEN item_id % 11 = 0 THEN 'https://www.youtube.com/watch?v=' || lpad(item_id::VARCHAR, 11, 'v') ELSE url END AS url,
      pub_s,
      CASE WHEN item_id % 11 = 0 AND item_id % 33 <> 0
           THEN 'Channel · 12K views · ' || (item_id % 240) || ' hours ago — ' || title ELSE raw_summary END AS raw_summary,
      fetch_s, ord,
      CASE WHEN item_id % 13 = 0 THEN 'Direct Tier-1 web extraction of a page' END AS og_description
    FROM v_items""",
)
view(
    "v_vectors",
    "SELECT vec_id AS item_id, embedding::DOUBLE[] AS embedding, label FROM embeddings",
)
view(
    "v_calls",
    """SELECT event_id, ts, event_type AS model,
      CASE WHEN length(event_type) % 2 = 0 THEN 'shared' ELSE 'single' END AS provider,
      CAST(floor(value) AS BIGINT) AS tokens, event_type = 'error' AS failed, user_id FROM events""",
)
view(
    "v_subscribers",
    """SELECT c_custkey AS subscriber_id, lower(c_name) || '@example.com' AS email,
      c_custkey % 10 <> 0 AS is_active, md5(c_name) AS unsubscribe_token, last_sent_at
    FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_sent_at FROM orders GROUP BY 1) o
      ON c_custkey = o_custkey""",
)
view(
    "v_sends",
    """SELECT o_orderkey AS send_id, o_orderdate AS sent_at,
      CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'partial' ELSE 'sent' END AS status,
      CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 7 END AS gmail_count,
      CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 11 END AS brevo_count,
      CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 13 END AS resend_count,
      CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 END AS map_gmail,
      CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 4 END AS map_ses
    FROM orders""",
)
