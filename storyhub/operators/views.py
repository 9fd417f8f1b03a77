"""Read path: item normalising, joins of hubs and items, filters, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyhub.functions import lexicon as lx
from storyhub.functions import text, times, topics
from storyhub.functions.text import col, contains_any
from storyhub.operators.ranking import first_n, top_n
from storyhub.operators.rollups import hub_cards, hub_languages
from storyhub.operators.running import running_totals
from storyhub.session import materialize

FACT_CHECK_QUERIES = ["fact check", "fact-check", "factcheck"]


def join_sources(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Left join on the source. No broadcast is forced: Spark broadcasts the
    source side when its measured size is under the threshold and otherwise
    shuffles, with AQE splitting a source that holds too many rows."""
    s = sources.select(
        "source_id", F.col("name").alias("source_name"), "lane", "type", "region",
        F.col("language").alias("source_language"),
    )
    return items.join(s, "source_id", "left")


def normalize_items(items: DataFrame) -> DataFrame:
    """Flatten the joined source (array `sources` or struct `source`), fill
    defaults, derive the syndication flag."""
    src = F.coalesce(F.get(F.col("sources"), F.lit(0)), F.col("source"))
    flag = F.coalesce(F.col("via_google_news"), F.lit(False)) | F.coalesce(
        F.contains("url", F.lit("news.google.com")), F.lit(False)
    )
    return (
        items.withColumn("__src", src)
        .withColumn("lane", F.coalesce("__src.lane", "lane", F.lit("mainstream")))
        .withColumn("source_name", F.coalesce("__src.name", "source_name", F.lit("Unknown")))
        .withColumn("language", F.coalesce("__src.language", "language", F.lit("en")))
        .withColumn("region", F.col("__src.region"))
        .withColumn("via_google_news", flag)
        .drop("__src", "sources", "source")
    )


def fold_lane(lane="lane") -> Column:
    """Hub view: only grassroots and discourse keep their lane."""
    low = F.lower(col(lane))
    return F.when(low.isin("grassroots", "discourse"), low).otherwise("mainstream")


def attach_items(hubs: DataFrame, items: DataFrame) -> DataFrame:
    """Hubs with their items, one row per item; hubs without items drop out."""
    cols = [c for c in items.columns if c not in ("cluster_id",)]
    i = items.select(F.col("cluster_id").alias("hub_id"), *[F.col(c).alias(f"item_{c}" if c in hubs.columns else c) for c in cols])
    return hubs.join(i, "hub_id")


def nest_items(items: DataFrame, page: int, hub="cluster_id", order="ord", fields=("item_id", "title", "url")) -> DataFrame:
    """All items of each hub in order, as arrays of at most `page` structs: (hub, page, items).

    Places come from a range sort over all items, so neither a task nor a row ever holds a whole hub."""
    slim = items.select(hub, order, *fields, F.lit(1).cast("bigint").alias("__one"))
    placed = running_totals(materialize(slim), [hub, order], ["__one"]).withColumnRenamed("before___one", "__at")
    first = placed.groupBy(hub).agg(F.min("__at").alias("__first"))
    paged = placed.join(first, hub).withColumn("page", F.floor((F.col("__at") - F.col("__first")) / F.lit(page)))
    return paged.groupBy(hub, "page").agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias("items"))


def hub_with_items(hubs: DataFrame, items: DataFrame, hub_id: str, limit: int | None = None) -> DataFrame:
    """One hub and its items, newest first; both filters reach the scan."""
    h = hubs.filter(F.col("hub_id") == hub_id)
    i = items.filter(F.col("cluster_id") == hub_id)
    return top_n(attach_items(h, i), [F.col("published_at").desc(), F.col("item_id")], limit)


def items_of_hubs(items: DataFrame, hub_ids: DataFrame) -> DataFrame:
    keys = hub_ids.select(F.col("hub_id").alias("cluster_id"))
    return items.join(keys, "cluster_id", "left_semi")


def front_page(hubs: DataFrame, items: DataFrame, as_of) -> DataFrame:
    """View model of the front page: hub, card columns, languages, topic, region."""
    cards = hub_cards(items, as_of).withColumnRenamed("cluster_id", "hub_id").drop("title")
    langs = hub_languages(items).withColumnRenamed("cluster_id", "hub_id")
    page = hubs.select("hub_id", "title", "ai_summary").join(cards, "hub_id").join(langs, "hub_id")
    return page.withColumn("topic", topics.topic_of("title")).withColumn(
        "region", topics.region_of("title", "source_region")
    )


def fallback_hubs(items: DataFrame, limit: int = 60) -> DataFrame:
    """One hub per item, for when no hub matches."""
    return top_n(items, [F.col("ord")], limit).select(
        F.coalesce("cluster_id", F.col("item_id").cast("string")).alias("hub_id"),
        "title",
        F.coalesce("raw_summary", "title").alias("ai_summary"),
        F.col("published_at").alias("first_seen_at"),
        F.col("published_at").alias("last_updated_at"),
        F.lit(1).cast("bigint").alias("item_count"),
    )


def fact_check_items(items: DataFrame, limit: int | None = 3) -> DataFrame:
    hit = contains_any(F.lower(F.coalesce("source_name", F.lit(""))), lx.FACT_CHECK_LIST_SOURCES)
    return top_n(items.filter(hit), [F.col("ord")], limit)


def _keyword_hit(searchable: Column, asked: str) -> Column:
    """Hit of any keyword of the topics the query names."""
    words = [
        w for name, kws in lx.TOPIC_WORDS.items()
        if asked in name.lower() or name.lower() in asked for w in kws
    ]
    return F.lower(searchable).rlike(topics.keyword_pattern(words, whole="none")) if words else F.lit(False)


def _both_ways(column, asked: str) -> Column:
    low = F.lower(col(column))
    return F.contains(low, F.lit(asked)) | F.contains(F.lit(asked), low)


def matches_query(q: str) -> Column:
    """Free-text filter of the front page."""
    asked = q.strip().lower()
    title = F.lower("title")
    source = F.lower(F.coalesce("first_source_name", F.lit("")))
    hit = (
        F.contains(title, F.lit(asked))
        | F.coalesce(F.contains(F.lower("ai_summary"), F.lit(asked)), F.lit(False))
        | F.contains(source, F.lit(asked))
        | _both_ways("topic", asked)
        | _keyword_hit(F.concat_ws(" ", "title", "ai_summary"), asked)
        | _both_ways("region", asked)
    )
    if asked in FACT_CHECK_QUERIES:
        hit = hit | contains_any(source, lx.FACT_CHECK_FILTER_SOURCES) | contains_any(title, lx.FACT_CHECK_TITLE_PHRASES)
    return hit


def matches_topic(topic: str) -> Column:
    asked = topic.lower()
    return (
        F.contains(F.lower("topic"), F.lit(asked))
        | F.contains(F.lower("title"), F.lit(asked))
        | _keyword_hit(F.col("title"), asked)
    )


def matches_language(code: str) -> Column:
    low = code.lower()
    return F.coalesce(F.lower("language") == low, F.lit(False)) | F.exists("languages", lambda x: F.lower(x) == low)


def filter_front_page(page: DataFrame, q: str = "", topic: str = "", language: str = "all") -> DataFrame:
    if q.strip():
        page = page.filter(matches_query(q))
    if topic and topic != "All":
        page = page.filter(matches_topic(topic))
    if language and language.lower() != "all":
        page = page.filter(matches_language(language))
    return page


def filter_hubs_by_items(hubs: DataFrame, items: DataFrame, q: str = "", topic: str = "All") -> DataFrame:
    """Older filter: title, summary, or any item title or source; items are
    filtered first, so only the keys of hits are shuffled."""
    out = hubs
    if q.strip():
        asked = F.lit(q.lower())
        hits = (
            items.filter(
                F.contains(F.lower("title"), asked)
                | F.coalesce(F.contains(F.lower("source_name"), asked), F.lit(False))
            )
            .select(F.col("cluster_id").alias("hub_id"), F.lit(True).alias("__item_hit"))
            .distinct()
        )
        out = (
            out.join(hits, "hub_id", "left")
            .filter(
                F.coalesce("__item_hit", F.lit(False))
                | F.contains(F.lower("title"), asked)
                | F.coalesce(F.contains(F.lower("ai_summary"), asked), F.lit(False))
            )
            .drop("__item_hit")
        )
    if topic != "All":
        out = out.filter(F.contains(F.lower("title"), F.lit(topic.lower())))
    return out


def search(hubs: DataFrame, items: DataFrame, q: str, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """Search of hubs and items; `%` and `_` act as wildcards."""
    asked, n = q.strip(), min(limit, 50)
    pattern = f"%{asked}%"
    if not asked:
        return hubs.limit(0), items.limit(0)
    hub_hits = hubs.filter(F.col("title").ilike(pattern) | F.coalesce(F.col("ai_summary").ilike(pattern), F.lit(False)))
    if asked.lower() in FACT_CHECK_QUERIES:
        hit = F.col("title").ilike("%fact check%") | F.col("title").ilike("%fact-check%")
    else:
        hit = F.col("title").ilike(pattern)
    return (
        top_n(hub_hits, [F.col("last_updated_at").desc(), F.col("hub_id")], n),
        top_n(items.filter(hit), [F.col("published_at").desc(), F.col("item_id")], n),
    )


def topic_sections(page: DataFrame, shown: int = 3, less: int = 2, topics_map=None) -> DataFrame:
    """Per topic the latest hubs and the least covered ones.

    Each hub is exploded to the topics its title names plus "*" (all hubs);
    every window keeps a handful of rows per topic, so the fall-back to all
    hubs and the exclusion of shown hubs work on a few dozen rows.
    """
    topics_map = topics_map or {n: lx.TOPIC_WORDS.get(n, [n.lower()]) for n in lx.SECTION_NAMES}
    low = F.lower("title")
    hits = [
        F.when(low.rlike(topics.keyword_pattern(words, whole="none")), F.lit(name))
        for name, words in topics_map.items()
    ]
    any_word = topics.keyword_pattern([w for words in topics_map.values() for w in words], whole="none")
    lanes = sum(
        ((F.col(c) > 0).cast("int") for c in ("mainstream_count", "grassroots_count", "discourse_count")), F.lit(0)
    )
    rows = page.select(
        "hub_id", "title", "source_count", "last_updated_at", lanes.alias("__lanes"),
        F.explode(F.when(low.rlike(any_word), F.array_compact(F.array(*hits, F.lit("*")))).otherwise(F.array(F.lit("*")))).alias("section"),
    )
    # Read five times below; the page behind it is computed once.
    rows = materialize(rows)
    counts = rows.groupBy("section").agg(F.count("*").alias("__n"))
    names = page.sparkSession.createDataFrame([(n,) for n in topics_map], "name string")
    sizes = names.join(counts, names.name == counts.section, "left").select(
        "name", F.coalesce("__n", F.lit(0)).alias("__n")
    )
    newest = [F.col("last_updated_at").desc(), F.col("hub_id")]
    sparse = [F.col("source_count").asc(), F.col("__lanes").asc(), *newest]
    latest = first_n(rows, "section", newest, shown, rank="position")
    scarce = first_n(rows, "section", sparse, shown + less, rank="position")
    show_from = sizes.select("name", F.when(F.col("__n") >= shown, F.col("name")).otherwise("*").alias("section"))
    less_from = sizes.select("name", F.when(F.col("__n") > 0, F.col("name")).otherwise("*").alias("section"))
    display = show_from.join(latest, "section").select(
        "name", F.lit("latest").alias("part"), "position", "hub_id", "title"
    )
    pool = less_from.join(scarce, "section").select("name", "position", "hub_id", "title")
    fresh = pool.join(display.select("name", "hub_id"), ["name", "hub_id"], "left_anti")
    enough = fresh.groupBy("name").agg(F.count("*").alias("__left"))
    fresh = first_n(fresh, "name", "position", less, rank="place")
    plain = first_n(pool, "name", "position", less, rank="place")
    left = F.coalesce("__left", F.lit(0))
    chosen = (
        fresh.join(enough, "name").filter(left >= less)
        .unionByName(plain.join(enough, "name", "left").filter(left < less))
        .select("name", F.lit("less covered").alias("part"), F.col("place").alias("position"), "hub_id", "title")
    )
    return display.unionByName(chosen).withColumnRenamed("name", "section")


def freshness(items: DataFrame, as_of, hours: float = 48, video_hours: float = 168) -> DataFrame:
    """Status `kept`, `purged` (to be deleted) or `stale` for every item, with
    the repaired publication time of videos."""
    now = times.as_ts(as_of)
    marker = F.nullif(F.regexp_extract("raw_summary", r"(?i)·(?U)\s*([^·]+ago)\s*—", 1), F.lit(""))
    anchor = F.coalesce("fetched_at", now)
    is_static = F.coalesce(F.startswith("og_description", F.lit("Direct Tier-1 web extraction")), F.lit(False))
    is_video = F.coalesce(F.contains("url", F.lit("youtube.com")), F.lit(False))
    if "type" in items.columns:
        is_video = is_video | F.coalesce(F.col("type") == "youtube", F.lit(False))
    repaired = times.relative_time(marker, anchor)
    published = F.when(is_video, repaired).otherwise(F.col("published_at"))
    status = (
        F.when(is_static, "purged")
        .when(is_video, F.when(F.coalesce(repaired >= times.hours_before(now, video_hours), F.lit(False)), "kept").otherwise("purged"))
        .when(F.coalesce(F.col("published_at") >= times.hours_before(now, hours), F.lit(False)), "kept")
        .otherwise("stale")
    )
    return items.withColumn("status", status).withColumn("published_at", published)
