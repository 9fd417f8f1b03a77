"""Hub, lane, source and time rollups.

Every rollup is a plain `groupBy().agg()`: partial aggregation runs before the
shuffle, so a hub or source with a third of all rows costs each task one row.
Lists are built only from values already reduced to a few per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyhub.functions import text, times
from storyhub.functions.text import col
from storyhub.operators.ranking import LANE_ORDER, first_n


def lane_count_columns(lane="lane", aggregator_as: str | None = None) -> list[Column]:
    """Counts per lane. `aggregator_as` names the lane aggregator items count
    in: None counts them in no lane, "mainstream" as the front page does."""
    out = []
    for name in LANE_ORDER:
        names = [name, "aggregator"] if aggregator_as == name else [name]
        out.append(F.count_if(col(lane).isin(*names)).alias(f"{name}_count"))
    return out


def lane_counts(items: DataFrame, hub="cluster_id", aggregator_as=None) -> DataFrame:
    return items.groupBy(hub).agg(F.count("*").alias("item_count"), *lane_count_columns(aggregator_as=aggregator_as))


def hub_times(items: DataFrame, as_of, hub="cluster_id") -> DataFrame:
    """First and last effective item time of a hub; `as_of` when no item has one."""
    when = times.effective_time("published_at", "fetched_at", as_of)
    return items.groupBy(hub).agg(
        F.coalesce(F.min(when), times.as_ts(as_of)).alias("first_seen_at"),
        F.coalesce(F.max(when), times.as_ts(as_of)).alias("last_updated_at"),
    )


def hub_languages(items: DataFrame, hub="cluster_id", language="language", order="ord") -> DataFrame:
    """Distinct languages of a hub in first-seen order. The first aggregation
    leaves one row per hub and language, so the list is short."""
    per_language = items.groupBy(hub, language).agg(F.min(order).alias("__ord"))
    listed = per_language.groupBy(hub).agg(F.sort_array(F.collect_list(F.struct("__ord", language))).alias("__l"))
    return listed.select(hub, F.transform("__l", lambda x: x[language]).alias("languages"))


def hub_cards(items: DataFrame, as_of, hub="cluster_id", order="ord") -> DataFrame:
    """Front-page columns of a hub in one pass: lane split, publisher count,
    times, first image and the picks that go with it, syndication flag."""
    lane = F.coalesce("lane", F.lit("mainstream"))
    name = F.coalesce("source_name", F.lit("Unknown"))
    language = F.coalesce("language", F.lit("en"))
    has_image = F.col("og_image").isNotNull()
    gloss = F.nullif(F.col("english_gloss"), F.lit("")) if "english_gloss" in items.columns else None
    regional = F.col("region").isNotNull() & (F.col("region") != "national")
    when = times.effective_time("published_at", "fetched_at", as_of)

    def first(value, where=None):
        expr = F.min_by(value, F.col(order) if where is None else F.when(where, F.col(order)))
        return expr

    agg = items.groupBy(hub).agg(
        F.count("*").alias("item_count"),
        first(F.col("title")).alias("title"),
        *lane_count_columns(lane, aggregator_as="mainstream"),
        F.countDistinct(name).alias("__names"),
        F.min(when).alias("first_seen_at"),
        F.max(when).alias("last_updated_at"),
        first(F.col("og_image"), has_image).alias("og_image"),
        F.coalesce(first(name, has_image), first(name)).alias("first_source_name"),
        F.coalesce(first(F.col("region"), regional), first(F.col("region"))).alias("source_region"),
        F.coalesce(first(language, has_image), first(language)).alias("language"),
        *([first(gloss, gloss.isNotNull()).alias("english_gloss")] if "english_gloss" in items.columns else []),
        F.bool_or(F.coalesce(F.contains("url", F.lit("news.google.com")), F.lit(False))).alias("via_google_news"),
    )
    unlaned = (F.col("mainstream_count") + F.col("grassroots_count") + F.col("discourse_count")) == 0
    agg = agg.withColumn(
        "mainstream_count", F.when(unlaned, F.col("item_count")).otherwise(F.col("mainstream_count"))
    )
    laned = F.col("mainstream_count") + F.col("grassroots_count") + F.col("discourse_count")
    return (
        agg.withColumn("source_count", F.greatest(F.col("__names"), laned, F.lit(1)))
        .withColumn("first_seen_at", F.coalesce("first_seen_at", times.as_ts(as_of)))
        .withColumn("last_updated_at", F.coalesce("last_updated_at", times.as_ts(as_of)))
        .drop("__names")
    )


def publisher_key(name="source_name", url="url") -> Column:
    """Lower-cased publisher name, else url host, else the url."""
    own = F.nullif(F.trim(F.coalesce(col(name), F.lit(""))), F.lit(""))
    return F.coalesce(F.lower(own), text.url_host(url), col(url))


def publishers(items: DataFrame, hub="cluster_id", approximate: bool = False) -> DataFrame:
    """Distinct publishers and lanes per hub; exact unless asked otherwise."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    lane = F.lower(F.nullif(F.trim("lane"), F.lit("")))
    return items.groupBy(hub).agg(
        count(publisher_key()).alias("publisher_count"), F.count_distinct(lane).alias("lane_count")
    )


def coverage_split(counts: DataFrame) -> DataFrame:
    """Rounded share of each lane in percent, 0 without items."""
    cols = [f"{lane}_count" for lane in LANE_ORDER]
    total = sum((F.col(c) for c in cols), F.lit(0))
    for lane, c in zip(LANE_ORDER, cols):
        share = F.when(total > 0, F.round(F.lit(100) * F.col(c) / total)).otherwise(F.lit(0))
        counts = counts.withColumn(f"{lane}_pct", share.cast("int"))
    return counts


def category_counts(items: DataFrame, category="category") -> DataFrame:
    return items.groupBy(category).agg(F.count("*").alias("item_count"))


def source_health(sources: DataFrame, items: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """Items per source with zeros kept, and the outcome of the last attempt."""
    counts = items.groupBy("source_id").agg(F.count("*").alias("article_count"))
    out = sources.join(counts, "source_id", "left").withColumn("article_count", F.coalesce("article_count", F.lit(0)))
    if attempts is None:
        return out
    return (
        out.join(attempts.select("source_id", F.col("error").alias("__error")), "source_id", "left")
        .withColumn("last_status", F.when(F.col("__error").isNull(), "healthy").otherwise("error"))
        .withColumn("last_error", F.substring("__error", 1, 500))
        .drop("__error")
    )


def total_counts(sources: DataFrame, items: DataFrame, hubs: DataFrame) -> DataFrame:
    """One row of totals; each side is reduced to one row before they meet."""
    s = sources.agg(F.count("*").alias("sources"))
    i = items.agg(F.count("*").alias("items"))
    h = hubs.agg(
        F.count("*").alias("hubs"),
        F.count_if(F.col("item_count") >= 2).alias("hubs_with_2"),
        F.count_if(F.col("item_count") >= 3).alias("hubs_with_3"),
    )
    rows = s.unionByName(i, allowMissingColumns=True).unionByName(h, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def story_cards(hubs: DataFrame, items: DataFrame, site: str, hub="cluster_id", order="ord") -> DataFrame:
    """Digest cards: first image, first three source names in order, count, link."""
    per_name = items.filter("source_name IS NOT NULL").groupBy(hub, "source_name").agg(F.min(order).alias("__ord"))
    names = (
        first_n(per_name, hub, "__ord", 3)
        .groupBy(hub)
        .agg(F.sort_array(F.collect_list(F.struct("__ord", "source_name"))).alias("__n"))
        .select(hub, F.transform("__n", lambda x: x["source_name"]).alias("source_names"))
    )
    facts = items.groupBy(hub).agg(
        F.min_by("og_image", F.when(F.col("og_image").isNotNull(), F.col(order))).alias("image"),
        F.count("*").alias("total_sources"),
    )
    link = F.concat(F.lit(site.rstrip("/") + "/hub/"), text.uri_component(F.col("hub_id")))
    return (
        hubs.join(facts.withColumnRenamed(hub, "hub_id"), "hub_id", "left")
        .join(names.withColumnRenamed(hub, "hub_id"), "hub_id", "left")
        .withColumn("hub_url", link)
    )


def hub_text_rows(hubs: DataFrame, items: DataFrame, hub="cluster_id") -> DataFrame:
    """Document of a hub as ordered rows: its title, then one row per item.
    Kept flat so that a hub of any size spreads over tasks."""
    head = hubs.select("hub_id", F.lit(0).cast("bigint").alias("ord"), F.col("title").alias("body"))
    parts = [c for c in ("title", "english_gloss", "raw_summary", "og_description") if c in items.columns]
    body = items.select(F.col(hub).alias("hub_id"), "ord", F.concat_ws(" ", *parts).alias("body"))
    return head.unionByName(body)


def sends_today(log: DataFrame, as_of, providers=("gmail", "brevo", "resend")) -> DataFrame:
    """Sends per provider since midnight in India. The three columns count
    where present; the map counts only in rows that lack the columns."""
    today = log.filter(F.col("sent_at") >= times.ist_day_start(as_of))
    fixed = F.array(
        *[F.struct(F.lit(p).alias("provider"), F.col(f"{p}_count").cast("bigint").alias("n")) for p in providers]
    )
    legacy = F.transform(
        F.map_entries("provider_counts"),
        lambda e: F.struct(e["key"].alias("provider"), e["value"].cast("bigint").alias("n")),
    )
    has_columns = F.coalesce(*[F.col(f"{p}_count") for p in providers]).isNotNull()
    rows = today.select(F.inline(F.when(has_columns, fixed).otherwise(legacy)))
    return rows.groupBy("provider").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sent"))
