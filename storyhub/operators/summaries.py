"""Summary repair, carry-over and work plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyhub.functions import media, text, times, topics
from storyhub.operators.ranking import lane_balanced


def repair_summaries(hubs: DataFrame) -> DataFrame:
    """Mark bad stored summaries; `emptied` drops them, `replaced` puts the
    cleaned headline in their place."""
    bad = text.is_bad_summary("ai_summary")
    return (
        hubs.withColumn("bad", bad)
        .withColumn("emptied", F.when(~F.col("bad"), F.col("ai_summary")))
        .withColumn("replaced", F.when(F.col("bad"), text.clean_headline("title")).otherwise(F.col("ai_summary")))
    )


def title_key(title="title"):
    return F.lower(text.strip(F.col(title)))


def carry_over(made: DataFrame, stored: DataFrame, cached: DataFrame, as_of, hours: float = 48, newest: int | None = None) -> DataFrame:
    """Give re-made hubs the valid summary an earlier hub of the same title
    had: stored ones of the last hours (the oldest of a title wins, after an
    optional cut to the newest), then cached ones (the first wins)."""
    recent = stored.filter(
        text.is_valid_summary("ai_summary") & (F.col("last_updated_at") >= times.hours_before(as_of, hours))
    )
    if newest is not None:
        recent = recent.orderBy(F.col("last_updated_at").desc(), F.col("hub_id")).limit(newest)
    order = F.struct(F.col("last_updated_at"), F.col("hub_id"))
    by_title = recent.groupBy(title_key().alias("__key")).agg(F.min_by("ai_summary", order).alias("__stored"))
    from_cache = (
        cached.filter(text.is_valid_summary("ai_summary"))
        .groupBy(title_key().alias("__key"))
        .agg(F.min_by("ai_summary", "ord").alias("__cached"))
    )
    return (
        made.withColumn("__key", title_key())
        .join(by_title, "__key", "left")
        .join(from_cache, "__key", "left")
        .withColumn("ai_summary", F.coalesce("ai_summary", "__stored", "__cached"))
        .drop("__key", "__stored", "__cached")
    )


def cache_lookup(asked: DataFrame, cache: DataFrame, as_of) -> DataFrame:
    """Add `cached_text` from live cache rows; null is a miss."""
    live = (
        cache.filter(F.col("expires_at") > times.as_ts(as_of))
        .groupBy("content_hash")
        .agg(F.min_by("text", "ord").alias("cached_text"))
    )
    return asked.join(live, "content_hash", "left")


def summarising_order(hubs: DataFrame, as_of, hours: float = 48) -> DataFrame:
    return hubs.filter(F.col("last_updated_at") >= times.hours_before(as_of, hours)).orderBy(
        F.col("item_count").desc(), F.col("hub_id")
    )


def hub_status():
    """valid / multi / single, the split a summarising run starts from."""
    own = text.strip(F.coalesce("ai_summary", F.lit("")))
    multi = F.when(text.is_valid_summary(own), "valid").otherwise("multi")
    single = F.when(F.length(own) > 10, "valid").otherwise("single")
    return F.when(F.col("item_count") > 1, multi).otherwise(single)


PROMPT_VERSION = "v2.2-compact"
SYSTEM_PROMPT = (
    "Neutral news editor. Write a 1-2 sentence factual briefing (<=35 words) strictly from the reports. "
    "Plain English, no source names, no quotes, no invented facts."
)


def told(items: DataFrame, with_page: bool = False) -> Column:
    """What an item says: title, gloss and summary; the protest check reads the
    page's description as well."""
    names = ["title", "english_gloss", "raw_summary", *(["og_description"] if with_page else [])]
    return F.concat_ws(" ", *[c for c in names if c in items.columns])


def _with_excerpt(prompts: DataFrame, items: DataFrame, pages: DataFrame, sparse: int = 220, length: int = 650) -> DataFrame:
    """Sparse prompts with the start of the first item's article."""
    first = items.groupBy("hub_id").agg(F.min_by("url", "ord").alias("url"))
    article = media.article_text("html", "url").alias("article")
    asked = prompts.filter(F.length("prompt") < sparse).join(first, "hub_id").join(pages, "url").select("hub_id", article)
    excerpt = F.substring(text.prompt_text("article"), 1, length)
    asked = asked.filter("article IS NOT NULL").select("hub_id", F.concat(F.lit("\nExcerpt: "), excerpt).alias("__excerpt"))
    out = prompts.join(asked, "hub_id", "left")
    return out.withColumn("prompt", F.concat("prompt", F.coalesce("__excerpt", F.lit("")))).drop("__excerpt")


def summary_plan(
    hubs: DataFrame,
    items: DataFrame,
    cache: DataFrame,
    as_of,
    hours: float = 48,
    version: str = PROMPT_VERSION,
    system: str = SYSTEM_PROMPT,
    chunk_above: int = 850,
    pages: DataFrame | None = None,
) -> DataFrame:
    """Work plan up to the model call: status, fallback, prompt, chunks, hash.

    With `pages` (url, html; the landed articles), reports of under 220
    characters get an excerpt of the first item's article.

    Whole-hub facts are aggregates; only the six chosen items of a hub are ever
    listed, so a hub of any size costs a bounded row.
    """
    recent = hubs.filter(F.col("last_updated_at") >= times.hours_before(as_of, hours))
    mine = items.filter(F.col("published_at") >= times.hours_before(as_of, hours)).withColumnRenamed("cluster_id", "hub_id")
    snippet = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("raw_summary", "og_description") if c in items.columns])
    # Only what is told of a text is sorted and shuffled, never the text.
    told_of = mine.select(
        "hub_id",
        "ord",
        topics.is_sensitive(told(mine)).alias("sensitive"),
        topics.is_protest(told(mine, with_page=True)).alias("protest"),
        F.when(snippet.isNotNull(), text.clean_summary_start(snippet, 180)).alias("lead"),
    )
    facts = told_of.groupBy("hub_id").agg(
        F.count("*").alias("items"),
        F.bool_or("sensitive").alias("sensitive"),
        F.bool_or("protest").alias("protest"),
        F.min_by("lead", F.when(F.col("lead").isNotNull(), F.col("ord"))).alias("lead"),
    )
    lines = mine.select("hub_id", "lane", "ord", text.report_line("title", "raw_summary").alias("line"))
    prompts = (
        lane_balanced(lines, hub="hub_id")
        .groupBy("hub_id")
        .agg(F.sort_array(F.collect_list(F.struct("position", "line"))).alias("l"))
        .select("hub_id", text.prompt_text(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("prompt"))
    )
    if pages is not None:
        prompts = _with_excerpt(prompts, mine, pages)
    plan = recent.select("hub_id", "title").join(facts, "hub_id", "left").join(prompts, "hub_id", "left")
    n, lead = F.coalesce("items", F.lit(0)), F.coalesce("lead", F.lit(""))
    flagged = F.coalesce("sensitive", F.lit(False)) | topics.is_sensitive(F.col("title"))
    trivial = (n == 0) | ((n == 1) & (F.length(lead) < 40))
    tokens = text.estimate_tokens("prompt")
    plan = (
        plan.withColumn("is_protest", F.coalesce("protest", F.lit(False)) | topics.is_protest("title"))
        .withColumn("fallback", F.when(flagged, text.clean_headline("title")).otherwise(text.fallback_of_clean("title", lead)))
        .withColumn("tokens", tokens)
        .withColumn("job", F.when(tokens > 2000, "long_input").otherwise("short_medium"))
        .withColumn("content_hash", text.content_hash(F.lit(version), "job", F.lit(system), "prompt"))
        .withColumn("chunks", F.when(F.col("tokens") > chunk_above, text.sentence_chunks("prompt", max_chunks=4)))
    )
    found = cache_lookup(plan, cache, as_of)
    status = (
        F.when(flagged, "flagged")
        .when(trivial, "trivial_bypass")
        .when(F.col("cached_text").isNotNull() & F.col("chunks").isNull(), "cached")
        .otherwise("to_generate")
    )
    return found.withColumn("status", status).select(
        "hub_id", "status", "is_protest", "fallback", "prompt", "tokens", "job", "content_hash", "chunks", "cached_text"
    )


def drop_embedding(hubs: DataFrame, items: str | None = "items") -> DataFrame:
    """Take the vector out of a flat frame, or out of nested items."""
    out = hubs.drop("embedding")
    if items in out.columns:
        out = out.withColumn(items, F.transform(items, lambda x: x.dropFields("embedding")))
    return out
