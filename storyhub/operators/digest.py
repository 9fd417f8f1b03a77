"""Daily digest: candidates, ranking, diversified pick, recipients, split.

Every edition date is worked at once. Candidate lists are top-k reports (40 and
60 hubs per edition), so the one Python step sees at most 100 short rows per
edition; items never enter it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyhub.functions import text, times
from storyhub.operators.ranking import first_n, top_n
from storyhub.operators.rollups import publisher_key


def candidate_hubs(hubs: DataFrame, as_of, fallback: bool = False, hours: float | None = None, limit: int | None = None) -> DataFrame:
    """24 h and the biggest 40, or 36 h and the latest 60."""
    hours = hours or (36 if fallback else 24)
    limit = limit or (60 if fallback else 40)
    order = F.col("last_updated_at").desc() if fallback else F.col("item_count").desc()
    return top_n(hubs.filter(F.col("last_updated_at") >= times.hours_before(as_of, hours)), [order, F.col("hub_id")], limit)


def edition_candidates(hubs: DataFrame, send_hour: int = 2, primary_hours: int = 24, fallback_hours: int = 36, primary_limit: int = 40, fallback_limit: int = 60) -> DataFrame:
    """Candidates of every edition a hub can be in. The edition of a day goes
    out at `send_hour` UTC; a hub names its own editions, so no join is needed."""
    hour = F.expr(f"INTERVAL {send_hour} HOUR")
    first_day = F.date_trunc("DAY", F.col("last_updated_at") - hour)
    # Editions sent at or after the last update and within the longer window.
    days = F.sequence(first_day, F.col("last_updated_at") + F.expr(f"INTERVAL {fallback_hours} HOUR"), F.expr("INTERVAL 1 DAY"))
    rows = (
        hubs.select("hub_id", "title", "last_updated_at", "item_count", F.explode(days).alias("__day"))
        .withColumn("as_of", F.col("__day") + hour)
        .filter(
            (F.col("as_of") >= F.col("last_updated_at"))
            & (F.col("last_updated_at") >= times.hours_before(F.col("as_of"), fallback_hours))
        )
        .withColumn("edition", F.to_date("as_of"))
    )
    in_primary = F.col("last_updated_at") >= times.hours_before(F.col("as_of"), primary_hours)
    big = first_n(rows.filter(in_primary), "edition", [F.col("item_count").desc(), F.col("hub_id")], primary_limit, "__p")
    late = first_n(rows, "edition", [F.col("last_updated_at").desc(), F.col("hub_id")], fallback_limit, "__f")
    keys = ["edition", "as_of", "hub_id", "title"]
    both = big.select(*keys, "__p", F.lit(None).cast("int").alias("__f")).unionByName(
        late.select(*keys, F.lit(None).cast("int").alias("__p"), "__f")
    )
    return both.groupBy(*keys).agg(F.max("__p").alias("primary_rank"), F.max("__f").alias("fallback_rank"))


def rank_candidates(candidates: DataFrame, items: DataFrame, max_age_hours: int = 36) -> DataFrame:
    """Publishers, lanes and fresh items of each candidate; hubs without fresh
    items drop out. A missing item time counts as stale here."""
    i = items.select(
        F.col("cluster_id").alias("hub_id"), "published_at", publisher_key().alias("__pub"), F.lower("lane").alias("__lane"), "url"
    )
    fresh = candidates.join(i, "hub_id").filter(F.col("published_at") >= times.hours_before(F.col("as_of"), max_age_hours))
    keys = ["edition", "hub_id", "title", "primary_rank", "fallback_rank"]
    return fresh.groupBy(*keys).agg(
        F.count_distinct("__pub").alias("publishers"),
        F.count_distinct("__lane").alias("lanes"),
        F.count("*").alias("fresh_items"),
    )


def shared_urls(candidates: DataFrame, items: DataFrame, max_age_hours: int = 36) -> DataFrame:
    """Pairs of candidates of one edition that share a fresh url. A url meets
    at most the candidates of its edition, which the top-k bounds."""
    i = items.filter("url IS NOT NULL").select(F.col("cluster_id").alias("hub_id"), "published_at", "url")
    fresh = candidates.join(i, "hub_id").filter(F.col("published_at") >= times.hours_before(F.col("as_of"), max_age_hours))
    holders = fresh.groupBy("edition", "url").agg(F.collect_set("hub_id").alias("hubs")).filter(F.size("hubs") > 1)
    return (
        holders.select("edition", F.explode("hubs").alias("hub_id"), "hubs")
        .select("edition", "hub_id", F.explode("hubs").alias("other"))
        .filter("hub_id <> other")
        .groupBy("edition", "hub_id")
        .agg(F.sort_array(F.collect_set("other")).alias("overlaps"))
    )


def pick_stories(ranked: pd.DataFrame, stage: str, count: int, min_publishers: int, max_overlap: float) -> list:
    """Take hubs in rank order unless they repeat a taken title or url."""
    order = "primary_rank" if stage == "primary" else "merged_rank"
    rows = ranked[ranked[order].notna()] if stage == "primary" else ranked
    rows = rows.sort_values(
        ["publishers", "lanes", "fresh_items", order], ascending=[False, False, False, True], kind="stable"
    )
    taken = []
    for row in rows.itertuples():
        if len(taken) >= count:
            break
        if row.publishers < min_publishers or not row.title.strip():
            continue
        words = set(row.words)
        clash = False
        for other in taken:
            theirs = set(other.words)
            union = len(words | theirs)
            overlap = len(words & theirs) / union if words and theirs else 0.0
            if row.norm == other.norm or overlap >= max_overlap or other.hub_id in row.overlaps:
                clash = True
                break
        if not clash:
            taken.append(row)
    return taken


def select_digest(
    hubs: DataFrame, items: DataFrame, send_hour: int = 2, count: int = 3, max_age_hours: int = 36, max_title_overlap: float = 0.35
) -> DataFrame:
    """Stories of every edition: 24 h with two publishers, else 36 h with two,
    else 36 h with one."""
    candidates = edition_candidates(hubs, send_hour)
    ranked = rank_candidates(candidates, items, max_age_hours)
    rows = (
        ranked.join(shared_urls(candidates, items, max_age_hours), ["edition", "hub_id"], "left")
        .withColumn("overlaps", F.coalesce("overlaps", F.array().cast("array<string>")))
        .withColumn("norm", text.normalize_title("title"))
        .withColumn("words", text.title_words("norm"))
        .withColumn("merged_rank", F.coalesce(F.col("primary_rank"), F.lit(1000) + F.col("fallback_rank")))
    )

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        for stage, publishers in (("primary", 2), ("wide", 2), ("single", 1)):
            taken = pick_stories(pdf, stage, count, publishers, max_title_overlap)
            if len(taken) >= count or stage == "single":
                break
        return pd.DataFrame(
            [(r.edition, i + 1, r.hub_id, r.title, stage) for i, r in enumerate(taken)],
            columns=["edition", "slot", "hub_id", "title", "stage"],
        )

    return rows.groupBy("edition").applyInPandas(
        choose, "edition date, slot int, hub_id string, title string, stage string"
    )


# -- recipients -------------------------------------------------------------------


def subscriber_order():
    return [F.col("last_sent_at").asc_nulls_first(), F.col("email")]


def due_subscribers(subscribers: DataFrame, as_of, force: bool = False) -> DataFrame:
    """Active and not served since midnight in India."""
    active = subscribers.filter("is_active")
    if force:
        return active
    return active.filter(F.col("last_sent_at").isNull() | (F.col("last_sent_at") < times.ist_day_start(as_of)))


def run_guard(log: DataFrame, as_of) -> DataFrame:
    """One row: does a sent or partial run since midnight block this one?"""
    today = (F.col("sent_at") >= times.ist_day_start(as_of)) & F.col("status").isin("sent", "partial")
    return log.filter(today).limit(1).agg((F.count("*") > 0).alias("blocked"))


def resolve_recipients(asked: DataFrame, subscribers: DataFrame, default_token: str = "test-token") -> DataFrame:
    known = subscribers.groupBy(F.lower("email").alias("__key")).agg(F.max("unsubscribe_token").alias("__token"))
    return (
        asked.withColumn("__key", F.lower("email"))
        .join(known, "__key", "left")
        .withColumn("token", F.coalesce("__token", F.lit(default_token)))
        .drop("__key", "__token")
    )


def provider_order(order, preferred: str = "resend", before: str = "gmail") -> list[str]:
    """The preferred provider moves to the front when it stands behind another
    or is missing."""
    if preferred not in order:
        return [preferred, *order]
    if before in order and order.index(preferred) > order.index(before):
        return [preferred, *[p for p in order if p != preferred]]
    return list(order)


def waterfall(due: DataFrame, sent: DataFrame, limits: dict[str, int], order: list[str], by=None) -> DataFrame:
    """Give recipients in priority order to providers in provider order.

    At most sum(limits) recipients can be served, a figure known before the
    job runs, so only that many rows are ranked; all others are deferred
    without ever being sorted.
    """
    spark = due.sparkSession
    order = [p for p in order if limits.get(p, 0) > 0]
    ceiling = sum(limits[p] for p in order)
    ladder = spark.createDataFrame([(i, p, limits[p]) for i, p in enumerate(order)], "place int, provider string, day_limit long")
    budget = ladder.join(sent, "provider", "left").withColumn(
        "budget", F.greatest(F.lit(0), F.col("day_limit") - F.coalesce("sent", F.lit(0)))
    )
    # One row per provider: a window over the whole ladder is a handful of rows.
    upto = F.sum("budget").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow))
    steps = budget.withColumn("hi", upto).filter("budget > 0").select(F.struct("hi", "provider").alias("step"))
    # The ladder as one sorted array: the first step that reaches a rank serves it.
    steps = steps.agg(F.sort_array(F.collect_list("step"))).scalar()
    by = by or subscriber_order()
    ranked = top_n(due, by, ceiling).withColumn("__rn", F.row_number().over(W.orderBy(*by)))
    step = F.get(F.filter("__steps", lambda s: s["hi"] >= F.col("__rn")), F.lit(0))
    served = ranked.withColumn("__steps", steps).select("email", step["provider"].alias("provider")).filter("provider IS NOT NULL")
    return due.join(served, "email", "left").withColumn("provider", F.coalesce("provider", F.lit("deferred")))


def send_record(assigned: DataFrame, hub_ids: list[str], sent_at, failed: DataFrame | None = None) -> DataFrame:
    """Row for the send log: counts per provider, deferred count, status."""
    counts = assigned.groupBy("provider").agg(F.count("*").alias("n"))
    row = counts.agg(
        F.coalesce(F.sum(F.when(F.col("provider") != "deferred", F.col("n"))), F.lit(0)).alias("subscriber_count"),
        F.coalesce(F.sum(F.when(F.col("provider") == "deferred", F.col("n"))), F.lit(0)).alias("deferred_count"),
        F.map_from_entries(
            F.sort_array(F.collect_list(F.when(F.col("provider") != "deferred", F.struct("provider", "n"))))
        ).alias("provider_counts"),
    )
    row = row.withColumn("sent_at", times.as_ts(sent_at)).withColumn("hub_ids", F.array(*[F.lit(h) for h in hub_ids]).cast("array<string>"))
    if failed is None:
        return row.withColumn("status", F.lit("sent"))
    failures = failed.agg(F.count("*")).scalar()
    return row.withColumn("status", F.when(failures > 0, "partial").otherwise("sent"))
