"""Source registry: merge of seed, cache and stored copies, and the change set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ["lane", "type", "feed_url", "language", "region"]
LANES = ["mainstream", "grassroots", "discourse", "aggregator"]
TYPES = ["rss", "youtube", "reddit", "api"]


def valid_sources(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("lane").isin(*LANES) & F.col("type").isin(*TYPES))


def merge_registry(seed: DataFrame, cached: DataFrame, stored: DataFrame) -> DataFrame:
    """Active sources: seed values win over the cache except id and activity;
    stored values win over both except the feed url."""
    c = cached.groupBy("name").agg(F.max("source_id").alias("__cid"), F.max("is_active").alias("__cactive"))
    s = stored.filter("is_active").groupBy("name").agg(
        F.max("source_id").alias("__sid"), *[F.max(f).alias(f"__s_{f}") for f in FIELDS]
    )
    out = seed.join(c, "name", "left").join(s, "name", "left").filter(F.coalesce("__cactive", F.lit(True)))
    out = out.withColumn("source_id", F.coalesce("__sid", "__cid", "source_id"))
    for f in FIELDS:
        value = F.coalesce(f, f"__s_{f}") if f == "feed_url" else F.coalesce(f"__s_{f}", f)
        out = out.withColumn(f, value)
    return out.select("source_id", "name", *FIELDS)


def registry_changes(seed: DataFrame, stored: DataFrame) -> DataFrame:
    """Change set: update rows matched by name, else by url; insert the rest;
    deactivate active stored rows whose name left the seed."""
    by_name = stored.groupBy("name").agg(F.max("source_id").alias("__by_name"))
    by_url = stored.groupBy("feed_url").agg(F.max("source_id").alias("__by_url"))
    rows = seed.join(by_name, "name", "left").join(by_url, "feed_url", "left")
    rows = rows.withColumn("match_id", F.coalesce("__by_name", "__by_url"))
    kept = rows.select(
        F.when(F.col("match_id").isNull(), "insert").otherwise("update").alias("action"), "match_id", "name", "feed_url"
    )
    gone = stored.filter("is_active").join(seed.select("name"), "name", "left_anti")
    return kept.unionByName(
        gone.select(F.lit("deactivate").alias("action"), F.col("source_id").alias("match_id"), "name", "feed_url")
    )
