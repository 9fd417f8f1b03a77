"""Entity views over the star-schema test tables.

Each view turns a table into one of the entities (sources, items, hubs,
subscribers, calls, ...). Column pruning reaches the Parquet scan, since every
view is a plain projection. `ord` is the load order: newest first, then id; it
is computed per row, so no global sort or window is needed to assign it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyhub.functions.text import normalize_title

# Facts of the test tables: first publication minute and the span in minutes.
EPOCH = 1704067200
SPAN_MINUTES = 43200
AS_OF = "2024-01-31 00:00:00"
AS_OF_SECONDS = EPOCH + SPAN_MINUTES * 60


SCAN_PARTITIONS = "storyhub.scan.partitions"
"""Session setting: deal the rows of every scan to so many tasks. For files with fewer row
groups than cores; unset, as by default, splits follow `spark.sql.files.*` alone."""


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/{name}.parquet")
    wanted = spark.conf.get(SCAN_PARTITIONS, None) if isinstance(spark, SparkSession) else None
    return rows.repartition(int(wanted)) if wanted else rows


def _pick(key: Column, values) -> Column:
    out = F.lit(None).cast("string")
    for i, value in enumerate(values):
        out = F.when(key == i, F.lit(value)).otherwise(out)
    return out


def source_key(source) -> Column:
    return F.regexp_extract(source, r"(\d+)", 1).cast("int")


def sources(spark: SparkSession, path: str) -> DataFrame:
    sid = F.col("source_id")
    return (
        table(spark, path, "documents")
        .groupBy("source")
        .agg(F.lit(True).alias("is_active"))
        .withColumn("source_id", source_key("source"))
        .select(
            "source_id",
            F.when(sid % 10 == 7, F.concat(F.lit("Factly Desk "), sid.cast("string")))
            .otherwise(F.concat(F.lit("Source "), sid.cast("string")))
            .alias("name"),
            _pick(sid % 4, ["mainstream", "grassroots", "discourse", "aggregator"]).alias("lane"),
            _pick(sid % 5, ["rss", "rss", "api", "reddit", "youtube"]).alias("type"),
            F.when(sid % 5 == 3, F.concat(F.lit("https://www.reddit.com/r/"), "source", F.lit("/.rss")))
            .otherwise(F.concat(F.lit("https://"), "source", F.lit(".example.com/rss")))
            .alias("feed_url"),
            _pick(sid % 4, ["en", "fr", "de", "es"]).alias("language"),
            _pick(sid % 5, ["national", "maharashtra", "kerala", "delhi"]).alias("region"),
            "is_active",
        )
    )


def items(spark: SparkSession, path: str) -> DataFrame:
    minute = F.col("doc_id") * 97 % SPAN_MINUTES
    published = F.timestamp_seconds(F.lit(EPOCH) + minute * 60)
    return table(spark, path, "documents").select(
        F.col("doc_id").alias("item_id"),
        source_key("source").alias("source_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.md5(F.col("text").cast("binary"))).alias("url"),
        published.alias("published_at"),
        F.col("text").alias("raw_summary"),
        F.when(
            F.col("doc_id") % 3 == 0,
            F.concat(F.lit("https://img.example.com/"), F.col("doc_id").cast("string"), F.lit(".jpg")),
        ).alias("og_image"),
        F.when(
            F.col("doc_id") % 9 == 0, F.concat(F.lit("Dharna near "), "source", F.lit(", "), F.col("doc_id").cast("string"))
        ).alias("og_description"),
        F.when((F.col("lang") != "en") & (F.col("doc_id") % 4 == 1), F.concat(F.lit("Gloss: "), F.substring_index("text", "\n", 1))).alias(
            "english_gloss"
        ),
        F.col("lang").alias("language"),
        (published + F.expr("INTERVAL 5 MINUTE")).alias("fetched_at"),
        ((F.lit(SPAN_MINUTES) - minute) * F.lit(10**13) + F.col("doc_id")).alias("ord"),
    )


def story_items(spark: SparkSession, path: str) -> DataFrame:
    """Items with their title key and the hub they belong to."""
    return items(spark, path).withColumn("norm_title", normalize_title("title")).withColumn(
        "cluster_id", F.md5(F.col("norm_title").cast("binary"))
    )


def hubs(spark: SparkSession, path: str) -> DataFrame:
    """Relational hubs: one per normalised title. Partial aggregation does the
    work before the shuffle, so a title shared by many rows is no hot spot."""
    return (
        story_items(spark, path)
        .groupBy("cluster_id")
        .agg(
            F.min_by("title", "ord").alias("title"),
            F.when(F.count("*") > 1, F.min_by("raw_summary", "ord")).alias("ai_summary"),
            F.min("published_at").alias("first_seen_at"),
            F.max("published_at").alias("last_updated_at"),
            F.count("*").alias("item_count"),
        )
        .withColumnRenamed("cluster_id", "hub_id")
    )


def video_rows(spark: SparkSession, path: str) -> DataFrame:
    """Items of which every 11th is a video with an age marker, every 33rd
    without one, and every 13th a static page extract."""
    doc = F.col("item_id")
    hours = (doc % 240).cast("string")
    video = doc % 11 == 0
    summary = F.when(
        video & (doc % 33 != 0),
        F.concat(F.lit("Channel · 12K views · "), hours, F.lit(" hours ago — "), "title"),
    ).otherwise(F.col("raw_summary"))
    return items(spark, path).select(
        "item_id", "source_id", "title",
        F.when(video, F.concat(F.lit("https://www.youtube.com/watch?v="), F.lpad(doc.cast("string"), 11, "v")))
        .otherwise(F.col("url")).alias("url"),
        "published_at", summary.alias("raw_summary"), "fetched_at", "ord",
        F.when(doc % 13 == 0, F.lit("Direct Tier-1 web extraction of a page")).alias("og_description"),
    )


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )


def calls(spark: SparkSession, path: str) -> DataFrame:
    """Model call log: model = event type, tokens = value, units = value / 100."""
    return table(spark, path, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("model"),
        _pick(F.length("event_type") % 2, ["shared", "single"]).alias("provider"),
        F.floor("value").alias("tokens"),
        (F.col("event_type") == "error").alias("failed"),
        "user_id",
    )


def pages(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "pages")


def subscribers(spark: SparkSession, path: str) -> DataFrame:
    last = (
        table(spark, path, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.max("o_orderdate").cast("timestamp").alias("last_sent_at"))
    )
    return (
        table(spark, path, "customer")
        .select("c_custkey", "c_name")
        .join(last, "c_custkey", "left")
        .select(
            F.col("c_custkey").alias("subscriber_id"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            (F.col("c_custkey") % 10 != 0).alias("is_active"),
            F.md5(F.col("c_name").cast("binary")).alias("unsubscribe_token"),
            "last_sent_at",
        )
    )


def send_log(spark: SparkSession, path: str) -> DataFrame:
    """Send log over orders: three provider counts, some only in the map."""
    key = F.col("o_orderkey")
    legacy = key % 5 == 0
    def count(n):
        return F.when(~legacy, (key % n).cast("int"))
    return table(spark, path, "orders").select(
        key.alias("send_id"),
        F.col("o_orderdate").cast("timestamp").alias("sent_at"),
        F.when(F.col("o_orderstatus") == "F", "failed")
        .when(F.col("o_orderstatus") == "P", "partial").otherwise("sent").alias("status"),
        count(7).alias("gmail_count"), count(11).alias("brevo_count"), count(13).alias("resend_count"),
        F.when(legacy, F.create_map(F.lit("gmail"), key % 3, F.lit("ses"), key % 4)).alias("provider_counts"),
    )
