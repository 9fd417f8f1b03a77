"""Landed feed payloads to item rows.

A payload is a row (source columns plus a text column) so that files, tables
and streams all go through the same mapping. Parsing is done by Spark's XML and
JSON functions; caps per source use `first_n`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyhub.functions import media, text, times, topics
from storyhub.functions.text import col, is_http, plain_snippet, strip
from storyhub.operators.ranking import first_n

_LINK = "struct<_href:string,_VALUE:string>"
_ITEM = (
    "struct<title:string,link:string,guid:string,pubDate:string,description:string,`content:encoded`:string,"
    "enclosure:struct<_url:string,_type:string>,`media:content`:struct<_url:string>,`media:thumbnail`:struct<_url:string>>"
)
_ENTRY = (
    f"struct<title:string,link:{_LINK},id:string,published:string,updated:string,summary:string,content:string,"
    "`media:thumbnail`:struct<_url:string>>"
)
FEED_SCHEMA = f"channel struct<item:array<{_ITEM}>>, entry array<{_ENTRY}>"
ITEM_CAP = 30
IMAGE_FILE = r"(?i)\.(?:jpeg|jpg|png|webp)"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole feed files, one row each; the file name carries the source id."""
    files = spark.read.format("text").option("wholetext", True).load(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.\w+)?$", 1)
    return files.select(name.alias("source_id"), F.col("value").alias("payload"))


def read_items_xml(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Feed files straight through the XML reader, one row per `item`."""
    fields = schema or _ITEM[len("struct<"):-1].replace(":string", " string").replace(":struct", " struct")
    return spark.read.format("xml").option("rowTag", "item").schema(fields).load(path)


def _blank(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def parse_feed(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per feed item, in feed order: raw fields of RSS or Atom."""
    feed = F.from_xml(media.sanitize_xml(payload), F.lit(FEED_SCHEMA))
    rss = F.transform(
        F.coalesce(F.col("__feed.channel.item"), F.array()),
        lambda x: F.struct(
            x["title"].alias("title"), x["link"].alias("link"), x["guid"].alias("guid"), x["pubDate"].alias("time"),
            x["description"].alias("snippet"), x["content:encoded"].alias("content"),
            F.when(
                F.coalesce(F.startswith(x["enclosure"]["_type"], F.lit("image")), F.lit(False))
                | F.coalesce(x["enclosure"]["_url"].rlike(IMAGE_FILE), F.lit(False)),
                x["enclosure"]["_url"],
            ).alias("enclosure"),
            x["media:content"]["_url"].alias("media"), x["media:thumbnail"]["_url"].alias("thumbnail"),
        ),
    )
    atom = F.transform(
        F.coalesce(F.col("__feed.entry"), F.array()),
        lambda x: F.struct(
            x["title"].alias("title"), F.coalesce(x["link"]["_href"], x["link"]["_VALUE"]).alias("link"),
            x["id"].alias("guid"), F.coalesce(x["published"], x["updated"]).alias("time"),
            x["summary"].alias("snippet"), x["content"].alias("content"), F.lit(None).cast("string").alias("enclosure"),
            F.lit(None).cast("string").alias("media"), x["media:thumbnail"]["_url"].alias("thumbnail"),
        ),
    )
    keep = [F.col(c) for c in payloads.columns if c != payload]
    parsed = payloads.withColumn("__feed", feed)
    rows = parsed.select(*keep, F.posexplode(F.concat(rss, atom)).alias("feed_pos", "__item"))
    return rows.select(*[c for c in payloads.columns if c != payload], "feed_pos", "__item.*")


def valid_items(items: DataFrame, min_title: int | None = None) -> DataFrame:
    """Only http urls and, where asked, titles longer than `min_title`."""
    ok = is_http("url")
    return items.filter(ok if min_title is None else ok & (F.length("title") > min_title))


def _capped(rows: DataFrame, cap: int | None) -> DataFrame:
    """First `cap` items of each source. Where a source lands in several payloads, the
    column `payload_pos` of the payloads orders them."""
    order = [c for c in ("payload_pos", "feed_pos") if c in rows.columns]
    return rows if cap is None else first_n(rows, "source_id", order, cap)


def _image() -> Column:
    return F.coalesce("enclosure", "media", "thumbnail")


def _map(rows, fetched_at, default_title, snippet, tag_lane, extra) -> DataFrame:
    title = strip(F.coalesce(_blank(F.col("title")), F.lit(default_title)))
    fetched = times.as_ts(fetched_at)
    base = rows.withColumn("title", title)
    return base.select(
        "source_id", "source_name", "lane", "title",
        strip(F.coalesce(_blank(F.col("link")), F.col("guid"), F.lit(""))).alias("url"),
        F.coalesce(times.feed_time("time"), fetched).alias("published_at"),
        plain_snippet(snippet).alias("raw_summary"),
        topics.topic_of("title", "source_name", "lane").alias("category"),
        *extra,
        fetched.alias("fetched_at"),
        "feed_pos",
    )


def news_items(payloads: DataFrame, fetched_at, cap: int | None = ITEM_CAP) -> DataFrame:
    """RSS or Atom news: first `cap` items per source, then the url guard."""
    rows = _capped(parse_feed(payloads), cap)
    used = F.coalesce(F.col("fallback_used"), F.lit(False)) if "fallback_used" in payloads.columns else F.lit(False)
    url = F.coalesce(_blank(F.col("link")), F.col("guid"), F.lit(""))
    via = used | F.contains(url, F.lit("news.google.com"))
    snippet = F.coalesce(_blank(F.col("snippet")), F.col("content"), F.lit(""))
    return valid_items(
        _map(rows, fetched_at, "Untitled Article", snippet, None, [_image().alias("og_image"), via.alias("via_google_news")])
    )


def community_items(payloads: DataFrame, fetched_at, cap: int | None = ITEM_CAP) -> DataFrame:
    rows = _capped(parse_feed(payloads), cap)
    snippet = F.coalesce(_blank(F.col("snippet")), F.col("content"), F.col("title"))
    note = F.concat(F.lit("Reddit community discussion · "), "source_name").alias("og_description")
    return valid_items(_map(rows, fetched_at, "Civic Post", snippet, None, [note]))


def split_communities(payloads: DataFrame, sources: DataFrame, fetched_at, cap: int | None = ITEM_CAP) -> DataFrame:
    """One combined feed back to its sources by the community in the link;
    unknown communities drop out."""
    rows = parse_feed(payloads.drop("source_id", "source_name", "lane"))
    rows = rows.withColumn("__community", media.community_of("link"))
    known = sources.withColumn("__community", media.community_of("feed_url", host="")).filter("__community IS NOT NULL")
    known = known.select("__community", "source_id", F.col("name").alias("source_name"), F.lit("discourse").alias("lane"))
    joined = _capped(rows.join(known, "__community"), cap)
    snippet = F.coalesce(_blank(F.col("snippet")), F.col("content"), F.col("title"))
    note = F.concat(F.lit("Reddit community discussion · "), "source_name").alias("og_description")
    return valid_items(_map(joined, fetched_at, "Civic Post", snippet, None, [note]))


NEWS_SCHEMA = "news array<struct<title:string,description:string,snippet:string,url:string,image:string,published:string>>"


def json_news_items(payloads: DataFrame, fetched_at) -> DataFrame:
    """JSON news payload: `news[]` to rows, image only when http."""
    rows = payloads.withColumn("__j", F.from_json("payload", NEWS_SCHEMA)).select(
        *[c for c in payloads.columns if c != "payload"], F.posexplode("__j.news").alias("feed_pos", "n")
    )
    title = strip(F.coalesce(_blank(F.col("n.title")), F.lit("Untitled Article")))
    fetched = times.as_ts(fetched_at)
    out = rows.withColumn("title", title).select(
        "source_id", "source_name", "lane", "title", strip(F.coalesce("n.url", F.lit(""))).alias("url"),
        F.coalesce(times.feed_time("n.published"), fetched).alias("published_at"),
        F.substring(F.coalesce(F.nullif("n.description", F.lit("")), "n.snippet", F.lit("")), 1, 300).alias("raw_summary"),
        topics.topic_of("title", "source_name", "lane").alias("category"),
        F.when(is_http("n.image"), F.col("n.image")).alias("og_image"),
        fetched.alias("fetched_at"), "feed_pos",
    )
    return valid_items(out, min_title=5)


def edition_items(payloads: DataFrame, sources: DataFrame, default_edition: str, fetched_at, cap: int = 25) -> DataFrame:
    """Language editions: `cap` per edition, source id by edition name, else
    that of the default edition."""
    rows = first_n(parse_feed(payloads), "edition", "feed_pos", cap)
    ids = sources.groupBy("name").agg(F.max("source_id").alias("__id"))
    default = sources.filter(F.col("name") == default_edition).agg(F.max("source_id")).scalar()
    rows = rows.join(ids, rows.edition == ids.name, "left")
    rows = rows.withColumn("source_id", F.coalesce("__id", default)).withColumn("source_name", F.col("edition"))
    rows = rows.withColumn("lane", F.lit("aggregator"))
    snippet = F.coalesce(_blank(F.col("snippet")), F.col("content"), F.col("title"))
    out = _map(rows, fetched_at, "Untitled Story", snippet, None, [F.lit(True).alias("via_google_news")])
    return valid_items(out, min_title=5)


_RUNS = "struct<runs:array<struct<text:string>>,simpleText:string>"
VIDEO_SCHEMA = (
    "contents struct<twoColumnSearchResultsRenderer:struct<primaryContents:struct<sectionListRenderer:struct<contents:array<"
    "struct<itemSectionRenderer:struct<contents:array<struct<videoRenderer:struct<videoId:string,"
    f"title:{_RUNS},ownerText:{_RUNS},longBylineText:{_RUNS},viewCountText:{_RUNS},shortViewCountText:{_RUNS},"
    f"publishedTimeText:{_RUNS}>>>>>>>>>>"
)


def video_search_rows(pages: DataFrame, html: str = "payload") -> DataFrame:
    """Video rows from the JSON embedded in a search page."""
    found = F.coalesce(
        F.nullif(F.regexp_extract(html, r"(?s)var\s+ytInitialData\s*=\s*(\{.*?\});\s*</script>", 1), F.lit("")),
        F.nullif(F.regexp_extract(html, r'(?s)window\["ytInitialData"\]\s*=\s*(\{.*?\});', 1), F.lit("")),
    )
    keep = [c for c in pages.columns if c != html]
    sections = F.col("__j.contents.twoColumnSearchResultsRenderer.primaryContents.sectionListRenderer.contents")
    rows = pages.withColumn("__j", F.from_json(found, VIDEO_SCHEMA)).select(*keep, F.posexplode(sections).alias("__s", "__sec"))
    rows = rows.select(*keep, "__s", F.posexplode("__sec.itemSectionRenderer.contents").alias("__p", "__e"))
    v = "__e.videoRenderer"

    def label(name):
        return F.coalesce(F.col(f"{v}.{name}.simpleText"))

    title = F.coalesce(
        F.nullif(F.array_join(F.transform(F.col(f"{v}.title.runs"), lambda r: r["text"]), ""), F.lit("")), label("title")
    )
    out = rows.select(
        *keep, F.struct("__s", "__p").alias("feed_pos"), F.col(f"{v}.videoId").alias("video_id"),
        strip(title).alias("title"),
        F.coalesce(F.get(F.col(f"{v}.ownerText.runs"), F.lit(0))["text"], F.get(F.col(f"{v}.longBylineText.runs"), F.lit(0))["text"]).alias("channel"),
        F.coalesce(label("viewCountText"), label("shortViewCountText")).alias("views"),
        label("publishedTimeText").alias("age"),
    )
    return out.filter("video_id IS NOT NULL AND title <> ''")


def video_items(videos: DataFrame, fetched_at, cap: int = 15, max_days: int = 7) -> DataFrame:
    """Videos whose channel fits the source and whose stated age is known and
    at most a week; the cap counts accepted rows only."""
    now = times.as_ts(fetched_at)
    published = times.relative_time("age", now)
    ok = media.channel_matches("channel", "source_name") & F.coalesce(
        published >= times.hours_before(now, max_days * 24), F.lit(False)
    )
    rows = first_n(videos.withColumn("published_at", published).filter(ok), "source_id", "feed_pos", cap)
    parts = F.concat_ws(" · ", F.coalesce("channel", "source_name"), "views", "age")
    return rows.select(
        "source_id", "source_name", "lane", "title",
        F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id").alias("url"), "published_at",
        F.substring(F.concat(parts, F.lit(" — "), F.col("title")), 1, 300).alias("raw_summary"),
        topics.topic_of("title", "source_name", "lane").alias("category"),
        F.concat(F.lit("https://i.ytimg.com/vi/"), "video_id", F.lit("/hqdefault.jpg")).alias("og_image"),
        F.concat(F.lit("YouTube video report · "), "source_name").alias("og_description"),
        now.alias("fetched_at"), "feed_pos",
    )


def portal_items(payloads: DataFrame, fetched_at, cap: int = 20, max_hours: int = 48) -> DataFrame:
    """Civic portals: a known publication time of at most 48 h; the cap comes
    after the filter."""
    now = times.as_ts(fetched_at)
    rows = parse_feed(payloads).filter(F.coalesce(times.feed_time("time") >= times.hours_before(now, max_hours), F.lit(False)))
    snippet = F.coalesce(_blank(F.col("snippet")), F.col("content"), F.col("title"))
    out = valid_items(_map(rows, fetched_at, "Untitled Report", snippet, None, [F.lit(True).alias("via_google_news")]))
    return first_n(out, "source_id", "feed_pos", cap)


def choose_payload(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Primary payload of each source; the fallback only where it failed."""
    fb = fallback.select("source_id", F.col("payload").alias("__fb"), F.col("ok").alias("__fb_ok"))
    rows = primary.join(fb, "source_id", "left")
    use = ~F.coalesce("ok", F.lit(False)) & F.coalesce("__fb_ok", F.lit(False))
    return (
        rows.withColumn("fallback_used", use)
        .withColumn("payload", F.when(F.col("fallback_used"), F.col("__fb")).otherwise(F.when(F.col("ok"), F.col("payload"))))
        .drop("__fb", "__fb_ok", "ok")
    )


def enrich_images(items: DataFrame, pages: DataFrame, first: int = 2) -> DataFrame:
    """Page meta for the first rows of a source that lack an image. The place
    counts all rows of the source, not only those lacking one."""
    head = first_n(items, "source_id", "feed_pos", first).filter(F.col("og_image").isNull()).select("source_id", "feed_pos", "url")
    meta = head.join(pages.select("url", "html"), "url").select(
        "source_id", "feed_pos", media.og_image("html").alias("__img"), media.og_description("html").alias("__desc")
    )
    out = items.join(meta, ["source_id", "feed_pos"], "left")
    desc = F.coalesce("og_description", "__desc") if "og_description" in items.columns else F.col("__desc")
    return out.withColumn("og_image", F.coalesce("og_image", "__img")).withColumn("og_description", desc).drop("__img", "__desc")


def union_items(*frames: DataFrame) -> DataFrame:
    """Union by name; columns a feed lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
