"""Page, video and feed-payload expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyhub.functions import lexicon as lx
from storyhub.functions.text import TAG, col, contains_any, decode_entities, let, squeeze, strip, sub


def sanitize_xml(c) -> Column:
    """Drop script and style blocks, escape bare ampersands."""
    t = sub(sub(col(c), r"(?is)<script.*?</script>"), r"(?is)<style.*?</style>")
    return sub(t, r"&(?!amp;|lt;|gt;|quot;|apos;|#\d+;|#x[0-9a-fA-F]+;)", "&amp;")


def _meta(html: Column, attribute: str, value: str, reverse: bool) -> Column:
    key = rf"""{attribute}=["']{value}["']"""
    content = r"""content=["']([^"']+)["']"""
    middle = f"{content}[^>]+{key}" if reverse else f"{key}[^>]+{content}"
    return F.nullif(F.regexp_extract(html, rf"(?i)<meta[^>]+{middle}", 1), F.lit(""))


def og_image(html) -> Column:
    h = col(html)
    found = F.coalesce(_meta(h, "property", "og:image", False), _meta(h, "property", "og:image", True))
    return F.nullif(strip(found), F.lit(""))


def og_description(html) -> Column:
    h = col(html)
    found = F.coalesce(
        _meta(h, "property", "og:description", False),
        _meta(h, "property", "og:description", True),
        _meta(h, "name", "description", False),
    )
    return F.nullif(strip(sub(found, TAG)), F.lit(""))


def article_text(html, url=None) -> Column:
    """Body text of an article page: whole paragraphs until 1500 characters
    are reached, cut at 1800; null when there is too little."""
    h = col(html)
    clean = sub(h, r"(?s)<!--.*?-->")
    for element in lx.ARTICLE_DROPPED_ELEMENTS:
        clean = sub(clean, rf"(?is)<{element}.*?</{element}>")

    def block(page, name):
        return F.nullif(F.regexp_extract(page, rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1), F.lit(""))

    body = let(clean, lambda page: F.coalesce(block(page, "article"), block(page, "main"), page))
    paragraphs = F.regexp_extract_all(body, F.lit(r"(?is)(<p[^>]*>.*?</p>)"), 1)
    texts = F.transform(
        paragraphs, lambda p: squeeze(sub(decode_entities(sub(p, TAG)), r"&#\d+;"))
    )
    texts = F.filter(
        texts, lambda t: (F.length(t) >= 45) & ~contains_any(F.lower(t), lx.ARTICLE_BOILERPLATE)
    )
    start = F.expr("cast(named_struct('kept', array(), 'size', 0) as struct<kept:array<string>,size:int>)")
    kept = F.aggregate(
        texts,
        start,
        lambda acc, t: F.when(acc["size"] >= 1500, acc).otherwise(
            F.struct(
                F.concat(acc["kept"], F.array(t)).alias("kept"),
                (acc["size"] + F.length(t)).alias("size"),
            )
        ),
        lambda acc: acc["kept"],
    )
    ok = F.length(h) >= 500
    if url is not None:
        u = col(url)
        ok = ok & F.startswith(u, F.lit("http")) & ~contains_any(u, lx.ARTICLE_SKIPPED_HOSTS)
    # Looked at first, as they cost little; the text is made once.
    made = let(strip(F.substring(F.array_join(kept, " "), 1, 1800)), lambda text: F.when(F.length(text) > 60, text))
    return F.when(ok, made)


def channel_matches(channel, source_name) -> Column:
    """True when a video channel belongs to a source; true when unknown."""
    ch, name = F.lower(F.coalesce(col(channel), F.lit(""))), F.lower(col(source_name))
    key_ch, key_name = sub(ch, "[^a-z0-9]"), sub(name, "[^a-z0-9]")
    tokens = F.filter(
        F.split(name, "[^a-z0-9]+"),
        lambda t: (F.length(t) >= 3) & ~t.isin(*lx.CHANNEL_STOP_WORDS),
    )
    alias = F.lit(False)
    for source, channels in lx.CHANNEL_ALIASES.items():
        alias = alias | ((key_name == source) & contains_any(key_ch, channels))
    return (
        (key_ch == "")
        | (key_name == "")
        | F.contains(key_ch, key_name)
        | F.contains(key_name, key_ch)
        | alias
        | F.exists(tokens, lambda t: F.contains(key_ch, t))
    )


def video_query(feed_url, source_name) -> Column:
    """Search words of a video source: url parameter, else its name."""
    u = col(feed_url)
    words = F.coalesce(
        F.nullif(F.try_parse_url(u, F.lit("QUERY"), F.lit("search_query")), F.lit("")),
        F.nullif(F.try_parse_url(u, F.lit("QUERY"), F.lit("q")), F.lit("")),
    )
    return F.coalesce(F.url_decode(words), F.concat(col(source_name), F.lit(" India news")))


EMBED_PATTERN = r"(?:youtu\.be/|youtube\.com/(?:embed/|v/|watch\?v=|watch\?.+&v=))([\w-]{11})"


def video_embed_url(url) -> Column:
    video = F.nullif(F.regexp_extract(col(url), EMBED_PATTERN, 1), F.lit(""))
    return F.concat(F.lit("https://www.youtube.com/embed/"), video)


def community_of(url, host: str = "reddit.com/") -> Column:
    """Lower-cased community name in `…/r/<name>`, null without one."""
    found = F.regexp_extract(col(url), rf"(?i){re.escape(host)}r/([^/]+)", 1)
    return F.lower(F.nullif(found, F.lit("")))
