"""Text cleaners, tokens and similarity as Column expressions.

Patterns are written for Java's regex engine. `(?U)` makes `\\s` match the
no-break space; it also widens `\\b`, so word boundaries are spelled out with
ASCII look-arounds instead (`whole_word`).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyhub.functions import lexicon as lx

SPACE = r"(?U)\s+"
NOT_WORD = lx.NOT_WORD
NOT_WORD_OR_SPACE = lx.NOT_WORD_OR_SPACE
PUBLISHER_TAIL = lx.PUBLISHER_TAIL
NBSP_TAIL = lx.NBSP_TAIL
SIGNED_TAIL = lx.SIGNED_TAIL
SENTENCE_BREAK = lx.SENTENCE_BREAK
TAG = lx.TAG


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`. Spark inlines a Column at
    every use, so a costly cleaner used three times would run three times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sub(c: Column, pattern: str, replacement: str = "") -> Column:
    """regexp_replace with a literal replacement."""
    return F.regexp_replace(c, pattern, replacement.replace("\\", "\\\\").replace("$", "\\$"))


def sub_all(c: Column, pairs) -> Column:
    return reduce(lambda acc, p: sub(acc, p[0], p[1]), pairs, c)


def squeeze(c: Column) -> Column:
    """Collapse runs of white space (no-break space included) and trim."""
    return F.trim(sub(c, SPACE, " "))


def strip(c: Column) -> Column:
    """Trim with the wide white-space class."""
    return sub(c, r"(?U)\A\s+|\s+\z", "")


def any_of(words) -> str:
    return "|".join(re.escape(w) for w in words)


def whole_word(word: str) -> str:
    """ASCII word boundary: also true next to a non-Latin letter."""
    left = "(?<![A-Za-z0-9_])" if re.match(r"[A-Za-z0-9_]", word[0]) else "(?<=[A-Za-z0-9_])"
    right = "(?![A-Za-z0-9_])" if re.match(r"[A-Za-z0-9_]", word[-1]) else "(?=[A-Za-z0-9_])"
    return left + re.escape(word) + right


def contains_any(c: Column, words) -> Column:
    """True when the text contains any of the words; one pass, one regex."""
    return c.rlike(any_of(words))


# -- titles -----------------------------------------------------------------


def cut_title_tail(c) -> Column:
    return sub(sub(col(c), NBSP_TAIL), PUBLISHER_TAIL)


def normalize_title(c) -> Column:
    """Matching key of a title: tail cut, punctuation to space, lower, squeezed."""
    cut = cut_title_tail(F.coalesce(col(c), F.lit("")))
    return squeeze(F.lower(sub(cut, NOT_WORD, " ")))


def title_words(norm) -> Column:
    """Distinct words longer than two characters of a normalised title."""
    return F.array_distinct(F.filter(F.split(col(norm), " "), lambda w: F.length(w) > 2))


def jaccard(words_a, words_b) -> Column:
    """Set overlap of two word arrays; 0 when either is empty."""
    a, b = col(words_a), col(words_b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(
        F.lit(0.0)
    )


def title_jaccard(norm_a, norm_b) -> Column:
    return let(title_words(norm_a), lambda a: let(title_words(norm_b), lambda b: jaccard(a, b)))


def decode_entities(c: Column) -> Column:
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), lx.HTML_ENTITIES, c)


def strip_quotes(c: Column) -> Column:
    return sub(c, lx.OUTER_QUOTES)


def clean_headline(c) -> Column:
    t = strip(strip_quotes(F.coalesce(col(c), F.lit(""))))
    for pattern in (lx.BAR_TAIL, SIGNED_TAIL, lx.COVERAGE_HEAD, lx.REPORTED_TAIL):
        t = sub(t, pattern)
    return strip(decode_entities(t))


def _without_tags(c: Column) -> Column:
    return squeeze(decode_entities(sub(c, TAG, " ")))


def _before_cut_phrase(c: Column) -> Column:
    return strip(sub(c, f"(?is)(?:{any_of(lx.SUMMARY_CUT_PHRASES)}).*\\z"))


def clean_summary(c) -> Column:
    return _before_cut_phrase(_without_tags(F.coalesce(col(c), F.lit(""))))


def clean_summary_start(c, limit: int) -> Column:
    """A text whose first `limit` characters are those of `clean_summary`.

    The start of the raw text is cleaned, and all of it only where too little is left. What
    a cut entity or cut phrase may change lies in the last characters, beyond the limit."""
    raw = F.coalesce(col(c), F.lit(""))
    sure = limit + 2 * max(map(len, lx.SUMMARY_CUT_PHRASES)) + 32
    start = _without_tags(F.substring(raw, 1, 4 * limit + 256))
    return let(start, lambda t: F.when(F.length(t) >= sure, _before_cut_phrase(t)).otherwise(clean_summary(raw)))


def plain_snippet(c, limit: int = 300) -> Column:
    """Feed summary: tags dropped, trimmed, cut."""
    return F.substring(strip(sub(col(c), TAG)), 1, limit)


def _strip_reasoning(c: Column) -> Column:
    for pattern in lx.REASONING:
        c = sub(c, pattern)
    return strip_quotes(c)


def clean_generated(c) -> Column:
    t = _strip_reasoning(col(c))
    for pattern in (lx.BRIEFING_HEAD, lx.COVERAGE_HEAD, lx.REPORTED_TAIL):
        t = sub(t, pattern)
    return strip(t)


def clean_translation(c) -> Column:
    t = _strip_reasoning(col(c))
    for prefix in lx.TRANSLATION_HEADS:
        t = sub(t, rf"(?i)\A{prefix}:\s*")
    return strip(t)


def is_valid_summary(c) -> Column:
    """False for short, marked-up or leaked texts; false for null."""
    t = col(c)
    good = (
        (F.length(t) >= 20)
        & ~F.substring(t, 1, 1).isin("/", "*", "#")
        & ~contains_any(F.lower(t), lx.LEAK_PHRASES)
    )
    return F.coalesce(good, F.lit(False))


def is_bad_summary(c) -> Column:
    return F.coalesce(contains_any(F.lower(col(c)), lx.BAD_SUMMARY_PHRASES), F.lit(False))


def first_sentence(c: Column) -> Column:
    return F.split(c, SENTENCE_BREAK, 2)[0]


def sentences(c) -> Column:
    return F.filter(F.split(col(c), SENTENCE_BREAK), lambda s: s != "")


def fallback_summary(title, raw, cut: int = 180) -> Column:
    """First sentence of the cleaned text when it adds something, else the headline."""
    return fallback_of_clean(title, clean_summary_start(raw, cut), cut)


def fallback_of_clean(title, cleaned, cut: int = 180) -> Column:

    def choose(lead, headline):
        return F.when((F.length(lead) > 25) & (F.lower(lead) != F.lower(headline)), lead).otherwise(headline)

    lead = F.substring(first_sentence(col(cleaned)), 1, cut)
    return let(lead, lambda x: let(clean_headline(title), lambda h: choose(x, h)))


def single_item_summary(title, raw, cut: int = 160) -> Column:
    lead = strip(first_sentence(clean_summary(raw)))
    return let(lead, lambda x: F.when(F.length(x) > 25, F.substring(x, 1, cut)).otherwise(clean_headline(title)))


def report_line(title, raw) -> Column:
    """`- headline: snippet`, or the headline alone when the snippet repeats it."""

    def line(headline, snippet):
        low_title, low_snippet = F.lower(headline), F.lower(snippet)
        adds = (
            (snippet != "")
            & (low_snippet != low_title)
            & ~F.contains(low_title, F.substring(low_snippet, 1, 35))
        )
        return F.when(adds, F.concat(F.lit("- "), headline, F.lit(": "), snippet)).otherwise(
            F.concat(F.lit("- "), headline)
        )

    snippet = F.substring(clean_summary_start(raw, 110), 1, 110)
    return let(clean_headline(title), lambda h: let(snippet, lambda s: line(h, s)))


def meta_description(summary, title, template: str) -> Column:
    """Stored summary or a template with `{title}`, cut to 155 when above 158."""
    head, tail = template.split("{title}")
    own = F.nullif(strip(F.coalesce(col(summary), F.lit(""))), F.lit(""))
    text = F.coalesce(own, F.concat(F.lit(head), strip(col(title)), F.lit(tail)))
    return F.when(F.length(text) > 158, F.concat(F.substring(text, 1, 155), F.lit("..."))).otherwise(text)


# -- feature text -------------------------------------------------------------


def feature_text(title, summary=None) -> Column:
    """Text the hashed features are built from: the title twice and the
    cleaned summary, or the title alone when the summary adds nothing."""
    raw = col(title)
    head = let(squeeze(cut_title_tail(raw)), lambda cut: F.when(F.length(cut) < 3, strip(raw)).otherwise(cut))
    if summary is None:
        return F.coalesce(head, F.lit(""))

    def without_boilerplate(body):
        cleaned = body
        for pattern in lx.FEATURE_BOILERPLATE:
            cleaned = sub(cleaned, "(?i)" + pattern, " ")
        # One look decides whether any of the patterns can match at all.
        hinted = let(F.lower(body), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(h.lower())) for h in lx.FEATURE_BOILERPLATE_HINTS]))
        return F.when(hinted, cleaned).otherwise(body)

    def key(c):
        return sub(F.lower(c), NOT_WORD_OR_SPACE)

    def whole(head, body):
        # The key of a head of the body tells most bodies from the title.
        start = F.substring(body, F.lit(1), F.length(head) * 2 + 64)
        longer = F.length(key(start)) > F.length(key(head))
        trivial = (F.length(body) < 15) | (~longer & let(key(body), lambda k: (k == key(head)) | (k == "")))
        return F.when(trivial, head).otherwise(F.concat(head, F.lit(". "), head, F.lit(". "), body))

    body = let(sub(F.coalesce(col(summary), F.lit("")), TAG, " "), without_boilerplate)
    body = sub(body, lx.DATELINE)
    body = squeeze(cut_title_tail(body))
    return F.coalesce(let(head, lambda h: let(body, lambda b: whole(h, b))), F.lit(""))


def feature_tokens(text, stop_words=None) -> Column:
    """Lower-cased words longer than one character, stop words dropped."""
    stop = stop_words or lx.FEATURE_STOP_WORDS
    words = F.split(sub(F.lower(col(text)), NOT_WORD, " "), SPACE)
    # A list of literals becomes a hash set; an array would be searched word by word.
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop))


# -- prompt text --------------------------------------------------------------


def prompt_lines(raw) -> Column:
    """Cleaned lines of a raw text, before near-duplicates are dropped."""
    t = F.coalesce(col(raw), F.lit(""))
    for element in lx.PROMPT_DROPPED_ELEMENTS:
        t = sub(t, rf"(?is)<{element}.*?</{element}>", " ")
    t = decode_entities(sub(t, TAG, " "))
    t = sub(t, f"(?is)(?:{any_of(lx.PROMPT_CUT_PHRASES)}).*\\z")
    return F.filter(F.transform(F.split(t, r"\r?\n"), squeeze), lambda x: x != "")


def line_key(c: Column) -> Column:
    """Comparison form of a line: publisher tail cut, a-z, 0-9 and Indic only."""
    t = sub(sub(c, r"(?U)\s*\|\s*.*\z"), SIGNED_TAIL)
    t = sub(F.lower(t), r"(?U)[^a-z0-9\x{0900}-\x{0D7F}\s]")
    return squeeze(t)


def distinct_lines(lines, min_overlap: float = 0.68, min_words: int = 4, min_length: int = 25) -> Column:
    """Drop lines that repeat an earlier kept line (equal, contained, or
    overlapping); the fold keeps only the lines kept so far as state."""

    def words(key):
        return F.array_distinct(F.filter(F.split(key, " "), lambda w: F.length(w) > 2))

    keyed = F.filter(
        F.transform(
            col(lines), lambda x: F.struct(x.alias("line"), line_key(x).alias("key"))
        ),
        lambda x: x["key"] != "",
    )
    # A line whose key came before is always dropped, by the same kept line or
    # by its first occurrence, so only first occurrences enter the fold.
    keyed = let(
        keyed,
        lambda rows: let(
            F.transform(rows, lambda x: x["key"]),
            lambda keys: F.filter(rows, lambda x, i: F.array_position(keys, x["key"]) == i + 1),
        ),
    )
    keyed = F.transform(
        keyed, lambda x: F.struct(x["line"].alias("line"), x["key"].alias("key"), words(x["key"]).alias("words"))
    )
    empty = F.expr("cast(array() as array<struct<line:string,key:string,words:array<string>>>)")

    def repeats(x, prev):
        inside = (F.length(prev["key"]) > min_length) & (
            F.contains(prev["key"], x["key"]) | F.contains(x["key"], prev["key"])
        )
        mine, theirs = F.size(x["words"]), F.size(prev["words"])
        # The ratio of sizes bounds the overlap, so most pairs stop there.
        near = (
            (mine >= min_words)
            & (theirs > 0)
            & (F.least(mine, theirs) / F.greatest(mine, theirs, F.lit(1)) >= min_overlap)
            & let(
                F.size(F.array_intersect(x["words"], prev["words"])),
                lambda both: both / (mine + theirs - both) >= min_overlap,
            )
        )
        return (prev["key"] == x["key"]) | inside | near

    kept = F.aggregate(
        keyed,
        empty,
        lambda acc, x: F.when(F.exists(acc, lambda prev: repeats(x, prev)), acc).otherwise(
            F.concat(acc, F.array(x))
        ),
    )
    return F.transform(kept, lambda x: x["line"])


def prompt_text(raw) -> Column:
    return strip(F.array_join(distinct_lines(prompt_lines(raw)), "\n"))


def estimate_tokens(c) -> Column:
    t = F.coalesce(col(c), F.lit(""))
    rate = F.when(t.rlike(r"[\x{0900}-\x{0D7F}]"), F.lit(2.2)).otherwise(F.lit(3.8))
    return F.when(t == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(F.length(t) / rate))).cast("bigint")


def content_hash(version, job, system, user) -> Column:
    return F.sha2(
        F.concat_ws("|", col(version), col(job), strip(col(system)), F.lower(strip(col(user)))), 256
    )


def sentence_chunks(text, limit: int = 420, max_chunks: int | None = None) -> Column:
    """Chunks of whole sentences of at most `limit` estimated tokens, one
    sentence carried over between neighbours."""
    state = "struct<done:array<string>,cur:array<string>,tokens:bigint>"
    start = F.expr(f"cast(named_struct('done', array(), 'cur', array(), 'tokens', 0L) as {state})")

    def step(acc, s):
        size = estimate_tokens(s)
        full = (acc["tokens"] + size > limit) & (F.size(acc["cur"]) > 0)
        carried = F.array(F.element_at(acc["cur"], -1), s)
        return F.when(
            full,
            F.struct(
                F.concat(acc["done"], F.array(F.array_join(acc["cur"], " "))).alias("done"),
                carried.alias("cur"),
                estimate_tokens(F.array_join(carried, " ")).alias("tokens"),
            ),
        ).otherwise(
            F.struct(
                acc["done"].alias("done"),
                F.concat(acc["cur"], F.array(s)).alias("cur"),
                (acc["tokens"] + size).alias("tokens"),
            )
        )

    def finish(acc):
        last = F.when(F.size(acc["cur"]) > 0, F.array(F.array_join(acc["cur"], " "))).otherwise(
            F.expr("cast(array() as array<string>)")
        )
        return F.concat(acc["done"], last)

    chunks = F.aggregate(sentences(text), start, step, finish)
    return chunks if max_chunks is None else F.slice(chunks, 1, max_chunks)


# -- formats --------------------------------------------------------------------


def is_http(c) -> Column:
    return F.coalesce(F.startswith(col(c), F.lit("http")), F.lit(False))


def is_email(c) -> Column:
    return F.coalesce(col(c).rlike(r"(?U)\A[^\s@]+@[^\s@]+\.[^\s@]+\z"), F.lit(False))


def is_uuid(c) -> Column:
    return F.coalesce(
        col(c).rlike(r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"), F.lit(False)
    )


def mask_email(c) -> Column:
    """First and last letter of the local part around `***`."""
    parts = F.split(F.coalesce(col(c), F.lit("")), "@")
    local, domain = parts[0], F.get(parts, F.lit(1))
    bad = domain.isNull() | (local == "") | (domain == "")
    first = F.substring(local, 1, 1)
    return (
        F.when(bad, F.lit("***"))
        .when(F.length(local) <= 2, F.concat(first, F.lit("***@"), domain))
        .otherwise(F.concat(first, F.lit("***"), F.substring(local, -1, 1), F.lit("@"), domain))
    )


def uri_component(c: Column) -> Column:
    """Percent-encoding with the browser's safe set (`!'()*` kept, space as %20)."""
    t = F.url_encode(c)
    for encoded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        t = F.replace(t, F.lit(encoded), F.lit(plain))
    return t


def compliance_headers(email, token, site: str, reply_to: str) -> Column:
    base = site.rstrip("/")
    suffix = F.when(
        F.coalesce(col(token), F.lit("")) != "", F.concat(F.lit("?token="), uri_component(col(token)))
    ).otherwise(F.lit(""))
    link = F.concat(F.lit(f"<{base}/api/newsletter/unsubscribe"), suffix, F.lit(">"))
    mail = F.concat(F.lit(f"<mailto:{reply_to}?subject=Unsubscribe%20"), uri_component(col(email)), F.lit(">"))
    return F.create_map(
        F.lit("List-Unsubscribe"), F.concat(link, F.lit(", "), mail),
        F.lit("List-Unsubscribe-Post"), F.lit("List-Unsubscribe=One-Click"),
    )


def bounce_class(message, code) -> Column:
    """quota / permanent / temporary from an error text and code."""
    c = col(code)
    text = F.lower(F.concat_ws(" ", F.coalesce(col(message), F.lit("")), F.coalesce(c.cast("string"), F.lit(""))))
    quota = contains_any(text, lx.BOUNCE_QUOTA_PHRASES) | ((c == 550) & F.contains(text, F.lit("limit")))
    permanent = c.between(500, 599) | contains_any(text, lx.BOUNCE_PERMANENT_PHRASES)
    return (
        F.when(F.coalesce(quota, F.lit(False)), "quota")
        .when(F.coalesce(permanent, F.lit(False)), "permanent")
        .otherwise("temporary")
    )


def is_private_host(url) -> Column:
    """True for local names and private IPv4 ranges."""
    host = F.lower(F.try_parse_url(col(url), F.lit("HOST")))
    return F.coalesce(
        host.isin("localhost", "127.0.0.1", "0.0.0.0")
        | host.rlike(r"\.(?:local|internal)\z")
        | host.rlike(r"\A(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[0-1])\.)"),
        F.lit(False),
    )


def url_host(c) -> Column:
    """Host of a url without a leading `www.`, null when it has none."""
    return sub(F.try_parse_url(col(c), F.lit("HOST")), r"\Awww\.")
