"""Topic, region, script and sensitivity tags as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyhub.functions import lexicon as lx
from storyhub.functions.text import any_of, col, contains_any, let, whole_word


def shared_prefixes(words, prefix_is_enough: bool) -> str:
    """Regex for any of the words with common beginnings written once, so a
    position that starts no word is left after one character. Where a word may
    match anywhere, it stands for all longer words it begins."""
    tree: dict = {}
    for word in words:
        node = tree
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node) -> str:
        if "" in node and (prefix_is_enough or len(node) == 1):
            return ""
        parts = [re.escape(ch) + render(node[ch]) for ch in node if ch]
        body = parts[0] if len(parts) == 1 and "" not in node else "(?:" + "|".join(parts) + ")"
        return body + "?" if "" in node else body

    return render(tree)


def keyword_pattern(words, whole=None) -> str:
    """One regex for a keyword list.

    Non-ASCII keywords match anywhere, listed or short ASCII ones as whole
    words, other ASCII ones anywhere. `whole="all"` makes every ASCII keyword a
    whole word, `whole="none"` none.
    """
    anywhere, bounded, odd = [], [], []
    for word in dict.fromkeys(w.lower().strip() for w in words):
        if not word.isascii() or whole == "none" or not (
            whole == "all" or word in lx.WHOLE_WORD_KEYWORDS or len(word) <= 3
        ):
            anywhere.append(word)
        elif re.fullmatch(r"\w.*\w|\w", word, re.ASCII):
            bounded.append(word)
        else:
            odd.append(whole_word(word))
    ascii_, other = [w for w in anywhere if w.isascii()], [w for w in anywhere if not w.isascii()]
    parts = [shared_prefixes(ascii_, True)] if ascii_ else []
    if other:
        # One look at a range rules most positions out; trying every first letter is slow.
        first = sorted(w[0] for w in other)
        parts.append(f"(?=[{re.escape(first[0])}-{re.escape(first[-1])}]){shared_prefixes(other, True)}")
    if bounded:
        first = "".join(sorted({w[0] for w in bounded}))
        parts.append(f"(?<![A-Za-z0-9_])(?=[{first}]){shared_prefixes(bounded, False)}(?![A-Za-z0-9_])")
    return "|".join(parts + odd)


def matches_keywords(text, words, whole=None) -> Column:
    return F.lower(col(text)).rlike(keyword_pattern(words, whole))


def topic_of(title, source_name=None, lane=None, topics=None) -> Column:
    """First topic in precedence order with a keyword in the title."""
    topics = topics or lx.TOPIC_WORDS
    low = F.lower(F.coalesce(col(title), F.lit("")))
    topic = F.lit("General")
    if lane is not None:
        topic = F.when(F.coalesce(col(lane) == "discourse", F.lit(False)), "Discourse & Civic").otherwise(topic)
    plain = topic
    for name in reversed(list(topics)):
        topic = F.when(low.rlike(keyword_pattern(topics[name])), name).otherwise(topic)
    # Most titles name no topic: one look at all keywords settles them.
    topic = F.when(low.rlike(keyword_pattern([w for ws in topics.values() for w in ws])), topic).otherwise(plain)
    if source_name is not None:
        checker = contains_any(F.lower(F.coalesce(col(source_name), F.lit(""))), lx.FACT_CHECK_TAG_SOURCES)
        topic = F.when(checker, "Fact-Check").otherwise(topic)
    return topic


def region_of(title, source_region=None) -> Column:
    """Region by source code unless national, else by the title."""
    low = F.lower(F.coalesce(col(title), F.lit("")))
    region = F.lit(lx.DEFAULT_REGION)
    for name, fragments in reversed(lx.REGION_TITLE_RULES):
        whole = [whole_word(w) for w in lx.REGION_WHOLE_WORDS.get(name, [])]
        pattern = "|".join([*whole, *map(re.escape, fragments)])
        region = F.when(low.rlike(pattern), name).otherwise(region)
    if source_region is not None:
        named = F.lit(None).cast("string")
        for code, name in lx.REGION_NAMES.items():
            named = F.when(col(source_region) == code, name).otherwise(named)
        region = F.coalesce(named, region)
    return region


def script_language(text, source_lang=None) -> Column:
    """struct(code, name, is_non_english) from the script of a text."""
    t = F.coalesce(col(text), F.lit(""))
    lang = F.lit(None).cast("string") if source_lang is None else col(source_lang)

    def tag(code, name, foreign):
        return F.struct(
            (F.lit(code) if isinstance(code, str) else code).alias("code"),
            (F.lit(name) if isinstance(name, str) else name).alias("name"),
            F.lit(foreign).alias("is_non_english"),
        )

    english = tag("en", "English", False)
    marathi = (F.coalesce(lang, F.lit("")) == "mr") | t.rlike(any_of(lx.MARATHI_MARKS))
    other = F.when(lang.isNotNull() & ~lang.isin("", "en", "all"), tag(lang, F.upper(lang), True)).otherwise(english)
    out = F.when(
        t.rlike(r"[\x{0900}-\x{097F}]"),
        F.when(marathi, tag("mr", "Marathi", True)).otherwise(tag("hi", "Hindi", True)),
    ).otherwise(other)
    for low, high, code, name in reversed(lx.SCRIPT_BLOCKS):
        out = F.when(t.rlike(rf"[\x{{{low}}}-\x{{{high}}}]"), tag(code, name, True)).otherwise(out)
    return F.when(t == "", english).otherwise(out)


def is_sensitive(text) -> Column:
    # A plain search a phrase is faster than one regex over all of them.
    return let(F.lower(col(text)), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in lx.SENSITIVE_PHRASES]))


def is_protest(text) -> Column:
    return matches_keywords(text, lx.PROTESTS_WORDS, whole="all")
