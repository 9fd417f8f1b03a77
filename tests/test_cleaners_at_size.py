"""Shortened ways of the text cleaners give what the long ways give."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from storyhub.functions import lexicon as lx
from storyhub.functions import media, text, topics


def test_start_of_a_cleaned_text_equals_the_cleaned_text(spark):
    rng = random.Random(7)
    parts = ["word ", "a. b", "&amp;quot;", "&amp;", "&nbsp;", "<b>", "</p", "<a href='x y'>", "\n\n", "  ", "Read More", "full coverage", " click here", " for more", "é! ", "&lt;", "𝒳"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 40, 150, 400]))) for _ in range(400)]
    texts += ["x" * 5000, " " * 3000 + "late", "<" + "y" * 4000 + ">" + "z" * 300, "w " * 150 + "&am", None]
    # A cut at every place of an entity, a tag and a phrase.
    texts += ["v" * k + tail + " end" * 40 for k in range(280, 420) for tail in ("&amp;quot;", "<i>", "Read more")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    wrong = rows.filter(F.substring(text.clean_summary_start("t", 40), 1, 40) != F.substring(text.clean_summary("t"), 1, 40))
    assert wrong.collect() == []


def test_only_the_start_of_a_long_text_is_cleaned(spark):
    long = spark.createDataFrame([("calm words. " * 20_000,)], "t string")
    assert long.select(text.fallback_summary(F.lit("calm title"), "t").alias("x")).first()["x"] == "calm title"
    assert long.select(F.length(text.clean_summary_start("t", 40)).alias("n")).first()["n"] < 500


def test_keywords_of_other_scripts_are_ruled_out_by_one_look(spark):
    words = ["protest", "sit-in", "धरना", "பந்த்", "हड़ताल"]
    assert topics.keyword_pattern(words, "all").startswith("(?=[")
    texts = ["a Protest here", "protests", "xprotest", "the sit-in.", "आज धरना है", "பந்த்", "धरन", "nothing", "", "protest", "हड़ताल"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in rows.select(topics.matches_keywords("t", words, "all")).collect()]
    assert found == [True, False, False, True, True, True, False, False, False, True, True]


def test_sensitive_phrases_in_any_case(spark):
    texts = [p.title() + " today" for p in lx.SENSITIVE_PHRASES] + ["a communal garden", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in rows.select(topics.is_sensitive("t")).collect()]
    assert found == [True] * len(lx.SENSITIVE_PHRASES) + [False, False, None]


def test_article_is_cleaned_once(spark):
    column = media.article_text(F.col("html"), "url")
    pages = spark.createDataFrame([("<main><p>" + "A long paragraph of an article. " * 30 + "</p></main>", "https://a.example/x")], "html string, url string")
    plan = pages.select(column.alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</noscript>") == 1
    assert pages.select(column.alias("a")).first()["a"].startswith("A long paragraph of an article.")
