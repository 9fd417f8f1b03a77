"""Labelled cases: cleaners, topics, scripts, times, mail, quota texts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from storyhub.functions import media, text, times, topics

NB = " "


@pytest.mark.parametrize(
    "title,want",
    [
        ("Rain hits coast - Daily Herald", "rain hits coast"),
        ("Rain hits coast | Herald", "rain hits coast"),
        ("Rain hits coast — Herald", "rain hits coast"),
        (f"Rain hits coast{NB}{NB}Herald", "rain hits coast"),
        (f"Rain{NB}hits,  coast!", "rain hits coast"),
        # The cut starts at the first hyphen of any kind.
        ("Six all-party talks", "six all"),
        ("मुंबईत पाऊस - लोकसत्ता", "मुंबईत पाऊस"),
        ("", ""),
        (None, ""),
    ],
)
def test_normalize_title(spark, title, want):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(text.normalize_title("t")).first()[0] == want


@pytest.mark.parametrize(
    "a,b,want",
    [("court grants bail", "court grants bail", 1.0), ("ab cd", "ab cd", 0.0), ("one two three", "two three four", 0.5), ("", "x", 0.0)],
)
def test_jaccard(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(text.title_jaccard("a", "b")).first()[0] == pytest.approx(want)


TOPIC_CASES = [
    ("Cup final tonight after long rally", None, "General"),
    ("UP police open new academy", None, "Courts & Law"),
    ("Bandhan shares rise on results", None, "Economy"),
    ("Bandh called by unions on Friday", None, "Protests"),
    ("IPL auction sees record bids", None, "Sports"),
    ("Netflix to stream regional film", None, "Entertainment"),
    ("ISRO readies lunar mission", None, "Technology"),
    ("Dengue cases fill wards", None, "Health"),
    ("Cyclone nears the east coast", None, "Environment"),
    ("भाजपा की बैठक आज", None, "Politics"),
    ("दिल्ली में धरना जारी", None, "Protests"),
    ("Anything at all", "BOOM Live Desk", "Fact-Check"),
    ("Lucknow gets a new bridge", None, "UP & Bihar"),
    ("Chennai metro opens line", None, "South India"),
    ("Karan's new romantic drama finishes casting", None, "Entertainment"),
    ("Box office numbers cross a record after the teaser", None, "Entertainment"),
    ("Director denies talk of a death in the climax of the movie", None, "Entertainment"),
    ("Bollywood star buys a duplex by the sea", None, "Entertainment"),
    ("Commercial real estate investments climb in the third quarter", None, "Economy"),
    ("Doctors at AIIMS use a robot for heart surgery", None, "Health"),
    ("Vaccine shows strong protection against a virus", None, "Health"),
    ("World Cup trophy lifted after a tense final over", None, "Sports"),
    ("Kohli reaches another century as BCCI names the squad", None, "Sports"),
    ("Badminton players win medal at the Asian Games", None, "Sports"),
    ("Playoffs: home side qualify with a late goal", None, "Sports"),
    ("Modi speaks in Lok Sabha as Parliament votes", None, "Politics"),
    ("BJP and Congress clash before the assembly election", None, "Politics"),
    ("Supreme Court grants bail and asks for a reply", None, "Courts & Law"),
    ("High Court bench gives verdict on judicial reform", None, "Courts & Law"),
    ("CBI raids lead to arrests in a fraud case", None, "Courts & Law"),
    ("RBI holds repo rate as inflation eases", None, "Economy"),
    ("Sensex and Nifty close at a record", None, "Economy"),
    ("Google and Apple add generative AI to smartphones", None, "Technology"),
    ("Semiconductor plant approved", None, "Technology"),
    ("Wall Street slips as Federal Reserve turns cautious", None, "Economy"),
    ("Oil prices jump on supply worries", None, "Economy"),
    ("Yamuna water level passes danger mark after monsoon rain", None, "Environment"),
    ("Air pollution worsens with stubble burning", None, "Environment"),
    ("Farmers hold a protest march and chakka jam", None, "Protests"),
]


@pytest.mark.parametrize("title,name,want", TOPIC_CASES)
def test_topics(spark, title, name, want):
    df = spark.createDataFrame([(title, name)], "t string, n string")
    assert df.select(topics.topic_of("t", "n")).first()[0] == want


def test_discourse_fallback_and_region(spark):
    df = spark.createDataFrame([("Plain talk", "discourse", "kerala"), ("कup final", "discourse", "national")], "t string, lane string, r string")
    rows = df.select(topics.topic_of("t", lane="lane").alias("topic"), topics.region_of("t", "r").alias("region")).collect()
    assert [tuple(r) for r in rows] == [("Discourse & Civic", "Kerala"), ("Discourse & Civic", "Uttar Pradesh")]


@pytest.mark.parametrize(
    "sample,lang,code",
    [
        ("Plain words", "en", "en"), ("पाणी पुरवठा आहे", "all", "mr"), ("सरकार ने कहा", "hi", "hi"), ("ప్రభుత్వం", None, "te"),
        ("அரசு", None, "ta"), ("സർക്കാർ", None, "ml"), ("ಸರ್ಕಾರ", None, "kn"), ("સરકાર", None, "gu"), ("সরকার", None, "bn"),
        ("ਸਰਕਾਰ", None, "pa"), ("Bonjour", "fr", "fr"), ("", "fr", "en"), ("सरकार", "mr", "mr"),
    ],
)
def test_scripts(spark, sample, lang, code):
    df = spark.createDataFrame([(sample, lang)], "t string, l string")
    got = df.select(topics.script_language("t", "l").alias("x")).first()["x"]
    assert got["code"] == code and got["is_non_english"] == (code != "en")


@pytest.mark.parametrize(
    "told,protest", [("Farmers on dharna", True), ("किसानों का मोर्चा", True), ("Bandhan Bank opens", False), ("a sit-in at noon", True)]
)
def test_protest_words(spark, told, protest):
    df = spark.createDataFrame([(told,)], "t string")
    assert df.select(topics.is_protest("t")).first()[0] is protest


@pytest.mark.parametrize(
    "mail,want",
    [("reader.name@site.org", "r***e@site.org"), ("ab@site.org", "a***@site.org"), ("x@site.org", "x***@site.org"), ("none", "***"), ("", "***"), (None, "***")],
)
def test_mask_email(spark, mail, want):
    assert spark.createDataFrame([(mail,)], "m string").select(text.mask_email("m")).first()[0] == want


@pytest.mark.parametrize("header,want", [("2m52.8s", 172800), ("180ms", 180), ("3", 3000), ("1h", 3600000), ("soon", None), (None, None)])
def test_reset_header(spark, header, want):
    assert spark.createDataFrame([(header,)], "h string").select(times.reset_header_ms("h")).first()[0] == want


def test_ist_midnight(one):
    assert one(times.ist_day_start("2026-10-03 01:30:00")) == datetime(2026, 10, 2, 18, 30)


@pytest.mark.parametrize(
    "pub,fetch,want",
    [
        ("2024-01-01 10:00:00", None, "2024-01-01 10:00:00"),
        ("2024-01-01 17:00:00", None, "2024-01-01 11:30:00"),
        ("2024-01-02 17:00:00", "2024-01-01 11:00:00", "2024-01-01 11:00:00"),
        ("2024-01-02 17:00:00", None, "2024-01-01 12:00:00"),
        (None, "2024-01-01 13:00:00", "2024-01-01 12:00:00"),
        (None, None, None),
    ],
)
def test_effective_time(spark, pub, fetch, want):
    df = spark.createDataFrame([(pub, fetch)], "p string, f string").select(F.to_timestamp("p").alias("p"), F.to_timestamp("f").alias("f"))
    got = df.select(times.effective_time("p", "f", "2024-01-01 12:00:00")).first()[0]
    assert got == (datetime.fromisoformat(want) if want else None)


@pytest.mark.parametrize(
    "age,secs", [("3 hours ago", 10800), ("2d ago", 172800), ("42 min ago", 2520), ("Streamed 5h ago", 18000), ("1w ago", 604800),
                 ("2 months ago", 5184000), (f"7{NB}mins ago", 420), ("yesterday", None), (None, None)]
)
def test_relative_time(spark, age, secs):
    df = spark.createDataFrame([(age,)], "a string")
    got = df.select(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) - F.unix_seconds(times.relative_time("a", "2024-01-01"))).first()[0]
    assert got == secs


@pytest.mark.parametrize(
    "raw", ["Wed, 03 Jan 2024 10:20:30 GMT", "3 Jan 2024 10:20:30 +0000", "2024-01-03T10:20:30Z", "2024-01-03T15:50:30+05:30", "Wed, 03 Jan 2024 15:50:30 +0530"]
)
def test_feed_time(spark, raw):
    got = spark.createDataFrame([(raw,)], "t string").select(times.feed_time("t")).first()[0]
    assert got == datetime(2024, 1, 3, 10, 20, 30)


def test_prompt_lines_lose_page_chrome_and_repeats(spark):
    html = (
        "<nav>Home Menu</nav><p>Officials open the new river bridge on Monday - Herald</p>\n"
        "<p>Officials open the new river bridge on Monday | Daily Post</p>\n<p>Traffic moves to the old road for a week</p>"
        "<footer>Terms</footer>\n<p>Read more about it</p>"
    )
    got = spark.createDataFrame([(html,)], "h string").select(text.prompt_text("h")).first()[0]
    assert got.split("\n") == ["Officials open the new river bridge on Monday - Herald", "Traffic moves to the old road for a week"]


def test_feature_text_drops_boilerplate(spark):
    rows = [
        ("Court grants bail - Herald", "View full coverage on Google News", "Court grants bail"),
        ("Court grants bail", None, "Court grants bail"),
        ("Court grants bail", "Court grants bail!", "Court grants bail"),
        ("Court grants bail", "Channel · 2K views — The judge heard both sides today", "Court grants bail. Court grants bail. The judge heard both sides today"),
    ]
    df = spark.createDataFrame(rows, "t string, s string, want string")
    for r in df.select(text.feature_text("t", "s").alias("got"), "want").collect():
        assert r["got"] == r["want"]


@pytest.mark.parametrize(
    "message,code,want",
    [("550 5.4.5 limit", 550, "quota"), ("over the limit", 550, "quota"), ("no such box", 550, "permanent"), ("User unknown", None, "permanent"), ("timeout", 421, "temporary")],
)
def test_bounce_class(spark, message, code, want):
    df = spark.createDataFrame([(message, code)], "m string, c int")
    assert df.select(text.bounce_class("m", "c")).first()[0] == want


def test_video_helpers(spark):
    df = spark.createDataFrame(
        [("https://youtu.be/abcdefghijk", "https://www.youtube.com/results?search_query=night+desk%20live", "Night Desk"), ("https://x.org/a", "bad", "Night Desk")],
        "u string, f string, n string",
    )
    rows = df.select(media.video_embed_url("u").alias("e"), media.video_query("f", "n").alias("q")).collect()
    assert [tuple(r) for r in rows] == [("https://www.youtube.com/embed/abcdefghijk", "night desk live"), (None, "Night Desk India news")]
