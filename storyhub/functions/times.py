"""Time rules. The clock is never read: `as_of` is always passed in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyhub.functions.text import col, sub

IST = "Asia/Kolkata"


def as_ts(value) -> Column:
    """A Column stays itself; anything else becomes a timestamp literal."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def seconds_before(as_of, seconds) -> Column:
    return as_ts(as_of) - F.make_dt_interval(secs=F.lit(float(seconds)))


def hours_before(as_of, hours) -> Column:
    return seconds_before(as_of, hours * 3600)


def seconds_between(later, earlier) -> Column:
    """Difference in seconds with millisecond resolution."""
    return (F.unix_millis(col(later)) - F.unix_millis(col(earlier))) / F.lit(1000.0)


def effective_time(published, fetched, as_of) -> Column:
    """Publication time, with future-dated rows pulled back: by 5:30 h when
    that explains the skew, else to the fetch time (at most `as_of`)."""
    pub, fetch, now = col(published), col(fetched), as_ts(as_of)
    soon = now + F.expr("INTERVAL 1 MINUTE")
    shifted = pub - F.expr("INTERVAL '5:30' HOUR TO MINUTE")
    bounded_fetch = F.least(fetch, now)
    return (
        F.when(pub.isNull(), F.when(fetch.isNotNull(), bounded_fetch))
        .when(pub <= soon, pub)
        .when(shifted <= soon, shifted)
        .otherwise(F.coalesce(bounded_fetch, now))
    )


def time_ago(ts, as_of) -> Column:
    now = as_ts(as_of)
    when = effective_time(ts, F.lit(None).cast("timestamp"), now)
    secs = F.floor(seconds_between(now, when))
    mins, hours, days = F.floor(secs / 60), F.floor(secs / 3600), F.floor(secs / 86400)
    return (
        F.when(when.isNull(), "")
        .when(secs < 60, "just now")
        .when(mins < 60, F.concat(mins.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(when, "d MMM"))
    )


# Seconds per unit of a relative age such as "3 hours ago".
AGE_UNITS = [
    (r"s|sec.*", 1), (r"m|min.*", 60), (r"h|hr.*|hour.*", 3600), (r"d|day.*", 86400),
    (r"w|wk.*|week.*", 604800), (r"mo|month.*", 2592000), (r"y|yr.*|year.*", 31536000),
]
AGE_PATTERN = (
    r"(?i)(\d+)\s*(mo|months?|mins?|minutes?|secs?|seconds?|hrs?|hours?|days?|wks?|weeks?|yrs?|years?"
    r"|s|m|h|d|w|y)\s+ago"
)


def relative_time(text, as_of) -> Column:
    """Timestamp of "N units ago", null when the text does not say."""
    t = F.trim(F.replace(col(text), F.lit("\u00a0"), F.lit(" ")))
    unit = F.lower(F.regexp_extract(t, AGE_PATTERN, 2))
    amount = F.regexp_extract(t, AGE_PATTERN, 1).try_cast("bigint")
    unit_secs = F.lit(None).cast("bigint")
    for pattern, secs in reversed(AGE_UNITS):
        unit_secs = F.when(unit.rlike(rf"\A(?:{pattern})\z"), F.lit(secs).cast("bigint")).otherwise(unit_secs)
    return F.timestamp_millis(F.unix_millis(as_ts(as_of)) - amount * unit_secs * 1000)


def feed_time(text) -> Column:
    """ISO 8601 or RFC 822 time; the weekday is cut because the parser refuses it."""
    t = F.trim(sub(col(text), r"\A\s*[A-Za-z]{3,9},\s*"))
    zone = sub(t, r"\s(?:GMT|UTC|UT|Z)\z", " +0000")
    return F.coalesce(
        F.try_to_timestamp(t),
        F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm Z")),
        F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss")),
    )


def reset_header_ms(text) -> Column:
    """Milliseconds of "2m52.8s", "180ms" or plain seconds; null without a match."""
    t = F.trim(col(text))

    def part(pattern, factor):
        return F.regexp_extract(t, pattern, 1).try_cast("double") * factor

    number = r"(\d+(?:\.\d+)?)"
    parts = [
        part(rf"(?i){number}h", 3600000.0),
        part(rf"(?i){number}m(?!s)", 60000.0),
        part(rf"(?i){number}s", 1000.0),
        part(rf"(?i){number}ms", 1.0),
    ]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    plain = F.when(t.rlike(r"\A\d+(?:\.\d+)?\z"), t.try_cast("double") * 1000)
    return F.ceil(F.coalesce(plain, F.when(F.coalesce(*parts).isNotNull(), total)))


def next_daily_reset(as_of, reset_hour) -> Column:
    """Next moment the UTC clock shows `reset_hour`; a null hour means midnight."""
    now = as_ts(as_of)
    hour = reset_hour if isinstance(reset_hour, Column) else F.lit(reset_hour).cast("int")
    today = F.date_trunc("DAY", now) + F.make_dt_interval(hours=F.coalesce(hour, F.lit(0)))
    return F.when(today > now, today).otherwise(today + F.expr("INTERVAL 1 DAY"))


def ist_day_start(as_of) -> Column:
    """Midnight of the current day in India, as a UTC timestamp."""
    local = F.from_utc_timestamp(as_ts(as_of), IST)
    return F.to_utc_timestamp(F.date_trunc("DAY", local), IST)


def ist_long_date(ts) -> Column:
    return F.date_format(F.from_utc_timestamp(as_ts(ts), IST), "EEEE, d MMMM yyyy")
