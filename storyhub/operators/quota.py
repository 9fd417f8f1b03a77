"""Request quotas derived from a call log: usage, headroom, admission, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyhub.functions import times
from storyhub.functions.text import col
from storyhub.session import materialize

LIMIT_SCHEMA = (
    "model string, provider string, scope string, reset_hour int, rpm long, rpd long, tpm long, tpd long, "
    "day_units double, context long, sensitive_ok boolean, configured boolean"
)

# Operational limits per model (requests and tokens per minute and
# day, daily units, context window, sensitive content allowed, configured).
MODEL_LIMITS = [
    ("groq:openai/gpt-oss-20b", "groq", "per_model", None, 30, 1000, 8000, 200000, None, 131072, True, True),
    ("groq:qwen/qwen3.8-27b", "groq", "per_model", None, 30, 1000, 8000, 200000, None, 131072, True, True),
    ("groq:openai/gpt-oss-120b", "groq", "per_model", None, 30, 1000, 8000, 200000, None, 131072, True, True),
    ("cloudflare:@cf/meta/llama-3.1-8b-instruct-fast", "cloudflare", "per_account", None, 20, 4800, 40000, 750000, 10000.0, 32768, True, True),
    ("gemini:gemini-3.5-flash-lite", "gemini", "per_project", 7, 15, 1000, 250000, 1500000, None, 1048576, False, True),
    ("openrouter:google/gemma-4-31b-it:free", "openrouter", "per_account", None, 20, 50, 40000, 100000, None, 262144, False, True),
    ("openrouter:google/gemma-4-26b-a4b-it:free", "openrouter", "per_account", None, 20, 50, 40000, 100000, None, 262144, False, True),
]

# Model order per kind of job; "*" is the rotating trio.
ROTATING_MODELS = ["groq:openai/gpt-oss-20b", "groq:qwen/qwen3.8-27b", "groq:openai/gpt-oss-120b"]
_CF = "cloudflare:@cf/meta/llama-3.1-8b-instruct-fast"
_GEMINI = "gemini:gemini-3.5-flash-lite"
_SPARE = ["openrouter:google/gemma-4-31b-it:free", "openrouter:google/gemma-4-26b-a4b-it:free"]
ROUTES = {
    "long_input": [_GEMINI, "*", _CF, *_SPARE],
    "final_merge": [ROTATING_MODELS[2], ROTATING_MODELS[1], _GEMINI, ROTATING_MODELS[0], _CF, *_SPARE],
    "default": ["*", _CF, _GEMINI, *_SPARE],
}
NOT_FOR_SENSITIVE = [_GEMINI, *_SPARE]

# Output allowance per job.
OUTPUT_TOKENS = {
    "chunk_summary": 70, "short_medium": 110, "final_merge": 110, "long_input": 110, "headline_translation": 65,
}
BUFFER = 0.12
UNITS_PER_REQUEST = 2.5


def model_limits(spark, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or MODEL_LIMITS, LIMIT_SCHEMA)


def daily_usage(calls: DataFrame, limits: DataFrame) -> DataFrame:
    """Requests, tokens and units per model and day; a shared scope sums its
    provider. The log is reduced to one row per model and day first."""
    units = F.col("units") if "units" in calls.columns else F.lit(0.0)
    per_model = calls.groupBy("model", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum(units).alias("units")
    )
    joined = per_model.join(limits.select("model", "provider", "scope"), "model")
    pool = W.partitionBy("provider", "day")
    shared = F.col("scope") != "per_model"
    for name in ("requests", "tokens", "units"):
        total = F.sum(name).over(pool)
        joined = joined.withColumn(f"{name}_used", F.when(shared, total).otherwise(F.col(name)))
    return joined.select("model", "provider", "day", "requests_used", "tokens_used", "units_used")


def dashboard(calls: DataFrame, limits: DataFrame, day, as_of, cooling: DataFrame | None = None) -> DataFrame:
    """Used and remaining per model for one day, remaining floored at 0."""
    usage = daily_usage(calls.filter(F.to_date("ts") == F.to_date(F.lit(day))), limits).drop("provider")
    out = limits.join(usage, "model", "left")
    for name, cap in (("requests", "rpd"), ("tokens", "tpd")):
        used = F.coalesce(f"{name}_used", F.lit(0))
        out = out.withColumn(f"{name}_used", used).withColumn(
            f"{name}_left", F.greatest(F.lit(0), F.col(cap) - F.col(f"{name}_used"))
        )
    out = out.withColumn("reset_at", times.next_daily_reset(as_of, F.col("reset_hour")))
    if cooling is not None:
        out = out.join(cooling.select("model", "cooling_until"), "model", "left").withColumn(
            "cooling", F.coalesce(F.col("cooling_until") > times.as_ts(as_of), F.lit(False))
        )
    return out


def hit_rate(hits, total) -> Column:
    """Share in percent with one decimal, "0.0%" for nothing."""
    share = F.when(col(total) > 0, F.lit(100.0) * col(hits) / col(total)).otherwise(F.lit(0.0))
    return F.format_string("%.1f%%", share)


def rolling_usage(calls: DataFrame, seconds: int = 60, slice_seconds: int = 600) -> DataFrame:
    """Requests and tokens of the last `seconds` per model, at every call.

    The window runs per model and time slice; calls near the end of a slice
    are copied into the next one as history. A model with a third of all calls
    is thereby cut into slices, and the result equals the unsliced window.
    """
    at = F.unix_micros("ts")
    width, span = slice_seconds * 1_000_000, seconds * 1_000_000
    own = F.floor(at / width)
    with_slice = calls.withColumn("__at", at).withColumn(
        "__slice", F.explode(F.sequence(own, F.floor((at + span) / width)))
    )
    with_slice = with_slice.withColumn("__own", F.col("__slice") == F.floor(F.col("__at") / width))
    # Both frames only grow, so a row is added once however long the span is.
    w = W.partitionBy("model", "__slice").orderBy("__at")
    until, before = w.rangeBetween(W.unboundedPreceding, 0), w.rangeBetween(W.unboundedPreceding, -span - 1)
    return (
        with_slice.withColumn("minute_requests", F.count("*").over(until) - F.count("*").over(before))
        .withColumn("minute_tokens", F.sum("tokens").over(until) - F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .filter("__own")
        .drop("__at", "__slice", "__own")
    )


def next_points(points: DataFrame, span: int, width: int) -> DataFrame:
    """(model, at, jump): the first point of the model at least `span` after each one.

    The answer lies in the slice of the time asked for, or it is the first point of
    the next slice that has any; so windows run over one slice, or over one row per slice."""
    asked = points.select("model", (F.col("at") + span).alias("pos"), F.col("at").alias("ask"))
    both = points.select("model", F.col("at").alias("pos"), F.lit(None).cast("bigint").alias("ask")).unionByName(asked)
    both = both.withColumn("slice", F.floor(F.col("pos") / width))
    # Backwards in time, as Spark adds up a frame that grows once, but one that shrinks anew for each row.
    here = F.min(F.when(F.col("ask").isNull(), F.col("pos"))).over(
        W.partitionBy("model", "slice").orderBy(F.col("pos").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    )
    found = both.withColumn("here", here).filter("ask IS NOT NULL").select("model", "slice", F.col("ask").alias("at"), "here")
    firsts = both.groupBy("model", "slice").agg(F.min(F.when(F.col("ask").isNull(), F.col("pos"))).alias("first"))
    later = F.min("first").over(W.partitionBy("model").orderBy(F.col("slice").desc()).rowsBetween(W.unboundedPreceding, -1))
    firsts = firsts.withColumn("later", later).select("model", "slice", "later")
    return found.join(firsts, ["model", "slice"]).select("model", "at", F.coalesce("here", "later").alias("jump"))


def block_starts(points: DataFrame, span: int, width: int) -> DataFrame:
    """(model, at) of the points at which a block begins: the first of a model, and then
    always the first one `span` or more after the last start.

    Pointer doubling: links to the next start are doubled, and starts pass their mark
    along them, so n starts in a row are marked in log2(n) joins. Joins are on
    model and time, so a model with most of the calls is no hot key."""
    head = points.groupBy("model").agg(F.min("at").alias("at")).withColumn("start", F.lit(True))
    links = next_points(points, span, width)
    state = materialize(links.join(head, ["model", "at"], "left").withColumn("start", F.coalesce("start", F.lit(False))))
    ends = points.agg(((F.max("at") - F.min("at")) / span).alias("n")).first()["n"]
    for _ in range(int(ends or 0).bit_length() + 1):
        marked = state.filter("start AND jump IS NOT NULL").select("model", F.col("jump").alias("at"), F.lit(True).alias("hit")).distinct()
        further = state.select("model", F.col("at").alias("jump"), F.col("jump").alias("far"))
        state = materialize(
            state.join(further, ["model", "jump"], "left").join(marked, ["model", "at"], "left")
            .select("model", "at", F.col("far").alias("jump"), (F.col("start") | F.coalesce("hit", F.lit(False))).alias("start"))
        )
    return state.filter("start").select("model", "at")


def block_usage(calls: DataFrame, seconds: int = 60, slice_seconds: int = 600) -> DataFrame:
    """Requests and tokens of the current block per model, at every call: a block
    begins with the first call `seconds` or more after the start of the last
    one, and counters begin anew. Calls at one time count together; calls without
    a time are left out."""
    width, span = slice_seconds * 1_000_000, seconds * 1_000_000
    timed = calls.withColumn("__at", F.unix_micros("ts")).filter("__at IS NOT NULL")
    points = materialize(timed.select("model", F.col("__at").alias("at")).distinct())
    starts = block_starts(points, span, width)
    # A start is less than `span` before all calls of its block: it is copied that far.
    own = F.floor(F.col("at") / width)
    spread = starts.withColumn("slice", F.explode(F.sequence(own, F.floor((F.col("at") + span) / width))))
    seen = points.withColumn("slice", own).withColumn("begin", F.lit(None).cast("bigint")).unionByName(spread.withColumn("begin", F.col("at")))
    begin = F.max("begin").over(W.partitionBy("model", "slice").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow))
    blocks = seen.withColumn("block", begin).filter("begin IS NULL").select("model", F.col("at").alias("__at"), "block")
    by_time = blocks.join(
        timed.groupBy("model", "__at").agg(F.count("*").alias("__n"), F.sum("tokens").alias("__t")), ["model", "__at"]
    )
    so_far = W.partitionBy("model", "block").orderBy("__at").rowsBetween(W.unboundedPreceding, W.currentRow)
    by_time = by_time.select(
        "model", "__at", F.timestamp_micros("block").alias("block_start"),
        F.sum("__n").over(so_far).alias("minute_requests"), F.sum("__t").over(so_far).alias("minute_tokens"),
    )
    return timed.join(by_time, ["model", "__at"]).drop("__at")


def admission(requests: DataFrame, usage: DataFrame, limits: DataFrame, as_of) -> DataFrame:
    """Allow or refuse each request x model, with the first failing reason.

    `requests` names a model, tokens, a priority and a sensitivity flag;
    `usage` has one row per model (minute and day figures, cooling time).
    """
    now = times.as_ts(as_of)
    r = requests.join(limits, "model", "left").join(usage, "model", "left")

    def used(name):
        return F.coalesce(F.col(name), F.lit(0))

    need = F.col("input_tokens") + F.col("output_tokens")
    rpd_cap = F.floor(F.col("rpd") * (1 - BUFFER))
    tpd_cap = F.floor(F.col("tpd") * (1 - BUFFER))
    units_cap = F.floor(F.col("day_units") * (1 - BUFFER))
    left = F.greatest(F.lit(0.0), times.seconds_between(times.next_daily_reset(now, F.col("reset_hour")), now))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.15), (86400 - left) / 86400 + 0.25))
    slice_cap = F.greatest(F.lit(5), F.ceil(rpd_cap * part))
    metered = F.coalesce(F.col("day_units") > 0, F.lit(False))
    background = F.col("priority") == "background"
    cooling = F.concat(
        F.lit("circuit_breaker_cooling_until_"), F.date_format("cooling_until", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    )
    # The reasons, in the order of the checks.
    checks = [
        ("unknown_model", F.col("provider").isNull()),
        ("missing_credentials", ~F.col("configured")),
        ("sensitive_content_disallowed_by_terms", F.col("sensitive") & ~F.col("sensitive_ok")),
        (cooling, F.coalesce(F.col("cooling_until") > now, F.lit(False))),
        ("exceeds_context_window", need > F.col("context")),
        ("exceeds_rpm", used("minute_requests") + 1 > F.col("rpm")),
        ("exceeds_tpm", used("minute_tokens") + need > F.col("tpm")),
        ("exceeds_rpd", used("requests_used") + 1 > F.col("rpd")),
        ("exceeds_tpd", used("tokens_used") + need > F.col("tpd")),
        ("exceeds_daily_neurons", metered & (used("units_used") + UNITS_PER_REQUEST > F.col("day_units"))),
        ("reserved_for_interactive_emergency_buffer_rpd", background & (used("requests_used") + 1 > rpd_cap)),
        ("reserved_for_interactive_emergency_buffer_tpd", background & (used("tokens_used") + need > tpd_cap)),
        ("reserved_for_interactive_emergency_buffer_neurons", background & metered & (used("units_used") + UNITS_PER_REQUEST > units_cap)),
        ("exceeds_time_slice_budget_for_background_job", background & (used("requests_used") + 1 > slice_cap)),
    ]
    reason = F.lit(None).cast("string")
    for name, failed in reversed(checks):
        reason = F.when(failed, name).otherwise(reason)
    return r.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def route_order(job, input_tokens, sensitive, turn) -> Column:
    """Model keys to try, as an array; `turn` rotates the trio."""
    n = len(ROTATING_MODELS)

    def chain(keys):
        by_turn = []
        for k in range(n):
            rotated = [ROTATING_MODELS[(k + i) % n] for i in range(n)]
            full = [m for key in keys for m in (rotated if key == "*" else [key])]
            safe = [m for m in full if m not in NOT_FOR_SENSITIVE]
            arrays = [F.array(*[F.lit(m) for m in ms]) for ms in (safe, full)]
            by_turn.append(F.when(col(sensitive), arrays[0]).otherwise(arrays[1]))
        turn_no = F.pmod(col(turn), F.lit(n))
        return F.when(turn_no == 0, by_turn[0]).when(turn_no == 1, by_turn[1]).otherwise(by_turn[2])

    return (
        F.when((col(job) == "long_input") | (col(input_tokens) > 2000), chain(ROUTES["long_input"]))
        .when(col(job) == "final_merge", chain(ROUTES["final_merge"]))
        .otherwise(chain(ROUTES["default"]))
    )
