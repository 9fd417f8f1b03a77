"""Secret scan with a trigram inverted index.

Every rule is a regular expression. What a match must contain is derived from
the expression as a Boolean query over trigrams of the lower-cased text: all
trigrams of each string that every match holds, and one of several where the
expression branches. The index has a posting (trigram, document) for the
trigrams the rules ask for; postings are intersected per rule and only the
documents found are verified with the expression. Rules without a mandatory
trigram scan every text.

Spans are counted in code points. A text is cut at all matches; the lengths of
the pieces and of the matches, added up, give the positions.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    """The group must have this many code points, else the match is dropped."""


# The base kinds in their order, then further well-known forms.
BASE = [
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
]
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
]
RULES = BASE + MORE

Clause = frozenset  # trigrams of which a text must hold all
Query = frozenset  # clauses of which one must hold; empty: any text may match


def _strings(items) -> list[list[str]] | None:
    """The ways the mandatory parts of an expression can read, each a list of
    strings a match must contain; None when there are too many ways."""
    ways: list[list[str]] = [[""]]
    for op, arg in items:
        if op is sre.LITERAL:
            parts = [[chr(arg).lower()]]
        elif op is sre.IN and len(arg) <= 8 and all(o is sre.LITERAL for o, _ in arg):
            parts = [[x] for x in sorted({chr(a).lower() for _, a in arg})]
        elif op is sre.SUBPATTERN:
            parts = _strings(arg[3])
        elif op is sre.BRANCH:
            inner = [_strings(x) for x in arg[1]]
            parts = None if None in inner else [w for x in inner for w in x]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and (arg[0], arg[1]) == (0, 1):
            inner = _strings(arg[2])
            parts = None if inner is None else [[""], *inner]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1 and len(arg[2]) == 1 and arg[2][0][0] is sre.LITERAL:
            parts = [[chr(arg[2][0][1]).lower() * arg[0], ""]]
        else:
            parts = [["", ""]]
        if parts is None:
            parts = [["", ""]]
        grown = [w[:-1] + [w[-1] + p[0]] + p[1:] for w in ways for p in parts]
        ways = grown if len(grown) <= 64 else [w + [""] for w in ways]
    return ways


def trigram_query(pattern: str) -> Query:
    """Clauses of which a text must satisfy one to match; empty if some way to
    match has no trigram."""
    clauses = set()
    for way in _strings(sre_parser.parse(pattern)) or [[]]:
        grams = frozenset(s[i : i + 3] for s in way for i in range(len(s) - 2))
        if not grams:
            return frozenset()
        clauses.add(grams)
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def build_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (gram, row) of the given trigrams over lower-cased texts."""
    low = docs.select("row", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("row", F.explode(held).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """row and the kinds whose trigram query its postings satisfy."""
    spark = index.sparkSession
    asked = [
        (kind, f"{kind}:{k}", len(clause), gram)
        for kind, query in queries.items()
        for k, clause in enumerate(sorted(query, key=sorted))
        for gram in sorted(clause)
    ]
    clauses = spark.createDataFrame(asked, "kind string, clause string, need int, gram string")
    found = (
        index.join(F.broadcast(clauses), "gram")  # as many rows as the rules have trigrams
        .groupBy("row", "kind", "clause", "need")
        .agg(F.count_distinct("gram").alias("held"))
        .filter("held = need")
    )
    return found.groupBy("row").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches that are long enough."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.least else whole
    gaps = F.split(text, rule.pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    steps = F.arrays_zip(
        F.transform(F.slice(gaps, F.lit(1), F.size(whole)), F.char_length).alias("gap"),
        F.transform(whole, F.char_length).alias("size"),
        F.transform(judged, lambda x: F.char_length(x) >= rule.least).alias("ok"),
    )

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(
            end.alias("at"), F.when(x["ok"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out")
        )

    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


EMPTY = "array<struct<start:int,place:int,end:int,kind:string>>"


def _labelled(place: int, kind: str):
    return lambda x: F.struct(
        x["start"].alias("start"), F.lit(place).alias("place"), x["end"].alias("end"), F.lit(kind).alias("kind")
    )


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, text, `found`: spans (start, place, end, kind) by start, then by
    the order of the rules; and the columns named in `keep`.

    Null and empty texts have no spans. Rows are told apart by position, so
    repeated ids are scanned one by one. Spans of different kinds may overlap.
    """
    rules = rules or RULES
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in keep or []],
    )
    ids = docs.select("doc_id", "text", *(keep or [])).withColumn("row", F.xxhash64("doc_id", "text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    grams = sorted({g for q in indexed.values() for c in q for g in c})
    if grams:
        found = candidates(build_index(ids.select("row", "text"), grams), indexed)
        ids = ids.join(found, "row", "left")
    else:
        ids = ids.withColumn("kinds", F.lit(None).cast("array<string>"))
    parts = []
    for place, rule in enumerate(rules):
        spans = F.transform(_spans(F.col("text"), rule), _labelled(place, rule.kind))
        asked = F.array_contains("kinds", rule.kind) if rule.kind in indexed else F.col("text").rlike(rule.pattern)
        parts.append(F.when(asked, spans).otherwise(F.array().cast(EMPTY)))
    return ids.select("doc_id", "text", *(keep or []), F.array_sort(F.concat(*parts)).alias("found"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans."""
    found = find_secrets(docs)
    base = F.filter("found", lambda x: x["place"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(r.kind) for r in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans")
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Documents with every secret replaced by `mark`; n_chars follows the text.
    Overlapping spans are replaced once. Null text stays null. All other columns
    stay as they are, whatever their names."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    own = [f"own_{k}" for k in range(len(others))]
    plain = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(k) for c, k in zip(others, own, strict=True)])
    found = find_secrets(plain.withColumn("was_null", F.col("text").isNull()), keep=[*own, "was_null"])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        piece = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        fresh = F.when(x["start"] >= acc["at"], F.array(piece, F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], fresh).alias("out"))

    clean = F.aggregate(
        "found",
        zero,
        step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))),
    )
    text = F.when(F.col("was_null"), F.lit(None)).when(F.size("found") == 0, F.col("text")).otherwise(clean)
    out = found.select("doc_id", text.alias("text"), *[F.col(k).alias(c) for c, k in zip(others, own, strict=True)])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
