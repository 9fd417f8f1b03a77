"""SQL surface: temporary functions and the nearest-hub table function."""

from __future__ import annotations

from pyspark.sql import SparkSession

from storyhub.functions import text

_SQL_BODY = {
    "normalize_title": (
        "t STRING", "STRING",
        rf"""trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(coalesce(t, ''), r'{text.NBSP_TAIL}', ''),
        r'{text.PUBLISHER_TAIL}', ''), r'{text.NOT_WORD}', ' ')), r'{text.SPACE}', ' '))""",
    ),
    "title_words": ("t STRING", "ARRAY<STRING>", "array_distinct(filter(split(t, ' '), w -> length(w) > 2))"),
    "word_jaccard": (
        "a STRING, b STRING", "DOUBLE",
        """CASE WHEN size(array_distinct(filter(split(a, ' '), w -> length(w) > 2))) = 0
             OR size(array_distinct(filter(split(b, ' '), w -> length(w) > 2))) = 0 THEN 0D
           ELSE size(array_intersect(filter(split(a, ' '), w -> length(w) > 2), filter(split(b, ' '), w -> length(w) > 2)))
             / size(array_union(filter(split(a, ' '), w -> length(w) > 2), filter(split(b, ' '), w -> length(w) > 2))) END""",
    ),
    "estimate_tokens": (
        "t STRING", "BIGINT",
        r"""CASE WHEN coalesce(t, '') = '' THEN 0L ELSE greatest(1L, ceil(length(t) / IF(t RLIKE r'[\x{0900}-\x{0D7F}]', 2.2D, 3.8D))) END""",
    ),
    "hub_uuid": (
        "seed STRING", "STRING",
        """concat_ws('-', substr(sha2(trim(seed), 256), 1, 8), substr(sha2(trim(seed), 256), 9, 4),
           '4' || substr(sha2(trim(seed), 256), 14, 3), '8' || substr(sha2(trim(seed), 256), 18, 3), substr(sha2(trim(seed), 256), 21, 12))""",
    ),
    "cosine_similarity": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        """CASE WHEN size(a) <> size(b) OR size(a) = 0 THEN 0D ELSE coalesce(
             aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)
             / nullif(sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v)), 0D), 0D) END""",
    ),
    "ist_day_start": (
        "t TIMESTAMP", "TIMESTAMP",
        "to_utc_timestamp(date_trunc('DAY', from_utc_timestamp(t, 'Asia/Kolkata')), 'Asia/Kolkata')",
    ),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary functions; returns their names."""
    for name, (args, kind, body) in _SQL_BODY.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(_SQL_BODY)


def register_match_hubs(spark: SparkSession, items_view: str, hubs_view: str, limit: int = 5) -> None:
    """Table function `match_hubs(query, threshold, as_of, hours)` over two
    views: items (item_id, cluster_id, embedding, published_at) and hubs."""
    register_functions(spark)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION match_hubs(query ARRAY<DOUBLE>, threshold DOUBLE, as_of TIMESTAMP, hours INT)
        RETURNS TABLE (hub_id STRING, title STRING, similarity DOUBLE)
        RETURN SELECT h.hub_id, h.title, cosine_similarity(i.embedding, match_hubs.query) AS similarity
          FROM {items_view} i JOIN {hubs_view} h ON i.cluster_id = h.hub_id
          WHERE i.embedding IS NOT NULL
            AND i.published_at >= match_hubs.as_of - make_dt_interval(0, match_hubs.hours)
            AND cosine_similarity(i.embedding, match_hubs.query) >= match_hubs.threshold
          ORDER BY similarity DESC, i.item_id LIMIT {limit}"""
    )
