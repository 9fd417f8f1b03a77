"""DuckDB text of the operators that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(hexadecimal: str) -> str:
    """Base32 of a 40-digit hexadecimal text: five digits are four letters."""
    parts = []
    for k in range(8):
        value = f"('0x' || substr({hexadecimal}, {5 * k + 1}, 5))::INTEGER"
        parts += [f"substr('{_DIGITS}', (({value} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0)]
    return " || ".join(parts)


def _components(edges: str) -> str:
    """Common table expressions for `part` (id, low): the smallest id each id
    reaches over the links of `edges` (a, b), both directions given."""
    return f"""reach AS (
  SELECT a AS id, b AS other FROM {edges}
  UNION SELECT r.id, e.b FROM reach r JOIN {edges} e ON r.other = e.a
), part AS (SELECT id, min(other) AS low FROM reach GROUP BY id)"""


JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k:k + 4], ' '))) END AS grams FROM w
), g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
n AS (SELECT doc_id, len(grams) AS n FROM s),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2
), edges AS (
  SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)
), {_components("edges")}
SELECT n.doc_id, n AS n_shingles, least(n.doc_id, coalesce(low, n.doc_id)) AS component_id FROM n LEFT JOIN part ON part.id = n.doc_id
"""

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS words FROM documents),
win AS (
  SELECT doc_id, k, md5(array_to_string(words[k:k + 49], ' ')) AS key
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS k FROM w WHERE len(words) >= 50)
), low AS (SELECT key, min(doc_id) AS first FROM win GROUP BY key),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS pos FROM win JOIN low USING (key) WHERE first < doc_id
), cut AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
    array_to_string(CASE WHEN gone IS NULL THEN words
      ELSE list_transform(list_filter(range(1, len(words) + 1), lambda p: NOT list_contains(gone, p)), lambda p: words[p]) END, ' ') AS text
  FROM w LEFT JOIN cut USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(text) AS kept_sha256 FROM kept
"""

VECTORS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), edges AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.93
), links AS (SELECT a, count(*) AS n FROM edges GROUP BY a), {_components("edges")}
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM v LEFT JOIN links ON links.a = vec_id LEFT JOIN part ON part.id = vec_id
"""

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, payload_bytes, {_base32("d.h")} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (h)
"""

_KINDS = [
    ("assign", 0, r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", 2, r"[0-9a-f]{32,}", 0, 0),
    ("private_key", 3, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", 4, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", 5, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", 6, r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("jwt", 7, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("stripe", 8, r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 0),
]


def _spans(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    return f"""SELECT doc_id, '{kind}' AS kind, {place} AS place, start, start + size AS stop FROM (
    SELECT doc_id, sizes[k] AS size, ok[k] >= {least} AS ok,
      list_sum(gaps[1:k]) + coalesce(list_sum(sizes[1:k - 1]), 0) AS start
    FROM (SELECT doc_id, list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) AS gaps,
        list_transform(regexp_extract_all(text, '{pattern}'), lambda x: length(x)) AS sizes,
        list_transform(regexp_extract_all(text, '{pattern}', {group}), lambda x: length(x)) AS ok,
        unnest(range(1, len(sizes) + 1)) AS k FROM t WHERE regexp_matches(text, '{pattern}'))) WHERE ok"""


SECRETS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_spans(*k) for k in _KINDS)}),
d AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, place) FILTER (place < 3) AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, place) AS spans
  FROM s GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN d USING (doc_id)
"""
