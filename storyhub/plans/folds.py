"""SQL twins of the order-dependent operators, written as list folds.

`list_reduce` needs elements and state of one type, so every element is wrapped
in a list of one and the state is the list of rows decided so far.
"""

from __future__ import annotations

from storyhub.plans import twins as t
from storyhub.plans.catalog import view


def jac(a: str, b: str) -> str:
    return f"({t.jaccard(a, b)})"


def fold(rows: str, key: str, row_type: str, decide: str, order: str = "ord") -> str:
    """(key, decided list): `decide` sees the state `acc` and the row `x[1]`."""
    return f"""SELECT {key}, list_reduce(list_transform(list(r ORDER BY {order}), lambda e: [e::{row_type}]),
      lambda acc, x: list_append(acc, {decide}), []::{row_type}[]) AS decided FROM {rows} GROUP BY {key}"""


# -- clustering -------------------------------------------------------------------

view(
    "v_item_vectors",
    """SELECT item_id, list_transform(generate_series(0, 383), lambda b: coalesce(m[b], 0.0)) AS vec
    FROM (SELECT item_id, map(list(bucket), list(weight)) AS m FROM v_features GROUP BY 1)""",
)
_CLUSTER_ROW = (
    "STRUCT(item_id BIGINT, ord BIGINT, hub BIGINT, role VARCHAR, merged BIGINT, pub VARCHAR, norm VARCHAR, "
    "words VARCHAR[], url VARCHAR, vec DOUBLE[], live BOOLEAN)"
)
_SIM = "round(list_cosine_similarity({a}.vec, x[1].vec), 12)"
_LEAD = "list_filter(acc, lambda l: l.ord = m.hub)[1]"
_BARRED = f"""(x[1].pub <> '' AND len(list_filter(acc, lambda n: n.hub = m.hub AND n.role <> 'duplicate' AND n.pub = x[1].pub)) > 0
      AND ({_SIM.format(a=_LEAD)} < 0.55 OR {jac('x[1].words', _LEAD + '.words')} < 0.25))
    OR (len(list_filter(acc, lambda n: n.hub = m.hub AND n.role <> 'duplicate')) >= 4 AND {_SIM.format(a=_LEAD)} < 0.30)"""
_BEST = f"""list_sort(list_transform(list_filter(acc, lambda m: m.role <> 'duplicate' AND m.live AND x[1].live AND {_SIM.format(a='m')} >= 0.45
      AND NOT ({_BARRED})), lambda m: {{'k': -{_SIM.format(a='m')}, 'h': m.hub}}))[1].h"""
_REPEATS = f"""list_filter(acc, lambda m: m.hub = b AND m.role <> 'duplicate' AND (m.url = x[1].url
      OR (m.norm <> '' AND x[1].norm <> '' AND (m.norm = x[1].norm OR {jac('x[1].words', 'm.words')} >= 0.85))))[1].ord"""


def _cluster_row(hub, role, merged):
    return (
        f"{{'item_id': x[1].item_id, 'ord': x[1].ord, 'hub': {hub}, 'role': {role}, 'merged': {merged}, 'pub': x[1].pub, "
        "'norm': x[1].norm, 'words': x[1].words, 'url': x[1].url, 'vec': x[1].vec, 'live': x[1].live}"
    )


_DECIDE_CLUSTER = f"""list_transform([{_BEST}], lambda b: list_transform([{_REPEATS}], lambda d:
      {_cluster_row("coalesce(b, x[1].ord)", "CASE WHEN b IS NULL THEN 'lead' WHEN d IS NULL THEN 'member' ELSE 'duplicate' END", "d")})[1])[1]"""

view(
    "v_run_rows",
    f"""SELECT (pub_s // 172800)::VARCHAR AS run, ord, {{'item_id': item_id, 'ord': ord, 'hub': 0, 'role': '', 'merged': NULL,
      'pub': source_name, 'norm': norm_title, 'words': {t.words('norm_title')}, 'url': url,
      'vec': coalesce(vec, [0.0]), 'live': vec IS NOT NULL}} AS r FROM v_joined LEFT JOIN v_item_vectors USING (item_id)""",
)
view("v_clusters", f"SELECT run, unnest(decided) AS d FROM ({fold('v_run_rows', 'run', _CLUSTER_ROW, _DECIDE_CLUSTER)})")

_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
EVENT_CLUSTERS = f"""WITH c AS (SELECT d.item_id AS item_id, run, d.hub AS hub, d.role AS role, d.merged AS merged_into FROM v_clusters),
    l AS (SELECT i.ord AS hub, sha256(i.url) AS h FROM v_items i)
    SELECT item_id, run, {_UUID} AS cluster_id, role, merged_into FROM c JOIN l USING (hub)"""
EVENT_HUBS = f"""WITH c AS (SELECT d.item_id AS item_id, run, d.hub AS hub FROM v_clusters WHERE d.role <> 'duplicate'),
    l AS (SELECT ord AS hub, sha256(url) AS h, title FROM v_items)
    SELECT run, {_UUID} AS hub_id, l.title, min(pub_s) AS first_seen_at, max(pub_s) AS last_updated_at, count(*) AS item_count,
      count(*) FILTER (lane = 'mainstream') AS mainstream_count, count(*) FILTER (lane = 'grassroots') AS grassroots_count,
      count(*) FILTER (lane = 'discourse') AS discourse_count
    FROM c JOIN l USING (hub) JOIN v_joined j USING (item_id) GROUP BY run, h, l.title"""

view(
    "v_vector_rows",
    """SELECT 1 AS run, item_id AS ord, {'item_id': item_id, 'ord': item_id, 'hub': 0, 'role': '', 'merged': NULL, 'pub': 's' || (item_id % 7),
      'norm': 'vector title ' || item_id, 'words': list_distinct(list_filter(['vector', 'title', item_id::VARCHAR], lambda w: length(w) > 2)),
      'url': NULL, 'vec': embedding, 'live': true} AS r FROM v_vectors""",
)
VECTOR_CLUSTERS = f"""SELECT d.ord AS ord, d.hub AS hub_ord, d.role AS role, d.merged AS merged_into
    FROM (SELECT unnest(decided) AS d FROM ({fold('v_vector_rows', 'run', _CLUSTER_ROW, _DECIDE_CLUSTER)}))"""

view(
    "v_last_rows",
    """SELECT 1 AS run, d.ord, r FROM v_run_rows d WHERE d.ord IN (SELECT min(ord) FROM v_items
      WHERE pub_s >= (SELECT max(pub_s) FROM v_items) - 172800 GROUP BY url)""",
)
LAST_WINDOW_CLUSTERS = f"""WITH c AS (SELECT unnest(decided) AS d FROM ({fold('v_last_rows', 'run', _CLUSTER_ROW, _DECIDE_CLUSTER)})),
    l AS (SELECT ord AS hub, sha256(url) AS h FROM v_items)
    SELECT d.item_id AS item_id, {_UUID} AS cluster_id, d.role AS role FROM c JOIN l ON d.hub = l.hub"""

# Two loads of a run: even items first, odd items against the hubs of the even ones.
_LOADED = "(item_id % 2) * 1000000000000000000 + ord"
view(
    "v_loaded_rows",
    f"""SELECT (pub_s // 172800)::VARCHAR AS run, {_LOADED} AS ord, {{'item_id': item_id, 'ord': {_LOADED}, 'hub': 0, 'role': '', 'merged': NULL,
      'pub': source_name, 'norm': norm_title, 'words': {t.words('norm_title')}, 'url': url,
      'vec': coalesce(vec, [0.0]), 'live': vec IS NOT NULL}} AS r FROM v_joined LEFT JOIN v_item_vectors USING (item_id)""",
)
CARRIED_CLUSTERS = f"""WITH c AS (SELECT run, unnest(decided) AS d FROM ({fold('v_loaded_rows', 'run', _CLUSTER_ROW, _DECIDE_CLUSTER)})),
    l AS (SELECT {_LOADED} AS hub, sha256(url) AS h FROM v_items)
    SELECT d.item_id AS item_id, run, {_UUID} AS cluster_id, d.role AS role, d.merged AS merged_into FROM c JOIN l ON d.hub = l.hub
    WHERE d.item_id % 2 = 1"""

# Micro-batches of the last two days: items land by id, three files in a row.
_LANDED = "(item_id % 3) * 1000000000000000000 + ord"
view(
    "v_landed_rows",
    f"""SELECT 1 AS run, {_LANDED} AS ord, {{'item_id': item_id, 'ord': {_LANDED}, 'hub': 0, 'role': '', 'merged': NULL,
      'pub': source_name, 'norm': norm_title, 'words': {t.words('norm_title')}, 'url': url,
      'vec': coalesce(vec, [0.0]), 'live': vec IS NOT NULL}} AS r FROM v_joined LEFT JOIN v_item_vectors USING (item_id)
    WHERE {_LANDED} IN (SELECT min({_LANDED}) FROM v_items WHERE pub_s >= (SELECT max(pub_s) FROM v_items) - 172800 GROUP BY url)""",
)
LANDED_CLUSTERS = f"""WITH c AS (SELECT unnest(decided) AS d FROM ({fold('v_landed_rows', 'run', _CLUSTER_ROW, _DECIDE_CLUSTER)})),
    l AS (SELECT {_LANDED} AS hub, sha256(url) AS h FROM v_items)
    SELECT d.item_id AS item_id, {_UUID} AS cluster_id, d.role AS role FROM c JOIN l ON d.hub = l.hub"""

# -- first in order wins ------------------------------------------------------------

_DEDUP_ROW = (
    "STRUCT(item_id BIGINT, ord BIGINT, agg BOOLEAN, hit BIGINT, hit_agg BOOLEAN, reason VARCHAR, sim DOUBLE, pub BIGINT, norm VARCHAR, words VARCHAR[], url VARCHAR)"
)


def _dedup(rows: str, key: str, band: int | None, min_title: int) -> str:
    near = f"m.norm <> '' AND (m.norm = x[1].norm OR {jac('x[1].words', 'm.words')} >= 0.85)"
    if band is not None:
        near = f"abs(m.pub - x[1].pub) <= {band} AND {near}"
    hit = f"""list_filter(acc, lambda m: m.hit IS NULL AND x[1].agg AND length(x[1].norm) >= {min_title} AND (m.url = x[1].url OR ({near})))[1]"""
    overlap = jac("x[1].words", "h.words")
    decide = f"""list_transform([{hit}], lambda h: {{'item_id': x[1].item_id, 'ord': x[1].ord, 'agg': x[1].agg, 'hit': h.item_id, 'hit_agg': h.agg,
      'reason': CASE WHEN h.item_id IS NULL THEN NULL WHEN h.url = x[1].url THEN 'exact_url_match' WHEN h.norm = x[1].norm THEN 'exact_normalized_title_match'
        ELSE 'high_jaccard_similarity_' || round({overlap} * 100)::INT || '%' END,
      'sim': CASE WHEN h.url = x[1].url OR h.norm = x[1].norm THEN 1.0 ELSE {overlap} END,
      'pub': x[1].pub, 'norm': x[1].norm, 'words': x[1].words, 'url': x[1].url}})[1]"""
    return f"SELECT {key}, unnest(decided) AS d FROM ({fold(rows, key, _DEDUP_ROW, decide, 'agg, ord')})"


def _dedup_rows(key: str, agg: str) -> str:
    return f"""SELECT {key}, {agg} AS agg, ord, {{'item_id': item_id, 'ord': ord, 'agg': {agg}, 'hit': NULL, 'hit_agg': NULL, 'reason': NULL, 'sim': NULL,
      'pub': pub_s, 'norm': norm_title, 'words': {t.words('norm_title')}, 'url': url}} AS r FROM v_story"""


view("v_dedup_rows", _dedup_rows("(pub_s // 172800)::VARCHAR AS run", "source_id % 4 = 3"))
view("v_dedup_2h", _dedup("v_dedup_rows", "run", 7200, 10))
view("v_dedup_48h", _dedup("v_dedup_rows", "run", 172800, 10))
view("v_hub_rows", _dedup_rows("language AS hub", "true"))
view("v_hub_dups", _dedup("v_hub_rows", "hub", None, 1))

AGGREGATOR_UNIQUE = "SELECT d.item_id AS item_id, run FROM v_dedup_2h WHERE d.agg AND d.hit IS NULL"
HIT_LOG = """SELECT d.item_id AS item_id, d.hit AS matched_item, d.reason AS reason, round(d.sim, 6) AS similarity,
    CASE WHEN d.hit_agg THEN 'aggregator' ELSE 'direct' END AS against FROM v_dedup_48h WHERE d.hit IS NOT NULL"""
DEDUP_REPORT = """SELECT count(*) AS total, count(d.hit) AS hits, printf('%.1f%%', 100.0 * count(d.hit) / count(*)) AS hit_rate FROM v_dedup_48h WHERE d.agg"""
HUB_DUPLICATES = """SELECT d.item_id AS item_id, d.hit AS matched_item, d.reason AS reason, round(d.sim, 6) AS similarity FROM v_hub_dups WHERE d.hit IS NOT NULL"""

# -- lines and chunks ---------------------------------------------------------------

_LINE_ROW = "STRUCT(line VARCHAR, key VARCHAR, words VARCHAR[])"


def _line_key(e: str) -> str:
    cut = t.rx(t.rx(e, r"\s*\|\s*.*$"), t.SIGNED)
    return t.squeeze(t.rx(f"lower({cut})", r"[^a-z0-9\x{0900}-\x{0D7F}\s]"))


def distinct_lines(source: str, key: str, lines: str) -> str:
    """Kept lines of a list of lines, as one text."""
    repeats = f"""len(list_filter(acc, lambda p: p.key = x[1].key
        OR (length(p.key) > 25 AND (contains(p.key, x[1].key) OR contains(x[1].key, p.key)))
        OR (len(x[1].words) >= 4 AND {jac('x[1].words', 'p.words')} >= 0.68))) > 0"""
    return f"""SELECT {key}, array_to_string(list_transform(list_reduce(list_transform(k, lambda e: [e::{_LINE_ROW}]),
        lambda acc, x: CASE WHEN {repeats} THEN acc ELSE list_concat(acc, x) END, []::{_LINE_ROW}[]), lambda e: e.line), chr(10)) AS kept
      FROM (SELECT {key}, list_transform(list_filter(list_transform({lines}, lambda l: {{'line': l, 'key': {_line_key('l')}}}), lambda e: e.key <> ''),
        lambda e: {{'line': e.line, 'key': e.key, 'words': {t.words('e.key')}}}) AS k FROM {source})"""


_CHUNK = "STRUCT(done VARCHAR[], cur VARCHAR[], tokens BIGINT)"
_SPLIT = "list_filter(string_split(regexp_replace(text, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_CARRY = "[acc[1].cur[-1], x[1].cur[1]]"
CHUNKS = f"""WITH f AS (SELECT doc_id, list_reduce(list_transform({_SPLIT}, lambda s: [{{'done': [], 'cur': [s], 'tokens': {t.tokens('s')}}}::{_CHUNK}]),
      lambda acc, x: CASE WHEN acc[1].tokens + x[1].tokens > 420 AND len(acc[1].cur) > 0
        THEN [{{'done': list_append(acc[1].done, array_to_string(acc[1].cur, ' ')), 'cur': {_CARRY},
          'tokens': {t.tokens("array_to_string(" + _CARRY + ", ' ')")}}}::{_CHUNK}]
        ELSE [{{'done': acc[1].done, 'cur': list_append(acc[1].cur, x[1].cur[1]), 'tokens': acc[1].tokens + x[1].tokens}}::{_CHUNK}] END,
      [{{'done': [], 'cur': [], 'tokens': 0}}::{_CHUNK}])[1] AS s FROM documents),
    c AS (SELECT doc_id, unnest(list_append(s.done, array_to_string(s.cur, ' '))) AS chunk FROM f WHERE len(s.cur) > 0)
    SELECT doc_id, chunk, {t.tokens('chunk')} AS tokens FROM c"""

# -- digest ---------------------------------------------------------------------------

_PICK_ROW = "STRUCT(hub_id VARCHAR, title VARCHAR, norm VARCHAR, words VARCHAR[], urls VARCHAR[], publishers BIGINT)"


def _pick(publishers: int) -> str:
    clash = f"""len(list_filter(acc, lambda p: p.norm = x[1].norm OR {jac('x[1].words', 'p.words')} >= 0.35 OR list_has_any(p.urls, x[1].urls))) > 0"""
    return f"CASE WHEN len(acc) >= 3 OR x[1].publishers < {publishers} OR trim(x[1].title) = '' OR {clash} THEN acc ELSE list_concat(acc, x) END"


def _stage(rows: str, name: str, publishers: int, rank: str) -> str:
    return f"""{name} AS (SELECT edition, list_reduce(list_transform(list(r ORDER BY publishers DESC, lanes DESC, fresh DESC, {rank}), lambda e: [e::{_PICK_ROW}]),
      lambda acc, x: {_pick(publishers)}, []::{_PICK_ROW}[]) AS taken FROM {rows} GROUP BY 1)"""


def digest(editions: str) -> str:
    return f"""WITH {editions},
    g AS (SELECT as_of, k.hub_id, primary_rank, fallback_rank, count(DISTINCT lower(source_name)) AS publishers, count(DISTINCT lane) AS lanes,
        count(*) AS fresh, list(DISTINCT url) AS urls FROM k JOIN v_joined i ON k.hub_id = i.cluster_id
      WHERE coalesce(primary_rank, fallback_rank) IS NOT NULL AND i.pub_s >= as_of - 129600 GROUP BY 1, 2, 3, 4),
    n AS (SELECT strftime(to_timestamp(as_of) AT TIME ZONE 'UTC', '%Y-%m-%d') AS edition, g.*, title, {t.norm('title')} AS norm FROM g JOIN v_hubs USING (hub_id)),
    rows AS (SELECT edition, primary_rank, coalesce(primary_rank, 1000 + fallback_rank) AS merged_rank, publishers, lanes, fresh,
      {{'hub_id': hub_id, 'title': title, 'norm': norm, 'words': {t.words('norm')}, 'urls': urls, 'publishers': publishers}} AS r FROM n),
    first AS (SELECT * FROM rows WHERE primary_rank IS NOT NULL),
    {_stage('first', 'day', 2, 'primary_rank')}, {_stage('rows', 'wide', 2, 'merged_rank')}, {_stage('rows', 'any_', 1, 'merged_rank')},
    s AS (SELECT any_.edition, CASE WHEN len(day.taken) >= 3 THEN 'primary' WHEN len(wide.taken) >= 3 THEN 'wide' ELSE 'single' END AS stage,
      CASE WHEN len(day.taken) >= 3 THEN day.taken WHEN len(wide.taken) >= 3 THEN wide.taken ELSE any_.taken END AS taken
      FROM any_ LEFT JOIN day USING (edition) LEFT JOIN wide USING (edition))
    SELECT edition, slot::INTEGER AS slot, taken[slot].hub_id AS hub_id, taken[slot].title AS title, stage FROM (SELECT *, unnest(generate_series(1, len(taken))) AS slot FROM s)"""
