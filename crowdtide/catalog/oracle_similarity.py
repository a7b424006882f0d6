"""Similarity, fuzzy matches and the canonical merge as SQL: independent statements, used only to check results."""

from __future__ import annotations

from .oracle_tables import name_sql, title_sql


def lcs_sql(a: str, b: str) -> str:
    """Longest common subsequence of two texts, the first of at most 120 letters: one row of bits, one step a letter of ``b``."""
    masks = f"list_transform(string_split({b}, ''), lambda x: list_sum(list_transform(range(0, length({a})), lambda i: CASE WHEN {a}[i + 1] = x THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT)"
    full = f"((1::HUGEINT << length({a})::INT) - 1)"
    return (f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count(list_reduce(list_prepend({full}, {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})) END")


def ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100e0 ELSE 200e0 * ({lcs_sql(a, b)}) / (length({a}) + length({b})) END"


def token_set_ctes(source: str, name: str) -> str:
    """Common tables that end in ``name``: (a, b, score) for all distinct pairs of normalised texts a, b of ``source``."""
    words = "list_sort(list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> '')))"
    return f"""{name}_w AS (SELECT a, b, {words.format(x='a')} AS l, {words.format(x='b')} AS r FROM (SELECT DISTINCT a, b FROM {source} WHERE a IS NOT NULL AND b IS NOT NULL)),
    {name}_p AS (SELECT *, list_filter(l, lambda w: list_contains(r, w)) AS s, array_to_string(list_filter(l, lambda w: NOT list_contains(r, w)), ' ') AS lo, array_to_string(list_filter(r, lambda w: NOT list_contains(l, w)), ' ') AS ro FROM {name}_w),
    {name}_n AS (SELECT *, length(array_to_string(s, ' ')) AS ns, {lcs_sql('lo', 'ro')} AS same FROM {name}_p),
    {name}_m AS (SELECT *, ns + CASE WHEN len(s) > 0 THEN 1 ELSE 0 END + length(lo) AS nl, ns + CASE WHEN len(s) > 0 THEN 1 ELSE 0 END + length(ro) AS nr FROM {name}_n),
    {name} AS (SELECT a, b, CASE WHEN len(l) = 0 OR len(r) = 0 THEN 0e0 WHEN len(s) > 0 AND (len(s) = len(l) OR len(s) = len(r)) THEN 100e0
      WHEN len(s) > 0 THEN greatest(100e0 - 100e0 * (length(lo) + length(ro) - 2 * same) / (nl + nr), 100e0 - 100e0 * (nl - ns) / (ns + nl), 100e0 - 100e0 * (nr - ns) / (ns + nr))
      ELSE 100e0 - 100e0 * (length(lo) + length(ro) - 2 * same) / (nl + nr) END AS score FROM {name}_m)"""


def confidence_sql(title: str, venue: str, city: str) -> str:
    return f"round_even(0.6::DOUBLE * ({title} / 100) + 0.25::DOUBLE * ({venue}) + 0.15::DOUBLE * ({city}), 3)"


def minutes_sql(x: str) -> str:
    return f"(left({x}, 2)::INT * 60 + right({x}, 2)::INT)"


def apart_sql(a: str, b: str, gap: str) -> str:
    return f"coalesce({a} <> {b} AND abs({minutes_sql(a)} - {minutes_sql(b)}) >= {gap}, false)"


def day_matches(left: str, right: str, name: str, condition: str) -> str:
    """Common tables that end in ``name``: (l_key, r_key, confidence) of the best counterpart per l_key.

    left, right: SELECT texts giving key, day, title, venue, city (normalised), t (time), src.
    """
    return f"""{name}_l AS (SELECT * FROM ({left}) WHERE venue <> '' AND title <> ''), {name}_r AS (SELECT * FROM ({right}) WHERE venue <> '' AND title <> ''),
    {name}_pairs AS (SELECT l.key AS l_key, r.key AS r_key, l.title AS ta, r.title AS tb, l.venue AS va, r.venue AS vb, l.city = r.city AS same_city FROM {name}_l l JOIN {name}_r r ON l.day = r.day
      WHERE l.key <> r.key AND NOT {apart_sql('r.t', 'l.t', 'CASE WHEN l.src = r.src THEN 1 ELSE 120 END')} AND {condition}),
    {name}_both AS (SELECT DISTINCT ta AS a, tb AS b FROM {name}_pairs UNION SELECT DISTINCT va, vb FROM {name}_pairs WHERE va <> vb), {token_set_ctes(f'{name}_both', f'{name}_sim')},
    {name}_judged AS (SELECT l_key, r_key, {confidence_sql('t.score', 'CASE WHEN va = vb THEN 1e0 ELSE v.score / 100 END', 'CASE WHEN same_city THEN 1e0 ELSE 0.3::DOUBLE END')} AS confidence
      FROM {name}_pairs p JOIN {name}_sim t ON t.a = ta AND t.b = tb LEFT JOIN {name}_sim v ON v.a = va AND v.b = vb),
    {name} AS (SELECT l_key, min_by(r_key, (-confidence, r_key)) AS r_key, max(confidence) AS confidence FROM {name}_judged WHERE confidence >= 0.88::DOUBLE GROUP BY l_key)"""


EVENT_SIDE = f"SELECT {{key}} AS key, date_start AS day, {{title}} AS title, {name_sql('venue_name_raw')} AS venue, {name_sql('city_name_raw')} AS city, time_start AS t, primary_source AS src FROM d_event WHERE venue_name_raw IS NOT NULL"
REWORDED = title_sql("'Live: ' || title || 's'")
JOIN08_SQL = f"WITH {day_matches(EVENT_SIDE.format(key='event_id', title=REWORDED), EVENT_SIDE.format(key='-event_id', title=title_sql('title')), 'm', 'true')} SELECT l_key, r_key, confidence FROM m"
WIN07_SQL = f"WITH {day_matches(EVENT_SIDE.format(key='event_id', title=title_sql('title')), EVENT_SIDE.format(key='event_id', title=title_sql('title')), 'm', 'true')} SELECT l_key, r_key, confidence FROM m"

OTHER_ORDER = "array_to_string(list_reverse(string_split(title, ' ')), ' ')"
STR13_SQL = f"""WITH q AS (SELECT event_id, {title_sql('title')} AS a, {title_sql(OTHER_ORDER)} AS b, {name_sql('venue_name_raw')} AS c FROM d_event), pairs AS (SELECT a, b FROM q UNION SELECT a, c FROM q),
    {token_set_ctes("pairs", "s")} SELECT event_id, x.score AS same, y.score AS other FROM q JOIN s x ON x.a = q.a AND x.b = q.b LEFT JOIN s y ON y.a = q.a AND y.b = q.c"""
STR14_SQL = f"""WITH q AS (SELECT event_id, {name_sql('city_name_raw')} AS a, {name_sql("city_name_raw || 's'")} AS b FROM d_event WHERE city_name_raw IS NOT NULL), p AS (SELECT a, b, {ratio_sql('a', 'b')} AS r FROM (SELECT DISTINCT a, b FROM q)) SELECT event_id, r FROM q JOIN p USING (a, b)"""
LIVE_TITLE = title_sql("title || ' live'")
STR15_SQL = f"""WITH q AS (SELECT event_id, {title_sql('title')} AS a, {LIVE_TITLE} AS b, venue_name_raw IS NOT NULL AS known FROM d_event), {token_set_ctes('q', 's')}
    SELECT event_id, {confidence_sql('score', 'CASE WHEN known THEN 1e0 ELSE 0.5::DOUBLE END', '1e0')} AS confidence FROM q JOIN s USING (a, b)"""


def fuzzy_lookup(rest: str, index: str, name: str, t: float) -> str:
    """Common tables that end in ``name``: (key, best index_key, score) at or above t by token-set similarity.  ``rest`` (key) and ``index`` (key) are tables of normalised names.

    Only pairs that can reach t are scored: shared words that cover enough of one name, or as many common letter pairs as so few edits leave.
    """
    words = "list_distinct(string_split({x}, ' '))"
    spread = "SELECT key, {n} AS n, p, row_number() OVER (PARTITION BY key, p) AS k FROM (SELECT key, unnest(list_transform(range(1, length(key) + 2), lambda i: (' ' || key || ' ')[i:i + 1])) AS p FROM {t})"
    share = t / (2 - t)
    return f"""{name}_lw AS (SELECT key, unnest({words.format(x='key')}) AS w FROM {rest}), {name}_rw AS (SELECT key, unnest({words.format(x='key')}) AS w FROM {index}),
    {name}_words AS (SELECT l.key AS a, r.key AS b FROM {name}_lw l JOIN {name}_rw r USING (w) GROUP BY l.key, r.key
      HAVING sum(length(w)) + count(*) - 1 >= {share!r} * least(length(l.key), length(r.key)) - 1e-9),
    {name}_lp AS ({spread.format(n='length(key)', t=rest)}), {name}_rp AS ({spread.format(n='length(key)', t=index)}),
    {name}_close AS (SELECT l.key AS a, r.key AS b FROM {name}_lp l JOIN {name}_rp r ON l.p = r.p AND l.k = r.k AND r.n BETWEEN {share!r} * l.n - 1e-9 AND l.n / {share!r} + 1e-9 GROUP BY l.key, r.key, l.n, r.n
      HAVING count(*) >= (l.n + r.n) * {1.5 * t - 1!r} + 1 - 1e-9),
    {name}_cand AS (SELECT a, b FROM {name}_words UNION SELECT a, b FROM {name}_close), {token_set_ctes(f'{name}_cand', f'{name}_sim')},
    {name} AS (SELECT a AS key, max_by(b, (score, b)) AS index_key, max(score) AS score FROM {name}_sim WHERE score >= {100 * t!r} GROUP BY a)"""


# ---- all listings of the event table into an empty state -------------------------------------------------------------------------
SIDE = "SELECT gfp AS key, h.day AS day, h.{title} AS title, {venue} AS venue, {city} AS city, h.t AS t, h.src AS src, seq FROM heads"
MERGED = f"""inc AS (SELECT e.event_id AS ordinal, e.title, {title_sql('e.title')} AS nt, e.date_start AS day, e.time_start AS t, e.primary_source AS src, e.venue_id, e.venue_name_raw AS vraw, coalesce(p.v_name, e.venue_name_raw) AS vshow,
      p.city_id, coalesce(p.c_name, e.city_name_raw) AS cshow, coalesce(s.priority, 0) AS pri, e.status, e.source_confidence AS conf, e.status = 'SOLD_OUT' AS sold, e.primary_source || '|' || e.event_id || '|' || e.event_id AS rec,
      {title_sql("e.title || coalesce(' ' || e.time_start, '')")} AS nts FROM d_event e JOIN d_placed p USING (event_id) LEFT JOIN d_source s ON s.key = e.primary_source),
    printed AS (SELECT *, (-pri, ordinal, rec) AS ord, (pri, ordinal, rec) AS rank, sha256(nt || '|' || day || '|' || {name_sql('vshow')} || '|' || {name_sql('cshow')}) AS fp, sha256(nts || '|' || day || '|' || {name_sql('vshow')} || '|' || {name_sql('cshow')}) AS fps FROM inc),
    firsts AS (SELECT fp, min_by({{'t': t, 'src': src}}, ord) AS f FROM printed GROUP BY fp),
    grouped AS (SELECT p.*, CASE WHEN {apart_sql('f.t', 'p.t', 'CASE WHEN f.src = p.src THEN 1 ELSE 120 END')} THEN fps ELSE fp END AS gfp FROM printed p JOIN firsts USING (fp)),
    heads AS (SELECT gfp, min(ord) AS seq, min_by({{'day': day, 'nt': nt, 'vshow': vshow, 'vraw': vraw, 'cshow': cshow, 't': t, 'src': src}}, ord) AS h FROM grouped GROUP BY gfp),
    {day_matches(SIDE.format(title='nt', venue=name_sql('h.vshow'), city=name_sql('h.cshow')), SIDE.format(title='nt', venue=name_sql('h.vraw'), city=name_sql('h.cshow')), 'm', 'r.seq < l.seq')},
    chain AS (SELECT l_key AS child, r_key AS parent, 1 AS n FROM m UNION ALL SELECT chain.child, m.r_key, n + 1 FROM chain JOIN m ON m.l_key = chain.parent),
    tops AS (SELECT child, max_by(parent, n) AS root FROM chain GROUP BY child),
    assigned AS (SELECT g.*, coalesce(tops.root, gfp) AS root FROM grouped g LEFT JOIN tops ON child = gfp),
    folded AS (SELECT left(root, 20) AS event_id, count(*) AS n, max_by({{'ordinal': ordinal, 'title': title, 'day': day, 'src': src, 'gfp': gfp}}, rank) AS win, max_by(t, rank) FILTER (t IS NOT NULL) AS time_start,
      max_by(venue_id, ord) FILTER (venue_id IS NOT NULL) AS venue_id, max_by(vraw, ord) FILTER (vraw IS NOT NULL) AS venue_name_raw, max_by(city_id, ord) FILTER (city_id IS NOT NULL) AS city_id,
      max_by({{'status': status, 'conf': conf}}, (CASE WHEN status = 'CANCELLED' THEN 6 WHEN status = 'POSTPONED' THEN 5 WHEN status = 'RESCHEDULED' THEN 4 WHEN status = 'SOLD_OUT' THEN 3 WHEN status = 'CONFIRMED' AND conf = 'OFFICIAL' THEN 2
        WHEN status = 'SCHEDULED' THEN 0 ELSE 1 END, ord)) AS said, bool_or(sold) AS sold, count(DISTINCT src) AS source_count FROM assigned GROUP BY root)"""
CANONICAL_SQL = f"""WITH RECURSIVE {MERGED} SELECT event_id, win.gfp AS fingerprint, win.title AS title, win.day::VARCHAR AS date_start, time_start, venue_id, venue_name_raw, city_id, win.src AS primary_source, source_count,
    CASE WHEN said.status IN ('CANCELLED', 'POSTPONED', 'RESCHEDULED') THEN said.status WHEN sold OR said.status = 'SOLD_OUT' THEN 'SOLD_OUT' WHEN win.day < DATE '1998-06-15' THEN 'COMPLETED'
      WHEN (said.status = 'CONFIRMED' AND said.conf = 'OFFICIAL') OR source_count >= 2 OR said.status = 'CONFIRMED' THEN 'CONFIRMED' ELSE said.status END AS status FROM folded"""
THREE_RUNS_SQL = f"""WITH RECURSIVE {MERGED}, n AS (SELECT sum(n) AS records, count(*) AS events, count(*) FILTER (win.ordinal % 7 = 0) AS moved FROM folded)
    SELECT 0 AS run, records::BIGINT AS records, (records - events)::BIGINT AS duplicates, events AS created, 0 AS updated, events AS changes, events AS snapshots FROM n UNION ALL SELECT 1, records::BIGINT, 0, 0, 0, 0, 0 FROM n UNION ALL SELECT 2, records::BIGINT, 0, 0, moved, moved, moved FROM n"""
