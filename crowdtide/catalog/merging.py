"""Place resolution, record matching, survivorship, upserts and retention over whole tables (JOIN, UPS)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import AS_OF, log_now, now
from ..functions.text import fingerprint, normalize_title
from ..operators import entities as en
from ..operators import geography as geo
from ..operators import upserts as up
from ..plans import stored_merge as sm
from ..session import scratch
from . import oracle_similarity as osim
from .oracle_tables import AS_OF as D
from .oracle_tables import LOG_NOW, name_sql, title_sql
from .registry import check
from .shape import iso

c = F.col

# ---- places -----------------------------------------------------------------------------------------------------------------------------
VENUE_NAME = """case pmod(event_id, 6) when 0 then venue_name_raw when 1 then concat('Hall ', cast(pmod(event_id, 3000) as string)) when 2 then concat(venue_name_raw, ' - Main Stage') when 3 then concat('Unknown Place ', cast(pmod(event_id, 50) as string))
    when 4 then 'TBC' else 'Customer#0000' end"""
VENUE_NAME_SQL = """CASE event_id % 6 WHEN 0 THEN venue_name_raw WHEN 1 THEN 'Hall ' || (event_id % 3000) WHEN 2 THEN venue_name_raw || ' - Main Stage' WHEN 3 THEN 'Unknown Place ' || (event_id % 50) WHEN 4 THEN 'TBC' ELSE 'Customer#0000' END"""
CITY_NAME = "case pmod(event_id, 4) when 0 then city_name_raw when 1 then concat('Greater ', city_name_raw) when 2 then concat(city_name_raw, ' Borough') else 'Nowhere' end"
CITY_NAME_SQL = "CASE event_id % 4 WHEN 0 THEN city_name_raw WHEN 1 THEN 'Greater ' || city_name_raw WHEN 2 THEN city_name_raw || ' Borough' ELSE 'Nowhere' END"

VENUE_INDEX = f"""vindex AS (SELECT key, min_by(venue_id, (CASE WHEN is_seeded THEN 0 ELSE 1 END, pos, venue_id)) AS venue_id FROM (SELECT {name_sql('name')} AS key, 0 AS pos, venue_id, is_seeded FROM d_venue
    UNION ALL SELECT {name_sql('alias1')}, 1, venue_id, is_seeded FROM d_venue WHERE is_seeded) GROUP BY 1)"""
VENUE_MATCH = f"""vnames AS (SELECT DISTINCT {VENUE_NAME_SQL} AS name FROM d_event WHERE {VENUE_NAME_SQL} IS NOT NULL), vkeys AS (SELECT name, {name_sql('name')} AS key FROM vnames), {VENUE_INDEX},
    vin AS (SELECT k.name, min_by(i.venue_id, (-length(i.key), i.key)) AS venue_id FROM vkeys k JOIN vindex i ON length(i.key) > 5 AND (contains(k.key, i.key) OR contains(i.key, k.key)) GROUP BY 1),
    vmatch AS (SELECT k.name, CASE WHEN k.key IN ('', 'tbc') THEN NULL ELSE coalesce(e.venue_id, n.venue_id) END AS venue_id, CASE WHEN k.key IN ('', 'tbc') THEN 'no_venue' WHEN e.venue_id IS NOT NULL THEN 'venue_exact' WHEN n.venue_id IS NOT NULL THEN 'venue_contains' ELSE 'venue_unmatched' END AS venue_method
      FROM vkeys k LEFT JOIN vindex e ON e.key = k.key LEFT JOIN vin n ON n.name = k.name)"""
CITY_MATCH = f"""cnames AS (SELECT DISTINCT {CITY_NAME_SQL} AS name FROM d_event WHERE {CITY_NAME_SQL} IS NOT NULL), ckeys AS (SELECT name, {name_sql('name')} AS key FROM cnames),
    cindex AS (SELECT key, min(city_id) AS city_id FROM (SELECT {name_sql('name')} AS key, city_id FROM d_city UNION ALL SELECT {name_sql('alias1')}, city_id FROM d_city) GROUP BY 1),
    cin AS (SELECT k.name, min_by(i.city_id, (-length(i.key), i.key)) AS city_id FROM ckeys k JOIN cindex i ON contains(' ' || k.key || ' ', ' ' || i.key || ' ') GROUP BY 1),
    cmatch AS (SELECT k.name, coalesce(e.city_id, n.city_id) AS city_id, CASE WHEN e.city_id IS NOT NULL THEN 'city_exact' WHEN n.city_id IS NOT NULL THEN 'city_contains' ELSE 'city_unmatched' END AS city_method
      FROM ckeys k LEFT JOIN cindex e ON e.key = k.key LEFT JOIN cin n ON n.name = k.name)"""


@check("join09_venue_cascade", f"WITH {VENUE_MATCH} SELECT name, venue_id, venue_method FROM vmatch")
def join09(t):
    return geo.match_venues(t.event.select(F.expr(VENUE_NAME).alias("name")).where("name IS NOT NULL"), t.venue, fuzzy=False)


SLIPS = "CASE WHEN event_id % 2 = 0 THEN substr(venue_name_raw, 10) || ' the Customer' ELSE 'Hal ' || venue_id END"


@check("join09b_venue_fuzzy", f"""WITH {VENUE_INDEX}, vn AS (SELECT name, {name_sql('name')} AS key FROM (SELECT DISTINCT {SLIPS} AS name FROM d_event WHERE venue_name_raw IS NOT NULL) WHERE name IS NOT NULL),
    vk AS (SELECT DISTINCT key FROM vn WHERE key NOT IN ('', 'tbc')), ex AS (SELECT key, venue_id FROM vk JOIN vindex USING (key)),
    inside AS (SELECT k.key, min_by(i.venue_id, (-length(i.key), i.key)) AS venue_id FROM vk k JOIN vindex i ON length(i.key) > 5 AND (contains(k.key, i.key) OR contains(i.key, k.key)) WHERE k.key NOT IN (SELECT key FROM ex) GROUP BY 1),
    open_names AS (SELECT key FROM vk WHERE key NOT IN (SELECT key FROM ex) AND key NOT IN (SELECT key FROM inside)), {osim.fuzzy_lookup('open_names', 'vindex', 'f', 0.9)}
    SELECT name, coalesce(ex.venue_id, inside.venue_id, i.venue_id) AS venue_id, CASE WHEN vn.key IN ('', 'tbc') THEN 'no_venue' WHEN ex.venue_id IS NOT NULL THEN 'venue_exact' WHEN inside.venue_id IS NOT NULL THEN 'venue_contains'
      WHEN f.key IS NOT NULL THEN 'venue_fuzzy_' || floor(f.score)::INT ELSE 'venue_unmatched' END AS venue_method
    FROM vn LEFT JOIN ex ON ex.key = vn.key LEFT JOIN inside ON inside.key = vn.key LEFT JOIN f ON f.key = vn.key LEFT JOIN vindex i ON i.key = f.index_key""")
def join09b(t):
    """All three steps; names carry a typing slip or their words in another order."""
    names = t.event.where("venue_name_raw IS NOT NULL").select(F.expr("case when pmod(event_id, 2) = 0 then concat(substr(venue_name_raw, 10), ' the Customer') else concat('Hal ', cast(venue_id as string)) end").alias("name")).where("name IS NOT NULL")
    return geo.match_venues(names, t.venue)


@check("join10_city_cascade", f"WITH {CITY_MATCH} SELECT name, city_id, city_method FROM cmatch")
def join10(t):
    return geo.match_cities(t.event.select(F.expr(CITY_NAME).alias("name")).where("name IS NOT NULL"), t.city, fuzzy=False)


@check("join10b_city_fuzzy", f"""WITH cindex AS (SELECT key, min(city_id) AS city_id FROM (SELECT {name_sql('name')} AS key, city_id FROM d_city UNION ALL SELECT {name_sql('alias1')}, city_id FROM d_city) GROUP BY 1),
    cn AS (SELECT name, {name_sql('name')} AS key FROM (SELECT DISTINCT replace(city_name_raw, 'NATION', 'NATIONN') AS name FROM d_event WHERE city_name_raw IS NOT NULL)),
    inside AS (SELECT k.key, min_by(i.city_id, (-length(i.key), i.key)) AS city_id FROM cn k JOIN cindex i ON contains(' ' || k.key || ' ', ' ' || i.key || ' ') GROUP BY 1),
    near AS (SELECT a AS key, max_by(city_id, (score, b)) AS city_id, max(score) AS score FROM (SELECT k.key AS a, i.key AS b, i.city_id, {osim.ratio_sql('k.key', 'i.key')} AS score FROM cn k JOIN cindex i ON true) WHERE score >= 88 GROUP BY 1)
    SELECT name, coalesce(e.city_id, inside.city_id, near.city_id) AS city_id, CASE WHEN e.city_id IS NOT NULL THEN 'city_exact' WHEN inside.city_id IS NOT NULL THEN 'city_contains' WHEN near.city_id IS NOT NULL THEN 'city_fuzzy_' || floor(near.score)::INT
      ELSE 'city_unmatched' END AS city_method FROM cn LEFT JOIN cindex e ON e.key = cn.key LEFT JOIN inside ON inside.key = cn.key LEFT JOIN near ON near.key = cn.key""")
def join10b(t):
    return geo.match_cities(t.event.where("city_name_raw IS NOT NULL").select(F.concat(F.replace("city_name_raw", F.lit("NATION"), F.lit("NATIONN"))).alias("name")), t.city)


def staged(t):
    return t.event.selectExpr("event_id", f"{VENUE_NAME} venue_name", f"{CITY_NAME} city_name", "case when pmod(event_id, 7) = 0 then 'm1 1aa' end postcode", "case when pmod(event_id, 10) = 3 then latitude end latitude",
                              "case when pmod(event_id, 10) = 3 then longitude end longitude")


NEAREST = """near AS (SELECT latitude, longitude, CASE WHEN d2 < 0.25 THEN city_id END AS city_id FROM (SELECT p.latitude, p.longitude, c.city_id, (c.latitude - p.latitude) * (c.latitude - p.latitude) + (c.longitude - p.longitude) * (c.longitude - p.longitude) AS d2,
    row_number() OVER (PARTITION BY p.latitude, p.longitude ORDER BY (c.latitude - p.latitude) * (c.latitude - p.latitude) + (c.longitude - p.longitude) * (c.longitude - p.longitude), c.city_id) AS rn
    FROM (SELECT DISTINCT latitude, longitude FROM d_event WHERE latitude IS NOT NULL) p CROSS JOIN d_city c) WHERE rn = 1)"""


@check("join11_place_resolution", f"""WITH {VENUE_MATCH}, {CITY_MATCH}, {NEAREST}, base AS (SELECT event_id, {VENUE_NAME_SQL} AS vn, {CITY_NAME_SQL} AS cn, CASE WHEN event_id % 7 = 0 THEN 'M1 1AA' END AS pc,
      CASE WHEN event_id % 10 = 3 THEN latitude END AS lat, CASE WHEN event_id % 10 = 3 THEN longitude END AS lon FROM d_event),
    a AS (SELECT b.event_id, m.venue_id, coalesce(m.venue_method, 'no_venue') AS vm, v.city_id IS NULL AS by_name, coalesce(v.city_id, k.city_id) AS city1, coalesce(k.city_method, 'no_city') AS cmeth,
      coalesce(b.pc, v.postcode) AS postcode, coalesce(b.lat, v.latitude) AS lat, CASE WHEN b.lat IS NOT NULL THEN b.lon ELSE v.longitude END AS lon FROM base b LEFT JOIN vmatch m ON m.name = b.vn LEFT JOIN d_venue v ON v.venue_id = m.venue_id LEFT JOIN cmatch k ON k.name = b.cn),
    n AS (SELECT a.*, coalesce(a.city1, near.city_id) AS city_id, a.city1 IS NULL AND near.city_id IS NOT NULL AS used_near FROM a LEFT JOIN near ON a.city1 IS NULL AND near.latitude = a.lat AND near.longitude = a.lon)
    SELECT n.event_id, n.venue_id, n.city_id, n.postcode, coalesce(n.lat, c.latitude) AS latitude, CASE WHEN n.lat IS NOT NULL THEN n.lon ELSE c.longitude END AS longitude,
      n.vm || CASE WHEN n.by_name THEN '+' || n.cmeth ELSE '' END || CASE WHEN n.used_near THEN '+nearest_city' ELSE '' END || CASE WHEN n.lat IS NULL AND c.latitude IS NOT NULL THEN '+city_centroid' ELSE '' END AS geo_method
    FROM n LEFT JOIN d_city c ON c.city_id = n.city_id""")
def join11(t):
    return geo.resolve_places(staged(t), t.venue, t.city, fuzzy=False).select("event_id", "venue_id", "city_id", "postcode", "latitude", "longitude", "geo_method")


@check("join12_postcode_lookup", """SELECT e.event_id, p.latitude, p.longitude FROM (SELECT event_id, 'M' || (event_id % 12 + 1) || ' ' || (event_id % 9) || 'AB' AS postcode FROM d_event) e
    LEFT JOIN (SELECT postcode, min(latitude) AS latitude, min(longitude) AS longitude FROM d_venue GROUP BY 1) p USING (postcode)""")
def join12(t):
    """Events with nothing but a postcode take the coordinates of the postcode reference table."""
    ref = t.venue.groupBy("postcode").agg(F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"))
    none = "cast(null as string)"
    rows = t.event.selectExpr("event_id", f"{none} venue_name", f"{none} city_name", "concat('m', cast(pmod(event_id, 12) + 1 as string), cast(pmod(event_id, 9) as string), 'ab') postcode", "cast(null as double) latitude", "cast(null as double) longitude")
    far = t.city.withColumns({"latitude": c("latitude") - 40, "longitude": c("longitude") - 40})
    return geo.resolve_places(rows, t.venue, far, postcodes=ref, fuzzy=False).select("event_id", "latitude", "longitude")


@check("ups11_new_venues", f"""WITH {VENUE_MATCH} SELECT {name_sql('name')} AS normalized_name, min(name) AS name, 'unknown' AS venue_type, count(*) AS spellings FROM vmatch WHERE venue_method = 'venue_unmatched' GROUP BY 1""")
def ups11(t):
    rows = staged(t).withColumns({"external_id": c("event_id").cast("string"), "venue_capacity": F.lit(None).cast("int")})
    resolved = geo.resolve_places(rows, t.venue, t.city, fuzzy=False)
    made = geo.new_venues(resolved, t.venue)
    from ..functions.text import normalize_name

    n = resolved.where("venue_id IS NULL").select("venue_name").distinct().groupBy(normalize_name("venue_name").alias("normalized_name")).agg(F.count("*").alias("spellings"))
    return made.join(n, "normalized_name").select("normalized_name", "name", "venue_type", "spellings")


# ---- record matching ------------------------------------------------------------------------------------------------------------------------
@check("join06_natural_key", """SELECT a.source_id, a.external_id, b.event_id AS linked FROM (SELECT source_id, CASE WHEN event_id % 4 = 0 THEN external_id || '-new' ELSE external_id END AS external_id FROM d_link) a LEFT JOIN d_link b USING (source_id, external_id)""")
def join06(t):
    inc = t.event_source.selectExpr("source_id", "case when pmod(event_id, 4) = 0 then concat(external_id, '-new') else external_id end external_id")
    return inc.join(t.event_source.select("source_id", "external_id", c("event_id").alias("linked")), ["source_id", "external_id"], "left")


def stored_events(t):
    return t.event.withColumn("fingerprint", fingerprint(c("title"), c("date_start"), c("venue_name_raw"), c("city_name_raw")))


_apart = osim.apart_sql

STORED_FP = f"{title_sql('title')} || '|' || date_start || '|' || {name_sql('venue_name_raw')} || '|' || {name_sql('city_name_raw')}"


@check("join07_fingerprint_match", f"""WITH stored AS (SELECT min(event_id) AS event_id, min_by(time_start, event_id) AS ts, min_by(primary_source, event_id) AS src, fp FROM (SELECT *, {STORED_FP} AS fp FROM d_event) GROUP BY fp),
    inc AS (SELECT event_id AS rec, CASE WHEN event_id % 3 = 0 THEN '11:00' ELSE time_start END AS t, CASE WHEN event_id % 2 = 0 THEN primary_source ELSE 'other' END AS src, {STORED_FP} AS fp,
      {title_sql("title || coalesce(' ' || CASE WHEN event_id % 3 = 0 THEN '11:00' ELSE time_start END, '')")} || '|' || date_start || '|' || {name_sql('venue_name_raw')} || '|' || {name_sql('city_name_raw')} AS fps FROM d_event),
    hit AS (SELECT i.*, s.event_id AS hit, {_apart('s.ts', 'i.t', "CASE WHEN s.src = i.src THEN 1 ELSE 120 END")} AS apart FROM inc i LEFT JOIN stored s USING (fp))
    SELECT h.rec, CASE WHEN h.hit IS NOT NULL AND h.apart THEN x.event_id ELSE h.hit END AS event_id, h.hit IS NOT NULL AND h.apart AS other_session FROM hit h LEFT JOIN stored x ON x.fp = h.fps""")
def join07(t):
    inc = stored_events(t).selectExpr("cast(event_id as string) rec", "case when pmod(event_id, 3) = 0 then '11:00' else time_start end time_start", "case when pmod(event_id, 2) = 0 then primary_source else 'other' end source_key",
                                      "cast(event_id as string) external_id", "fingerprint fp", "title", "date_start", "venue_name_raw", "city_name_raw")
    inc = inc.withColumn("fp_session", fingerprint(F.concat_ws(" ", "title", "time_start"), c("date_start"), c("venue_name_raw"), c("city_name_raw")))
    no_links = t.event.limit(0).selectExpr("primary_source source_key", "cast(event_id as string) external_id", "event_id")
    m = en.match_exact(inc, stored_events(t), no_links)
    return m.select(c("rec").cast("bigint").alias("rec"), c("exact_event").alias("event_id"), (c("fp_final") != c("fp")).alias("other_session"))


@check("join20_link_sessions", f"""SELECT event_id AS rec, CASE WHEN {_apart('time_start', 't', '120')} THEN NULL ELSE event_id END AS by_link FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN '11:00' WHEN 1 THEN left(time_start, 3) || '45' ELSE time_start END AS t FROM d_event)""")
def join20(t):
    """Linked records whose start moved by two hours or more are another session; smaller moves keep the link."""
    inc = t.event.selectExpr("cast(event_id as string) rec", "case pmod(event_id, 3) when 0 then '11:00' when 1 then concat(left(time_start, 3), '45') else time_start end time_start", "primary_source source_key",
                             "cast(event_id as string) external_id", "concat('a', cast(event_id as string)) fp", "concat('b', cast(event_id as string)) fp_session")
    links = t.event.selectExpr("primary_source source_key", "cast(event_id as string) external_id", "event_id")
    m = en.match_exact(inc, t.event.withColumn("fingerprint", c("event_id").cast("string")), links)
    return m.select(c("rec").cast("bigint").alias("rec"), "by_link")


@check("join08_fuzzy_join", osim.JOIN08_SQL)
def join08(t):
    """Every event with a reworded title against all events of its day."""
    ev = t.event.where("venue_name_raw IS NOT NULL")
    left = ev.select(c("event_id").alias("l_key"), "date_start", normalize_title(F.concat(F.lit("Live: "), c("title"), F.lit("s"))).alias("norm_title"), c("venue_name_raw").alias("venue"), c("city_name_raw").alias("city"),
                     "time_start", c("primary_source").alias("source_key"))
    right = ev.select(c("event_id").alias("r_key"), "date_start", "title", c("venue_name_raw").alias("venue"), c("city_name_raw").alias("city"), "time_start", c("primary_source").alias("source_key"))
    return en.fuzzy_matches(left, right.withColumn("r_key", -c("r_key")))


@check("win07_best_candidate", osim.WIN07_SQL)
def win07(t):
    """Best counterpart per event among the other events of its day."""
    ev = t.event.where("venue_name_raw IS NOT NULL").select(c("event_id").alias("l_key"), "date_start", "title", normalize_title("title").alias("norm_title"), c("venue_name_raw").alias("venue"), c("city_name_raw").alias("city"),
                                                            "time_start", c("primary_source").alias("source_key"))
    return en.fuzzy_matches(ev, ev.withColumnRenamed("l_key", "r_key"))


def listings(t):
    """The whole event table as landed listings of two source groups, places already resolved."""
    return t.with_places(t.event).selectExpr(
        "primary_source source_key", "cast(event_id as string) external_id", "event_id ordinal", "title", "cast(null as string) description", "category category_hint", "date_start", "date_end", "time_start", "time_end",
        "venue_id", "v_name", "venue_name_raw venue_name", "city_id", "c_name", "city_name_raw city_name", "region_id", "postcode", "latitude", "longitude", "v_capacity", "venue_capacity", "organizer", "official_url", "ticket_url",
        "official_url source_url", "status", "source_confidence", "cast(null as string) event_subtype", "status = 'SOLD_OUT' sold_out", "cast(null as string) recurrence")


CANONICAL = ["event_id", "fingerprint", "title", "date_start", "time_start", "venue_id", "venue_name_raw", "city_id", "primary_source", "source_count", "status"]


@check("ups02_canonical_upsert", osim.CANONICAL_SQL)
def ups02(t):
    """All listings into empty stored tables, as one batch."""
    base = scratch(t.spark, "ups02")
    sm.merge_once(base, 0, listings(t), t.source, AS_OF, now(), sm.MONTH)
    return iso(sm.read_table(t.spark, base, "event").select(*CANONICAL))


@check("agg22_run_counters", osim.THREE_RUNS_SQL)
def agg22(t):
    """Three runs over stored tables: everything is new, nothing changes, the ticket links of one listing in seven lead deeper."""
    base = scratch(t.spark, "agg22")
    first = listings(t)
    deeper = F.when(c("ordinal") % 7 == 0, F.concat(F.lit("https://tickets.example/buy/seats/row/"), c("ordinal").cast("string"))).otherwise(c("ticket_url"))
    for k, rows in enumerate((first, first, first.withColumn("ticket_url", deeper))):
        sm.merge_once(base, k, rows, t.source, AS_OF, now(), sm.MONTH)
    return sm.read_table(t.spark, base, "counter").select(c("batch").alias("run"), "records", "duplicates", "created", "updated", "changes", "snapshots")


@check("stm02_micro_batch_upsert", osim.CANONICAL_SQL)
def stm02(t):
    """The listings as a stream of files with whole months, some of them sent twice: the stored events are those of one batch."""
    base = scratch(t.spark, "stm02")
    rows = listings(t).withColumn("month", F.date_format("date_start", sm.MONTH))
    rows.repartition(4, "month").write.parquet(f"{base}/landing")
    rows.where(F.substring("month", -1, 1) == "3").repartition(2, "month").write.mode("append").parquet(f"{base}/landing")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/landing").drop("month")
    sm.upsert_stream(stream, f"{base}/state", t.source, AS_OF, now(), f"{base}/offsets", sm.MONTH)
    return iso(sm.read_table(t.spark, f"{base}/state", "event").select(*CANONICAL))


CHANGED = f"""SELECT event_id, date_start AS od, date_start + CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END AS nd, time_start AS ot, CASE event_id % 5 WHEN 0 THEN '20:00' WHEN 1 THEN NULL ELSE time_start END AS nt, official_url AS ou,
    CASE event_id % 4 WHEN 0 THEN 'https://tickets.example/' WHEN 2 THEN 'https://tickets.example/e/x/' || event_id ELSE official_url END AS nu, venue_name_raw AS ov, CASE WHEN event_id % 10 = 0 THEN 'Elsewhere' ELSE venue_name_raw END AS nv FROM d_event"""


@check("ups03_change_detection", f"""SELECT event_id, 'DATE_CHANGED' AS change_type, 'date_start' AS field, od::VARCHAR AS old_value, nd::VARCHAR AS new_value FROM ({CHANGED}) WHERE od <> nd
    UNION ALL SELECT event_id, 'TIME_CHANGED', 'time_start', coalesce(ot, 'None'), nt FROM ({CHANGED}) WHERE nt IS NOT NULL AND coalesce(ot, 'None') <> nt
    UNION ALL SELECT event_id, 'VENUE_CHANGED', 'venue_name_raw', coalesce(ov, 'None'), nv FROM ({CHANGED}) WHERE nv IS NOT NULL AND coalesce(ov, 'None') <> nv
    UNION ALL SELECT event_id, 'UPDATED', 'official_url', coalesce(ou, 'None'), nu FROM ({CHANGED}) WHERE nu IS NOT NULL AND coalesce(ou, 'None') <> nu AND (ou IS NULL OR event_id % 4 = 2)""")
def ups03(t):
    ev = t.event
    new = {"date_start": F.expr("date_add(date_start, case when pmod(event_id, 6) = 0 then 1 else 0 end)"), "date_end": c("date_end"), "time_start": F.expr("case pmod(event_id, 5) when 0 then '20:00' when 1 then null else time_start end"),
           "time_end": c("time_end"), "venue_name_raw": F.expr("case when pmod(event_id, 10) = 0 then 'Elsewhere' else venue_name_raw end"), "title": c("title"), "ticket_url": c("ticket_url"),
           "official_url": F.expr("case pmod(event_id, 4) when 0 then 'https://tickets.example/' when 2 then concat('https://tickets.example/e/x/', cast(event_id as string)) else official_url end")}
    found = en.detect_changes({k: c(k) for k in new}, new)
    return ev.select("event_id", F.explode(found).alias("x")).select("event_id", "x.*")


@check("ups05_link_upsert", f"""SELECT coalesce(n.source_id, o.source_id)::VARCHAR AS source_key, coalesce(n.external_id, o.external_id) AS external_id, coalesce(n.event_id, o.event_id) AS event_id, n.event_id IS NOT NULL AS seen
    FROM (SELECT * FROM d_link WHERE event_id % 2 = 0) o FULL JOIN (SELECT DISTINCT source_id, external_id, event_id + 1 AS event_id FROM d_link WHERE event_id % 3 = 0) n USING (source_id, external_id)""")
def ups05(t):
    ln = t.event_source.selectExpr("cast(source_id as string) source_key", "external_id", "event_id", "cast(null as string) source_url", "TIMESTAMP_NTZ '1998-01-01 00:00:00' first_seen", "TIMESTAMP_NTZ '1998-01-01 00:00:00' last_seen")
    rec = ln.where("pmod(event_id, 3) = 0").selectExpr("source_key", "external_id", "event_id + 1 event_id", "source_url", "1 src_priority", "event_id ordinal")
    out = en.upsert_links(ln.where("pmod(event_id, 2) = 0"), rec, now())
    return out.select("source_key", "external_id", "event_id", (c("last_seen") == now()).alias("seen"))


@check("join14_insert_if_absent", """SELECT DISTINCT a.source_key, a.external_id, a.hash FROM (SELECT user_id::VARCHAR AS source_key, (event_id % 500)::VARCHAR AS external_id, event_type AS hash FROM events) a
    WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.event_id % 2 = 0 AND b.user_id::VARCHAR = a.source_key AND (b.event_id % 500)::VARCHAR = a.external_id AND b.event_type = a.hash)""")
def join14(t):
    rows = t.table("events").selectExpr("cast(user_id as string) source_key", "cast(pmod(event_id, 500) as string) external_id", "event_type hash", "event_id ordinal", "props payload")
    return up.insert_raw(rows.where("pmod(ordinal, 2) = 0"), rows).select("source_key", "external_id", "hash")


def children(t):
    """Stored opportunities: the full set plus one obsolete type; regenerated: events with an even id."""
    opp = t.opportunity().select("event_id", "opportunity_type", "score")
    stored = opp.union(opp.where("opportunity_type = 'PRE_BOOKING'").select("event_id", F.lit("RETIRED_TYPE").alias("opportunity_type"), "score"))
    done = t.event.where("pmod(event_id, 2) = 0")
    return up.upsert_children(stored, opp.join(done.select("event_id"), "event_id", "left_semi").withColumn("score", c("score") + 1), done, ["event_id", "opportunity_type"])


@check("join15_obsolete_children", "SELECT event_id, 'RETIRED_TYPE' AS opportunity_type FROM d_opp WHERE opportunity_type = 'PRE_BOOKING' AND event_id % 2 = 0")
def join15(t):
    return children(t)[1].select("event_id", "opportunity_type")


@check("ups06_opportunity_upsert", """SELECT event_id, opportunity_type, score + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS score FROM d_opp UNION ALL SELECT event_id, 'RETIRED_TYPE', score FROM d_opp WHERE opportunity_type = 'PRE_BOOKING' AND event_id % 2 = 1""")
def ups06(t):
    return children(t)[0]


STORED_ACTION = "SELECT a.event_id, a.action_type, a.action_status AS status, e.status AS event_status, a.ordinal FROM d_action a JOIN d_event e USING (event_id) WHERE a.action_type <> 'LANDING_PAGE'"


def action_turn(t):
    """Stored: all but one action type; the gate now only stays open for even event ids, and two in seven events are cancelled."""
    ev = t.scored_between(0, 30)
    act = t.action(ev)
    stored = act.where("action_type <> 'LANDING_PAGE'").withColumn("scheduled_for", F.lit(None).cast("timestamp_ntz"))
    proposed = act.where("pmod(event_id, 2) = 0")
    status = F.when(c("event_id") % 7 < 2, F.lit("CANCELLED")).otherwise(c("status"))
    processed = ev.select("event_id", status.alias("status"))
    return stored, proposed, processed, up.upsert_actions(stored, proposed, processed, now())


@check("ups07_action_upsert", f"""SELECT event_id, action_type, CASE WHEN event_id % 2 = 0 AND status IN ('NEW', 'DISMISSED_AUTO') THEN 'NEW' WHEN event_id % 2 = 1 AND (status = 'NEW' OR (event_id % 7 < 2 AND status = 'PLANNED')) THEN
      CASE WHEN event_id % 7 < 2 THEN 'DISMISSED' ELSE 'DISMISSED_AUTO' END ELSE status END AS status, CASE WHEN event_id % 2 = 0 AND status IN ('NEW', 'DISMISSED_AUTO') THEN 'updated'
      WHEN event_id % 2 = 1 AND (status = 'NEW' OR (event_id % 7 < 2 AND status = 'PLANNED')) THEN 'dismissed' ELSE 'kept' END AS merge_action FROM ({STORED_ACTION})
    UNION ALL SELECT * FROM (SELECT event_id, action_type, 'NEW', 'created' FROM d_action WHERE event_id % 2 = 0 AND action_type = 'LANDING_PAGE')""")
def ups07(t):
    return action_turn(t)[3].select("event_id", "action_type", "status", "merge_action")


@check("agg24_gate_metrics", f"""SELECT (SELECT count(*) FROM d_event WHERE date_start BETWEEN {D} AND {D} + 30) AS events_scored, (SELECT count(DISTINCT event_id) FROM d_action WHERE event_id % 2 = 0) AS events_passing_gate,
    (SELECT count(*) FROM d_action WHERE event_id % 2 = 0 AND action_type = 'LANDING_PAGE') AS actions_created, 0 AS actions_capped,
    (SELECT count(*) FROM ({STORED_ACTION}) WHERE event_id % 2 = 1 AND (status = 'NEW' OR (event_id % 7 < 2 AND status = 'PLANNED'))) AS actions_auto_dismissed""")
def agg24(t):
    stored, proposed, processed, nxt = action_turn(t)
    return up.gate_counters(nxt, proposed, processed, stored)


@check("ups08_action_transitions", """SELECT a.action_id, coalesce(CASE k.command WHEN 'complete' THEN 'DONE' WHEN 'dismiss' THEN 'DISMISSED' WHEN 'schedule' THEN 'SCHEDULED' WHEN 'plan' THEN 'PLANNED' WHEN 'reopen' THEN 'NEW' WHEN 'start' THEN 'IN_PROGRESS' END, a.action_status) AS status
    FROM d_action a LEFT JOIN (SELECT action_id, max_by(command, issued_at) AS command FROM (SELECT action_id, (['complete','dismiss','schedule','plan','reopen','start'])[((action_id + g) % 6)::INT + 1] AS command, g AS issued_at FROM d_action, (VALUES (1), (2)) t(g) WHERE action_id % 3 = 0) GROUP BY 1) k USING (action_id)""")
def ups08(t):
    act = t.action(t.scored_between(0, 30)).withColumn("scheduled_for", F.lit(None).cast("timestamp_ntz"))
    cmd = act.where("pmod(action_id, 3) = 0").select("action_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("issued_at")).withColumn(
        "command", F.expr("element_at(array('complete','dismiss','schedule','plan','reopen','start'), cast(pmod(action_id + issued_at, 6) as int) + 1)"))
    return up.apply_transitions(act, cmd).select("action_id", "status")


# ---- retention, dimensions, runs ---------------------------------------------------------------------------------------------------------------
@check("ups09_retention", f"""SELECT 'raw' AS kind, count(*) AS n FROM events WHERE ts >= {LOG_NOW} - INTERVAL 14 DAY UNION ALL SELECT 'expired_run', count(*) FROM d_prun WHERE started_at < {LOG_NOW} - INTERVAL 20 DAY
    UNION ALL SELECT 'orphaned_change', count(*) FROM d_change c JOIN d_prun r ON r.run_id = c.change_id WHERE r.started_at < {LOG_NOW} - INTERVAL 20 DAY
    UNION ALL SELECT 'completed', count(*) FROM d_event WHERE date_start < {D} - 1 AND status IN ('SCHEDULED', 'RESCHEDULED', 'CONFIRMED', 'SOLD_OUT')""")
def ups09(t):
    old = up.expired_runs(t.pipeline_run, log_now(), 20)
    kept = up.keep_recent(t.table("events"), "ts", log_now(), 14).agg(F.count("*").alias("n")).select(F.lit("raw").alias("kind"), "n")
    gone = old.agg(F.count("*").alias("n")).select(F.lit("expired_run").alias("kind"), "n")
    orphans = up.forget_runs(t.event_change.withColumn("run_id", c("change_id")), old).agg(F.count_if(c("run_id").isNull()).alias("n")).select(F.lit("orphaned_change").alias("kind"), "n")
    done = up.complete_past_events(t.event, AS_OF).agg(F.count_if(c("status") == "COMPLETED").alias("n")).select(F.lit("completed").alias("kind"), "n")
    return kept.union(gone).union(orphans).union(done)


@check("ups10_dimension_upsert", """SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.key IS NOT NULL THEN n.priority ELSE o.priority END AS priority, coalesce(o.enabled, n.enabled) AS enabled, CASE WHEN o.key IS NULL THEN 'created' WHEN n.key IS NULL THEN 'kept' ELSE 'updated' END AS merge_action
    FROM (SELECT key, priority, enabled FROM d_source WHERE source_id % 2 = 0) o FULL JOIN (SELECT key, priority + 5 AS priority, true AS enabled FROM d_source WHERE source_id % 3 = 0) n USING (key)""")
def ups10(t):
    s = t.source.select("source_id", "key", "priority", "enabled")
    seed = s.where("pmod(source_id, 3) = 0").select("key", (c("priority") + 5).alias("priority"), F.lit(True).alias("enabled"))
    return up.upsert_dimension(s.where("pmod(source_id, 2) = 0").drop("source_id"), seed, "key", ("enabled",))


@check("ups12_source_maintenance", """SELECT s.source_id, coalesce(l.status, s.status) AS status, strftime(greatest(l.ok_at, s.last_success_at), '%Y-%m-%d %H:%M:%S') AS last_success_at, coalesce(l.n, s.last_events_collected) AS last_events_collected FROM d_source s
    LEFT JOIN (SELECT source_id, max_by(status, run_id) AS status, max_by(events_collected, run_id) AS n, max(completed_at) FILTER (status IN ('HEALTHY', 'DEGRADED', 'EMPTY')) AS ok_at FROM d_run GROUP BY 1) l USING (source_id)""")
def ups12(t):
    s = t.source.withColumn("last_response_ms", F.lit(None).cast("int"))
    return iso(up.maintain_sources(s, t.source_run).select("source_id", "status", "last_success_at", "last_events_collected"))


@check("ups14_full_rescore", "SELECT event_id, opportunity_score, demand_level, event_quality_score, freshness_score FROM d_scored")
def ups14(t):
    return t.scored_event.select("event_id", "opportunity_score", "demand_level", "event_quality_score", "freshness_score")


@check("ups15_run_metrics", f"SELECT 7 AS run_id, count(*) AS events_raw, count(*) FILTER (date_start BETWEEN {D} - 2 AND {D} + 400) AS events_valid, 2 AS errors, 'PARTIAL' AS status, 43200e0 AS duration_seconds FROM d_event")
def ups15(t):
    counters = t.event.agg(F.count("*").alias("events_raw"), F.count_if(c("date_start").between(F.date_sub(F.lit(AS_OF), 2), F.date_add(F.lit(AS_OF), 400))).alias("events_valid"))
    m = up.run_metrics(counters, 7, F.lit(AS_OF).cast("timestamp_ntz"), now(), stage_errors=2)
    return m.select("run_id", "events_raw", "events_valid", "errors", "status", "duration_seconds")


@check("ups16_source_toggle", """SELECT s.source_id, s.enabled <> (coalesce(k.n, 0) % 2 = 1) AS enabled, CASE WHEN coalesce(k.n, 0) % 2 = 1 AND s.enabled THEN 'DISABLED' ELSE s.status END AS status FROM d_source s LEFT JOIN (SELECT user_id AS source_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) k USING (source_id)""")
def ups16(t):
    cmd = t.table("events").where("event_type = 'click'").select(c("user_id").alias("source_id"))
    return up.toggle_sources(t.source, cmd).select("source_id", "enabled", "status")
