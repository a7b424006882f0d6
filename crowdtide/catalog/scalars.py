"""Scalar functions over whole tables: strings, URLs, hashes, dates, geo, scores, nested values (STR, DT, GEO, MTH, JSN, ARR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..bindings import AS_OF, now
from ..functions import dates as dt
from ..functions import geo, scoring, similarity, text
from ..operators import fanout
from ..operators import filters as fl
from ..operators.bookings import booking_legs
from ..operators.entities import status_change
from ..operators.views import flatten
from ..session import pin
from . import oracle_similarity as osim
from .oracle_tables import AS_OF as D
from .oracle_tables import NOW, band_sql, level_sql, name_sql, title_sql
from .registry import check
from .shape import iso

c = F.col


# ---- strings --------------------------------------------------------------------------------------------------------------------
@check("str01_strip_accents", "SELECT doc_id, md5(strip_accents(text)) AS h FROM documents")
def str01(t):
    return t.table("documents").select("doc_id", F.md5(text.strip_accents("text")).alias("h"))


@check("str02_normalize_name", f"SELECT doc_id, md5({name_sql('text')}) AS h FROM documents")
def str02(t):
    return t.table("documents").select("doc_id", F.md5(text.normalize_name("text")).alias("h"))


@check("str03_normalize_title", f"SELECT doc_id, md5({title_sql('text')}) AS h FROM documents")
def str03(t):
    return t.table("documents").select("doc_id", F.md5(text.normalize_title("text")).alias("h"))


@check("str04_clean_title", r"SELECT doc_id, trim(regexp_replace(text, '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' ', 'g')) AS title FROM documents")
def str04(t):
    return t.table("documents").select("doc_id", text.clean_title("text").alias("title"))


RAW_PC = "case when pmod(c_custkey, 11) = 0 then 'x' else concat('m', cast(pmod(c_custkey, 97) as string), ' ', cast(pmod(c_custkey, 9) as string), 'ab ') end"


@check("str05_normalize_postcode", """SELECT c_custkey, CASE WHEN length(p) BETWEEN 5 AND 7 THEN left(p, length(p) - 3) || ' ' || right(p, 3) END AS postcode FROM (
    SELECT c_custkey, regexp_replace(upper(CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE 'm' || (c_custkey % 97) || ' ' || (c_custkey % 9) || 'ab ' END), '\\s+', '', 'g') AS p FROM customer)""".replace("\\\\", "\\"))
def str05(t):
    return t.table("customer").select("c_custkey", text.normalize_postcode(F.expr(RAW_PC)).alias("postcode"))


@check("str06_normalize_url", """SELECT page_id, CASE WHEN u LIKE 'http://%' OR u LIKE 'https://%' THEN u ELSE 'https://' || u END AS u FROM (
    SELECT page_id, trim(CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?://', ' ') ELSE url END) AS u FROM pages)""")
def str06(t):
    raw = F.when(c("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", " ")).otherwise(c("url"))
    return t.table("pages").select("page_id", text.normalize_url(raw).alias("u"))


DEPTH = r"len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''))"


@check("str07_url_depth", f"SELECT page_id, {DEPTH} AS depth, {DEPTH} > 1 AS deeper FROM pages")
def str07(t):
    return t.table("pages").select("page_id", text.url_depth("url").alias("depth"), text.more_specific(c("url"), F.lit("https://x.example/a")).alias("deeper"))


STATUS_FORMS = ["https://schema.org/EventCancelled", "onsale", "EventPostponed", "off-sale", "Rescheduled", "MovedOnline", "completed", "unknown word", "CANCELED", "event_rescheduled"]


@check("str08_normalize_status", f"""SELECT event_id, CASE regexp_replace(string_split(lower(s), '/')[-1], '[^a-z]', '', 'g') WHEN 'eventcancelled' THEN 'CANCELLED' WHEN 'canceled' THEN 'CANCELLED'
    WHEN 'eventpostponed' THEN 'POSTPONED' WHEN 'rescheduled' THEN 'RESCHEDULED' WHEN 'eventrescheduled' THEN 'RESCHEDULED' WHEN 'completed' THEN 'COMPLETED' ELSE 'SCHEDULED' END AS status
    FROM (SELECT event_id, ({STATUS_FORMS})[(event_id % 10)::INT + 1] AS s FROM events)""")
def str08(t):
    raw = F.element_at(text.strings(STATUS_FORMS), (c("event_id") % 10).cast("int") + 1)
    return t.table("events").select("event_id", text.normalize_status(raw).alias("status"))


@check("str09_fingerprint", f"SELECT event_id, sha256({title_sql('title')} || '|' || date_start || '|' || {name_sql('venue_name_raw')} || '|' || {name_sql('city_name_raw')}) AS fp FROM d_event")
def str09(t):
    return t.event.select("event_id", text.fingerprint(c("title"), c("date_start"), c("venue_name_raw"), c("city_name_raw")).alias("fp"))


@check("str10_external_ids", "SELECT page_id, substring(sha1(url || '|' || page_id || '|' || length(html)), 1, 20) AS ext FROM pages")
def str10(t):
    return t.table("pages").select("page_id", text.external_id(c("url"), c("page_id"), F.length("html")).alias("ext"))


@check("str11_payload_hash", """SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS h FROM events""")
def str11(t):
    return t.table("events").select("event_id", text.payload_hash(F.struct("event_id", "event_type", "user_id")).alias("h"))


@check("str12_snapshot_hash", """SELECT event_id, sha256('{"title":"' || title || '","time_start":' || coalesce('"' || time_start || '"', 'null') || ',"status":"' || status || '"}') AS h FROM d_event""")
def str12(t):
    return t.event.select("event_id", text.payload_hash(F.struct("title", "time_start", "status")).alias("h"))


@check("str13_token_set_ratio", osim.STR13_SQL)
def str13(t):
    """Similarity of every event title with its organiser-style label, words in another order."""
    other = F.concat_ws(" ", F.reverse(F.split("title", " ")))
    return t.event.select("event_id", similarity.token_set_ratio(text.normalize_title("title"), text.normalize_title(other)).alias("same"),
                          similarity.token_set_ratio(text.normalize_title("title"), text.normalize_name("venue_name_raw")).alias("other"))


@check("str14_plain_ratio", osim.STR14_SQL)
def str14(t):
    return t.event.where("city_name_raw IS NOT NULL").select("event_id", similarity.ratio(text.normalize_name("city_name_raw"), text.normalize_name(F.concat(c("city_name_raw"), F.lit("s")))).alias("r"))


@check("str15_duplicate_confidence", osim.STR15_SQL)
def str15(t):
    return t.event.select("event_id", similarity.duplicate_confidence(c("title"), F.concat(c("title"), F.lit(" live")), c("venue_name_raw"), c("venue_name_raw"),
                                                                      c("city_name_raw"), c("city_name_raw"), F.lit(True)).alias("confidence"))


def _rules_sql(x: str) -> str:
    whens = []
    for cat, sub, kws in V.CATEGORY_RULES:
        hit = " OR ".join("contains({x}, '{k}')".format(x="q.t", k=k.lower().replace("'", "''")) for k in kws)
        whens.append(f"WHEN {hit} THEN '{cat}/{sub}'")
    return f"(SELECT CASE {' '.join(whens)} END FROM (SELECT ' ' || lower({x}) || ' ' AS t) q)"


@check("str16_classify", f"""SELECT doc_id, coalesce({_rules_sql('strong')} || '/1.0', {_rules_sql('title')} || '/0.9', {_rules_sql('text')} || '/0.6',
      {_rules_sql('weak')} || '/0.5', 'other/general/0.3') AS cls FROM (
      SELECT doc_id, text, string_split(text, chr(10))[1] AS title, CASE WHEN doc_id % 5 = 0 THEN 'horse racing' END AS strong, CASE WHEN doc_id % 3 = 0 THEN 'comedy' END AS weak FROM documents)""")
def str16(t):
    hint = F.expr("nullif(concat(case when pmod(doc_id, 5) = 0 then 'horse racing ' else '' end, case when pmod(doc_id, 3) = 0 then 'fallback: comedy' else '' end), '')")
    cls = text.classify(F.get(F.split("text", "\n"), F.lit(0)), hint, c("text"))
    return t.table("documents").select("doc_id", cls.alias("k")).select("doc_id", F.concat_ws("/", "k.category", "k.subcategory", c("k.confidence").cast("string")).alias("cls"))


@check("str17_hint_merge", """SELECT event_id, nullif(trim(CASE WHEN event_type <> 'view' THEN event_type ELSE '' END || CASE WHEN event_id % 4 = 0 THEN ' fallback:community' WHEN event_id % 4 = 1 THEN ' arts' ELSE '' END), '') AS merged,
      CASE WHEN event_id % 4 = 0 THEN 'community' END AS weak FROM events""")
def str17(t):
    e = t.table("events").withColumn("page", F.expr("case pmod(event_id, 4) when 0 then 'fallback:community' when 1 then ' arts ' end"))
    kind = F.when(c("event_type") == "view", F.lit("Event")).otherwise(c("event_type"))
    merged = text.merge_hint(kind, c("page"))
    return e.select("event_id", merged.alias("merged"), text.split_hint(merged)[1].alias("weak"))


@check("str18_slugify", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-')) AS h FROM documents")
def str18(t):
    return t.table("documents").select("doc_id", F.md5(text.slugify("text")).alias("h"))


@check("str19_keyword_hit", """SELECT doc_id, CASE WHEN contains(t, 'the ') THEN 'the ' WHEN contains(t, 'les ') THEN 'les ' WHEN contains(t, 'der ') THEN 'der ' END AS hit
    FROM (SELECT doc_id, ' ' || lower(text) || ' ' AS t FROM documents)""")
def str19(t):
    return t.table("documents").select("doc_id", text.keyword_hit(c("text"), ["the ", "les ", "der "]).alias("hit"))


@check("str20_host_allowed", """SELECT page_id, host = 'example.net' OR host LIKE '%.example.net' OR host LIKE '%.blog.example.org' OR host LIKE '%.example.com' AS allowed
    FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM pages)""")
def str20(t):
    return t.table("pages").select("page_id", text.host_allowed(text.url_host("url"), ["example.net", "blog.example.org", "example.com"]).alias("allowed"))


URL_FORMS = ["https://venue.example/e/", "http://10.0.0.5/", "http://172.20.1.1/", "http://192.168.0.9:80/", "ftp://venue.example/", "http://localhost:8000/", "http://user:pw@venue.example/",
             "https://8.8.8.8/", "http://x.internal/", "http://169.254.1.1/"]
URL_VERDICT = [None, "private_ip", "private_ip", "private_ip", "scheme", "host", "credentials", None, "host", "private_ip"]


@check("str21_url_hygiene", f"SELECT event_id, ([{', '.join('NULL' if v is None else repr(v) for v in URL_VERDICT)}])[(event_id % 10)::INT + 1] AS problem FROM events")
def str21(t):
    url = F.concat(F.element_at(text.strings(URL_FORMS), (c("event_id") % 10).cast("int") + 1), c("event_id").cast("string"))
    return t.table("events").select("event_id", text.url_problem(url).alias("problem"))


@check("str22_action_texts", """SELECT a.event_id, a.action_type, replace(replace(replace(CASE a.action_type
      WHEN 'SEO' THEN 'Add an FAQ + fare guide block targeting ''taxi to @V'' and ''@V taxi''. Mention @T on @D.'
      WHEN 'GBP_POST' THEN 'Post: ''Heading to @T at @V on @D? Book your ride in advance.''' END, '@V', coalesce(a.v_name, a.venue_name_raw, 'the venue')), '@T', a.event_title), '@D', strftime(a.date_start, '%a %d %b %Y')) AS description
    FROM d_action a WHERE a.action_type IN ('SEO', 'GBP_POST')""")
def str22(t):
    return t.action(t.scored_between(0, 30)).where(c("action_type").isin("SEO", "GBP_POST")).select("event_id", "action_type", "description")


# ---- dates and times ---------------------------------------------------------------------------------------------------------------
DATE_FORMS = """case pmod(o_orderkey, 7) when 0 then date_format(o_orderdate, 'dd/MM/yyyy') when 1 then date_format(o_orderdate, 'yyyy-MM-dd') when 2 then date_format(o_orderdate, 'd MMM yyyy')
    when 3 then concat('Sat ', date_format(o_orderdate, 'd'), 'th of ', date_format(o_orderdate, 'MMMM yyyy')) when 4 then date_format(o_orderdate, 'd.M.yyyy') when 5 then concat('31/02/', date_format(o_orderdate, 'yyyy')) else 'to be confirmed' end"""


@check("dt01_uk_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 5 THEN o_orderdate::DATE::VARCHAR END AS d FROM orders")
def dt01(t):
    return iso(pin(t.table("orders").select("o_orderkey", "o_orderdate"), raw=F.expr(DATE_FORMS)).select("o_orderkey", dt.parse_uk_date("raw").alias("d")))


TIME_FORMS = """case pmod(event_id, 6) when 0 then date_format(ts, 'HH:mm') when 1 then concat(date_format(ts, 'h'), '.', date_format(ts, 'mm'), lower(date_format(ts, 'a'))) when 2 then 'TBC'
    when 3 then concat(date_format(ts, 'hh:mm'), ' ', date_format(ts, 'a')) when 4 then concat('doors ', date_format(ts, 'h'), lower(date_format(ts, 'a'))) else date_format(ts, 'HH:mm:ss') end"""


@check("dt02_times", "SELECT event_id, CASE event_id % 6 WHEN 2 THEN NULL WHEN 4 THEN strftime(ts, '%H:00') ELSE strftime(ts, '%H:%M') END AS t FROM events")
def dt02(t):
    return pin(t.table("events").select("event_id", "ts"), raw=F.expr(TIME_FORMS)).select("event_id", dt.parse_time("raw").alias("t"))


SUMMER = """o_orderdate + to_hours((o_orderkey % 24)::INT) >= date_trunc('month', make_date(year(o_orderdate), 3, 1)) + to_days(30 - isodow(make_date(year(o_orderdate), 3, 31))::INT % 7) + INTERVAL 1 HOUR
    AND o_orderdate + to_hours((o_orderkey % 24)::INT) < CASE WHEN year(o_orderdate) = 1995 THEN TIMESTAMP '1995-10-22 01:00:00'
      ELSE make_date(year(o_orderdate), 10, 1) + to_days(30 - isodow(make_date(year(o_orderdate), 10, 31))::INT % 7) + INTERVAL 1 HOUR END"""
LOCAL = f"(o_orderdate + to_hours((o_orderkey % 24)::INT) + CASE WHEN {SUMMER} THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END)"
UTC = "timestampadd(HOUR, cast(pmod(o_orderkey, 24) as int), o_orderdate)"


@check("dt03_utc_to_london", f"SELECT o_orderkey, {LOCAL}::DATE::VARCHAR AS d, strftime({LOCAL}, '%H:%M') AS t FROM orders")
def dt03(t):
    d, hm = dt.split_local(F.expr(UTC))
    return iso(t.table("orders").select("o_orderkey", d.alias("d"), hm.alias("t")))


@check("dt04_local_wall_clock", "SELECT event_id, strftime(date_start + (time_start || ':00')::TIME, '%Y-%m-%d %H:%M:%S') AS at FROM d_event")
def dt04(t):
    return iso(t.event.select("event_id", dt.local_datetime(c("date_start"), c("time_start")).alias("at")))


@check("dt05_schema_datetimes", f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate::DATE::VARCHAR WHEN 3 THEN {LOCAL}::DATE::VARCHAR WHEN 4 THEN {LOCAL}::DATE::VARCHAR
      ELSE (o_orderdate + to_hours((o_orderkey % 24)::INT))::DATE::VARCHAR END AS d,
    CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 3 THEN strftime({LOCAL}, '%H:%M') WHEN 4 THEN strftime({LOCAL}, '%H:%M') ELSE strftime(o_orderdate + to_hours((o_orderkey % 24)::INT), '%H:%M') END AS t FROM orders""")
def dt05(t):
    raw = F.expr(f"""case pmod(o_orderkey, 5) when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format({UTC}, "yyyy-MM-dd'T'HH:mm") when 2 then date_format({UTC}, 'yyyy-MM-dd HH:mm:ss')
        when 3 then date_format({UTC}, "yyyy-MM-dd'T'HH:mm:ss'Z'") else date_format(timestampadd(HOUR, 2, {UTC}), "yyyy-MM-dd'T'HH:mm:ss'+02:00'") end""")
    d, hm = dt.parse_schema_datetime("raw")
    return iso(pin(t.table("orders").select("o_orderkey", "o_orderdate"), raw=raw).select("o_orderkey", d.alias("d"), hm.alias("t")))


@check("dt06_booking_timestamps", "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN strftime(ts, '%Y-%m-%d %H:%M:00') WHEN event_id % 5 = 3 THEN strftime(ts, '%Y-%m-%d 00:00:00') END AS at FROM events")
def dt06(t):
    raw = F.expr("""case pmod(event_id, 5) when 0 then date_format(ts, 'yyyy-MM-dd HH:mm') when 1 then date_format(ts, 'dd/MM/yyyy HH:mm') when 2 then date_format(ts, "yyyy-MM-dd'T'HH:mm:00")
        when 3 then date_format(ts, 'd MMM yyyy') else 'NULL' end""")
    return iso(pin(t.table("events").select("event_id", "ts"), raw=raw).select("event_id", dt.parse_booking_timestamp("raw").alias("at")))


@check("dt07_different_session", """SELECT event_id, coalesce(time_start <> time_end AND abs((left(time_start, 2)::INT * 60 + right(time_start, 2)::INT) - (left(time_end, 2)::INT * 60 + right(time_end, 2)::INT)) >= 120, false) AS apart FROM d_event""")
def dt07(t):
    return t.event.select("event_id", dt.different_session(c("time_start"), c("time_end")).alias("apart"))


@check("dt08_horizons", f"SELECT d.days, (SELECT count(*) FROM d_event WHERE date_start BETWEEN {D} AND {D} + d.days) AS n FROM (VALUES (0), (1), (7), (30), (90)) d(days)")
def dt08(t):
    hits = F.array(*[F.when(dt.within_days(c("date_start"), fl.as_date(AS_OF), n), F.lit(n)) for n in (0, 1, 7, 30, 90)])
    return t.event_between(0, 90).select(F.explode(hits).alias("days")).where("days IS NOT NULL").groupBy("days").agg(F.count("*").alias("n"))


@check("dt09_weekday", "SELECT event_id, isodow(date_start) - 1 AS dow, isodow(date_start) >= 6 AS is_weekend FROM d_event")
def dt09(t):
    return t.event.select("event_id", F.weekday("date_start").alias("dow"), dt.weekend(c("date_start")).alias("is_weekend"))


@check("dt10_freshness", "SELECT event_id, freshness_score FROM d_placed")
def dt10(t):
    return t.event.select("event_id", dt.freshness_score(c("last_verified_at"), now()).alias("freshness_score"))


@check("dt11_source_silent", f"SELECT event_id, date_start >= {D} AND last_verified_at < {NOW} - INTERVAL 21 DAY AS silent FROM d_event")
def dt11(t):
    return t.event.select("event_id", dt.source_silent(c("last_verified_at"), c("date_start"), now()).alias("silent"))


@check("dt12_windows", "SELECT event_id, pre_start, pre_end, post_start, post_end, peak, time_start IS NOT NULL AS available FROM d_scored")
def dt12(t):
    return t.event.select("event_id", scoring.demand_windows(c("category"), c("date_start"), c("time_start"), c("time_end")).alias("w")).select(
        "event_id", "w.pre_start", "w.pre_end", "w.post_start", "w.post_end", "w.peak", "w.available")


@check("dt13_duration_factor", "SELECT event_id, k_duration FROM d_parts")
def dt13(t):
    f = scoring.duration_factor(c("category"), c("date_start"), c("date_end"), c("time_start"), c("time_end"))
    return t.event.select("event_id", F.bround(f * 5.0, 1).alias("k_duration"))


@check("dt14_days_ahead", f"SELECT event_id, date_start - {D} AS days, date_start - {D} BETWEEN 0 AND 30 AS inside FROM d_event")
def dt14(t):
    days = F.datediff("date_start", fl.as_date(AS_OF))
    return t.event.select("event_id", days.alias("days"), days.between(V.GATE_MIN_DAYS, V.GATE_MAX_DAYS).alias("inside"))


@check("dt15_lead_dates", "SELECT event_id, (date_start - 1)::VARCHAR AS before, (date_start - 7)::VARCHAR AS lead, (date_start - 14)::VARCHAR AS far, strftime(date_start, '%a %d %b %Y') AS shown FROM d_event")
def dt15(t):
    d = c("date_start")
    return iso(t.event.select("event_id", F.date_sub(d, 1).alias("before"), F.date_sub(d, 7).alias("lead"), F.date_sub(d, 14).alias("far"), F.date_format(d, "E dd MMM yyyy").alias("shown")))


# ---- distances -----------------------------------------------------------------------------------------------------------------------
HAV = "2 * 6371e0 * asin(sqrt(pow(sin((radians(c.latitude) - radians(v.latitude)) / 2), 2) + cos(radians(v.latitude)) * cos(radians(c.latitude)) * pow(sin((radians(c.longitude) - radians(v.longitude)) / 2), 2)))"


@check("geo01_haversine", f"SELECT v.venue_id, round({HAV}, 6) AS km FROM d_venue v JOIN d_city c USING (city_id)")
def geo01(t):
    ct = t.city.select("city_id", c("latitude").alias("la"), c("longitude").alias("lo"))
    return t.venue.join(ct, "city_id").select("venue_id", F.round(geo.haversine_km(c("latitude"), c("longitude"), c("la"), c("lo")), 6).alias("km"))


@check("geo02_box", "SELECT venue_id, round(1 / 111e0, 9) AS dlat, round(1 / (111e0 * greatest(cos(radians(latitude)), 0.2::DOUBLE)), 9) AS dlon FROM d_venue")
def geo02(t):
    dlat, dlon = geo.box_half_widths(c("latitude"))
    return t.venue.select("venue_id", F.round(dlat, 9).alias("dlat"), F.round(dlon, 9).alias("dlon"))


@check("geo03_nearest_city", """SELECT venue_id, CASE WHEN d2 < 0.25 THEN city_id END AS city_id FROM (SELECT v.venue_id, c.city_id, pow(c.latitude - v.latitude, 2) + pow(c.longitude - v.longitude, 2) AS d2,
    row_number() OVER (PARTITION BY v.venue_id ORDER BY (c.latitude - v.latitude) * (c.latitude - v.latitude) + (c.longitude - v.longitude) * (c.longitude - v.longitude), c.city_id) AS rn
    FROM d_venue v CROSS JOIN d_city c) WHERE rn = 1""")
def geo03(t):
    from ..operators.geography import nearest_city

    return t.venue.select("venue_id", "latitude", "longitude").join(nearest_city(t.venue, t.city), ["latitude", "longitude"], "left").select("venue_id", c("near_city_id").alias("city_id"))


@check("geo04_match_confidence", """SELECT booking_id, round_even(greatest(0e0, 1 - (booking_id % 150) / 1e2) * (0.5::DOUBLE + 0.5::DOUBLE * greatest(0e0, 1 - abs(booking_id % 400 - 180) / 180e0)), 3) AS conf FROM d_booking""")
def geo04(t):
    return t.booking.select("booking_id", geo.match_confidence((c("booking_id") % 150) / 100.0, c("booking_id") % 400 - 180, F.lit(180)).alias("conf"))


# ---- scores --------------------------------------------------------------------------------------------------------------------------------
@check("mth01_capacity_bands", f"SELECT venue_id, {band_sql('capacity')} AS factor FROM d_venue")
def mth01(t):
    return t.venue.select("venue_id", scoring.capacity_factor(c("capacity")).alias("factor"))


@check("mth02_venue_scale", """SELECT venue_id, round(f, 6) AS factor, CASE WHEN coalesce(capacity, 0) = 0 THEN name || ': capacity not published' ELSE
    (CASE WHEN f >= 0.8 THEN 'Major venue' WHEN f >= 0.6 THEN 'Large venue' WHEN f >= 0.4 THEN 'Mid-size venue' ELSE 'Small venue' END) || ' (' || name || ', capacity ' || format('{:,}', capacity::BIGINT) || ')' END AS label
    FROM (SELECT *, CASE WHEN coalesce(capacity, 0) = 0 THEN 0.3::DOUBLE ELSE least(1e0, 0.8::DOUBLE * """ + band_sql("capacity") + """ + 0.2::DOUBLE * importance_score) END AS f FROM d_venue)""")
def mth02(t):
    f = scoring.venue_scale(F.lit(True), c("capacity"), c("importance_score"))
    return t.venue.withColumn("f", f).select("venue_id", F.round("f", 6).alias("factor"), scoring.venue_reason(F.lit(True), c("name"), c("capacity"), c("f")).alias("label"))


@check("mth03_venue_importance", "SELECT venue_id, importance_score FROM d_venue")
def mth03(t):
    return t.venue.select("venue_id", "importance_score")


@check("mth04_transport", """SELECT venue_id, round_even((CASE WHEN s IS NULL THEN 0.5 ELSE least(1e0, (CASE WHEN s <= 0.5 THEN 0.35 WHEN s <= 1.5 THEN 0.55 WHEN s <= 3 THEN 0.8 ELSE 1.0 END::DOUBLE)
      + (CASE WHEN a <= 5 THEN 0.3 WHEN a <= 15 THEN 0.15 ELSE 0 END::DOUBLE)) END), 3) AS factor,
    CASE WHEN s IS NULL THEN 'Transport access unknown' ELSE (CASE WHEN s <= 0.5 THEN 'Strong rail connectivity' WHEN s <= 1.5 THEN 'Moderate rail access' ELSE 'Limited rail access — taxi reliant' END)
      || CASE WHEN a <= 15 THEN '; airport ' || round_even(a, 0)::INT || ' km' ELSE '' END END AS reason
    FROM (SELECT venue_id, station_distance_km AS s, coalesce(nullif(airport_distance_km, 0), 50) AS a FROM d_venue)""")
def mth04(t):
    return t.venue.select("venue_id", F.bround(scoring.transport_factor(c("station_distance_km"), c("airport_distance_km")), 3).alias("factor"),
                          scoring.transport_reason(c("station_distance_km"), c("airport_distance_km")).alias("reason"))


@check("mth05_attendance", "SELECT event_id, attendance_estimate, CASE WHEN attendance_estimate IS NOT NULL THEN CASE WHEN v_seeded THEN 'MEDIUM' ELSE 'LOW' END END AS confidence FROM d_factors")
def mth05(t):
    return t.scored_event.select("event_id", "attendance_estimate", c("attendance_confidence").alias("confidence"))


@check("mth06_timing", "SELECT event_id, k_timing FROM d_parts")
def mth06(t):
    return t.event.select("event_id", F.bround(scoring.timing_factor(c("date_start"), c("time_start"), c("time_end")) * 15.0, 1).alias("k_timing"))


@check("mth07_location", "SELECT event_id, k_location FROM d_parts")
def mth07(t):
    return t.scored_event.select("event_id", c("components.location").alias("k_location"))


@check("mth08_demand_score", """SELECT event_id, k_event_scale, k_venue_scale, k_timing, k_location, k_transport, k_category, k_tourism, k_duration, opportunity_score FROM d_scored""")
def mth08(t):
    return t.scored_event.select("event_id", *[c(f"components.{k}").alias(f"k_{k}") for k in scoring.COMPONENTS], "opportunity_score")


@check("mth09_levels", "SELECT event_id, demand_level, marketing_priority FROM d_scored")
def mth09(t):
    return t.scored_event.select("event_id", "demand_level", "marketing_priority")


@check("mth10_category_factor", "SELECT event_id, k_category FROM d_parts")
def mth10(t):
    return t.event.select("event_id", F.bround(scoring.category_factor(c("category")) * 10.0, 1).alias("k_category"))


@check("mth11_quality", "SELECT event_id, event_quality_score, quality_level FROM d_rated")
def mth11(t):
    return t.scored_event.select("event_id", "event_quality_score", "quality_level")


@check("mth12_best_confidence", """SELECT e.event_id, arg_max(e.source_confidence, CASE e.source_confidence WHEN 'OFFICIAL' THEN 4 WHEN 'CURATED' THEN 3 WHEN 'TRUSTED' THEN 3 WHEN 'SECONDARY' THEN 2 ELSE 1 END) AS kept,
    CASE WHEN (CASE any_value(n.incoming) WHEN 'OFFICIAL' THEN 4 WHEN 'CURATED' THEN 3 WHEN 'TRUSTED' THEN 3 WHEN 'SECONDARY' THEN 2 ELSE 1 END) >
      (CASE any_value(e.source_confidence) WHEN 'OFFICIAL' THEN 4 WHEN 'CURATED' THEN 3 WHEN 'TRUSTED' THEN 3 WHEN 'SECONDARY' THEN 2 ELSE 1 END) THEN any_value(n.incoming) ELSE any_value(e.source_confidence) END AS best
    FROM d_event e JOIN (SELECT event_id, (['UNVERIFIED','TRUSTED','OFFICIAL','SECONDARY','CURATED'])[(event_id % 5)::INT + 1] AS incoming FROM d_event) n USING (event_id) GROUP BY 1""")
def mth12(t):
    incoming = F.expr("element_at(array('UNVERIFIED','TRUSTED','OFFICIAL','SECONDARY','CURATED'), cast(pmod(event_id, 5) as int) + 1)")
    return t.event.select("event_id", c("source_confidence").alias("kept"), scoring.better_confidence(c("source_confidence"), incoming).alias("best"))


@check("mth13_status_engine", f"""SELECT event_id, CASE WHEN inc = 'CANCELLED' OR contains(tl, 'cancelled') OR contains(tl, 'called off') THEN 'CANCELLED' WHEN inc = 'POSTPONED' OR contains(tl, 'postponed') THEN 'POSTPONED'
      WHEN inc = 'RESCHEDULED' OR moved OR contains(tl, 'rescheduled') OR contains(tl, 'new date') THEN 'RESCHEDULED' WHEN status IN ('CANCELLED', 'POSTPONED') AND inc IN ('', 'SCHEDULED', 'UNKNOWN') THEN status
      WHEN sold OR inc = 'SOLD_OUT' THEN 'SOLD_OUT' WHEN date_start < {D} THEN 'COMPLETED' WHEN inc = 'CONFIRMED' AND source_confidence = 'OFFICIAL' THEN 'CONFIRMED' WHEN source_count >= 2 THEN 'CONFIRMED'
      WHEN status = 'CONFIRMED' THEN 'CONFIRMED' WHEN inc IN ('SCHEDULED', '', 'UNKNOWN') THEN 'SCHEDULED' ELSE inc END AS status FROM (
    SELECT *, (['SCHEDULED','','CONFIRMED','CANCELLED','POSTPONED','RESCHEDULED','SOLD_OUT','UNKNOWN','SCHEDULED','SCHEDULED','MOVED'])[(event_id % 11)::INT + 1] AS inc, event_id % 37 = 0 AS moved, event_id % 41 = 0 AS sold,
      lower(title || CASE event_id % 43 WHEN 0 THEN ' (CANCELLED)' WHEN 1 THEN ' - postponed' WHEN 2 THEN ' new date' ELSE '' END) AS tl FROM d_event)""")
def mth13(t):
    inc = F.expr("element_at(array('SCHEDULED','','CONFIRMED','CANCELLED','POSTPONED','RESCHEDULED','SOLD_OUT','UNKNOWN','SCHEDULED','SCHEDULED','MOVED'), cast(pmod(event_id, 11) as int) + 1)")
    title = F.expr("concat(title, case pmod(event_id, 43) when 0 then ' (CANCELLED)' when 1 then ' - postponed' when 2 then ' new date' else '' end)")
    st = scoring.derive_status(c("status"), inc, c("source_confidence"), title, F.expr("pmod(event_id, 41) = 0"), c("source_count"), c("date_start"), F.expr("pmod(event_id, 37) = 0"), fl.as_date(AS_OF))
    return t.event.select("event_id", st["status"].alias("status"))


@check("mth14_opportunity_score", "SELECT event_id, opportunity_type, k_demand, k_quality, k_freshness, k_area, score FROM d_opp")
def mth14(t):
    return t.opportunity().select("event_id", "opportunity_type", c("score_components.demand").alias("k_demand"), c("score_components.quality").alias("k_quality"),
                                  c("score_components.freshness").alias("k_freshness"), c("score_components.service_area").alias("k_area"), "score")


@check("mth15_reasons", """SELECT event_id, array_to_string(list_filter([
      CASE WHEN status IN ('CANCELLED', 'POSTPONED') THEN 'Event ' || lower(status) || ' — no demand expected' END,
      CASE WHEN coalesce(attendance_estimate, 0) <> 0 THEN 'Modelled attendance ≈ ' || format('{:,}', attendance_estimate::BIGINT) ELSE 'Attendance unknown (no published capacity)' END,
      CASE WHEN time_start IS NULL THEN 'Start time not yet confirmed' WHEN sh >= 17 THEN 'Evening event — late return journeys' WHEN sh >= 12 THEN 'Afternoon event' ELSE 'Morning start' END,
      CASE WHEN time_start IS NOT NULL AND eh >= 22 THEN 'Late finish after public transport thins out' END, CASE WHEN dow >= 6 THEN 'Weekend' WHEN dow = 5 THEN 'Friday' END,
      CASE WHEN c_name IS NULL THEN 'City unresolved' ELSE c_name || ' (priority ' || c_priority || ')' END, CASE WHEN c_name IS NOT NULL AND in_area THEN 'Inside taxi service area' END,
      'Category: ' || category, CASE WHEN coalesce(c_tourism, 0.2::DOUBLE) >= 0.7 THEN 'High-tourism city — hotel/airport transfers' END,
      CASE WHEN date_end > date_start THEN 'Multi-day event (' || (date_end - date_start + 1) || ' days)' WHEN time_start IS NOT NULL AND time_end IS NOT NULL THEN 'Duration ≈ ' || ((eh - sh + 24) % 24) || 'h'
        ELSE 'Typical ' || category || ' duration ≈ ' || CASE WHEN category IN ('arts', 'community') THEN '3' ELSE default_hours::VARCHAR END || 'h (modelled)' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM d_factors""")
def mth15(t):
    """All reasons but the venue and transport ones, which mth02 and mth04 check."""
    kept = F.filter("reasons", lambda x: ~x.rlike("^(?:Major|Large|Mid-size|Small) venue|^Venue unknown|: capacity not published$|^(?:Strong|Moderate|Limited) rail|^Transport access"))
    return iso(t.scored_event.select("event_id", kept.alias("reasons")))


@check("mth17_url_merge", f"""SELECT page_id, CASE WHEN {DEPTH} > 1 THEN url ELSE 'https://x.example/a' END AS merged FROM pages""")
def mth17(t):
    return t.table("pages").select("page_id", text.merge_url(c("url"), F.lit("https://x.example/a")).alias("merged"))


# ---- nested values -----------------------------------------------------------------------------------------------------------------------
@check("jsn01_nested_path", """SELECT event_id, coalesce(json_extract_string(props, '$.k'), '-1')::INT AS k, json_extract_string(props, '$.missing.deep') AS missing FROM events""")
def jsn01(t):
    return t.table("events").withColumn("v", F.try_parse_json("props")).select(
        "event_id", F.coalesce(F.try_variant_get("v", "$.k", "int"), F.lit(-1)).alias("k"), F.try_variant_get("v", "$.missing.deep", "string").alias("missing"))


@check("jsn02_polymorphic_field", "SELECT event_id, 'name-' || (event_id % 10) AS name FROM events")
def jsn02(t):
    from ..sources.html import _name_of, _plain

    doc = F.expr("""case pmod(event_id, 3) when 0 then concat('{"venue":{"name":"name-', cast(pmod(event_id, 10) as string), '"}}') when 1 then concat('{"venue":[{"name":"name-', cast(pmod(event_id, 10) as string), '"}]}')
        else concat('{"venue":"name-', cast(pmod(event_id, 10) as string), '"}') end""")
    v = c("v")
    return t.table("events").withColumn("v", F.try_parse_json(doc)).select("event_id", F.coalesce(_plain(v, "$.venue"), _name_of(v, "venue")).alias("name"))


@check("jsn03_alias_expansion", f"""SELECT key, min(city_id) AS city_id FROM (SELECT {name_sql('name')} AS key, city_id FROM d_city UNION ALL SELECT {name_sql('alias1')}, city_id FROM d_city) GROUP BY 1""")
def jsn03(t):
    from ..operators.geography import alias_index

    return alias_index(t.city, "city_id")


@check("jsn04_joined_facts", "SELECT event_id, reason AS facts FROM d_gate WHERE gate_failure IS NULL")
def jsn04(t):
    day = fl.as_date(AS_OF)
    ev = t.scored_between(0, 30)
    return ev.where(fl.gate_failure(day).isNull()).select("event_id", F.array_join(fl.gate_facts(day), "; ").alias("facts"))


@check("jsn05_distinct_sources", "SELECT event_id, count(DISTINCT source_id) + (CASE WHEN bool_or(source_id = 3) THEN 0 ELSE 1 END) AS n FROM d_link GROUP BY 1")
def jsn05(t):
    """Distinct sources of an event once source 3 lists it too; pairs are made distinct before counting."""
    both = t.event_source.select("event_id", "source_id").distinct()
    return both.groupBy("event_id").agg(F.count("*").alias("n"), F.max(c("source_id") == 3).alias("has")).select("event_id", (c("n") + F.when(c("has"), 0).otherwise(1)).alias("n"))


@check("jsn06_window_field", "SELECT event_id, coalesce(post_start, 'none') AS post_start FROM d_scored")
def jsn06(t):
    return t.scored_event.select("event_id", F.coalesce("windows.post_start", F.lit("none")).alias("post_start"))


@check("jsn07_flatten", """SELECT event_id, CASE WHEN v_name IS NOT NULL THEN venue_id END AS venue_id, v_name AS venue_name, '["' || category || '","' || subcategory || '"]' AS tags FROM d_placed""")
def jsn07(t):
    nested = t.with_places(t.event).select("event_id", F.struct(F.when(c("v_name").isNotNull(), c("venue_id")).alias("id"), c("v_name").alias("name")).alias("venue"), F.array("category", "subcategory").alias("tags"))
    return flatten(nested)


@check("jsn08_feature_record", """SELECT event_id, category AS event_type, subcategory AS event_subtype, opportunity_score AS event_score, event_quality_score AS quality_score, venue_capacity AS capacity, isodow(date_start) - 1 AS day_of_week,
    left(time_start, 2)::INT AS start_hour, isodow(date_start) >= 6 AS is_weekend, status, source_confidence FROM d_scored""")
def jsn08(t):
    from ..operators.bookings import features

    return features(t.scored_event).select("event_id", "event_type", "event_subtype", "event_score", "quality_score", "capacity", "day_of_week", "start_hour", "is_weekend", "status", "source_confidence")


@check("jsn09_map_merge", """SELECT event_id, 'collect=' || event_type || ',validate=' || CASE WHEN event_id % 2 = 0 THEN 'late' ELSE 'ok' END AS stages FROM events""")
def jsn09(t):
    from ..operators.upserts import merge_stages

    left = F.create_map(F.lit("collect"), c("event_type"), F.lit("validate"), F.lit("ok"))
    right = F.when(c("event_id") % 2 == 0, F.create_map(F.lit("validate"), F.lit("late"))).otherwise(F.from_json(F.lit("{}"), "map<string,string>"))
    m = merge_stages(left, right)
    return t.table("events").select("event_id", F.concat(F.lit("collect="), F.try_element_at(m, F.lit("collect")), F.lit(",validate="), F.try_element_at(m, F.lit("validate"))).alias("stages"))


@check("arr01_opportunity_fanout", "SELECT event_id, opportunity_type, score, demand_level, window_start, window_end, confidence FROM d_opp")
def arr01(t):
    return t.opportunity().select("event_id", "opportunity_type", "score", "demand_level", "window_start", "window_end", "confidence")


@check("arr02_action_fanout", "SELECT event_id, action_type, ordinal, title, priority, recommended_date, reason FROM d_action")
def arr02(t):
    return fanout.action_rows(t.scored_event, AS_OF).select("event_id", "action_type", "ordinal", "title", "priority", "recommended_date", "reason")


@check("arr03_two_legs", """SELECT booking_id, 'PICKUP' AS leg, round(pickup_lat, 6) AS lat, round(pickup_lon, 6) AS lon FROM d_booking
    UNION ALL SELECT booking_id, 'DROPOFF', round(dropoff_lat, 6), round(dropoff_lon, 6) FROM d_booking WHERE dropoff_lat IS NOT NULL""")
def arr03(t):
    return booking_legs(t.booking).select("booking_id", "leg", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@check("ups04_status_change_rows", """SELECT event_id, CASE WHEN new IN ('CANCELLED', 'POSTPONED') THEN new ELSE 'STATUS_CHANGED' END AS change_type, status AS old_value, new AS new_value FROM (
    SELECT event_id, status, (['SCHEDULED','CANCELLED','CONFIRMED','POSTPONED'])[(event_id % 4)::INT + 1] AS new FROM d_event) WHERE status <> new""")
def ups04(t):
    new = F.expr("element_at(array('SCHEDULED','CANCELLED','CONFIRMED','POSTPONED'), cast(pmod(event_id, 4) as int) + 1)")
    return t.event.select("event_id", status_change(c("status"), new).alias("x")).where("x IS NOT NULL").select("event_id", "x.change_type", "x.old_value", "x.new_value")


@check("udf03_unicode_accents", "SELECT doc_id, md5(strip_accents(text)) AS h FROM documents")
def udf03(t):
    return t.table("documents").select("doc_id", F.md5(text.strip_accents_any("text")).alias("h"))


@check("udf04_rules_as_data", f"SELECT event_id, {level_sql('event_id % 101')} AS level FROM events")
def udf04(t):
    """The level ladder generated from its rule table."""
    return t.table("events").select("event_id", scoring.ladder(c("event_id") % 101, V.DEMAND_LEVELS, F.lit("LOW")).alias("level"))


@check("udf05_external_hooks", """SELECT event_id, NULL::VARCHAR AS traffic, 'value ' || (event_id % 7) AS weather FROM d_event""")
def udf05(t):
    from ..operators.bookings import features

    weather = t.event.select("event_id", F.concat(F.lit("value "), (c("event_id") % 7).cast("string")).alias("weather"))
    ev = t.with_places(t.event).withColumns({"opportunity_score": F.lit(0), "event_quality_score": F.lit(0)})
    return features(ev, weather=weather).select("event_id", "traffic", "weather")
