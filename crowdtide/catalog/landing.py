"""Source parsers over payloads built from the tables (SRC) and the streaming fronts (STM)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import AREA
from ..operators import history
from ..session import scratch, shared_folder
from ..sources import feeds, html, payloads
from ..streaming import feeds as streams
from .registry import check
from .shape import iso

c = F.col
WHEN = "date_format(ts, \"yyyy-MM-dd'T'HH:mm\")"
WHEN_SQL = "strftime(ts, '%Y-%m-%d') AS date_start, strftime(ts, '%H:%M') AS time_start"


@check("src01_curated_records", f"SELECT 'c' || event_id AS external_id, 'Show ' || event_id AS title, {WHEN_SQL}, 'Hall ' || (event_id % 9) AS venue_name, CASE WHEN event_id % 5 = 0 THEN 'CANCELLED' ELSE 'SCHEDULED' END AS status FROM events WHERE event_id % 10 <> 7")
def src01(t):
    doc = """case when pmod(event_id, 10) = 7 then '{"not":"a list"}' else concat('[', to_json(named_struct('external_id', concat('c', cast(event_id as string)), 'title', concat('Show ', cast(event_id as string)), 'date_start', date_format(ts, 'dd/MM/yyyy'),
        'time_start', date_format(ts, 'HH:mm'), 'venue', concat('Hall ', cast(pmod(event_id, 9) as string)), 'status', case when pmod(event_id, 5) = 0 then 'CANCELLED' end)), ']') end value"""
    return iso(payloads.curated(t.table("events").selectExpr(doc)).select("external_id", "title", "date_start", "time_start", "venue_name", "status"))


LD = """concat(html, '<script type="application/ld+json">{"@graph":[{"@type":"MusicEvent","name":"Gig &amp; ', cast(page_id as string), '","startDate":"2027-03-01T19:30","endDate":"1970-01-01","location":{"name":"Arena","address":{"addressLocality":"Leeds","postalCode":"LS1 1AA"}},',
    '"offers":[{"url":"https://t.example/', cast(page_id as string), '","availability":"https://schema.org/SoldOut"}],"subEvent":{"@type":"Event","name":"Inner\\t', cast(page_id as string), '","startDate":"2027-07-02T18:30:00Z","location":"Room 1"}},{"@type":"Organization","name":"x"}]}</script>',
    '<script type="application/ld+json">{broken Event</script>')"""


def ld_items(t):
    pages = t.table("pages").select("page_id", c("url").alias("page_url"), F.expr(LD).alias("html"))
    return html.jsonld_events(pages)


DEEP = """concat('<script type="application/ld+json">', repeat('{"@type":"Festival","name":"around","subEvent":[', 39), '{"@type":["Thing","Festival"],"name":"core"}', repeat(']}', 39), '</script>')"""


@check("src07_jsonld_events", """SELECT page_id, k.name || CASE WHEN k.own THEN page_id::VARCHAR ELSE '' END AS name, k.start_date, k.n FROM pages,
    (VALUES ('Gig &amp; ', true, '2027-03-01T19:30', 1), ('Inner' || chr(9), true, '2027-07-02T18:30:00Z', 1), ('around', false, NULL, 39), ('core', false, NULL, 1)) k(name, own, start_date, n)""")
def src07(t):
    """Two events in a graph and forty inside each other on every page."""
    pages = t.table("pages").select("page_id", F.concat(F.expr(LD), F.expr(DEEP)).alias("html"))
    found = html.jsonld_events(pages)
    return found.groupBy("page_id", F.get_json_object("item", "$.name").alias("name"), F.get_json_object("item", "$.startDate").alias("start_date")).agg(F.count("*").alias("n"))


@check("src08_detail_links", r"""SELECT page_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(html, 'href=["'']([^"''#?]+)', 1), lambda h: regexp_matches(h, '^/[a-z]+$') OR starts_with(h, 'http')),
    lambda h: CASE WHEN starts_with(h, 'http') THEN h ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h END).list_filter(lambda u: regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) = regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)))), ' '), '') AS links FROM pages""")
def src08(t):
    return t.table("pages").select("page_id", F.array_join(html.detail_links(c("html"), c("url"), "^/[a-z]+$|^http"), " ").alias("links"))


@check("src09_schema_items", """SELECT page_id, k.title || page_id AS title, k.d AS date_start, k.t AS time_start, NULL::VARCHAR AS date_end, k.venue AS venue_name, k.city AS city_name, k.status, CASE WHEN k.status = 'SOLD_OUT' THEN 'https://t.example/' || page_id END AS ticket_url
    FROM pages, (VALUES ('Gig & ', '2027-03-01', '19:30', 'Arena', 'Leeds', 'SOLD_OUT'), ('Inner' || chr(9), '2027-07-02', '19:30', 'Room 1', NULL, 'SCHEDULED')) k(title, d, t, venue, city, status)""")
def src09(t):
    s = html.normalize_items(ld_items(t), "venue_pages")
    return iso(s.select(F.regexp_extract("title", r"(\d+)$", 1).cast("bigint").alias("page_id"), "title", "date_start", "time_start", "date_end", "venue_name", "city_name", "status", "ticket_url"))


def ics(t):
    text = """concat('BEGIN:VCALENDAR\\nBEGIN:VEVENT\\nUID:u', cast(event_id as string), '\\nDTSTART', case pmod(event_id, 3) when 0 then concat(';VALUE=DATE:', date_format(ts, 'yyyyMMdd')) when 1 then date_format(ts, "':'yyyyMMdd'T'HHmmss'Z'")
        else date_format(ts, "';TZID=Europe/London:'yyyyMMdd'T'HHmmss") end, '\\nSUMMARY:Talk\\\\, part ', cast(event_id as string), '\\nLOCATION:Room\\n  A\\nEND:VEVENT\\nBEGIN:VEVENT\\nUID:none\\nSUMMARY:No start\\nEND:VEVENT\\nEND:VCALENDAR') text"""
    return feeds.ical_items(t.table("events").selectExpr(text, "'https://f.example/cal' feed_url", "event_id", "'Leeds' feed_city"))


@check("src10_ical_items", "SELECT event_id, k.uid || CASE WHEN k.uid = 'u' THEN event_id::VARCHAR ELSE '' END AS uid, CASE WHEN k.uid = 'u' THEN 'Talk, part ' || event_id ELSE 'No start' END AS summary, CASE WHEN k.uid = 'u' THEN 'Room A' END AS location FROM events, (VALUES ('u'), ('none')) k(uid)")
def src10(t):
    return ics(t).select("event_id", "uid", "summary", "location")


@check("src11_ical_events", "SELECT 'Talk, part ' || event_id AS title, strftime(ts, '%Y-%m-%d') AS date_start, CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%H:%M') END AS time_start, substring(sha1('https://f.example/cal|u' || event_id), 1, 20) AS external_id, 'Leeds' AS city_name FROM events")
def src11(t):
    return iso(feeds.normalize_ical(ics(t)).select("title", "date_start", "time_start", "external_id", "city_name"))


def rss(t):
    text = """concat('<?xml version="1.0"?><rss><channel><item><title>Macbeth ', cast(event_id as string), ' | ', date_format(ts, 'd MMMM yyyy'), ' (', date_format(ts, 'HH:mm'), 'PM)</title><link>https://x.example/', cast(event_id as string), '</link><guid isPermaLink="false">g', cast(event_id as string),
        '</guid></item><item><title>News post</title><link>https://x.example/n</link></item></channel></rss>') text"""
    return feeds.rss_items(t.table("events").selectExpr(text, "'https://f.example/rss' feed_url", "event_id"))


@check("src12_rss_items", "SELECT event_id, k.guid || CASE WHEN k.guid = 'g' THEN event_id::VARCHAR ELSE '' END AS guid FROM events, (VALUES ('g'), ('https://x.example/n')) k(guid)")
def src12(t):
    return rss(t).select("event_id", "guid")


@check("src13_rss_events", f"SELECT 'Macbeth ' || event_id AS title, {WHEN_SQL}, 'https://x.example/' || event_id AS official_url FROM events")
def src13(t):
    return iso(feeds.normalize_rss(rss(t)).select("title", "date_start", "time_start", "official_url"))


@check("src14_fixtures", """SELECT 'Team ' || (event_id % 20) || ' v Team ' || (event_id % 17) AS title, strftime(ts, '%Y-%m-%d') AS date_start, nullif(strftime(ts, '%H:%M'), '00:00') AS time_start, CASE WHEN event_id % 4 = 0 THEN 'COMPLETED' ELSE 'SCHEDULED' END AS status
    FROM events WHERE event_id % 9 <> 0 AND (event_id % 2 = 0 OR user_id < (SELECT count(*) FROM customer))""")
def src14(t):
    m = t.table("events").selectExpr("cast(event_id as string) MatchNumber", "'1' RoundNumber", "date_format(ts, \"yyyy-MM-dd HH:mm:ss'Z'\") DateUtc", "concat('Customer#', lpad(cast(user_id as string), 9, '0')) Location",
                                     "case when pmod(event_id, 9) = 0 then 'To Be Announced' else concat('Team ', cast(pmod(event_id, 20) as string)) end HomeTeam", "concat('Team ', cast(pmod(event_id, 17) as string)) AwayTeam",
                                     "case when pmod(event_id, 4) = 0 then '2' end HomeTeamScore", "pmod(event_id, 2) = 1 uk_only", "'https://f.example' feed_url")
    return iso(payloads.fixtures(m, t.venue).select("title", "date_start", "time_start", "status"))


API_SQL = f"SELECT 'id' || event_id AS external_id, 'Gig ' || event_id AS title, {WHEN_SQL}, 'Arena' AS venue_name, 'Leeds' AS city_name, 'CANCELLED' AS status FROM events"


@check("src15_ticketing_payload", API_SQL)
def src15(t):
    doc = """concat('{"_embedded":{"events":[{"id":"id', cast(event_id as string), '","name":"Gig ', cast(event_id as string), '","dates":{"start":{"localDate":"', date_format(ts, 'yyyy-MM-dd'), '","localTime":"', date_format(ts, 'HH:mm:ss'),
        '"},"status":{"code":"cancelled"}},"_embedded":{"venues":[{"name":"Arena","city":{"name":"Leeds"}}]}}]}}') value"""
    return iso(payloads.ticketing(t.table("events").selectExpr(doc)).select("external_id", "title", "date_start", "time_start", "venue_name", "city_name", "status"))


@check("src16_organiser_payload", API_SQL)
def src16(t):
    one = f"""concat('{{"id":"id', cast(event_id as string), '","name":{{"text":"Gig ', cast(event_id as string), '"}},"status":"canceled","start":{{"local":"', {WHEN}, '"}},"venue":{{"name":"Arena","address":{{"city":"Leeds"}}}}}}')"""
    doc = f"case when pmod(event_id, 2) = 0 then {one} else concat('{{\"events\":[', {one}, ']}}') end value"
    return iso(payloads.organiser(t.table("events").selectExpr(doc)).select("external_id", "title", "date_start", "time_start", "venue_name", "city_name", "status"))


@check("src17_music_payload", API_SQL)
def src17(t):
    doc = f"""concat('{{"events":[{{"identifier":"id', cast(event_id as string), '","name":"Gig ', cast(event_id as string), '","startDate":"', {WHEN}, '","eventStatus":"cancelled","location":{{"name":"Arena","address":{{"addressLocality":"Leeds"}}}}}}]}}') value"""
    return iso(payloads.music(t.table("events").selectExpr(doc)).select("external_id", "title", "date_start", "time_start", "venue_name", "city_name", "status"))


@check("src18_feed_fallback", "SELECT user_id AS target, event_id FROM (SELECT *, min(k) OVER (PARTITION BY user_id) AS best FROM (SELECT *, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS k FROM events)) WHERE k = best")
def src18(t):
    rows = t.table("events").selectExpr("user_id target", "event_id", "case event_type when 'signup' then 1 when 'purchase' then 2 when 'click' then 3 else 4 end kind_rank")
    return history.feed_fallback(rows).select("target", "event_id")


@check("src19_first_per_target", "SELECT user_id AS target, event_type AS external_id, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def src19(t):
    rows = t.table("events").selectExpr("user_id target", "event_type external_id", "event_id")
    return history.first_per_key(rows, ["target", "external_id"], ["event_id"])


@check("src20_registry_seed", "SELECT 'venue' AS kind, count(*) AS n FROM (SELECT DISTINCT c_name FROM customer) UNION ALL SELECT 'city', count(*) FROM nation UNION ALL SELECT 'region', count(DISTINCT n_regionkey) FROM nation")
def src20(t):
    from ..sources.files import seed_dimensions

    cities = t.table("nation").selectExpr("n_name name", "cast(n_regionkey as string) region", "cast(null as string) country", "50.0D latitude", "1.0D longitude", "1L population", "'x' population_source", "50 priority", "0.5D tourism", "cast(null as array<string>) aliases")
    venues = t.venue.selectExpr("name", "aliases", "'NATION_1' city", "postcode", "latitude", "longitude", "capacity", "capacity_source", "venue_type", "station_distance_km", "airport_distance_km")
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in seed_dimensions(cities, venues).items()]
    return parts[0].union(parts[1]).union(parts[2])


PROFILED = """case pmod(page_id, 5) when 0 then concat('BEGIN:VCALENDAR', repeat('\\nBEGIN:VEVENT\\nEND:VEVENT', cast(pmod(page_id, 4) as int)), '\\nEND:VCALENDAR')
    when 1 then concat("<?xml version='1.0'?><rss><channel>", repeat('<item></item><entry/>', cast(pmod(page_id, 3) as int)), '</channel></rss>')
    when 2 then concat('<script type="application/ld+json">{"other":{"list":[', repeat('{"@type":"SportsEvent","startDate":"2027-01-01","x":{"@type":"Event","name":"no date"}},', cast(pmod(page_id, 3) as int)), '{"@type":["Thing","BusinessEvent"],"startDate":"d"}]}}</script>')
    when 3 then '<link rel="alternate" type="application/rss+xml" href="/feed">' else html end"""


@check("src22_page_profile", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'ICS' WHEN 1 THEN 'RSS' WHEN 2 THEN 'JSONLD' WHEN 3 THEN 'HAS_FEED_LINK' ELSE CASE WHEN regexp_matches(html, '(?i)href=["''][^"'']+\\.ics') THEN 'HAS_FEED_LINK' ELSE 'HTML_ONLY' END END AS kind,
    (CASE page_id % 5 WHEN 0 THEN page_id % 4 WHEN 1 THEN 2 * (page_id % 3) WHEN 2 THEN page_id % 3 + 1 ELSE 0 END)::INT AS n_items,
    CASE page_id % 5 WHEN 3 THEN 1 WHEN 4 THEN len(list_distinct(regexp_extract_all(html, 'href=["'']([^"''#?]+)', 1))) ELSE 0 END AS n_links FROM pages""".replace("\\\\", "\\"))
def src22(t):
    """Four pages in five are a calendar, a feed, nested markup under unknown keys or a link to a feed; the fifth is as it was landed."""
    return html.page_profile(t.table("pages").select("page_id", F.expr(PROFILED).alias("html"))).select("page_id", "kind", "n_items", "n_links")


@check("src24_source_selection", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND lower('NATION_' || (user_id % 25)) = 'nation_3'")
def src24(t):
    landing = t.table("events").selectExpr("event_id", "event_type source_key", "concat('NATION_', cast(pmod(user_id, 25) as string)) target_city")
    return payloads.select_landed(landing, only=["click", "view"], city=AREA[2]).select("event_id")


@check("udf01_parser_registry", "SELECT 'eventbrite' AS source_key, count(*) AS n FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'jambase', count(*) FROM events WHERE event_id % 2 = 1")
def udf01(t):
    doc = f"""case when pmod(event_id, 2) = 0 then concat('{{"id":"', cast(event_id as string), '","start":{{"local":"', {WHEN}, '"}}}}') else concat('{{"events":[{{"identifier":"', cast(event_id as string), '","startDate":"', {WHEN}, '"}}]}}') end value"""
    landing = t.table("events").selectExpr("case when pmod(event_id, 2) = 0 then 'eventbrite' else 'jambase' end source_key", doc)
    return payloads.parse_landed(landing).groupBy("source_key").agg(F.count("*").alias("n"))


# ---- streams: all files of the table, run to completion ----------------------------------------------------------------------------------------
def stream_of(t, name: str):
    schema = t.table(name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def run(t, df, name: str, columns: str):
    import uuid

    base = f"{shared_folder(t.spark)}/stream_{name}_{uuid.uuid4().hex}"
    streams.run_available(df, f"{base}/out", f"{base}/state")
    return t.spark.read.schema(columns).parquet(f"{base}/out")


@check("stm01_incremental_landing", "SELECT user_id::VARCHAR AS source_key, event_type AS external_id, min(event_id) AS first_event FROM events GROUP BY ALL")
def stm01(t):
    """The log lands twice, the second time in a stream that has no memory of the first: the stored keys alone keep it out."""
    base = scratch(t.spark, "stm01")
    landed = stream_of(t, "events").selectExpr("cast(user_id as string) source_key", "event_type external_id", "'h' hash", "event_id ordinal", "cast(ts as timestamp) fetched_at")
    for k in (0, 1):
        streams.land_into(landed, f"{base}/raw", f"{base}/state{k}", first_batch=1000 * k)
    return t.spark.read.schema("source_key string, external_id string, ordinal bigint").parquet(f"{base}/raw").select("source_key", "external_id", c("ordinal").alias("first_event"))


SILENT_DAYS = 2


@check("stm03_silent_sources", f"""WITH w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events), seen AS (SELECT user_id, date_trunc('hour', ts) AS h, epoch_us(min(ts)) // 1000 AS first, epoch_us(max(ts)) // 1000 AS last FROM events, w GROUP BY ALL HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= any_value(mark)),
    gaps AS (SELECT user_id, last, lead(first) OVER (PARTITION BY user_id ORDER BY h) AS next FROM seen)
    SELECT user_id::VARCHAR AS source_key, last AS last_seen_ms FROM gaps, w WHERE coalesce(next - last > {SILENT_DAYS} * 86400000, last + {SILENT_DAYS} * 86400000 <= epoch_us(mark) // 1000)""")
def stm03(t):
    """Every silence of more than two days in the log, up to the watermark."""
    base = scratch(t.spark, "stm03")
    seen = stream_of(t, "events").selectExpr("cast(user_id as string) source_key", "cast(ts as timestamp) seen_at")
    streams.run_silence(seen, f"{base}/out", f"{base}/state", days=SILENT_DAYS)
    return t.spark.read.schema("source_key string, last_seen_ms bigint").parquet(f"{base}/out")


@check("stm04_booking_match", "SELECT event_id, booking_id, leg, time_delta_min FROM d_match")
def stm04(t):
    lat = "50 + pmod(user_id, 500) / 100.0D + (pmod(event_id, 7) - 3) * 0.002D"
    lon = "-3 + pmod(user_id * 7, 500) / 100.0D + (pmod(event_id, 5) - 2) * 0.003D"
    bookings = stream_of(t, "events").selectExpr("event_id booking_id", "ts pickup_datetime", f"{lat} pickup_lat", f"{lon} pickup_lon", f"case when pmod(event_id, 2) = 0 then {lat} + 0.001D end dropoff_lat", f"case when pmod(event_id, 2) = 0 then {lon} + 0.001D end dropoff_lon")
    return run(t, streams.match_stream(bookings, t.booking_event), "stm04", "event_id bigint, booking_id bigint, leg string, time_delta_min int")


