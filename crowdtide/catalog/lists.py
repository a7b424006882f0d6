"""Filters, sorted lists, views and exports over the event tables (FLT, SRT, PRJ, SNK)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..bindings import AREA, AS_OF, log_now
from ..functions.dates import within_days
from ..operators import filters as fl
from ..operators import views
from ..operators.bookings import list_best_matches
from ..plans import reports
from ..session import cut_lineage
from ..sources import sinks
from . import figures as fg
from .oracle_tables import AS_OF as D
from .oracle_tables import LOG_NOW, name_sql
from .registry import check
from .shape import iso

c = F.col
ACTIVE = "('SCHEDULED', 'RESCHEDULED', 'CONFIRMED', 'SOLD_OUT')"
LIST = ["event_id", "title", "category", "date_start", "time_start", "status", "opportunity_score", "demand_level", "quality_level"]
LIST_SQL = "event_id, title, category, date_start::VARCHAR AS date_start, time_start, status, opportunity_score, demand_level, quality_level"


def brief(df, *extra):
    return iso(df.select(*LIST, *extra))


# ---- filters -----------------------------------------------------------------------------------------------------------------
@check("flt01_composable_filters", f"""SELECT {LIST_SQL}, c_name, r_name FROM d_scored WHERE date_start BETWEEN {D} AND {D} + 30 AND category = 'music'
    AND r_name = 'ASIA' AND demand_level IN ('HIGH', 'MEDIUM', 'MODERATE') AND opportunity_score >= 40 AND quality_level IN ('HIGH', 'MEDIUM')
    AND source_confidence IN ('OFFICIAL', 'TRUSTED', 'CURATED') AND subcategory = 'concert'""")
def flt01(t):
    return brief(fl.filter_events(t.scored_between(0, 30), AS_OF, range_="30d", category="music", region="ASIA", demand="high, medium,moderate", min_score=40,
                                  quality="HIGH,MEDIUM", confidence="OFFICIAL,TRUSTED,CURATED", subcategory="concert"), "c_name", "r_name")


def _overlap(day: str) -> str:
    return f"date_start <= {day} AND coalesce(date_end, date_start) >= {day}"


@check("flt02_date_presets", f"""SELECT 'today' AS preset, event_id FROM d_event WHERE {_overlap(D)}
    UNION ALL SELECT 'tomorrow', event_id FROM d_event WHERE {_overlap(f'({D} + 1)')}
    UNION ALL SELECT '7d', event_id FROM d_event WHERE date_start BETWEEN {D} AND {D} + 7
    UNION ALL SELECT '30d', event_id FROM d_event WHERE date_start BETWEEN {D} AND {D} + 30""")
def flt02(t):
    day = fl.as_date(AS_OF)
    presets = F.array_compact(F.array(*[F.when(fl.in_range(p, day), F.lit(p)) for p in ("today", "tomorrow", "7d", "30d")]))
    return t.event_touching(30).select(F.explode(presets).alias("preset"), "event_id")


@check("flt03_default_horizon", f"SELECT category, count(*) AS n FROM d_event WHERE date_start >= {D} GROUP BY 1")
def flt03(t):
    return fl.default_horizon(t.event_between(0), AS_OF).groupBy("category").agg(F.count("*").alias("n"))


@check("flt04_multi_value", f"SELECT {LIST_SQL} FROM d_scored WHERE demand_level IN ('VERY_HIGH', 'HIGH') AND quality_level IN ('HIGH', 'LOW') AND date_start >= {D}")
def flt04(t):
    return brief(fl.filter_events(t.scored_between(0), AS_OF, date_from=AS_OF, demand=" very_high , high", quality="high,low"))


@check("flt05_text_search", f"""SELECT event_id, title, venue_name_raw, v_name FROM d_placed WHERE date_start >= {D}
    AND (title ILIKE '%playhouse 7%' OR city_name_raw ILIKE '%playhouse 7%' OR venue_name_raw ILIKE '%playhouse 7%' OR v_name ILIKE '%playhouse 7%')""")
def flt05(t):
    return fl.filter_events(t.with_places(t.event_between(0)), AS_OF, date_from=AS_OF, q="Playhouse 7").select("event_id", "title", "venue_name_raw", "v_name")


@check("flt06_missing_fields", """SELECT event_id FROM d_placed WHERE time_start IS NULL AND venue_id IS NULL AND official_url IS NULL AND ticket_url IS NULL AND latitude IS NULL
    UNION ALL SELECT -event_id FROM d_placed WHERE venue_capacity IS NULL AND time_start IS NULL""")
def flt06(t):
    ev = t.with_places(t.event)
    a = fl.filter_events(ev, AS_OF, missing="time, venue,official_url,coordinates").select("event_id")
    return a.union(fl.filter_events(ev, AS_OF, missing="capacity,time").select(-F.col("event_id")))


@check("flt07_resolved_or_raw_city", "SELECT event_id, c_name, city_name_raw FROM d_placed WHERE c_name = 'NATION_4' OR city_name_raw = 'NATION_4'")
def flt07(t):
    return fl.filter_events(t.with_places(t.event), AS_OF, city="NATION_4").select("event_id", "c_name", "city_name_raw")


@check("flt08_active_status", f"SELECT status, count(*) AS n FROM d_event WHERE status IN {ACTIVE} GROUP BY 1")
def flt08(t):
    return t.event.where(fl.active()).groupBy("status").agg(F.count("*").alias("n"))


@check("flt09_calendar_overlap", """SELECT event_id, date_start::VARCHAR AS date_start, date_end::VARCHAR AS date_end FROM d_event
    WHERE date_start <= DATE '1998-07-03' AND coalesce(date_end, date_start) >= DATE '1998-06-28'""")
def flt09(t):
    return iso(fl.calendar(t.event_between(days_ahead=18), dt.date(1998, 6, 28), dt.date(1998, 7, 3)).select("event_id", "date_start", "date_end"))


@check("flt10_map_points", f"""SELECT event_id, title, latitude, longitude, opportunity_score, coalesce(v_name, venue_name_raw) AS venue FROM d_scored
    WHERE date_start BETWEEN {D} AND {D} + 30 AND status IN {ACTIVE} AND latitude IS NOT NULL AND opportunity_score >= 50""")
def flt10(t):
    return fl.map_points(t.scored_between(0, 30), AS_OF, 30, 50).select("event_id", "title", "latitude", "longitude", "opportunity_score", F.coalesce("v_name", "venue_name_raw").alias("venue"))


PATTERNS = ["circus", "gallery opening 1"]


@check("flt11_validation", f"""SELECT event_id, array_to_string(list_filter([
      CASE WHEN length(trim(title)) < 3 THEN 'title_too_short' END, CASE WHEN event_id % 31 = 0 THEN 'missing_external_id' END,
      CASE WHEN date_start < {D} - 2 THEN 'event_in_past' END, CASE WHEN date_start > {D} + 400 THEN 'event_too_far_future' END,
      CASE WHEN date_end < date_start THEN 'end_before_start' END, CASE WHEN venue_name_raw IS NULL AND city_name_raw IS NULL AND (latitude IS NULL OR longitude IS NULL OR latitude = 0 OR longitude = 0) THEN 'no_location' END,
      CASE WHEN lower(title) LIKE '%circus%' OR lower(title) LIKE '%gallery opening 1%' THEN 'non_event_title' END], lambda x: x IS NOT NULL), '; ') AS problems FROM d_event""")
def flt11(t):
    staged = t.event.withColumns({"external_id": F.expr("case when pmod(event_id, 31) = 0 then '' else cast(event_id as string) end"),
                                  "venue_name": F.col("venue_name_raw"), "city_name": F.col("city_name_raw")})
    return iso(staged.select("event_id", fl.validation_problems(fl.as_date(AS_OF), PATTERNS).alias("problems")))


@check("flt12_non_event_titles", """SELECT doc_id, lower(text) LIKE '%the%deposit%' OR contains(lower(text), 'car park') OR contains(lower(text), 'pre-order') OR contains(lower(text), 'refundable')
    OR contains(lower(text), 'deposit') OR contains(lower(text), 'membership') OR contains(lower(text), 'parking') OR contains(lower(text), 'donation') OR contains(lower(text), 'gift card')
    OR contains(lower(text), 'gift voucher') OR contains(lower(text), 'secret seats') OR contains(lower(text), 'season announcement') OR contains(lower(text), 'to be announced v')
    OR contains(lower(text), 'v to be announced') OR contains(lower(text), 'tbc v tbc') AS rejected FROM documents""")
def flt12(t):
    from ..functions.text import non_event_title

    return t.table("documents").select("doc_id", non_event_title(F.col("text")).alias("rejected"))


@check("flt13_action_gate", "SELECT event_id, gate_failure, CASE WHEN gate_failure IS NULL THEN reason END AS facts FROM d_gate")
def flt13(t):
    day = fl.as_date(AS_OF)
    failure = fl.gate_failure(day)
    return t.scored_event.select("event_id", failure.alias("gate_failure"), F.when(failure.isNull(), F.array_join(fl.gate_facts(day), "; ")).alias("facts"))


@check("flt14_service_area", "SELECT in_area, c_name, count(*) AS n FROM d_placed GROUP BY ALL")
def flt14(t):
    return fl.mark_service_area(t.with_places(t.event), AREA).groupBy("in_area", "c_name").agg(F.count("*").alias("n"))


@check("flt15_action_search", f"""SELECT action_id, title, event_title FROM d_action WHERE date_start BETWEEN {D} AND {D} + 14 AND action_status IN ('NEW', 'PLANNED', 'SCHEDULED', 'IN_PROGRESS')
    AND (title ILIKE '%united%' OR event_title ILIKE '%united%' OR venue_name_raw ILIKE '%united%')""")
def flt15(t):
    ev = t.scored_between(0, 30)
    return fl.action_feed(t.action(ev), ev, AS_OF, q="united").select("action_id", "title", "event_title")


@check("flt16_prefix_match", "SELECT event_id FROM d_event WHERE status_reason LIKE 'SOURCE SILENT%'")
def flt16(t):
    return t.event.where(F.startswith("status_reason", F.lit("SOURCE SILENT"))).select("event_id")


@check("flt17_operator_list", f"""SELECT {LIST_SQL} FROM d_scored WHERE date_start BETWEEN {D} AND {D} + 60 AND city_name_raw ILIKE '%nation_1%' AND category = 'sports' AND opportunity_score >= 30
    ORDER BY opportunity_score DESC, d_scored.date_start, event_id LIMIT 40""")
def flt17(t):
    return brief(fl.operator_list(t.scored_between(0, 60), AS_OF, 60, "nation_1", "sports", 30, 40))


def _canned_sql() -> str:
    conds = {"today": f"date_start = {D}", "tomorrow": f"date_start = {D} + 1", "week": f"date_start BETWEEN {D} AND {D} + 7",
             "high": f"date_start >= {D} AND demand_level IN ('HIGH', 'VERY_HIGH')", "concerts": f"date_start >= {D} AND category = 'music'",
             "sports": f"date_start >= {D} AND category = 'sports'", "education": f"date_start >= {D} AND category = 'education'"}
    parts = [f"(SELECT '{k}' AS listing, event_id, opportunity_score FROM d_scored WHERE status IN ('SCHEDULED', 'RESCHEDULED') AND {v} ORDER BY opportunity_score DESC, event_id LIMIT 10)"
             for k, v in conds.items()]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ")"


@check("flt18_canned_listings", _canned_sql())
def flt18(t):
    return reports.canned_listings(t.scored_between(0), AS_OF).select("listing", "event_id", "opportunity_score")


# ---- sorts and pages -----------------------------------------------------------------------------------------------------------
def _sorted_sql(order: str, size: int = 25, offset: int = 0) -> str:
    return f"SELECT event_id FROM d_scored WHERE date_start >= {D} ORDER BY {order}, event_id LIMIT {size} OFFSET {offset}"


@check("srt01_event_sorts", "SELECT * FROM (" + " UNION ALL ".join(f"(SELECT '{k}' AS sort, event_id FROM ({_sorted_sql(v)}))" for k, v in {
    "score": "opportunity_score DESC, date_start", "date": "date_start, time_start NULLS FIRST", "updated": "last_verified_at DESC",
    "quality": "event_quality_score DESC, opportunity_score DESC"}.items()) + ")")
def srt01(t):
    ev = cut_lineage(t.scored_between(0))
    parts = [fl.list_events(ev, AS_OF, sort=s, size=25).select(F.lit(s).alias("sort"), "event_id") for s in ("score", "date", "updated", "quality")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@check("srt02_action_sorts", "SELECT * FROM (" + " UNION ALL ".join(f"(SELECT '{k}' AS sort, action_id FROM d_action ORDER BY {v}, action_id LIMIT 20)" for k, v in {
    "priority": "priority, date_start, opportunity_score DESC", "date": "date_start", "score": "opportunity_score DESC", "created": "created_at DESC"}.items()) + ")")
def srt02(t):
    ev = t.scored_between(0, 30)
    feed = fl.action_feed(t.action(ev), ev, AS_OF, days=30, status=None)
    parts = [fl.page(feed, o(), ["action_id"], 1, 20).select(F.lit(k).alias("sort"), "action_id") for k, o in fl.ACTION_SORTS.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@check("srt03_page_and_total", f"""SELECT p.event_id, n.total FROM ({_sorted_sql('opportunity_score DESC, date_start', 50, 100)}) p,
    (SELECT count(*) AS total FROM d_scored WHERE date_start >= {D}) n""")
def srt03(t):
    ev = t.scored_between(0)
    total = fl.count_events(t.event_between(0), AS_OF).withColumn("_k", F.lit(1))
    return fl.list_events(ev, AS_OF, number=3, size=50).select("event_id").withColumn("_k", F.lit(1)).join(total, "_k").drop("_k")


TOP_SQL = f"""SELECT event_id, title, date_start::VARCHAR AS date_start, time_start, v_name AS venue, c_name AS city, r_name AS region, opportunity_score, demand_level
    FROM d_scored WHERE date_start BETWEEN {D} AND {D} + 7 AND status IN {ACTIVE} ORDER BY opportunity_score DESC, d_scored.date_start, event_id LIMIT 20"""


@check("srt04_top_events", TOP_SQL)
def srt04(t):
    top = reports.top_events(t.scored_between(0, 7), AS_OF, 7, 20)
    return iso(top.select("event_id", "title", "date_start", "time_start", F.col("v_name").alias("venue"), F.col("c_name").alias("city"), F.col("r_name").alias("region"),
                          "opportunity_score", "demand_level"))


@check("srt05_service_area_top", f"""SELECT event_id, c_name, opportunity_score, quality_level FROM d_scored WHERE date_start BETWEEN {D} AND {D} + 30 AND status IN {ACTIVE} AND in_area
    AND c_name IS NOT NULL AND quality_level IN ('HIGH', 'MEDIUM') ORDER BY opportunity_score DESC, date_start, event_id LIMIT 10""")
def srt05(t):
    return reports.service_area_top(t.scored_between(0, 30), AS_OF, 30, 10).select("event_id", "c_name", "opportunity_score", "quality_level")


@check("srt06_venues_nulls_last", f"""SELECT venue_id, capacity, coalesce(n, 0) AS upcoming_events FROM d_venue LEFT JOIN (SELECT venue_id, count(*) AS n FROM d_event WHERE date_start >= {D} GROUP BY 1) USING (venue_id)
    ORDER BY coalesce(n, 0) DESC, capacity DESC NULLS LAST, venue_id LIMIT 100""")
def srt06(t):
    n = reports.dimension_counts(t.venue.select("venue_id", "capacity"), t.event_between(0), "venue_id", AS_OF)
    return n.orderBy(F.desc("upcoming_events"), F.desc_nulls_last("capacity"), "venue_id").limit(100)


@check("srt07_correlations_page", "SELECT event_id, booking_id, leg, match_confidence FROM d_match ORDER BY match_confidence DESC, event_id, booking_id, leg LIMIT 50 OFFSET 50")
def srt07(t):
    return list_best_matches(t.booking_event, t.booking, number=2).select("event_id", "booking_id", "leg", "match_confidence")


@check("srt08_changes_feed", f"""SELECT change_id, event_id, change_type, strftime(detected_at, '%Y-%m-%d %H:%M:%S') AS detected_at FROM d_change
    WHERE detected_at >= {LOG_NOW} - INTERVAL 7 DAY AND change_type = 'TIME_CHANGED' ORDER BY d_change.detected_at DESC, change_id LIMIT 100""")
def srt08(t):
    feed = fl.recent_changes(t.event_change, log_now(), 7, "time_changed")
    return iso(fl.page(feed, [F.desc("detected_at")], ["change_id"], 1, 100).select("change_id", "event_id", "change_type", "detected_at"))


@check("srt09_opportunity_feed", f"""SELECT o.event_id, o.opportunity_type, o.score, e.title FROM d_opp o JOIN d_event e USING (event_id) WHERE e.date_start BETWEEN {D} AND {D} + 7 AND e.status IN {ACTIVE}
    AND o.demand_level IN ('HIGH', 'MEDIUM', 'VERY_HIGH') AND o.opportunity_type = 'VENUE_TO_HOME' ORDER BY o.score DESC, e.date_start, o.event_id LIMIT 50""")
def srt09(t):
    ev = t.scored_between(0, 7)
    feed = fl.opportunity_feed(t.opportunity(ev), ev, AS_OF, 7, demand="high,medium,very_high", opportunity_type="venue_to_home")
    return fl.page(feed, [F.desc("score"), F.asc("date_start")], ["event_id"]).select("event_id", "opportunity_type", "score", "title")


@check("srt10_action_feed", f"""SELECT action_id, action_type, priority, action_status AS status, title FROM d_action WHERE date_start BETWEEN {D} AND {D} + 14 AND action_status IN ('NEW', 'PLANNED')
    AND action_type IN ('SEO', 'META_ADS') ORDER BY priority, date_start, opportunity_score DESC, action_id LIMIT 100""")
def srt10(t):
    ev = t.scored_between(0, 14)
    feed = fl.action_feed(t.action(ev), ev, AS_OF, 14, status="new,planned", action_type="seo, meta_ads")
    return fl.page(feed, fl.ACTION_SORTS["priority"](), ["action_id"], 1, 100).select("action_id", "action_type", "priority", "status", "title")


@check("srt11_source_drilldown", f"""SELECT 'event' AS kind, event_id AS id FROM (SELECT DISTINCT e.event_id, e.date_start FROM d_event e JOIN d_link USING (event_id) WHERE source_id = 3 ORDER BY e.date_start, e.event_id LIMIT 50)
    UNION ALL SELECT 'run', run_id FROM (SELECT run_id FROM d_run WHERE source_id = 3 ORDER BY run_id DESC LIMIT 30)""")
def srt11(t):
    linked = t.event_source.where("source_id = 3").select("event_id")
    ev = t.event.join(linked, "event_id", "left_semi").orderBy("date_start", "event_id").limit(50).select(F.lit("event").alias("kind"), F.col("event_id").alias("id"))
    runs = t.source_run.where("source_id = 3").orderBy(F.desc("run_id")).limit(30).select(F.lit("run").alias("kind"), F.col("run_id").alias("id"))
    return ev.union(runs)


@check("srt12_snapshot_history", "SELECT snapshot_id, reason, snapshot_hash FROM d_snap WHERE event_id = 12 ORDER BY snapshot_id DESC LIMIT 20")
def srt12(t):
    return t.snapshot.where("event_id = 12").orderBy(F.desc("snapshot_id")).limit(20).select("snapshot_id", "reason", "snapshot_hash")


# ---- views -----------------------------------------------------------------------------------------------------------------------
@check("prj01_event_summary", """SELECT event_id, title, CASE WHEN v_name IS NOT NULL THEN venue_id END AS venue_id, coalesce(v_name, venue_name_raw) AS venue_name, v_capacity AS venue_capacity,
    coalesce(c_name, city_name_raw) AS city, r_name AS region, opportunity_score, demand_level, marketing_priority, event_quality_score, quality_level, freshness_score FROM d_scored""")
def prj01(t):
    s = views.flatten(views.event_summary(t.scored_event).select("event_id", "title", "venue", "city", "region", "opportunity_score", "demand_level", "marketing_priority",
                                                                  "event_quality_score", "quality_level", "freshness_score"))
    return s


@check("prj02_event_detail", """SELECT e.event_id, coalesce(o.n, 0) AS n_opportunities, o.best, coalesce(a.n, 0) AS n_actions FROM d_scored e
    LEFT JOIN (SELECT event_id, count(*) AS n, max(score) AS best FROM d_opp GROUP BY 1) o USING (event_id) LEFT JOIN (SELECT event_id, count(*) AS n FROM d_action GROUP BY 1) a USING (event_id)""")
def prj02(t):
    ev = t.scored_event
    d = views.event_detail(ev, ev, t.opportunity(ev), t.action(ev), t.event_change, t.event_source)["detail"]
    return d.select("event_id", F.coalesce(F.size("opportunities"), F.lit(0)).alias("n_opportunities"), F.get("opportunities.score", F.lit(0)).alias("best"),
                    F.coalesce(F.size("marketing_actions"), F.lit(0)).alias("n_actions"))


@check("prj03_provenance_split", """SELECT e.event_id, e.title, coalesce(e.c_name, e.city_name_raw) AS city, e.opportunity_score, coalesce(a.n, 0) AS shown_actions FROM d_scored e
    LEFT JOIN (SELECT event_id, count(*) FILTER (action_status <> 'DISMISSED_AUTO') AS n FROM d_action GROUP BY 1) a USING (event_id) WHERE e.event_id IN (SELECT event_id FROM d_action)""")
def prj03(t):
    ev = t.scored_between(0, 30)
    acts = t.action(ev)
    d = views.event_detail(acts, ev, t.opportunity(ev), acts, t.event_change, t.event_source)["detail"]
    return d.select("event_id", "facts.title", "facts.city", "modelled.opportunity_score", F.coalesce(F.size("recommendations.marketing_actions"), F.lit(0)).alias("shown_actions"))


@check("prj04_child_rows", f"""SELECT c.change_id, c.change_type, c.new_value, e.title, coalesce(e.c_name, e.city_name_raw) AS city FROM d_change c LEFT JOIN d_placed e USING (event_id)""")
def prj04(t):
    v = views.change_view(t.event_change, t.with_places(t.event))
    return v.select("change_id", "change_type", "new_value", "event.title", "event.city")


@check("prj05_venue_view", """SELECT v.venue_id, v.name, c.name AS city, v.postcode, v.capacity, v.venue_type, v.importance_score, v.station_distance_km, v.airport_distance_km, v.is_seeded
    FROM d_venue v LEFT JOIN d_city c USING (city_id)""")
def prj05(t):
    return views.venue_view(t.venue, t.city).drop("latitude", "longitude", "capacity_source")


@check("prj06_source_view", """SELECT source_id, key, CASE WHEN (requires_key IS NOT NULL AND requires_key <> 'KEY_5') OR NOT enabled THEN 'DISABLED' ELSE status END AS shown_status,
    CASE WHEN requires_key IS NOT NULL AND requires_key <> 'KEY_5' THEN 'API key not configured (' || requires_key || ')' WHEN NOT enabled THEN 'Disabled in settings'
    WHEN status = 'DISABLED' THEN coalesce(nullif(last_error, ''), 'Disabled') END AS disabled_reason, CASE WHEN requires_key IS NOT NULL THEN requires_key = 'KEY_5' END AS key_configured FROM d_source""")
def prj06(t):
    return views.source_view(t.source, ["KEY_5"]).select("source_id", "key", "shown_status", "disabled_reason", "key_configured")


@check("prj07_event_brief", f"""SELECT e.event_id, coalesce(e.v_name, e.venue_name_raw) AS venue, e.post_start, e.post_end, a.top_action, e.v_capacity AS capacity FROM d_scored e
    LEFT JOIN (SELECT event_id, min_by(title, action_id) AS top_action FROM d_action WHERE action_status = 'NEW' GROUP BY 1) a USING (event_id) WHERE e.date_start BETWEEN {D} AND {D} + 30""")
def prj07(t):
    ev = t.scored_between(0, 30)
    return views.event_brief(ev.where(within_days(F.col("date_start"), fl.as_date(AS_OF), 30)), t.action(ev)).select("event_id", "venue", "post_start", "post_end", "top_action", "capacity")


@check("prj09_fact_snapshot", """SELECT event_id, 'title=' || title || '|start=' || date_start || '|time=' || coalesce(time_start, '') || '|status=' || status || '|venue=' || coalesce(venue_id::VARCHAR, '') || '|n=' || source_count AS facts FROM d_placed""")
def prj09(t):
    s = t.with_places(t.event).select("event_id", views.snapshot_struct().alias("s"))
    field = {"title": "title", "start": "date_start", "time": "time_start", "status": "status", "venue": "venue_id", "n": "source_count"}
    parts = []
    for i, (label, name) in enumerate(field.items()):
        parts += [F.lit(("|" if i else "") + label + "="), F.coalesce(F.col(f"s.{name}").cast("string"), F.lit(""))]
    return s.select("event_id", F.concat(*parts).alias("facts"))


@check("prj10_service_area_dimension", f"""SELECT DISTINCT name AS city_name, {name_sql('name')} AS normalized_name, round_even(priority * 1609 / 1000e0, 3) AS reach_km FROM d_city WHERE priority >= 60""")
def prj10(t):
    """Cities of at least the given priority as the configured area, with the reach in miles turned into kilometres."""
    from ..functions.text import normalize_name

    return t.city.where("priority >= 60").select(F.col("name").alias("city_name"), normalize_name("name").alias("normalized_name"),
                                                  F.bround(views.miles_to_km(F.col("priority")), 3).alias("reach_km")).distinct()


# ---- exports -------------------------------------------------------------------------------------------------------------------------
@check("snk01_csv_export", """SELECT event_id::VARCHAR AS event_id, coalesce(v_name, venue_name_raw) AS venue_name, v_capacity::VARCHAR AS venue_capacity, opportunity_score::VARCHAR AS opportunity_score FROM d_scored
    ORDER BY date_start, d_scored.event_id""")
def snk01(t):
    from ..session import scratch

    path = scratch(t.spark, "export_csv")
    sinks.export(sinks.events_export(t.scored_event, AS_OF).select("event_id", "venue", "opportunity_score"), path, "csv")
    return t.spark.read.option("header", True).csv(path).select("event_id", "venue_name", "venue_capacity", "opportunity_score")


@check("snk02_json_export", f"""SELECT event_id, opportunity_type, score FROM (SELECT o.event_id, o.opportunity_type, o.score FROM d_opp o JOIN d_event e USING (event_id) WHERE e.date_start BETWEEN {D} AND {D} + 30
    ORDER BY o.score DESC, o.event_id, o.opportunity_type)""")
def snk02(t):
    from ..session import scratch

    path = scratch(t.spark, "export_json")
    ev = t.scored_between(0, 30)
    sinks.export(sinks.opportunities_export(t.opportunity(ev), ev, AS_OF), path, "json")
    return t.spark.read.schema("event_id bigint, opportunity_type string, score int").json(path)


@check("snk03_events_export", f"""SELECT event_id, date_start::VARCHAR AS date_start, title, city FROM (SELECT event_id, date_start, title, coalesce(c_name, city_name_raw) AS city FROM d_scored
    WHERE date_start >= {D} AND category = 'music' ORDER BY date_start, event_id)""")
def snk03(t):
    return iso(sinks.events_export(t.scored_between(0), AS_OF, date_from=AS_OF, category="music").select("event_id", "date_start", "title", "city"))


@check("snk04_opportunities_export", f"""SELECT o.event_id, o.opportunity_type, o.score, o.demand_level, o.window_start, o.window_end, o.confidence FROM d_opp o JOIN d_event e USING (event_id)
    WHERE o.score >= 50 AND e.date_start BETWEEN {D} AND {D} + 30 ORDER BY o.score DESC, o.event_id, o.opportunity_type""")
def snk04(t):
    ev = t.scored_between(0, 30)
    return sinks.opportunities_export(t.opportunity(ev), ev, AS_OF, min_score=50).select(
        "event_id", "opportunity_type", "score", "demand_level", "window.window_start", "window.window_end", "confidence")


@check("snk05_actions_export", """SELECT action_id, action_type, priority, action_status AS status FROM d_action WHERE action_status = 'NEW' AND action_type = 'SEO' ORDER BY priority DESC, action_id DESC""")
def snk05(t):
    return sinks.actions_export(t.action(t.scored_between(0, 30)), "new", "seo").select("action_id", "action_type", "priority", "status")


@check("snk06_runs_export", """SELECT run_id, trigger, status, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, duration_seconds, sources_attempted, events_raw, events_valid FROM d_prun ORDER BY run_id DESC""")
def snk06(t):
    return iso(sinks.runs_export(t.pipeline_run).drop("completed_at"))


SUMMARY_KEYS = ["events_today", "events_next_7_days", "very_high", "new_events", "sources_total", "open_actions"]


@check("snk07_snapshot_bundle", f"""SELECT * FROM (SELECT 'summary' AS name, 1 AS n, events_today || ';' || events_next_7_days || ';' || very_high || ';' || new_events || ';' || sources_total || ';' || open_actions AS content
      FROM ({fg.COUNTERS}), ({fg.CHANGES.format(since=D + ' - 1')}), ({fg.SOURCES}), ({fg.OPEN}))
    UNION ALL SELECT 'trends', count(*), sum(n)::BIGINT::VARCHAR FROM (SELECT date_start, count(*) AS n FROM d_scored WHERE date_start BETWEEN {D} AND {D} + 30 AND status IN {ACTIVE} GROUP BY 1)
    UNION ALL SELECT 'map', count(*), sum(opportunity_score)::BIGINT::VARCHAR FROM d_scored WHERE date_start BETWEEN {D} AND {D} + 7 AND latitude IS NOT NULL AND status IN {ACTIVE}
    UNION ALL SELECT 'events_7d', count(*), sum(event_id)::BIGINT::VARCHAR FROM d_scored WHERE date_start BETWEEN {D} AND {D} + 7
    UNION ALL SELECT 'events_30d', count(*), sum(event_id)::BIGINT::VARCHAR FROM d_scored WHERE date_start BETWEEN {D} AND {D} + 30
    UNION ALL SELECT 'opportunities', count(*), sum(score)::BIGINT::VARCHAR FROM d_opp JOIN d_event e USING (event_id) WHERE e.date_start BETWEEN {D} AND {D} + 7 AND e.status IN {ACTIVE}
    UNION ALL SELECT 'actions', count(*), sum(action_id)::BIGINT::VARCHAR FROM d_action WHERE date_start BETWEEN {D} AND {D} + 14 AND action_status IN ('NEW', 'PLANNED', 'SCHEDULED', 'IN_PROGRESS')
    UNION ALL SELECT 'sources', count(*), sum(source_id)::BIGINT::VARCHAR FROM d_source
    UNION ALL SELECT 'daily_report', count(*), sum(opportunity_score)::BIGINT::VARCHAR FROM (SELECT * FROM d_scored WHERE date_start = {D} AND status IN {ACTIVE} ORDER BY opportunity_score DESC, event_id LIMIT 20)
    UNION ALL SELECT 'health', 1, count(*) || ';' || count(*) FILTER (status = 'HEALTHY') FROM d_source
    UNION ALL SELECT 'changes', count(*), sum(change_id)::BIGINT::VARCHAR FROM d_change WHERE detected_at >= {LOG_NOW} - INTERVAL 7 DAY""")
def snk07(t):
    """Writes the eleven named result sets and reads them back: rows and a sum of the content per name."""
    from ..session import scratch

    folder = scratch(t.spark, "bundle")
    ev, actions = fg.report_frames(t)
    near = ev.where(c("date_start") >= fl.as_date(AS_OF))
    report = reports.daily_report(ev, t.event_change, t.source, actions, AS_OF, t.source_run, t.pipeline_run)
    sinks.snapshot_bundle({
        "summary": report["summary"], "trends": reports.by_day(reports.upcoming(near, AS_OF)), "map": fl.map_points(near, AS_OF, 7),
        "events_7d": views.event_summary(fl.list_events(near, AS_OF, range_="7d", size=None)), "events_30d": views.event_summary(fl.list_events(near, AS_OF, range_="30d", size=None)),
        "opportunities": fl.opportunity_feed(t.opportunity(near), near, AS_OF, days=7), "actions": fl.action_feed(actions, near, AS_OF, days=14), "sources": t.source,
        "daily_report": report["today"], "health": reports.system_counts(t.source), "changes": fl.recent_changes(t.event_change, log_now(), 7)}, folder)
    content = {"summary": F.array_join(F.array(*[F.max(c(k)).cast("string") for k in SUMMARY_KEYS]), ";"), "trends": F.sum("n"), "map": F.sum("opportunity_score"), "events_7d": F.sum("event_id"), "events_30d": F.sum("event_id"),
               "opportunities": F.sum("score"), "actions": F.sum("action_id"), "sources": F.sum("source_id"), "daily_report": F.sum("opportunity_score"),
               "health": F.concat_ws(";", F.max("total"), F.max("healthy")), "changes": F.sum("change_id")}
    parts = [t.spark.read.json(f"{folder}/{n}").agg(F.count("*").alias("n"), v.cast("string").alias("content")).select(F.lit(n).alias("name"), "n", "content") for n, v in content.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@check("snk08_report_sheets", f"""SELECT 'daily_reports' AS sheet, 1 AS n, events_next_7_days::VARCHAR AS content FROM ({fg.COUNTERS})
    UNION ALL SELECT 'opportunities', count(*), string_agg(title, ';' ORDER BY title) FROM (SELECT title FROM d_scored WHERE date_start BETWEEN {D} AND {D} + 7 AND status IN {ACTIVE} ORDER BY opportunity_score DESC, date_start, event_id LIMIT 5)
    UNION ALL SELECT 'events', count(*), string_agg(title, ';' ORDER BY title) FROM (SELECT title FROM d_scored WHERE date_start = {D} AND status IN {ACTIVE} ORDER BY opportunity_score DESC, event_id LIMIT 20)""")
def snk08(t):
    """Writes the three sheets and reads them back: rows and titles per sheet."""
    from ..session import scratch

    folder = scratch(t.spark, "sheets")
    sinks.sheets_bundle(fg.daily(t), folder)
    titles = F.array_join(F.sort_array(F.collect_list("title")), ";")  # of at most 20 rows
    content = {"daily_reports": F.max("events_next_7_days"), "opportunities": titles, "events": titles}
    parts = [t.spark.read.option("header", True).option("multiLine", True).csv(f"{folder}/{n}").agg(F.count("*").alias("n"), v.alias("content")).select(F.lit(n).alias("sheet"), "n", "content") for n, v in content.items()]
    return parts[0].union(parts[1]).union(parts[2])
