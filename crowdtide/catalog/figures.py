"""Aggregates, histories and set operations over whole tables (AGG, WIN, SET, JOIN of dimensions and bridges)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..bindings import AS_OF, log_now
from ..operators import filters as fl
from ..operators import history
from ..operators.views import with_dimensions
from ..plans import reports
from ..session import cut_lineage
from .oracle_tables import AS_OF as D
from .oracle_tables import LOG_NOW, title_sql
from .registry import check
from .shape import iso

c = F.col
ACTIVE = "('SCHEDULED', 'RESCHEDULED', 'CONFIRMED', 'SOLD_OUT')"
UP = f"date_start BETWEEN {D} AND {D} + 30 AND status IN {ACTIVE}"


def up(t):
    return reports.upcoming(t.scored_between(0, 30), AS_OF)


@check("agg01_horizon_counts", "SELECT " + ", ".join(f"count(*) FILTER (date_start BETWEEN {D} AND {D} + {n}) AS h_{k}" for k, n in V.HORIZON_DAYS) + " FROM d_event WHERE category = 'sports'")
def agg01(t):
    return reports.horizon_counts(t.event_between(0, 90), AS_OF, category="sports")


COUNTERS = f"""SELECT count(*) FILTER (date_start <= {D} AND coalesce(date_end, date_start) >= {D} AND status IN {ACTIVE}) AS events_today,
    count(*) FILTER (date_start <= {D} + 1 AND coalesce(date_end, date_start) >= {D} + 1 AND status IN {ACTIVE}) AS events_tomorrow,
    count(*) FILTER (date_start BETWEEN {D} AND {D} + 7 AND status IN {ACTIVE}) AS events_next_7_days, count(*) FILTER (date_start BETWEEN {D} AND {D} + 30 AND status IN {ACTIVE}) AS events_next_30_days,
    count(*) FILTER (date_start BETWEEN {D} AND {D} + 7 AND status IN {ACTIVE} AND demand_level = 'HIGH') AS high, count(*) FILTER (date_start BETWEEN {D} AND {D} + 7 AND status IN {ACTIVE} AND demand_level = 'VERY_HIGH') AS very_high,
    count(*) FILTER (date_start BETWEEN {D} AND {D} + 7 AND status IN {ACTIVE} AND demand_level = 'MEDIUM') AS medium FROM d_scored"""
CHANGES = """SELECT count(DISTINCT event_id) FILTER (change_type = 'NEW') AS new_events, count(DISTINCT event_id) FILTER (change_type = 'CANCELLED') AS cancelled_events,
    count(DISTINCT event_id) FILTER (change_type NOT IN ('NEW', 'CANCELLED')) AS changed_events FROM d_change WHERE detected_at >= {since}"""
SOURCES = """SELECT count(*) FILTER (enabled) AS sources_total, count(*) FILTER (status IN ('HEALTHY', 'DEGRADED', 'EMPTY')) AS sources_healthy, count(*) FILTER (status = 'EMPTY') AS sources_empty,
    count(*) FILTER (status = 'BLOCKED') AS sources_blocked FROM d_source"""
OPEN = f"SELECT count(*) AS open_actions FROM d_action WHERE action_status IN ('NEW', 'PLANNED', 'SCHEDULED', 'IN_PROGRESS') AND date_start BETWEEN {D} AND {D} + 14"


FALLEN = """SELECT run_id, source_id, source_id || ' regression: ' || events_collected || ' events vs ' || prev || ' in previous successful run' AS message FROM (SELECT *, last_value(CASE WHEN status IN ('HEALTHY', 'DEGRADED') THEN events_collected END IGNORE NULLS)
    OVER (PARTITION BY source_id ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM d_run) WHERE prev >= 10 AND events_collected < 0.5 * prev AND started_at::DATE = (SELECT max(started_at)::DATE FROM d_run)"""
REGRESSIONS = f"SELECT coalesce(string_agg(message, chr(10) ORDER BY source_id, run_id), '') AS source_regressions FROM ({FALLEN})"
SILENT = f"SELECT count(*) AS source_silent_events FROM d_event WHERE date_start BETWEEN {D} AND {D} + 30 AND status_reason LIKE 'SOURCE SILENT%'"
PIPELINE = "SELECT coalesce(max_by(status, run_id), 'UNKNOWN') AS pipeline_status FROM d_prun WHERE status <> 'RUNNING'"


def report_frames(t):
    """Scored events of the report's horizon and their actions, each worked out once and stored."""
    ev = cut_lineage(t.scored(t.event_touching(30)))
    return ev, cut_lineage(t.action(ev))


def daily(t):
    ev, actions = report_frames(t)
    return reports.daily_report(ev, t.event_change, t.source, actions, AS_OF, t.source_run, t.pipeline_run)


@check("agg02_daily_summary", f"SELECT * FROM ({COUNTERS}), ({CHANGES.format(since=D + ' - 1')}), ({SOURCES}), ({OPEN}), ({REGRESSIONS})")
def agg02(t):
    ev, actions = report_frames(t)
    return reports.summary(ev, t.event_change, t.source, actions, AS_OF, t.source_run)


@check("agg03_change_counters", CHANGES.format(since="DATE '2024-01-29'"))
def agg03(t):
    import datetime as dt

    return reports.change_counters(t.event_change, dt.date(2024, 1, 30))


@check("agg04_by_category", f"SELECT category, count(*) AS n, round_even(avg(opportunity_score), 1) AS avg_score FROM d_scored WHERE {UP} GROUP BY 1")
def agg04(t):
    return reports.grouped(up(t), "category")


@check("agg05_top_places", f"""SELECT * FROM (SELECT 'city' AS kind, c_name AS place, count(*) AS n, round_even(avg(opportunity_score), 1) AS avg_score, max(opportunity_score) AS max_score FROM d_scored WHERE {UP} AND c_name IS NOT NULL GROUP BY 2 ORDER BY n DESC, place LIMIT 15)
    UNION ALL SELECT * FROM (SELECT 'region' AS kind, r_name AS place, count(*) AS n, round_even(avg(opportunity_score), 1) AS avg_score, max(opportunity_score) AS max_score FROM d_scored WHERE {UP} AND r_name IS NOT NULL GROUP BY 2 ORDER BY n DESC, place LIMIT 15)
    UNION ALL SELECT * FROM (SELECT 'venue' AS kind, v_name AS place, count(*) AS n, round_even(avg(opportunity_score), 1) AS avg_score, max(opportunity_score) AS max_score FROM d_scored WHERE {UP} AND v_name IS NOT NULL GROUP BY 2 ORDER BY n DESC, place LIMIT 10)""")
def agg05(t):
    u = cut_lineage(up(t).select("c_name", "r_name", "v_name", "opportunity_score"))
    parts = [reports.top_places(u, key, n).select(F.lit(kind).alias("kind"), c(key).alias("place"), "n", "avg_score", "max_score") for kind, key, n in (("city", "c_name", 15), ("region", "r_name", 15), ("venue", "v_name", 10))]
    return parts[0].union(parts[1]).union(parts[2])


@check("agg06_by_day", f"SELECT date_start::VARCHAR AS date_start, count(*) AS n, count(*) FILTER (demand_level IN ('HIGH', 'VERY_HIGH')) AS high_or_above FROM d_scored WHERE {UP} GROUP BY 1")
def agg06(t):
    return iso(reports.by_day(up(t)))


@check("agg07_score_histogram", f"SELECT CASE WHEN opportunity_score >= 80 THEN '80-100' WHEN opportunity_score >= 65 THEN '65-79' WHEN opportunity_score >= 50 THEN '50-64' WHEN opportunity_score >= 35 THEN '35-49' ELSE '0-34' END AS bucket, count(*) AS n FROM d_scored WHERE {UP} GROUP BY 1")
def agg07(t):
    return reports.score_histogram(up(t))


@check("agg08_change_trends", f"SELECT detected_at::DATE::VARCHAR AS day, change_type, count(*) AS n FROM d_change WHERE detected_at >= {LOG_NOW} - INTERVAL 14 DAY GROUP BY 1, 2")
def agg08(t):
    return iso(reports.change_trend(t.event_change, log_now()))


@check("agg09_source_coverage", f"SELECT primary_source, count(*) AS n FROM d_event WHERE {UP} GROUP BY 1")
def agg09(t):
    return reports.upcoming(t.event_between(0, 30), AS_OF).groupBy("primary_source").agg(F.count("*").alias("n"))


HEALTH = f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY run_id DESC) AS rn FROM d_run), recent AS (SELECT * FROM ranked WHERE rn <= 20),
    figures AS (SELECT source_id, count(*) AS runs_sampled, count(*) FILTER (status = 'FAILED') AS failure_count, round_even(avg(events_collected) FILTER (started_at >= {LOG_NOW} - INTERVAL 7 DAY), 1) AS events_7_day_average,
      max_by(started_at, run_id) FILTER (status = 'FAILED') AS last_failure_at, round_even(count(*) FILTER (status = 'FAILED') / count(*)::DOUBLE, 2) AS failure_rate,
      trunc(sum(response_ms) / count(*)::DOUBLE)::INT AS avg_response_ms, count(*) FILTER (rn <= 3 AND events_collected = 0) = 3 AND count(*) FILTER (rn > 3 AND events_collected > 0) > 0 AS silent_zero FROM recent GROUP BY 1)"""


@check("agg10_source_health", HEALTH + f""", future AS (SELECT source_id, count(DISTINCT event_id) AS future_events FROM d_link JOIN d_event USING (event_id) WHERE date_start >= {D} GROUP BY 1)
    SELECT s.source_id, s.key, CASE WHEN s.enabled AND s.status <> 'DISABLED' AND (s.last_success_at < {LOG_NOW} - INTERVAL 3 DAY OR coalesce(f.silent_zero, false)) THEN 'SOURCE SILENT' WHEN NOT s.enabled THEN 'DISABLED'
      WHEN s.status IN ('HEALTHY', 'DEGRADED') AND s.last_events_collected = 0 THEN 'EMPTY' ELSE s.status END AS health, s.status AS raw_status, coalesce(f.runs_sampled, 0) AS runs_sampled, coalesce(f.failure_count, 0) AS failure_count,
      f.events_7_day_average, f.failure_rate, f.avg_response_ms, coalesce(x.future_events, 0) AS future_events FROM d_source s LEFT JOIN figures f USING (source_id) LEFT JOIN future x USING (source_id)""")
def agg10(t):
    h = reports.source_health(t.source, t.source_run, t.event_source, t.event_between(0), AS_OF, log_now())
    return h.select("source_id", "key", "health", "raw_status", "runs_sampled", "failure_count", "events_7_day_average", "failure_rate", "avg_response_ms", "future_events")


def targets(t):
    """The four registries bound to supplier, customer, nation and part rows."""
    venues = t.venue.selectExpr("name", "'city' city", "venue_type", "case when pmod(venue_id, 3) = 0 then concat('https://v.example/', cast(venue_id as string)) end official_events_url", "cast(null as string) events_json_url",
                                "cast(null as string) ical_url", "case when pmod(venue_id, 5) = 0 then 'https://v.example/rss' end rss_url", "pmod(venue_id, 4) <> 3 enabled", "case when pmod(venue_id, 2) = 0 then 'BLOCKED' end verification_status")
    councils = t.city.selectExpr("name council", "case when pmod(city_id, 2) = 0 then 'tourism' else 'council' end kind", "name city", "true enabled", "'UNVERIFIED' verification_status")
    parts = t.table("part").selectExpr("concat('Organiser ', cast(pmod(p_partkey, 40) as string)) name", "case pmod(p_partkey, 4) when 0 then 'university' when 1 then 'college' when 2 then 'sixth_form' else 'school' end type",
                                       "'x' city", "pmod(p_partkey, 6) <> 0 enabled", "cast(null as string) verification_status")
    return reports.configured_targets(t.source, venues, councils, parts)


TARGETS = """targets AS (SELECT 'source' AS kind, key, enabled, requires_key, NULL::VARCHAR AS declared FROM d_source
    UNION ALL SELECT 'venue', name, venue_id % 4 <> 3, NULL, CASE WHEN venue_id % 2 = 0 THEN 'BLOCKED' END FROM d_venue WHERE venue_id % 3 = 0 OR venue_id % 5 = 0
    UNION ALL SELECT CASE WHEN city_id % 2 = 0 THEN 'tourism' ELSE 'council' END, name, true, NULL, 'UNVERIFIED' FROM d_city
    UNION ALL SELECT CASE p_partkey % 4 WHEN 0 THEN 'university' WHEN 1 THEN 'college' WHEN 2 THEN 'college' ELSE 'school' END, 'Organiser ' || (p_partkey % 40), p_partkey % 6 <> 0, NULL, NULL FROM part)"""
STATUSED = HEALTH + f""", future AS (SELECT source_id, count(DISTINCT event_id) AS n FROM d_link JOIN d_event USING (event_id) WHERE date_start >= {D} GROUP BY 1),
    health AS (SELECT s.key, coalesce(x.n, 0) AS n, CASE WHEN s.enabled AND s.status <> 'DISABLED' AND (s.last_success_at < {LOG_NOW} - INTERVAL 3 DAY OR coalesce(f.silent_zero, false)) THEN 'SOURCE SILENT' WHEN NOT s.enabled THEN 'DISABLED'
      WHEN s.status IN ('HEALTHY', 'DEGRADED') AND s.last_events_collected = 0 THEN 'EMPTY' ELSE s.status END AS health FROM d_source s LEFT JOIN figures f USING (source_id) LEFT JOIN future x USING (source_id)),
    byvenue AS (SELECT v_name AS key, count(*) AS n FROM d_placed WHERE date_start >= {D} AND v_name IS NOT NULL GROUP BY 1), byorg AS (SELECT organizer AS key, count(*) AS n FROM d_event WHERE date_start >= {D} AND organizer IS NOT NULL GROUP BY 1), {TARGETS},
    st AS (SELECT t.kind, t.key, t.enabled, t.requires_key, CASE WHEN t.kind = 'source' THEN CASE WHEN h.health IN ('HEALTHY', 'DEGRADED') AND h.n = 0 THEN 'EMPTY' WHEN h.health = 'HEALTHY' THEN 'ACTIVE' ELSE h.health END
      WHEN NOT t.enabled THEN 'DISABLED' WHEN coalesce(CASE WHEN t.kind = 'venue' THEN v.n ELSE o.n END, 0) > 0 THEN 'ACTIVE' ELSE coalesce(t.declared, 'EMPTY') END AS status
      FROM targets t LEFT JOIN health h ON h.key = t.key LEFT JOIN byvenue v ON v.key = t.key LEFT JOIN byorg o ON o.key = t.key)"""


def statused(t):
    ev = with_dimensions(t.event_between(0), t.venue)
    health = reports.source_health(t.source, t.source_run, t.event_source, t.event_between(0), AS_OF, log_now())
    return reports.target_status(targets(t), health, ev, AS_OF)


@check("agg11_coverage_index", STATUSED + """, w AS (SELECT *, CASE kind WHEN 'source' THEN 3.0 WHEN 'university' THEN 0.5 WHEN 'college' THEN 0.25 WHEN 'school' THEN 0.25 ELSE 1.0 END::DOUBLE AS w FROM st WHERE enabled AND requires_key IS NULL)
    SELECT round_even(sum(w) FILTER (status = 'ACTIVE'), 2) AS weighted_active, round_even(sum(w), 2) AS weighted_configured, round_even(100 * sum(w) FILTER (status = 'ACTIVE') / sum(w), 0)::INT AS coverage_index FROM w""")
def agg11(t):
    return reports.coverage_index(statused(t))


@check("join17_targets_by_status", STATUSED + " SELECT kind, status, count(*) AS n FROM st GROUP BY 1, 2")
def join17(t):
    return statused(t).groupBy("kind", "status").agg(F.count("*").alias("n"))


@check("src21_configured_targets", f"WITH {TARGETS} SELECT kind, key, enabled, declared AS declared_status, count(*) AS n FROM targets GROUP BY ALL")
def src21(t):
    return targets(t).groupBy("kind", "key", "enabled", "declared_status").agg(F.count("*").alias("n"))


@check("agg12_gap_analysis", f"""SELECT 'source' AS mix, primary_source AS value, count(*) AS n FROM d_scored WHERE date_start >= {D} GROUP BY 2 UNION ALL SELECT 'confidence', source_confidence, count(*) FROM d_scored WHERE date_start >= {D} GROUP BY 2
    UNION ALL SELECT 'quality', quality_level, count(*) FROM d_scored WHERE date_start >= {D} GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM d_scored GROUP BY 2""")
def agg12(t):
    return reports.mixes(t.scored_event, AS_OF)


@check("agg12b_region_rollup", f"""SELECT region, city, sum(n)::BIGINT AS n, grouping(city)::INT AS is_total FROM (SELECT r.name AS region, c.name AS city, count(e.event_id) AS n FROM d_city c LEFT JOIN d_region r USING (region_id)
    LEFT JOIN d_placed e ON e.city_id = c.city_id AND e.date_start >= {D} GROUP BY 1, 2) GROUP BY GROUPING SETS ((region, city), (region))""")
def agg12b(t):
    return reports.region_rollup(t.city, t.region, t.with_places(t.event_between(0)), AS_OF)


@check("agg12c_coverage_totals", f"SELECT count(*) AS future_total, count(DISTINCT venue_id) AS venues_with_events, count(*) FILTER (status_reason LIKE 'SOURCE SILENT%') AS source_silent, (SELECT count(*) FROM d_venue) AS venues_registered FROM d_event WHERE date_start >= {D}")
def agg12c(t):
    return reports.coverage_totals(t.event_between(0), t.venue, AS_OF)


METRICS = {"missing_time_start": "time_start IS NULL", "missing_venue_id": "venue_id IS NULL", "missing_city_id": "city_id IS NULL", "missing_official_url": "official_url IS NULL AND ticket_url IS NULL",
           "missing_coordinates": "latitude IS NULL", "missing_venue_capacity": "venue_capacity IS NULL", "category_other": "category = 'other'", "multi_source": "source_count >= 2",
           **{f"quality_{q}": f"quality_level = '{q}'" for q in ("HIGH", "MEDIUM", "LOW")}, **{f"confidence_{q}": f"source_confidence = '{q}'" for q in V.CONFIDENCE_RANK},
           "source_silent": "status_reason LIKE 'SOURCE SILENT%'"}


@check("agg13_data_quality", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS metric, count(*) FILTER ({v}) AS n, round_even(100 * count(*) FILTER ({v}) / count(*)::DOUBLE, 1) AS pct FROM d_rated WHERE date_start >= {D}" for k, v in METRICS.items()) + ")")
def agg13(t):
    return reports.data_quality(t.scored_between(0), AS_OF)


@check("agg13b_quality_averages", f"SELECT count(*) AS future_events, round_even(avg(event_quality_score), 1) AS avg_quality_score, round_even(avg(freshness_score), 1) AS avg_freshness, min(freshness_score) AS min_freshness FROM d_rated WHERE date_start >= {D}")
def agg13b(t):
    return reports.quality_averages(t.scored_between(0), AS_OF)


@check("agg14_possible_duplicates", f"SELECT {title_sql('title')} AS normalized_title, date_start::VARCHAR AS date_start, count(*) AS n FROM d_event WHERE date_start >= {D} GROUP BY 1, 2 HAVING count(*) > 1")
def agg14(t):
    from ..functions.text import normalize_title

    return iso(reports.possible_duplicates(t.event_between(0).withColumn("normalized_title", normalize_title("title")), AS_OF))


@check("agg15_dimension_counts", f"""SELECT 'city' AS kind, c.name, count(e.event_id) AS upcoming_events FROM d_city c LEFT JOIN d_placed e ON e.city_id = c.city_id AND e.date_start >= {D} GROUP BY 1, 2
    UNION ALL SELECT 'region', r.name, count(e.event_id) FROM d_region r LEFT JOIN d_placed e ON e.region_id = r.region_id AND e.date_start >= {D} GROUP BY 1, 2
    UNION ALL SELECT 'venue', v.name, count(e.event_id) FROM d_venue v LEFT JOIN d_event e ON e.venue_id = v.venue_id AND e.date_start >= {D} GROUP BY 1, 2""")
def agg15(t):
    ev = t.with_places(t.event_between(0))
    parts = [reports.dimension_counts(dim, ev, key, AS_OF).select(F.lit(kind).alias("kind"), "name", "upcoming_events")
             for kind, dim, key in (("city", t.city, "city_id"), ("region", t.region, "region_id"), ("venue", t.venue, "venue_id"))]
    return parts[0].union(parts[1]).union(parts[2])


@check("agg16_category_mix", f"SELECT category, count(*) AS n FROM d_event WHERE date_start BETWEEN {D} AND {D} + 7 AND status IN {ACTIVE} GROUP BY 1")
def agg16(t):
    return reports.upcoming(t.event_between(0, 7), AS_OF, 7).groupBy("category").agg(F.count("*").alias("n"))


@check("agg21_rejections", f"""SELECT primary_source AS source_key, problem, count(*) AS n FROM (SELECT primary_source, unnest(list_filter([CASE WHEN date_start < {D} - 2 THEN 'event_in_past' END, CASE WHEN date_start > {D} + 400 THEN 'event_too_far_future' END,
      CASE WHEN lower(title) LIKE '%deposit%' THEN 'non_event_title' END], lambda x: x IS NOT NULL)) AS problem FROM d_event) GROUP BY 1, 2
    UNION ALL SELECT primary_source, 'rejected', count(*) FILTER (date_start NOT BETWEEN {D} - 2 AND {D} + 400) FROM d_event GROUP BY 1""")
def agg21(t):
    staged = t.event.withColumns({"external_id": c("event_id").cast("string"), "venue_name": F.lit("x"), "city_name": c("city_name_raw"), "source_key": c("primary_source")})
    _, bad = fl.split_valid(staged, AS_OF)
    dry = reports.dry_run(staged, AS_OF).select("source_key", F.lit("rejected").alias("problem"), c("rejected").alias("n"))
    return reports.rejections(bad).union(dry)


@check("agg23_quality_counts", f"SELECT quality_level, count(*) AS n, count(*) FILTER (last_verified_at < TIMESTAMP '1998-06-15 12:00:00' - INTERVAL 21 DAY) AS silent FROM d_rated WHERE date_start >= {D} GROUP BY 1")
def agg23(t):
    from ..bindings import now
    from ..functions.dates import source_silent

    ev = t.scored_between(0)
    return ev.groupBy("quality_level").agg(F.count("*").alias("n"), F.count_if(source_silent(c("last_verified_at"), c("date_start"), now())).alias("silent"))


@check("agg25_collector_outcome", """SELECT source_id::VARCHAR AS source_key, count(*) FILTER (event_type <> 'signup') AS attempted, count(*) FILTER (event_type IN ('click', 'view')) AS ok,
      CASE WHEN count(*) FILTER (event_type <> 'signup') = 0 AND sum(n) = 0 THEN 'EMPTY' WHEN count(*) FILTER (event_type <> 'signup') > 0 AND count(*) FILTER (event_type IN ('click', 'view')) = 0 THEN
        CASE WHEN count(*) FILTER (event_type = 'purchase') >= count(*) FILTER (event_type <> 'signup') THEN 'BLOCKED' ELSE 'FAILED' END WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS outcome
    FROM (SELECT user_id * 100 + day(ts) AS source_id, event_type, CASE WHEN event_type IN ('click', 'view') THEN trunc(value)::INT ELSE 0 END AS n FROM events) GROUP BY 1""")
def agg25(t):
    log = t.table("events").selectExpr("cast(user_id * 100 + day(ts) as string) source_key", "event_type <> 'signup' attempted", "event_type in ('click', 'view') ok", "event_type = 'purchase' blocked",
                                       "event_type = 'error' warned", "case when event_type in ('click', 'view') then cast(value as int) else 0 end events")
    return history.collector_outcome(log).select("source_key", "attempted", "ok", "outcome")


@check("agg26_top_values_per_source", """SELECT source_id, venue, n, rn FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, venue) AS rn FROM (
    SELECT l.source_id, e.category AS venue, count(*) AS n FROM d_link l JOIN d_event e USING (event_id) GROUP BY 1, 2)) WHERE rn <= 5""")
def agg26(t):
    rows = t.event_source.join(t.event.select("event_id", c("category").alias("venue")), "event_id")
    return history.top_values(rows, "source_id", "venue", 5)


@check("agg27_system_counts", """SELECT * FROM (SELECT count(*) AS total, count(*) FILTER (status = 'HEALTHY') AS healthy, count(*) FILTER (status = 'DEGRADED') AS degraded, count(*) FILTER (status = 'FAILED') AS failed,
    count(*) FILTER (status = 'DISABLED' OR NOT enabled) AS disabled FROM d_source), (SELECT count(*) FILTER (event_type = 'click') AS sent, count(*) FILTER (event_type = 'error') AS send_failed FROM events)""")
def agg27(t):
    mail = t.table("events").select(F.when(c("event_type") == "click", "SENT").when(c("event_type") == "error", "FAILED").otherwise("SKIPPED").alias("status"))
    return reports.system_counts(t.source, mail)


@check("agg28_daily_report", f"""SELECT * FROM (SELECT 'top' AS part, event_id, opportunity_score FROM d_scored WHERE date_start BETWEEN {D} AND {D} + 7 AND status IN {ACTIVE} ORDER BY opportunity_score DESC, date_start, event_id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'area' AS part, event_id, opportunity_score FROM d_scored WHERE date_start BETWEEN {D} AND {D} + 7 AND status IN {ACTIVE} AND in_area AND c_name IS NOT NULL AND quality_level <> 'LOW' ORDER BY opportunity_score DESC, date_start, event_id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'today' AS part, event_id, opportunity_score FROM d_scored WHERE date_start = {D} AND status IN {ACTIVE} ORDER BY opportunity_score DESC, event_id LIMIT 20)
    UNION ALL SELECT 'category ' || category, NULL, count(*)::INT FROM d_event WHERE date_start BETWEEN {D} AND {D} + 7 AND status IN {ACTIVE} GROUP BY category
    UNION ALL SELECT 'silent', NULL, source_silent_events::INT FROM ({SILENT}) UNION ALL SELECT 'pipeline ' || pipeline_status, NULL, NULL FROM ({PIPELINE})
    UNION ALL SELECT 'regressions', NULL, length(source_regressions)::INT FROM ({REGRESSIONS}) UNION ALL SELECT 'week', NULL, count(*)::INT FROM d_event WHERE date_start BETWEEN {D} AND {D} + 7 AND status IN {ACTIVE}""")
def agg28(t):
    r = daily(t)
    none = F.lit(None).cast("bigint").alias("event_id")
    parts = [r[k].select(F.lit(n).alias("part"), "event_id", "opportunity_score") for n, k in (("top", "top_opportunities"), ("area", "service_area_top"), ("today", "today"))]
    counted = F.inline(F.array(*[F.struct(F.lit(k).alias("part"), v.cast("int").alias("n")) for k, v in (("silent", c("source_silent_events")), ("regressions", F.char_length("source_regressions")), ("week", c("events_next_7_days")))]))
    parts += [r["by_category_7d"].select(F.concat(F.lit("category "), "category"), none, c("n").cast("int")), r["summary"].select(counted).select("part", none, "n"),
              r["pipeline"].select(F.concat(F.lit("pipeline "), "pipeline_status"), none, F.lit(None).cast("int"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@check("agg29_digest", f"""WITH area AS (SELECT * FROM d_scored WHERE date_start BETWEEN {D} AND {D} + 7 AND status IN {ACTIVE} AND in_area AND c_name IS NOT NULL AND quality_level <> 'LOW' ORDER BY opportunity_score DESC, date_start, event_id LIMIT 5),
    tops AS (SELECT * FROM d_scored WHERE date_start BETWEEN {D} AND {D} + 7 AND status IN {ACTIVE} ORDER BY opportunity_score DESC, date_start, event_id LIMIT 5),
    chosen AS (SELECT * FROM area UNION ALL SELECT * FROM tops WHERE NOT EXISTS (SELECT 1 FROM area)),
    listed AS (SELECT title, opportunity_score, row_number() OVER (ORDER BY opportunity_score DESC, date_start, event_id) AS i FROM chosen WHERE demand_level IN ('VERY_HIGH', 'HIGH', 'MEDIUM') AND quality_level <> 'LOW'),
    s AS (SELECT * FROM ({COUNTERS}), ({CHANGES.format(since=D + ' - 1')}), ({SOURCES}), ({SILENT}), ({PIPELINE}))
    SELECT 'levels' AS section, 1 AS ordinal, 'very_high' AS label, very_high::VARCHAR AS value FROM s UNION ALL SELECT 'levels', 2, 'high', high::VARCHAR FROM s UNION ALL SELECT 'levels', 3, 'medium', medium::VARCHAR FROM s
    UNION ALL SELECT 'top', i, title, opportunity_score::VARCHAR FROM listed UNION ALL SELECT 'changes', 1, 'new_events', new_events::VARCHAR FROM s UNION ALL SELECT 'changes', 2, 'changed_events', changed_events::VARCHAR FROM s
    UNION ALL SELECT 'changes', 3, 'cancelled_events', cancelled_events::VARCHAR FROM s
    UNION ALL SELECT 'categories', CASE category WHEN 'education' THEN 1 WHEN 'sports' THEN 2 ELSE 3 END, category, count(*)::VARCHAR FROM d_event WHERE date_start BETWEEN {D} AND {D} + 7 AND status IN {ACTIVE} AND category IN ('education', 'sports', 'music') GROUP BY category
    UNION ALL SELECT 'system', 1, 'sources_healthy', sources_healthy::VARCHAR FROM s UNION ALL SELECT 'system', 2, 'sources_total', sources_total::VARCHAR FROM s UNION ALL SELECT 'system', 3, 'pipeline_status', pipeline_status FROM s
    UNION ALL SELECT 'warnings', 1, 'source_silent_events', source_silent_events::VARCHAR FROM s WHERE source_silent_events > 0 UNION ALL SELECT 'warnings', 2, 'sources_blocked', sources_blocked::VARCHAR FROM s WHERE sources_blocked > 0
    UNION ALL SELECT 'regressions', row_number() OVER (ORDER BY source_id, run_id), 'source', message FROM ({FALLEN})
    UNION ALL SELECT 'top', 0, 'quiet day', 'No high-priority taxi opportunities detected today.' FROM s WHERE very_high + high = 0 AND NOT EXISTS (SELECT 1 FROM listed)""")
def agg29(t):
    return reports.digest(daily(t))


@check("agg30_run_history", "SELECT run_id, status, events_valid, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at FROM d_prun ORDER BY run_id DESC LIMIT 20")
def agg30(t):
    return iso(reports.run_history(t.pipeline_run).select("run_id", "status", "events_valid", "started_at"))


@check("dt16_data_freshness", f"""SELECT * FROM (SELECT hours AS hours_since_last_success, CASE WHEN hours <= 26 THEN 'FRESH' WHEN hours IS NOT NULL THEN 'STALE' ELSE 'UNKNOWN' END AS label FROM (
    SELECT round_even(date_diff('microsecond', max_by(completed_at, run_id), {LOG_NOW}) / 3.6e9, 1) AS hours FROM d_prun WHERE status IN ('SUCCESS', 'PARTIAL'))), (SELECT round_even(avg(freshness_score), 1) AS avg_freshness_score FROM d_placed WHERE date_start >= {D})""")
def dt16(t):
    return reports.data_freshness(t.pipeline_run, t.scored_between(0), AS_OF, log_now())


# ---- histories ---------------------------------------------------------------------------------------------------------------------------
@check("win01_latest_runs", "SELECT source_id, run_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY run_id DESC) AS rn FROM d_run) WHERE rn <= 20")
def win01(t):
    return history.latest_runs(t.source_run).select("source_id", "run_id", "rn")


@check("win02_silent_zero", HEALTH + " SELECT source_id, silent_zero FROM figures")
def win02(t):
    return history.health_figures(history.latest_runs(t.source_run), log_now()).select("source_id", "silent_zero")


@check("win03_latest_failure", HEALTH + " SELECT source_id, strftime(last_failure_at, '%Y-%m-%d %H:%M:%S') AS last_failure_at FROM figures")
def win03(t):
    return iso(history.health_figures(history.latest_runs(t.source_run), log_now()).select("source_id", "last_failure_at"))


@check("win04_week_average", HEALTH + " SELECT source_id, events_7_day_average FROM figures")
def win04(t):
    return history.health_figures(history.latest_runs(t.source_run), log_now()).select("source_id", "events_7_day_average")


@check("win05_regressions", """SELECT run_id, source_id, 'regression: ' || events_collected || ' events vs ' || prev || ' in previous successful run' AS message FROM (SELECT *, last_value(CASE WHEN status IN ('HEALTHY', 'DEGRADED') THEN events_collected END IGNORE NULLS)
    OVER (PARTITION BY source_id ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM d_run) WHERE prev >= 10 AND events_collected < 0.5 * prev""")
def win05(t):
    return history.regressions(t.source_run).select("run_id", "source_id", "message")


@check("win06_snapshot_changed", "SELECT event_id, last_hash FROM (SELECT event_id, max_by(snapshot_hash, snapshot_id) AS last_hash FROM d_snap GROUP BY 1)")
def win06(t):
    return history.latest_hash(t.snapshot)


@check("win08_first_new_action", "SELECT event_id, min_by(title, action_id) AS top_action FROM d_action WHERE action_status = 'NEW' GROUP BY 1")
def win08(t):
    from ..operators.views import first_new_action

    return first_new_action(t.action(t.scored_between(0, 30)))


@check("win09_survivorship", """SELECT l.event_id, first(s.requires_key ORDER BY s.priority DESC, l.source_id, l.external_id) FILTER (s.requires_key IS NOT NULL) AS requires_key,
    first(s.key ORDER BY s.priority DESC, l.source_id, l.external_id) FILTER (s.key IS NOT NULL) AS key FROM d_link l JOIN d_source s USING (source_id) GROUP BY 1""")
def win09(t):
    rec = t.event_source.join(t.source.select("source_id", "priority", "requires_key", "key"), "source_id")
    return history.survivors(rec, "event_id", ["requires_key", "key"], "priority", "source_id", "external_id")


@check("win10_action_cap", "SELECT event_id, action_type FROM d_action ORDER BY event_id, ordinal LIMIT 120")
def win10(t):
    from ..operators.fanout import cap_new_actions

    return cap_new_actions(t.action(), 120).select("event_id", "action_type")


@check("win11_stale_runs", f"SELECT run_id, CASE WHEN status = 'RUNNING' AND started_at < {LOG_NOW} - INTERVAL 3 HOUR THEN 'ABORTED' ELSE status END AS status FROM d_prun")
def win11(t):
    from ..operators.upserts import recover_stale_runs

    return recover_stale_runs(t.pipeline_run, log_now()).select("run_id", "status")


# ---- sets ----------------------------------------------------------------------------------------------------------------------------------
@check("set01_union_sources", "SELECT kind, count(*) AS n FROM (SELECT 'run' AS kind FROM d_run UNION ALL SELECT 'link' FROM d_link UNION ALL SELECT 'event' FROM d_event) GROUP BY 1")
def set01(t):
    parts = [df.select(F.lit(k).alias("kind")) for k, df in (("run", t.source_run), ("link", t.event_source), ("event", t.event))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("n"))


@check("set02_distinct_links", "SELECT DISTINCT event_id, source_id FROM d_link")
def set02(t):
    return t.event_source.select("event_id", "source_id").distinct()


@check("set03_difference", f"SELECT event_id, opportunity_type FROM d_opp EXCEPT SELECT event_id, opportunity_type FROM d_opp WHERE score >= 60")
def set03(t):
    opp = t.opportunity()
    return opp.select("event_id", "opportunity_type").exceptAll(opp.where("score >= 60").select("event_id", "opportunity_type"))


@check("set04_city_gaps", f"SELECT c.city_id, c.name AS city FROM d_city c WHERE c.city_id NOT IN (SELECT city_id FROM d_placed WHERE date_start BETWEEN {D} AND {D} + 1 AND city_id IS NOT NULL)")
def set04(t):
    return reports.city_gaps(t.city, t.with_places(t.event_between(0, 1)), AS_OF)


# ---- dimension and bridge joins --------------------------------------------------------------------------------------------------------------
@check("join01_dimension_lookup", "SELECT event_id, v_name, c_name, r_name FROM d_placed")
def join01(t):
    return t.with_places(t.event).select("event_id", "v_name", "c_name", "r_name")


@check("join02_child_join", "SELECT o.event_id, o.opportunity_type, e.title FROM d_opp o JOIN d_event e USING (event_id) WHERE o.score >= 50")
def join02(t):
    return t.opportunity().where("score >= 50").join(t.event.select("event_id", "title"), "event_id").select("event_id", "opportunity_type", "title")


@check("join03_left_with_predicate", f"SELECT v.venue_id, count(e.event_id) AS upcoming_events FROM d_venue v LEFT JOIN d_event e ON e.venue_id = v.venue_id AND e.date_start >= {D} AND e.status = 'SCHEDULED' GROUP BY 1")
def join03(t):
    return reports.dimension_counts(t.venue.select("venue_id"), t.event_between(0).where("status = 'SCHEDULED'"), "venue_id", AS_OF)


@check("join04_bridge", f"SELECT source_id, count(DISTINCT event_id) AS future_events FROM d_link JOIN d_event USING (event_id) WHERE date_start >= {D} GROUP BY 1")
def join04(t):
    return reports.future_events_per_source(t.event_source, t.event_between(0), AS_OF)


@check("join13_semi_join", "SELECT change_id FROM d_change WHERE change_id IN (SELECT run_id FROM d_prun WHERE started_at < TIMESTAMP '2024-01-10')")
def join13(t):
    old = t.pipeline_run.where(c("started_at") < F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")).select(c("run_id").alias("change_id"))
    return t.event_change.join(old, "change_id", "left_semi").select("change_id")


@check("join16_priority_lookup", """SELECT l.event_id, l.external_id, a.priority AS incoming, b.priority AS current, a.priority >= coalesce(b.priority, 0) AS wins FROM d_link l JOIN d_source a USING (source_id)
    JOIN d_event e USING (event_id) LEFT JOIN d_source b ON b.key = e.primary_source""")
def join16(t):
    a = t.source.select("source_id", c("priority").alias("incoming"))
    b = t.source.select(c("key").alias("primary_source"), c("priority").alias("current"))
    rows = t.event_source.join(a, "source_id").join(t.event.select("event_id", "primary_source"), "event_id").join(b, "primary_source", "left")
    return rows.select("event_id", "external_id", "incoming", "current", (c("incoming") >= F.coalesce("current", F.lit(0))).alias("wins"))


@check("join19_institution_lookup", "SELECT e.event_id, i.level FROM d_event e LEFT JOIN (SELECT lower('Organiser ' || (p_partkey % 40)) AS org, min(CASE WHEN p_partkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END) AS level FROM part GROUP BY 1) i ON i.org = lower(e.organizer)")
def join19(t):
    inst = t.table("part").selectExpr("lower(concat('Organiser ', cast(pmod(p_partkey, 40) as string))) org", "case when pmod(p_partkey, 2) = 0 then 'HIGH' else 'LOW' end level").groupBy("org").agg(F.min("level").alias("level"))
    return t.event.withColumn("org", F.lower("organizer")).join(inst, "org", "left").select("event_id", "level")
