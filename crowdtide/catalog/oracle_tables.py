"""The common tables as SQL: an independent statement of bindings.py and of the scoring rules, used only to check results."""

from __future__ import annotations

import re

from ..fixed_values import TITLE_STOP_WORDS

AS_OF = "DATE '1998-06-15'"
NOW = "TIMESTAMP '1998-06-15 12:00:00'"
LOG_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def name_sql(x: str) -> str:
    return f"coalesce(trim(regexp_replace(replace(replace(lower(strip_accents({x})), '&', ' and '), '''', ''), '[^a-z0-9]+', ' ', 'g')), '')"


def title_sql(x: str) -> str:
    stops = ", ".join(f"'{w}'" for w in TITLE_STOP_WORDS)
    return f"array_to_string(list_filter(string_split({name_sql(x)}, ' '), lambda w: w <> '' AND w NOT IN ({stops})), ' ')"


def band_sql(x: str) -> str:
    return (f"CASE WHEN coalesce({x}, 0) = 0 THEN 0.0 WHEN {x} >= 50000 THEN 1.0 WHEN {x} >= 30000 THEN 0.82 WHEN {x} >= 15000 THEN 0.62 "
            f"WHEN {x} >= 8000 THEN 0.45 WHEN {x} >= 3000 THEN 0.3 WHEN {x} >= 1000 THEN 0.2 ELSE 0.1 END::DOUBLE")


def level_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 80 THEN 'VERY_HIGH' WHEN {x} >= 65 THEN 'HIGH' WHEN {x} >= 50 THEN 'MEDIUM' WHEN {x} >= 35 THEN 'MODERATE' ELSE 'LOW' END"


def hours_sql(cat: str) -> str:
    return (f"CASE {cat} WHEN 'sports' THEN 2.25 WHEN 'music' THEN 3.0 WHEN 'festival' THEN 8.0 WHEN 'theatre' THEN 2.5 WHEN 'comedy' THEN 2.0 WHEN 'education' THEN 4.0 "
            f"WHEN 'conference' THEN 8.0 WHEN 'nightlife' THEN 5.0 WHEN 'family' THEN 2.0 WHEN 'other' THEN 3.0 ELSE 3.0 END::DOUBLE")


TABLES = {
    "d_region": "SELECT r_regionkey::BIGINT AS region_id, r_name AS name, 'England' AS country FROM region",
    "d_city": f"""SELECT n_nationkey::BIGINT AS city_id, n_name AS name, 'Greater ' || n_name AS alias1, n_regionkey::BIGINT AS region_id,
        (n_nationkey * 7 % 10) * 10 + 10 AS priority, (n_nationkey * 3 % 11) / 1e1 AS tourism, 50 + n_nationkey * 2e-1 AS latitude,
        -3 + (n_nationkey * 7 % 25) * 2e-1 AS longitude, {name_sql('n_name')} AS normalized_name FROM nation""",
    "d_venue": """SELECT *, round_even(CASE WHEN venue_type IN ('stadium', 'arena') THEN least(least(coalesce(capacity, 0) / 6e4, 1e0) + 0.1::DOUBLE, 1e0)
              ELSE least(coalesce(capacity, 0) / 6e4, 1e0) END, 3) AS importance_score
        FROM (SELECT c_custkey AS venue_id, c_name AS name, 'Hall ' || c_custkey AS alias1, c_nationkey::BIGINT AS city_id,
          CASE WHEN c_acctbal > 0 THEN trunc(c_acctbal * 10)::INT END AS capacity, 'registry' AS capacity_source,
          CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 50) / 1e1 END AS station_distance_km,
          CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey * 3 % 40)::DOUBLE END AS airport_distance_km, c_custkey % 10 <> 9 AS is_seeded,
          'M' || (c_custkey % 9 + 1) || ' ' || (c_custkey % 9) || 'AB' AS postcode, 50 + (c_custkey % 500) / 1e2 AS latitude,
          -3 + (c_custkey * 7 % 500) / 1e2 AS longitude,
          CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'stadium' WHEN 'BUILDING' THEN 'arena' WHEN 'FURNITURE' THEN 'theatre' WHEN 'HOUSEHOLD' THEN 'hall' ELSE 'other' END AS venue_type
        FROM customer)""",
    "d_source": f"""SELECT s_suppkey AS source_id, s_name AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'api' ELSE 'feed' END AS type, (s_suppkey % 10 * 10)::INT AS priority,
        s_suppkey % 8 <> 7 AS enabled, CASE WHEN s_suppkey % 6 = 5 THEN 'KEY_' || s_suppkey END AS requires_key,
        (['HEALTHY','DEGRADED','EMPTY','BLOCKED','FAILED','DISABLED'])[(s_suppkey % 6)::INT + 1] AS status,
        {LOG_NOW} - to_hours((s_suppkey * 5 % 120)::INT) AS last_success_at,
        trunc(CASE WHEN s_acctbal > 0 THEN s_acctbal / 100 ELSE 0 END)::INT AS last_events_collected, NULL::VARCHAR AS last_error FROM supplier""",
    "d_event": f"""SELECT o_orderkey AS event_id, o_orderdate::DATE AS date_start, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate::DATE + (o_orderkey % 3)::INT END AS date_end,
        CASE WHEN o_orderkey % 9 <> 0 THEN lpad((8 + o_orderkey % 15)::VARCHAR, 2, '0') || CASE WHEN o_orderkey % 2 = 0 THEN ':30' ELSE ':00' END END AS time_start,
        CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 4 = 0 THEN lpad(((10 + o_orderkey % 15 + o_orderkey % 3) % 24)::VARCHAR, 2, '0') || ':15' END AS time_end,
        CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS venue_id,
        CASE WHEN o_orderkey % 17 <> 0 THEN 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') END AS venue_name_raw,
        CASE WHEN o_orderkey % 19 <> 0 THEN 'NATION_' || (o_orderkey % 25) END AS city_name_raw,
        CASE WHEN o_orderkey % 23 = 0 THEN 'CANCELLED' WHEN o_orderkey % 11 = 0 THEN 'SOLD_OUT' WHEN o_orderkey % 14 = 0 THEN 'RESCHEDULED' WHEN o_orderstatus = 'F' THEN 'CONFIRMED'
          WHEN o_orderstatus = 'P' AND o_custkey % 4 = 0 THEN 'POSTPONED' ELSE 'SCHEDULED' END AS status,
        'Supplier#' || lpad((o_orderkey % 10)::VARCHAR, 9, '0') AS primary_source, (o_orderkey % 3 + 1)::INT AS source_count,
        {NOW} - to_hours((o_orderkey * 7 % 700)::INT) AS last_verified_at,
        CASE WHEN o_orderkey % 4 <> 1 THEN 'https://tickets.example/e/' || o_orderkey END AS official_url,
        CASE WHEN o_orderkey % 6 = 1 THEN 'https://tickets.example/buy/' || o_orderkey END AS ticket_url,
        CASE WHEN o_orderkey % 13 <> 0 THEN 50 + (o_custkey % 500) / 1e2 END AS latitude, CASE WHEN o_orderkey % 13 <> 0 THEN -3 + (o_custkey * 7 % 500) / 1e2 END AS longitude,
        CASE WHEN o_orderkey % 8 = 0 THEN 'Organiser ' || (o_custkey % 20) END AS organizer, CASE WHEN o_orderkey % 3 = 0 THEN 'M1 1AA' END AS postcode, o_totalprice,
        (['music','sports','theatre','comedy','education','festival','conference','family','arts','community','nightlife','other'])[(o_orderkey % 12)::INT + 1] AS category,
        (['concert','football','show','standup','school','general','business','attraction','exhibition','talk','club','general'])[(o_orderkey % 12)::INT + 1] AS subcategory,
        (['Orchestra Night','City v United','Macbeth at the Playhouse','Stand-up Special','School Concert','Street Food Festival','Careers Fair','Circus Spectacular',
          'Gallery Opening','Guest Lecture','DJ Set Saturday','The Open Evening'])[(o_orderkey % 12)::INT + 1] || ' ' || (o_custkey % 40) AS title,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'OFFICIAL' WHEN '2-HIGH' THEN 'TRUSTED' WHEN '3-MEDIUM' THEN 'CURATED' WHEN '4-NOT SPECIFIED' THEN 'SECONDARY' ELSE 'UNVERIFIED' END AS source_confidence,
        CASE WHEN o_custkey % 3 = 0 THEN 'HIGH' ELSE 'LOW' END AS school_confidence,
        CASE WHEN o_orderkey % 29 = 0 THEN 'SOURCE SILENT: not returned' ELSE 'Listed by source' END AS status_reason FROM orders""",
    "d_placed": f"""SELECT e.*, v.city_id, c.region_id, v.capacity AS venue_capacity, v.name AS v_name, v.capacity AS v_capacity, v.importance_score AS v_importance, v.is_seeded AS v_seeded,
        v.station_distance_km AS v_station_km, v.airport_distance_km AS v_airport_km, c.name AS c_name, c.priority AS c_priority, c.tourism AS c_tourism, r.name AS r_name,
        {title_sql('e.title')} AS normalized_title,
        {name_sql('coalesce(c.name, e.city_name_raw)')} IN ('nation 1', 'nation 2', 'nation 3', 'nation 7', 'nation 11') AS in_area,
        CASE WHEN date_diff('second', e.last_verified_at, {NOW}) >= 14 * 86400 THEN 10
          ELSE round_even(100 - 90e0 * (greatest(0e0, date_diff('second', e.last_verified_at, {NOW}) / 86400e0) / 14e0), 0)::INT END AS freshness_score
        FROM d_event e LEFT JOIN d_venue v USING (venue_id) LEFT JOIN d_city c ON c.city_id = v.city_id LEFT JOIN d_region r ON r.region_id = c.region_id""",
    "d_rated": """SELECT *, CASE WHEN event_quality_score >= 75 THEN 'HIGH' WHEN event_quality_score >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS quality_level FROM (
        SELECT *, greatest(0, least(100, (CASE source_confidence WHEN 'OFFICIAL' THEN 40 WHEN 'TRUSTED' THEN 32 WHEN 'CURATED' THEN 30 WHEN 'SECONDARY' THEN 20 ELSE 8 END)
          + (CASE WHEN time_start IS NOT NULL THEN 12 ELSE 0 END) + (CASE WHEN venue_id IS NOT NULL THEN 12 WHEN venue_name_raw IS NOT NULL THEN 6 ELSE 0 END)
          + (CASE WHEN city_id IS NOT NULL THEN 8 ELSE 0 END) + (CASE WHEN official_url IS NOT NULL OR ticket_url IS NOT NULL THEN 8 ELSE 0 END)
          + (CASE WHEN postcode IS NOT NULL OR latitude IS NOT NULL THEN 5 ELSE 0 END) + (CASE WHEN category <> 'other' THEN 5 ELSE 0 END)
          + (CASE WHEN source_count >= 2 THEN 10 ELSE 0 END)
          + (CASE WHEN category = 'education' AND subcategory IN ('school', 'college') AND school_confidence <> 'HIGH' THEN -20 ELSE 0 END)
          + (CASE WHEN freshness_score < 40 THEN -15 ELSE 0 END))) AS event_quality_score FROM d_placed)""",
    "d_factors": f"""SELECT *, {band_sql('attendance_estimate')} AS att_band, {band_sql('v_capacity')} AS cap_band FROM (
        SELECT *, CASE WHEN coalesce(v_capacity, 0) <> 0 THEN trunc(v_capacity * (CASE category WHEN 'sports' THEN 0.9 WHEN 'music' THEN 0.85 WHEN 'festival' THEN 0.7 WHEN 'theatre' THEN 0.75
          WHEN 'comedy' THEN 0.7 WHEN 'education' THEN 0.6 WHEN 'conference' THEN 0.5 WHEN 'nightlife' THEN 0.7 WHEN 'family' THEN 0.6 WHEN 'other' THEN 0.4 ELSE 0.5 END::DOUBLE))::INT END AS attendance_estimate,
          left(time_start, 2)::INT AS sh, left(time_end, 2)::INT AS eh, isodow(date_start) AS dow, {hours_sql('category')} AS default_hours FROM d_rated)""",
    "d_parts": """SELECT *,
        round_even((CASE WHEN coalesce(attendance_estimate, 0) = 0 THEN 0.15::DOUBLE ELSE att_band END) * 20, 1) AS k_event_scale,
        round_even((CASE WHEN v_name IS NULL THEN 0.15::DOUBLE WHEN coalesce(v_capacity, 0) = 0 THEN 0.3::DOUBLE ELSE least(1e0, 0.8::DOUBLE * cap_band + 0.2::DOUBLE * coalesce(v_importance, 0)) END) * 20, 1) AS k_venue_scale,
        round_even(least((CASE WHEN time_start IS NULL THEN 0.5::DOUBLE ELSE (CASE WHEN sh >= 17 THEN 0.75 WHEN sh >= 12 THEN 0.5 ELSE 0.35 END::DOUBLE) + (CASE WHEN eh >= 22 THEN 0.15 ELSE 0 END::DOUBLE) END)
          + (CASE WHEN dow >= 6 THEN 0.25 WHEN dow = 5 THEN 0.15 ELSE 0 END::DOUBLE), 1e0) * 15, 1) AS k_timing,
        round_even((CASE WHEN c_name IS NULL THEN 0.2::DOUBLE WHEN in_area THEN least(1e0, c_priority / 1e2 + 0.2::DOUBLE) ELSE c_priority / 1e2 END) * 15, 1) AS k_location,
        round_even((CASE WHEN v_station_km IS NULL THEN 0.5::DOUBLE ELSE least(1e0, (CASE WHEN v_station_km <= 0.5 THEN 0.35 WHEN v_station_km <= 1.5 THEN 0.55 WHEN v_station_km <= 3 THEN 0.8 ELSE 1.0 END::DOUBLE)
          + (CASE WHEN coalesce(nullif(v_airport_km, 0), 50) <= 5 THEN 0.3 WHEN coalesce(nullif(v_airport_km, 0), 50) <= 15 THEN 0.15 ELSE 0 END::DOUBLE)) END) * 10, 1) AS k_transport,
        round_even((CASE category WHEN 'music' THEN 1.0 WHEN 'sports' THEN 0.95 WHEN 'festival' THEN 0.85 WHEN 'nightlife' THEN 0.8 WHEN 'theatre' THEN 0.7 WHEN 'comedy' THEN 0.65 WHEN 'education' THEN 0.6
          WHEN 'conference' THEN 0.55 WHEN 'family' THEN 0.5 WHEN 'arts' THEN 0.4 WHEN 'community' THEN 0.35 ELSE 0.3 END::DOUBLE) * 10, 1) AS k_category,
        round_even(coalesce(c_tourism, 0.2::DOUBLE) * 5, 1) AS k_tourism,
        round_even((CASE WHEN date_end > date_start THEN least(1e0, 0.5::DOUBLE + (date_end - date_start + 1) * 0.1::DOUBLE) WHEN time_start IS NOT NULL AND time_end IS NOT NULL
          THEN least(1e0, ((eh - sh + 24) % 24) / 8e0) ELSE least(1e0, default_hours / 8e0) END) * 5, 1) AS k_duration FROM d_factors""",
    "d_scored": f"""SELECT *, {level_sql('opportunity_score')} AS demand_level,
        CASE WHEN opportunity_score >= 80 THEN 'P1' WHEN opportunity_score >= 65 THEN 'P2' WHEN opportunity_score >= 50 THEN 'P3' END AS marketing_priority,
        strftime(w_start - to_minutes(180), '%H:%M') AS pre_start, strftime(w_start, '%H:%M') AS pre_end, strftime(w_end, '%H:%M') AS post_start,
        strftime(w_end + to_minutes(150), '%H:%M') AS post_end, strftime(w_end + to_minutes(20), '%H:%M') AS peak
        FROM (SELECT *, CASE WHEN time_end IS NULL THEN w_start + to_minutes((default_hours * 60)::INT)
            WHEN date_start + (time_end || ':00')::TIME <= w_start THEN date_start + (time_end || ':00')::TIME + INTERVAL 1 DAY ELSE date_start + (time_end || ':00')::TIME END AS w_end
        FROM (SELECT *, CASE WHEN status IN ('CANCELLED', 'POSTPONED') THEN 0 ELSE greatest(0, least(100,
            round_even(k_event_scale + k_venue_scale + k_timing + k_location + k_transport + k_category + k_tourism + k_duration, 0)::INT)) END AS opportunity_score,
            date_start + (time_start || ':00')::TIME AS w_start FROM d_parts))""",
    "d_opp": f"""SELECT *, {level_sql('score')} AS demand_level FROM (SELECT *, greatest(0, least(100, round_even(k_demand + k_quality + k_freshness + k_area, 0)::INT)) AS score
        FROM (SELECT e.event_id, e.quality_level AS confidence, t.kind AS opportunity_type, t.win,
          round_even(e.opportunity_score * t.factor * 55e0 / 100e0, 1) AS k_demand, round_even(e.event_quality_score * 20e0 / 100e0, 1) AS k_quality,
          round_even(e.freshness_score * 10e0 / 100e0, 1) AS k_freshness, CASE WHEN e.in_area THEN 15e0 ELSE 0e0 END AS k_area,
          CASE t.win WHEN 'pre' THEN e.pre_start WHEN 'post' THEN e.post_start ELSE '00:00' END AS window_start,
          CASE t.win WHEN 'pre' THEN e.pre_end WHEN 'post' THEN e.post_end ELSE '23:59' END AS window_end
        FROM d_scored e JOIN (VALUES ('HOME_TO_VENUE', 0.9::DOUBLE, 'pre', ''), ('VENUE_TO_HOME', 1e0, 'post', ''), ('STATION_TO_VENUE', 0.75::DOUBLE, 'pre', 'station'),
          ('VENUE_TO_STATION', 0.75::DOUBLE, 'post', 'station'), ('HOTEL_TO_VENUE', 0.65::DOUBLE, 'pre', 'hotel'), ('VENUE_TO_HOTEL', 0.65::DOUBLE, 'post', 'hotel'),
          ('AIRPORT_TO_VENUE', 0.6::DOUBLE, 'pre', 'airport'), ('VENUE_TO_AIRPORT', 0.55::DOUBLE, 'post', 'airport'), ('LATE_NIGHT_RETURN', 0.95::DOUBLE, 'post', 'late'),
          ('PRE_BOOKING', 0.8::DOUBLE, 'day', '')) t(kind, factor, win, need)
          ON e.opportunity_score >= 35 AND e.status NOT IN ('CANCELLED', 'POSTPONED', 'COMPLETED')
          AND (t.need = '' OR (t.need = 'station' AND e.v_station_km IS NOT NULL) OR (t.need = 'hotel' AND coalesce(e.c_tourism, 0.2::DOUBLE) >= 0.5)
               OR (t.need = 'airport' AND e.v_airport_km <= 20) OR (t.need = 'late' AND e.sh >= 18))))""",
    "d_gate": f"""SELECT *, date_start - {AS_OF} AS days, CASE WHEN status IN ('CANCELLED', 'POSTPONED', 'COMPLETED') THEN 'status ' || status
          WHEN opportunity_score < 65 THEN 'opportunity score ' || opportunity_score || ' < 65' WHEN quality_level = 'LOW' THEN 'quality LOW below MEDIUM' WHEN NOT in_area THEN 'outside service area'
          WHEN date_start - {AS_OF} NOT BETWEEN 0 AND 30 THEN (date_start - {AS_OF}) || ' days ahead outside window' END AS gate_failure,
        'opportunity score ' || opportunity_score || ' ≥ 65; quality ' || quality_level || ' (' || event_quality_score || '); status ' || status || '; ' || (date_start - {AS_OF})
          || ' days ahead; inside service area' || CASE WHEN coalesce(v_capacity, 0) <> 0 THEN '; venue capacity ' || format('{{:,}}', v_capacity::BIGINT) || ' (registry)' ELSE '' END AS reason FROM d_scored""",
    "d_action": f"""SELECT *, event_id * 10 + ordinal AS action_id, (['NEW','PLANNED','DONE','NEW','DISMISSED_AUTO'])[((event_id + ordinal) % 5)::INT + 1] AS action_status,
          {NOW} - to_hours((event_id % 200)::INT) AS created_at FROM (
        SELECT g.event_id, g.reason, coalesce(g.marketing_priority, 'P3') AS priority, g.date_start, g.opportunity_score, g.title AS event_title, g.venue_name_raw, g.city_name_raw, g.v_name, t.kind AS action_type,
          row_number() OVER (PARTITION BY g.event_id ORDER BY t.n) - 1 AS ordinal, CASE t.lead WHEN 'lead' THEN (g.date_start - 7)::VARCHAR WHEN 'before' THEN (g.date_start - 1)::VARCHAR
            WHEN 'day' THEN g.date_start::VARCHAR ELSE (g.date_start - 14)::VARCHAR END AS recommended_date,
          replace(replace(replace(t.title, '@V', coalesce(g.v_name, g.venue_name_raw, 'the venue')), '@T', g.title), '@L',
            'Landing page /taxi-' || trim(regexp_replace(lower(coalesce(g.v_name, g.venue_name_raw, 'the venue')), '[^a-z0-9]+', '-', 'g'), '-') || '/') AS title
        FROM d_gate g JOIN (VALUES (1, 'SEO', '', 'lead', 'Optimise for “taxi to @V”'), (2, 'GOOGLE_ADS', '', 'before', 'Search campaign: “taxi near @V”'), (3, 'LANDING_PAGE', '', 'lead', '@L'),
          (4, 'GBP_POST', '', 'before', 'Google Business Profile update for @T'), (5, 'SOCIAL_POST', '', 'day', 'Social post: @T'), (6, 'META_ADS', 'hot', 'before', 'Meta Ads: @T'),
          (7, 'WHATSAPP_CTA', 'hot', 'before', 'WhatsApp booking CTA'), (8, 'EMAIL', 'large', 'lead', 'Email campaign: @T'), (9, 'PARTNERSHIP', 'large', 'far', 'Partnership outreach: @V'))
          t(n, kind, need, lead, title) ON g.gate_failure IS NULL AND (t.need <> 'large' OR (g.v_capacity >= 15000 AND g.opportunity_score >= 70)))""",
    "d_link": "SELECT l_orderkey AS event_id, l_suppkey AS source_id, l_orderkey || '-' || l_linenumber AS external_id FROM lineitem",
    "d_run": """SELECT event_id AS run_id, user_id AS source_id, ts AS started_at, ts + to_seconds((event_id % 90)::INT) AS completed_at,
        CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'HEALTHY' WHEN 'view' THEN 'DEGRADED' WHEN 'signup' THEN 'EMPTY' ELSE 'HEALTHY' END AS status,
        CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE trunc(value)::INT END AS events_collected, (event_id * 37 % 900)::INT AS response_ms,
        CASE WHEN event_type = 'error' THEN 'timeout ' || (event_id % 7) END AS error FROM events""",
    "d_prun": """SELECT event_id AS run_id, CASE WHEN event_id % 4 = 0 THEN 'manual' ELSE 'cron' END AS trigger,
        CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'SUCCESS' WHEN 'view' THEN 'PARTIAL' WHEN 'signup' THEN 'RUNNING' ELSE 'SUCCESS' END AS status, ts AS started_at,
        CASE WHEN event_type <> 'signup' THEN ts + to_seconds((event_id % 90)::INT) END AS completed_at, (event_id % 90)::DOUBLE AS duration_seconds, (event_id % 13)::INT AS sources_attempted,
        trunc(value)::INT AS events_raw, trunc(value / 2)::INT AS events_valid FROM events""",
    "d_change": """SELECT event_id AS change_id, user_id * 7 AS event_id, ts AS detected_at, CASE event_type WHEN 'error' THEN 'CANCELLED' WHEN 'click' THEN 'TIME_CHANGED' WHEN 'view' THEN 'UPDATED'
        WHEN 'signup' THEN 'NEW' ELSE 'DATE_CHANGED' END AS change_type, json_extract_string(props, '$.k') AS new_value FROM events""",
    "d_snap": "SELECT event_id AS snapshot_id, user_id AS event_id, ts AS taken_at, event_type AS reason, event_type || '-' || trunc(value)::INT AS snapshot_hash FROM events",
    "d_booking": """SELECT *, CASE WHEN booking_id % 2 = 0 THEN pickup_lat + 0.001::DOUBLE END AS dropoff_lat, CASE WHEN booking_id % 2 = 0 THEN pickup_lon + 0.001::DOUBLE END AS dropoff_lon FROM (
        SELECT event_id AS booking_id, ts AS pickup_datetime, 50 + (user_id % 500) / 1e2 + (event_id % 7 - 3) * 0.002::DOUBLE AS pickup_lat,
        -3 + (user_id * 7 % 500) / 1e2 + (event_id % 5 - 2) * 0.003::DOUBLE AS pickup_lon, value AS fare FROM events)""",
    "d_bevent": """SELECT o_orderkey AS event_id, TIMESTAMP '2024-01-01' + to_hours((o_orderkey * 5 % 700)::INT) AS start, 50 + (o_custkey % 500) / 1e2 AS latitude,
        -3 + (o_custkey * 7 % 500) / 1e2 AS longitude, CASE WHEN o_totalprice > 20000 THEN trunc(o_totalprice / 10)::INT END AS venue_capacity,
        (['music','sports','theatre','comedy','education','festival','conference','family','arts','community','nightlife','other'])[(o_orderkey % 12)::INT + 1] AS category FROM orders""",
    "d_match": """SELECT event_id, booking_id, leg, round_even(dist, 3) AS distance_km, delta AS time_delta_min,
        round_even(greatest(0e0, 1e0 - dist) * (0.5::DOUBLE + 0.5::DOUBLE * greatest(0e0, 1e0 - abs(CASE WHEN leg = 'DROPOFF' THEN delta ELSE delta - 150 END) / (CASE WHEN leg = 'DROPOFF' THEN 180 ELSE 390 END)::DOUBLE)), 3) AS match_confidence
        FROM (SELECT e.event_id, b.booking_id, b.leg, floor(date_diff('microsecond', e.start, b.pickup_datetime) / 6e7)::INT AS delta,
          2 * 6371e0 * asin(sqrt(pow(sin((radians(e.latitude) - radians(b.lat)) / 2), 2) + cos(radians(b.lat)) * cos(radians(e.latitude)) * pow(sin((radians(e.longitude) - radians(b.lon)) / 2), 2))) AS dist
          FROM d_bevent e JOIN (SELECT booking_id, pickup_datetime, 'DROPOFF' AS leg, dropoff_lat AS lat, dropoff_lon AS lon FROM d_booking WHERE dropoff_lat IS NOT NULL
            UNION ALL SELECT booking_id, pickup_datetime, 'PICKUP', pickup_lat, pickup_lon FROM d_booking) b
          ON b.pickup_datetime BETWEEN e.start - to_minutes(180) AND e.start + to_minutes(390) AND abs(b.lat - e.latitude) <= 1 / 111e0
            AND abs(b.lon - e.longitude) <= 1 / (111e0 * greatest(cos(radians(e.latitude)), 0.2::DOUBLE)))
        WHERE dist <= 1 AND ((leg = 'DROPOFF' AND delta <= 30) OR (leg = 'PICKUP' AND delta >= 0))""",
}
_NAME = re.compile(r"\bd_[a-z]+\b")


def with_tables(sql: str) -> str:
    """Prefix the query with the common tables it needs, in dependency order."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in TABLES and name not in need:
                visit(TABLES[name])
                need.append(name)

    visit(sql)
    if not need:
        return sql
    ctes = ", ".join(f"{n} AS ({TABLES[n]})" for n in need)
    head = sql.lstrip()
    if head[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {head[15:]}"
    if head[:5].upper() == "WITH ":
        return f"WITH {ctes}, {head[5:]}"
    return f"WITH {ctes} {sql}"
