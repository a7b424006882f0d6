"""Demand, quality, status, opportunity expressions.  Rules come from fixed_values and become CASE expressions."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..session import pin
from .dates import freshness_score, hour_of, local_datetime, minutes_interval, weekend
from .text import choose, keyword_hit, lookup, normalize_name


def ladder(score: Column, steps: Sequence[tuple], default: Column | None = None) -> Column:
    """First (label, floor) whose floor is reached; steps are in descending order."""
    return choose([(score >= floor, F.lit(label)) for label, floor in steps], default)


def demand_level(score: Column) -> Column:
    return ladder(score, V.DEMAND_LEVELS, F.lit("LOW"))


def marketing_priority(score: Column) -> Column:
    return ladder(score, V.MARKETING_PRIORITIES)


def capacity_factor(capacity: Column) -> Column:
    by_band = ladder(capacity, [(factor, floor) for floor, factor in V.CAPACITY_BANDS], F.lit(0.1))
    return F.when(F.coalesce(capacity, F.lit(0)) == 0, F.lit(0.0)).otherwise(by_band)


def category_factor(category: Column) -> Column:
    return lookup(category, V.CATEGORY_FACTORS, F.lit(V.DEFAULT_CATEGORY_FACTOR))


def venue_importance(capacity: Column, venue_type: Column) -> Column:
    base = F.least(F.coalesce(capacity, F.lit(0)) / F.lit(60000.0), F.lit(1.0))
    return F.bround(F.when(venue_type.isin("stadium", "arena"), F.least(base + 0.1, F.lit(1.0))).otherwise(base), 3)


def attendance_estimate(category: Column, capacity: Column) -> Column:
    rate = lookup(category, V.FILL_RATES, F.lit(V.DEFAULT_FILL_RATE))
    return F.when(F.coalesce(capacity, F.lit(0)) != 0, (capacity * rate).cast("int"))


def venue_scale(has_venue: Column, capacity: Column, importance: Column) -> Column:
    scaled = F.least(F.lit(1.0), F.lit(0.8) * capacity_factor(capacity) + F.lit(0.2) * F.coalesce(importance, F.lit(0.0)))
    return F.when(~has_venue, F.lit(0.15)).when(F.coalesce(capacity, F.lit(0)) == 0, F.lit(0.3)).otherwise(scaled)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def venue_reason(has_venue: Column, name: Column, capacity: Column, factor: Column) -> Column:
    label = ladder(factor, [("Major venue", 0.8), ("Large venue", 0.6), ("Mid-size venue", 0.4)], F.lit("Small venue"))
    return (F.when(~has_venue, F.lit("Venue unknown"))
            .when(F.coalesce(capacity, F.lit(0)) == 0, F.concat(name, F.lit(": capacity not published")))
            .otherwise(F.concat(label, F.lit(" ("), name, F.lit(", capacity "), thousands(capacity), F.lit(")"))))


def transport_factor(station_km: Column, airport_km: Column) -> Column:
    air = F.coalesce(F.nullif(airport_km, F.lit(0.0)), F.lit(50.0))
    station = F.when(station_km <= 0.5, 0.35).when(station_km <= 1.5, 0.55).when(station_km <= 3, 0.8).otherwise(1.0)
    airport = F.when(air <= 5, 0.3).when(air <= 15, 0.15).otherwise(0.0)
    return F.when(station_km.isNull(), F.lit(0.5)).otherwise(F.least(F.lit(1.0), station + airport))


def transport_reason(station_km: Column, airport_km: Column) -> Column:
    air = F.coalesce(F.nullif(airport_km, F.lit(0.0)), F.lit(50.0))
    rail = (F.when(station_km <= 0.5, F.lit("Strong rail connectivity")).when(station_km <= 1.5, F.lit("Moderate rail access"))
            .otherwise(F.lit("Limited rail access — taxi reliant")))
    near = F.when(air <= 15, F.concat(F.lit("; airport "), F.bround(air, 0).cast("int").cast("string"), F.lit(" km"))).otherwise(F.lit(""))
    return F.when(station_km.isNull(), F.lit("Transport access unknown")).otherwise(F.concat(rail, near))


def timing_factor(date_start: Column, time_start: Column, time_end: Column) -> Column:
    h = hour_of(time_start)
    by_hour = F.when(h >= V.EVENING_HOUR, 0.75).when(h >= V.NOON_HOUR, 0.5).otherwise(0.35)
    late = F.when(hour_of(time_end) >= V.LATE_FINISH_HOUR, V.LATE_BONUS).otherwise(0.0)
    base = F.when(time_start.isNull(), F.lit(V.UNKNOWN_TIME_FACTOR)).otherwise(by_hour + late)
    bonus = F.when(weekend(date_start), V.WEEKEND_BONUS).when(F.weekday(date_start) == 4, V.FRIDAY_BONUS).otherwise(0.0)
    return F.least(base + bonus, F.lit(1.0))


def timing_reasons(date_start: Column, time_start: Column, time_end: Column) -> list[Column]:
    h = hour_of(time_start)
    return [
        F.when(time_start.isNull(), F.lit("Start time not yet confirmed"))
        .when(h >= V.EVENING_HOUR, F.lit("Evening event — late return journeys"))
        .when(h >= V.NOON_HOUR, F.lit("Afternoon event")).otherwise(F.lit("Morning start")),
        F.when(time_start.isNotNull() & (hour_of(time_end) >= V.LATE_FINISH_HOUR), F.lit("Late finish after public transport thins out")),
        F.when(weekend(date_start), F.lit("Weekend")).when(F.weekday(date_start) == 4, F.lit("Friday")),
    ]


def location_factor(has_city: Column, priority: Column, in_area: Column) -> Column:
    base = F.coalesce(F.nullif(priority, F.lit(0)), F.lit(50)) / F.lit(100.0)
    return F.when(~has_city, F.lit(0.2)).when(in_area, F.least(F.lit(1.0), base + 0.2)).otherwise(base)


def default_hours(category: Column) -> Column:
    return lookup(category, V.DEFAULT_DURATION_HOURS, F.lit(V.FALLBACK_DURATION_HOURS))


def duration_factor(category: Column, date_start: Column, date_end: Column, time_start: Column, time_end: Column) -> Column:
    days = F.datediff(date_end, date_start) + 1
    hours = F.pmod(hour_of(time_end) - hour_of(time_start), F.lit(24))
    return (F.when(date_end > date_start, F.least(F.lit(1.0), F.lit(0.5) + days * F.lit(0.1)))
            .when(time_start.isNotNull() & time_end.isNotNull(), F.least(F.lit(1.0), hours / F.lit(8.0)))
            .otherwise(F.least(F.lit(1.0), default_hours(category) / F.lit(8.0))))


def _default_hours_text(category: Column) -> Column:
    return lookup(category, {k: str(v) for k, v in V.DEFAULT_DURATION_HOURS.items()}, F.lit(f"{V.FALLBACK_DURATION_HOURS:g}"))


def duration_reason(category: Column, date_start: Column, date_end: Column, time_start: Column, time_end: Column) -> Column:
    days = F.datediff(date_end, date_start) + 1
    hours = F.pmod(hour_of(time_end) - hour_of(time_start), F.lit(24))
    return (F.when(date_end > date_start, F.concat(F.lit("Multi-day event ("), days.cast("string"), F.lit(" days)")))
            .when(time_start.isNotNull() & time_end.isNotNull(), F.concat(F.lit("Duration ≈ "), hours.cast("string"), F.lit("h")))
            .otherwise(F.concat(F.lit("Typical "), category, F.lit(" duration ≈ "), _default_hours_text(category), F.lit("h (modelled)"))))


def demand_windows(category: Column, date_start: Column, time_start: Column, time_end: Column) -> Column:
    """Modelled arrival, event and departure windows as HH:MM text; wall-clock arithmetic, no DST."""
    start = local_datetime(date_start, time_start)
    given = local_datetime(date_start, time_end)
    rolled = F.when(given <= start, given + F.expr("INTERVAL 1 DAY")).otherwise(given)
    end = F.when(time_end.isNotNull(), rolled).otherwise(start + minutes_interval(default_hours(category) * 60))

    def text(ts: Column) -> Column:
        return F.date_format(ts, "HH:mm")

    pre = start - minutes_interval(F.lit(V.PRE_EVENT_MINUTES))
    post = end + minutes_interval(F.lit(V.POST_EVENT_MINUTES))
    peak = end + minutes_interval(F.lit(V.PEAK_MINUTES))
    return F.struct(
        F.lit("Modelled demand window").alias("label"),
        time_start.isNotNull().alias("available"),
        F.when(time_start.isNull(), F.lit("Start time unknown")).alias("reason"),
        text(pre).alias("pre_start"), text(start).alias("pre_end"),
        text(start).alias("event_start"), text(end).alias("event_end"),
        text(end).alias("post_start"), text(post).alias("post_end"), text(peak).alias("peak"),
        (time_start.isNotNull() & time_end.isNull()).alias("end_estimated"),
    )


COMPONENTS = list(V.SCORE_WEIGHTS)


def score_events(events: DataFrame) -> DataFrame:
    """Adds the demand score with components, reasons, attendance and windows.

    Needs: category, date_start, date_end, time_start, time_end, status and the joined dimension columns v_name, v_capacity,
    v_importance, v_seeded, v_station_km, v_airport_km, c_name, c_priority, c_tourism, in_area.  Narrow: no shuffle.
    """
    x = _demand_expressions()
    attended = pin(events, **x["first"])
    scored = pin(pin(attended, components=x["components"]), opportunity_score=x["score"])
    return scored.withColumns(x["last"]).drop("_venue_factor")


@functools.cache
def _demand_expressions() -> dict:
    """The expressions of score_events; they name columns only, so they are built once."""
    c = F.col
    has_venue, has_city = c("v_name").isNotNull(), c("c_name").isNotNull()
    when = (c("date_start"), c("time_start"), c("time_end"))
    span = (c("category"), c("date_start"), c("date_end"), c("time_start"), c("time_end"))
    first = {"attendance_estimate": attendance_estimate(c("category"), c("v_capacity")), "_venue_factor": venue_scale(has_venue, c("v_capacity"), c("v_importance"))}
    tourism = F.coalesce(c("c_tourism"), F.lit(0.2))
    factors = {
        "event_scale": F.when(F.coalesce(c("attendance_estimate"), F.lit(0)) == 0, F.lit(0.15)).otherwise(capacity_factor(c("attendance_estimate"))),
        "venue_scale": c("_venue_factor"),
        "timing": timing_factor(*when),
        "location": location_factor(has_city, c("c_priority"), c("in_area")),
        "transport": transport_factor(c("v_station_km"), c("v_airport_km")),
        "category": category_factor(c("category")),
        "tourism": tourism,
        "duration": duration_factor(*span),
    }
    components = F.struct(*[F.bround(f * F.lit(float(V.SCORE_WEIGHTS[k])), 1).alias(k) for k, f in factors.items()])
    total = c("components.event_scale")
    for k in COMPONENTS[1:]:
        total = total + c(f"components.{k}")
    dead = c("status").isin("CANCELLED", "POSTPONED")
    score = F.when(dead, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.bround(total, 0).cast("int"))))
    reasons = F.array_compact(F.array(
        F.when(dead, F.concat(F.lit("Event "), F.lower(c("status")), F.lit(" — no demand expected"))),
        F.when(F.coalesce(c("attendance_estimate"), F.lit(0)) != 0, F.concat(F.lit("Modelled attendance ≈ "), thousands(c("attendance_estimate"))))
        .otherwise(F.lit("Attendance unknown (no published capacity)")),
        venue_reason(has_venue, c("v_name"), c("v_capacity"), c("_venue_factor")),
        *timing_reasons(*when),
        F.when(has_city, F.concat(c("c_name"), F.lit(" (priority "), c("c_priority").cast("string"), F.lit(")"))).otherwise(F.lit("City unresolved")),
        F.when(has_city & c("in_area"), F.lit("Inside taxi service area")),
        transport_reason(c("v_station_km"), c("v_airport_km")),
        F.concat(F.lit("Category: "), c("category")),
        F.when(tourism >= 0.7, F.lit("High-tourism city — hotel/airport transfers")),
        duration_reason(*span),
    ))
    last = {
        "demand_level": demand_level(c("opportunity_score")),
        "marketing_priority": marketing_priority(c("opportunity_score")),
        "reasons": reasons,
        "attendance_confidence": F.when(c("attendance_estimate").isNotNull(), F.when(c("v_seeded"), F.lit("MEDIUM")).otherwise(F.lit("LOW"))),
        "windows": demand_windows(c("category"), c("date_start"), c("time_start"), c("time_end")),
    }
    return {"first": first, "components": components, "score": score, "last": last}


# ---- quality -------------------------------------------------------------------------------------------------------
def confidence_rank(conf: Column) -> Column:
    return lookup(conf, V.CONFIDENCE_RANK, F.lit(0))


def better_confidence(existing: Column, incoming: Column) -> Column:
    """Higher-ranked of two; the existing one on a tie; UNVERIFIED when both are missing."""
    pick = F.when(existing.isNull() | (F.coalesce(confidence_rank(incoming), F.lit(-1)) > confidence_rank(existing)), F.coalesce(incoming, existing)).otherwise(existing)
    return F.coalesce(F.nullif(pick, F.lit("")), F.lit("UNVERIFIED"))


def score_quality(events: DataFrame) -> DataFrame:
    """Adds event_quality_score, quality_level, quality_reasons.

    Needs: source_confidence, time_start, venue_id, venue_name_raw, city_id, official_url, ticket_url, postcode, latitude,
    category, subcategory, source_count, freshness_score, school_confidence.
    """
    total, reasons = _quality_expressions()
    return (
        pin(events, event_quality_score=F.greatest(F.lit(0), F.least(F.lit(100), total)))
        .withColumn("quality_level", ladder(F.col("event_quality_score"), V.QUALITY_LEVELS, F.lit("LOW")))
        .withColumn("quality_reasons", reasons)
    )


@functools.cache
def _quality_expressions() -> tuple[Column, Column]:
    c = F.col
    conf = F.coalesce(F.nullif(c("source_confidence"), F.lit("")), F.lit("UNVERIFIED"))
    base = lookup(conf, V.CONFIDENCE_POINTS, F.lit(V.CONFIDENCE_POINTS["UNVERIFIED"]))
    school = (c("category") == "education") & F.coalesce(c("subcategory"), F.lit("")).isin("school", "college")
    school_level = F.coalesce(c("school_confidence"), F.lit("LOW"))
    sources = F.coalesce(c("source_count"), F.lit(1))
    matched = c("venue_id").isNotNull()
    named = ~matched & (F.length(F.coalesce(c("venue_name_raw"), F.lit(""))) > 0)
    url = F.coalesce(F.nullif(c("official_url"), F.lit("")), F.nullif(c("ticket_url"), F.lit("")))
    geo = (F.length(F.coalesce(c("postcode"), F.lit(""))) > 0) | c("latitude").isNotNull()
    known = F.length(F.coalesce(c("category"), F.lit(""))) > 0
    rules = [
        ("has_time", F.length(F.coalesce(c("time_start"), F.lit(""))) > 0, F.lit("Start time known")),
        ("has_venue_matched", matched, F.lit("Venue matched to registry")),
        ("has_venue_named", named, F.lit("Venue named (not in registry)")),
        (None, ~matched & ~named, F.lit("Venue unknown")),
        ("has_city", c("city_id").isNotNull(), F.lit("City resolved")),
        ("has_official_url", url.isNotNull(), F.lit("Official URL present")),
        ("has_postcode_or_coords", geo, F.lit("Postcode/coordinates known")),
        ("category_classified", known & (c("category") != "other"), F.concat(F.lit("Category classified as "), c("category"))),
        ("multi_source_bonus", sources >= V.CONFIRM_SOURCES, F.concat(F.lit("Corroborated by "), sources.cast("string"), F.lit(" sources"))),
        ("school_event_penalty", school & (F.upper(school_level) != "HIGH"),
         F.concat(F.lit("School calendar event with "), school_level, F.lit(" confidence"))),
        ("stale_penalty", c("freshness_score") < V.STALE_BELOW, F.concat(F.lit("Stale: freshness "), c("freshness_score").cast("string"))),
    ]
    total = base
    reasons = [F.concat(F.lit("Source confidence "), conf, F.lit(" (+"), base.cast("string"), F.lit(")"))]
    for key, cond, label in rules:
        cond = F.coalesce(cond, F.lit(False))
        if key is None:
            reasons.append(F.when(cond, label))
            continue
        pts = V.QUALITY_POINTS[key]
        total = total + F.when(cond, F.lit(pts)).otherwise(F.lit(0))
        reasons.append(F.when(cond, F.concat(label, F.lit(f" ({pts:+d})"))))
    return total, F.array_compact(F.array(*reasons))


def with_freshness(events: DataFrame, now: Column) -> DataFrame:
    return pin(events, freshness_score=freshness_score(F.coalesce(F.col("last_verified_at"), F.col("last_seen_at")), now))


# ---- status --------------------------------------------------------------------------------------------------------
def derive_status(current: Column, incoming: Column, incoming_confidence: Column, title: Column, sold_out: Column, source_count: Column,
                  date_start: Column, date_changed: Column, as_of: Column) -> Column:
    """struct(status, reason): ordered rules, first match wins; silence of a source never changes a status."""
    inc = F.upper(F.coalesce(incoming, F.lit("")))
    cancel, postpone, move = (keyword_hit(title, k) for k in (V.CANCELLED_KEYWORDS, V.POSTPONED_KEYWORDS, V.RESCHEDULED_KEYWORDS))
    changed = F.coalesce(date_changed, F.lit(False))

    def said(word: str, kw: Column) -> Column:
        return F.when(inc == word, F.lit(f"Source reported {word.lower()}")).otherwise(F.concat(F.lit("Title contains '"), kw, F.lit("'")))

    def out(status: Column | str, reason: Column | str) -> Column:
        s = F.lit(status) if isinstance(status, str) else status
        r = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(s.alias("status"), r.alias("reason"))

    return choose([
        ((inc == "CANCELLED") | cancel.isNotNull(), out("CANCELLED", said("CANCELLED", cancel))),
        ((inc == "POSTPONED") | postpone.isNotNull(), out("POSTPONED", said("POSTPONED", postpone))),
        ((inc == "RESCHEDULED") | changed | move.isNotNull(),
         out("RESCHEDULED", F.when(changed, F.lit("Event date changed since first seen")).otherwise(F.lit("Source reported rescheduled")))),
        (current.isin("CANCELLED", "POSTPONED") & inc.isin("", "SCHEDULED", "UNKNOWN"),
         out(current, F.concat(F.lit("Previously "), F.lower(current), F.lit("; a plain listing does not reverse it")))),
        (F.coalesce(sold_out, F.lit(False)) | (inc == "SOLD_OUT"), out("SOLD_OUT", "Ticket availability reported as sold out")),
        (date_start < as_of, out("COMPLETED", "Event date has passed")),
        ((inc == "CONFIRMED") & (incoming_confidence == "OFFICIAL"), out("CONFIRMED", "Confirmed by official source")),
        (source_count >= V.CONFIRM_SOURCES, out("CONFIRMED", F.concat(F.lit("Corroborated by "), source_count.cast("string"), F.lit(" independent sources")))),
        (current == "CONFIRMED", out("CONFIRMED", "Previously confirmed")),
        (inc.isin("SCHEDULED", "", "UNKNOWN"), out("SCHEDULED", "Listed by source; single-source, not yet corroborated")),
    ], out(inc, "Source-reported status"))


# ---- service area ----------------------------------------------------------------------------------------------------
def in_service_area(city_name: Column, city_raw: Column, area: Sequence[str]) -> Column:
    """Resolved city name, else the raw one, looked up in the normalised area names (a constant the optimizer folds)."""
    key = normalize_name(F.coalesce(city_name, city_raw))
    names = F.array(*[normalize_name(F.lit(a)) for a in area]) if area else F.array().cast("array<string>")
    return (key != "") & F.array_contains(names, key)


# ---- opportunity score ----------------------------------------------------------------------------------------------
def opportunity_components(score: Column, quality: Column, fresh: Column, in_area: Column, factor: Column) -> Column:
    w = V.OPPORTUNITY_WEIGHTS
    demand, q, f = F.coalesce(score, F.lit(0)), F.coalesce(quality, F.lit(0)), F.coalesce(fresh, F.lit(V.UNKNOWN_FRESHNESS))
    return F.struct(
        F.bround(demand * factor * F.lit(float(w["demand"])) / F.lit(100.0), 1).alias("demand"),
        F.bround(q * F.lit(float(w["quality"])) / F.lit(100.0), 1).alias("quality"),
        F.bround(f * F.lit(float(w["freshness"])) / F.lit(100.0), 1).alias("freshness"),
        F.when(in_area, F.lit(float(w["service_area"]))).otherwise(F.lit(0.0)).alias("service_area"),
    )


def opportunity_total(comps: Column) -> Column:
    total = comps["demand"] + comps["quality"] + comps["freshness"] + comps["service_area"]
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(total, 0).cast("int")))
