"""Predicates over the event, opportunity and action tables.  Each non-null parameter adds one filter; Catalyst merges them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.dates import overlaps_day, within_days
from ..functions.scoring import in_service_area
from ..functions.text import choose, non_event_title
from ..session import pin

RANGE_DAYS = {"7d": 7, "30d": 30}


def as_date(d: dt.date | str) -> Column:
    return F.lit(d if isinstance(d, dt.date) else dt.date.fromisoformat(d))


def multi(value: str | None) -> list[str]:
    return [x.strip().upper() for x in (value or "").split(",") if x.strip()]


def active(statuses: Sequence[str] = tuple(V.ACTIVE_STATUSES)) -> Column:
    return F.col("status").isin(list(statuses))


def in_range(name: str | None, as_of: Column) -> Column | None:
    start, end = F.col("date_start"), F.col("date_end")
    if name == "today":
        return overlaps_day(start, end, as_of)
    if name == "tomorrow":
        return overlaps_day(start, end, F.date_add(as_of, 1))
    if name in RANGE_DAYS:
        return within_days(start, as_of, RANGE_DAYS[name])
    return None


def like_any(text: str, *cols: str) -> Column:
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
    return hit


MISSING = {
    "time": lambda: F.col("time_start").isNull(),
    "venue": lambda: F.col("venue_id").isNull(),
    "location": lambda: F.col("city_id").isNull(),
    "official_url": lambda: F.col("official_url").isNull() & F.col("ticket_url").isNull(),
    "coordinates": lambda: F.col("latitude").isNull(),
    "capacity": lambda: F.col("venue_capacity").isNull(),
}


def filter_events(events: DataFrame, as_of, *, range_: str | None = None, date_from=None, date_to=None, category: str | None = None,
                  city: str | None = None, region: str | None = None, demand: str | None = None, min_score: int | None = None,
                  venue: str | None = None, status: str | None = None, source: str | None = None, q: str | None = None,
                  quality: str | None = None, confidence: str | None = None, subcategory: str | None = None,
                  missing: str | None = None) -> DataFrame:
    """The sixteen optional list filters.  ``events`` carries the dimension names v_name, c_name, r_name when city, region,
    venue or q are used."""
    day = as_date(as_of)
    c = F.col
    conds: list[Column | None] = [
        in_range(range_, day),
        c("date_start") >= as_date(date_from) if date_from else None,
        c("date_start") <= as_date(date_to) if date_to else None,
        c("category") == category if category else None,
        (c("c_name") == city) | (c("city_name_raw") == city) if city else None,
        c("r_name") == region if region else None,
        c("demand_level").isin(multi(demand)) if demand else None,
        c("opportunity_score") >= min_score if min_score is not None else None,
        like_any(venue, "v_name", "venue_name_raw") if venue else None,
        c("status") == status.upper() if status else None,
        c("primary_source") == source if source else None,
        like_any(q, "title", "city_name_raw", "venue_name_raw", "v_name") if q else None,
        c("quality_level").isin(multi(quality)) if quality else None,
        c("source_confidence").isin(multi(confidence)) if confidence else None,
        c("subcategory") == subcategory if subcategory else None,
    ]
    conds += [MISSING[m.strip()]() for m in (missing or "").split(",") if m.strip() in MISSING]
    for cond in conds:
        if cond is not None:
            events = events.where(cond)
    return events


def default_horizon(events: DataFrame, as_of, *, range_=None, date_from=None, date_to=None) -> DataFrame:
    """Future events only, unless the caller gave any date bound."""
    if range_ is None and date_from is None and date_to is None:
        return events.where(F.col("date_start") >= as_date(as_of))
    return events


EVENT_SORTS = {
    "score": lambda: [F.desc("opportunity_score"), F.asc("date_start")],
    "date": lambda: [F.asc("date_start"), F.asc("time_start")],
    "updated": lambda: [F.desc("last_updated_at")],
    "quality": lambda: [F.desc("event_quality_score"), F.desc("opportunity_score")],
}
ACTION_SORTS = {
    "priority": lambda: [F.asc("priority"), F.asc("date_start"), F.desc("opportunity_score")],
    "date": lambda: [F.asc("date_start")],
    "score": lambda: [F.desc("opportunity_score")],
    "created": lambda: [F.desc("created_at")],
}


def page(df: DataFrame, order: Sequence[Column], tie: Sequence[str], number: int = 1, size: int | None = 50) -> DataFrame:
    """One page of a totally ordered list: a top-k plan, no full sort; without a size the whole list."""
    whole = df.orderBy(*order, *[F.asc(t) for t in tie])
    return whole if size is None else whole.offset((number - 1) * size).limit(size)


def list_events(events: DataFrame, as_of, sort: str = "score", number: int = 1, size: int | None = 50, **filters) -> DataFrame:
    dates = {k: filters.get(k) for k in ("range_", "date_from", "date_to")}
    chosen = default_horizon(filter_events(events, as_of, **filters), as_of, **dates)
    return page(chosen, EVENT_SORTS.get(sort, EVENT_SORTS["score"])(), ["event_id"], number, size)


def count_events(events: DataFrame, as_of, **filters) -> DataFrame:
    dates = {k: filters.get(k) for k in ("range_", "date_from", "date_to")}
    return default_horizon(filter_events(events, as_of, **filters), as_of, **dates).agg(F.count("*").alias("total"))


def calendar(events: DataFrame, start, end) -> DataFrame:
    return events.where((F.col("date_start") <= as_date(end)) & (F.coalesce("date_end", "date_start") >= as_date(start)))


def map_points(events: DataFrame, as_of, days: int = 7, min_score: int = 0) -> DataFrame:
    return events.where(within_days(F.col("date_start"), as_date(as_of), days) & active()
                        & F.col("latitude").isNotNull() & (F.col("opportunity_score") >= min_score))


def operator_list(events: DataFrame, as_of, days: int = 7, city: str | None = None, category: str | None = None,
                  min_score: int | None = None, limit: int = 50) -> DataFrame:
    out = events.where(within_days(F.col("date_start"), as_date(as_of), days))
    if city:
        out = out.where(like_any(city, "city_name_raw"))
    if category:
        out = out.where(F.col("category") == category)
    if min_score:
        out = out.where(F.col("opportunity_score") >= min_score)
    return out.orderBy(F.desc("opportunity_score"), "date_start", "event_id").limit(limit)


CANNED = ("today", "tomorrow", "week", "high", "concerts", "sports", "education")


def canned(events: DataFrame, name: str, as_of, limit: int = 10) -> DataFrame:
    """Named listings; they cover SCHEDULED and RESCHEDULED only."""
    day, start = as_date(as_of), F.col("date_start")
    future = start >= day
    cond = {
        "today": start == day,
        "tomorrow": start == F.date_add(day, 1),
        "week": within_days(start, day, 7),
        "high": future & F.col("demand_level").isin("HIGH", "VERY_HIGH"),
        "concerts": future & (F.col("category") == "music"),
        "sports": future & (F.col("category") == "sports"),
        "education": future & (F.col("category") == "education"),
    }[name]
    return (events.where(active(V.LISTING_STATUSES) & cond)
            .orderBy(F.desc("opportunity_score"), "event_id").limit(limit))


# ---- validation --------------------------------------------------------------------------------------------------------
def validation_problems(as_of: Column, patterns: Sequence[str] = tuple(V.NON_EVENT_TITLE_PATTERNS)) -> Column:
    """array of the broken rules over the staging columns; empty when the record is valid."""
    c = F.col

    def blank(name: str) -> Column:
        return F.length(F.coalesce(c(name), F.lit(""))) == 0

    located = ~blank("venue_name") | ~blank("city_name") | F.coalesce((c("latitude") != 0) & (c("longitude") != 0), F.lit(False))
    rules = [
        (F.length(F.trim(F.coalesce(c("title"), F.lit("")))) < V.MIN_TITLE_CHARS, "title_too_short"),
        (blank("external_id"), "missing_external_id"),
        (c("date_start") < F.date_sub(as_of, V.MAX_PAST_DAYS), "event_in_past"),
        (c("date_start") > F.date_add(as_of, V.MAX_FUTURE_DAYS), "event_too_far_future"),
        (c("date_end") < c("date_start"), "end_before_start"),
        (~located, "no_location"),
        (non_event_title(c("title"), patterns), "non_event_title"),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))


def split_valid(staged: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with problems)."""
    checked = pin(staged, problems=validation_problems(as_date(as_of)))
    return checked.where(F.size("problems") == 0).drop("problems"), checked.where(F.size("problems") > 0)


# ---- action gate ---------------------------------------------------------------------------------------------------------
def gate_failure(as_of: Column) -> Column:
    """First failing gate as text, null when the event may receive recommendations."""
    c = F.col
    days = F.datediff(c("date_start"), as_of)
    level = F.upper(F.coalesce(F.nullif(c("quality_level"), F.lit("")), F.lit("LOW")))
    rank = choose([(level == k, F.lit(v)) for k, v in V.QUALITY_RANK.items()], F.lit(0))
    score = F.coalesce(c("opportunity_score"), F.lit(0))
    return choose([
        (c("status").isin(V.DEAD_STATUSES), F.concat(F.lit("status "), c("status"))),
        (score < V.GATE_MIN_SCORE, F.concat(F.lit("opportunity score "), score.cast("string"), F.lit(f" < {V.GATE_MIN_SCORE}"))),
        (rank < V.QUALITY_RANK[V.GATE_MIN_LEVEL], F.concat(F.lit("quality "), F.coalesce(c("quality_level"), F.lit("LOW")), F.lit(f" below {V.GATE_MIN_LEVEL}"))),
        (~c("in_area"), F.lit("outside service area")),
        (~days.between(V.GATE_MIN_DAYS, V.GATE_MAX_DAYS), F.concat(days.cast("string"), F.lit(" days ahead outside window"))),
    ])


def gate_facts(as_of: Column) -> Column:
    """The facts that opened the gate, as an array."""
    c = F.col
    return F.array_compact(F.array(
        F.concat(F.lit("opportunity score "), c("opportunity_score").cast("string"), F.lit(f" ≥ {V.GATE_MIN_SCORE}")),
        F.concat(F.lit("quality "), c("quality_level"), F.lit(" ("), c("event_quality_score").cast("string"), F.lit(")")),
        F.concat(F.lit("status "), c("status")),
        F.concat(F.datediff(c("date_start"), as_of).cast("string"), F.lit(" days ahead")),
        F.lit("inside service area"),
        F.when(F.coalesce(c("v_capacity"), F.lit(0)) != 0, F.concat(F.lit("venue capacity "), F.format_number(c("v_capacity"), 0), F.lit(" ("),
                                                                     F.coalesce(c("v_capacity_source"), F.lit("registry")), F.lit(")"))),
    ))


def mark_service_area(events: DataFrame, area: Sequence[str]) -> DataFrame:
    return pin(events, in_area=in_service_area(F.col("c_name"), F.col("city_name_raw"), area))


# ---- opportunity and action feeds -----------------------------------------------------------------------------------------
def opportunity_feed(opportunities: DataFrame, events: DataFrame, as_of, days: int = 7, demand: str | None = None,
                     opportunity_type: str | None = None, city: str | None = None) -> DataFrame:
    ev = events.where(within_days(F.col("date_start"), as_date(as_of), days) & active())
    if city:
        ev = ev.where(F.col("city_name_raw") == city)
    opp = opportunities
    if demand:
        opp = opp.where(F.col("demand_level").isin(multi(demand)))
    if opportunity_type:
        opp = opp.where(F.col("opportunity_type") == opportunity_type.upper())
    return opp.join(ev.select("event_id", "title", "date_start", "city_name_raw"), "event_id")


def action_feed(actions: DataFrame, events: DataFrame, as_of, days: int = 14, status: str | None = ",".join(V.OPEN_ACTION_STATUSES),
                priority: str | None = None, action_type: str | None = None, city: str | None = None, q: str | None = None) -> DataFrame:
    ev = events.where(within_days(F.col("date_start"), as_date(as_of), days))
    if city:
        ev = ev.where(F.col("city_name_raw") == city)
    act = actions
    if status:
        act = act.where(F.col("status").isin(multi(status)))
    if priority:
        act = act.where(F.col("priority") == priority.upper())
    if action_type:
        act = act.where(F.col("action_type").isin(multi(action_type)))
    facts = ev.select("event_id", F.col("title").alias("event_title"), "date_start", "opportunity_score", "city_name_raw", "venue_name_raw")
    out = act.join(facts, "event_id")
    return out.where(like_any(q, "title", "event_title", "venue_name_raw")) if q else out


def recent_changes(changes: DataFrame, now: Column, days: int = 7, change_type: str | None = None) -> DataFrame:
    out = changes.where(F.col("detected_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    return out.where(F.col("change_type") == change_type.upper()) if change_type else out
