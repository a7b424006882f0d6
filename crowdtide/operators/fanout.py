"""One event to many rows: typed journey opportunities and gated marketing actions.  Both are a narrow explode of conditional structs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.dates import hour_of
from ..functions.scoring import demand_level, opportunity_components, opportunity_total
from ..functions.text import slugify
from ..session import pin
from .filters import as_date, gate_facts, gate_failure


def fill(template: str, **parts: Column) -> Column:
    """Text template with {name} slots filled from columns."""
    out, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            out.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        out.append(parts[name])
    return F.concat(*out)


def _km(x: Column) -> Column:
    return x.cast("string")


def opportunity_rows(events: DataFrame) -> DataFrame:
    """Up to ten opportunities per event above the score floor.

    Needs score_events columns plus quality_level, event_quality_score, freshness_score and in_area.
    """
    c = F.col
    live = events.where((c("opportunity_score") >= V.OPPORTUNITY_MIN_SCORE) & ~c("status").isin(V.DEAD_STATUSES))
    rows = live.select("event_id", "opportunity_score", "event_quality_score", "freshness_score", "quality_level", "in_area",
                       F.explode(_opportunity_options()).alias("o")).where("o IS NOT NULL")
    comps = opportunity_components(c("opportunity_score"), c("event_quality_score"), c("freshness_score"), c("in_area"), c("o.type_factor"))
    return (
        pin(rows, score_components=comps)
        .withColumn("score", opportunity_total(c("score_components")))
        .select("event_id", "o.opportunity_type", "score", demand_level(c("score")).alias("demand_level"), "o.window_start", "o.window_end",
                F.lit("Modelled demand window").alias("window_label"), "o.reasons", "o.recommended_action", "score_components",
                "o.legacy_factor", F.coalesce("quality_level", F.lit("LOW")).alias("confidence"))
    )


@functools.cache
def _opportunity_options() -> Column:
    """array<struct>: one entry per opportunity type, null where its condition fails."""
    c = F.col
    w = c("windows")
    tourism = F.coalesce(c("c_tourism"), F.lit(0.2))
    station, airport = c("v_station_km"), c("v_airport_km")
    place = F.coalesce(c("v_name"), c("city_name_raw"), F.lit("venue"))
    has_station, has_hotels, has_airport = station.isNotNull(), tourism >= V.HOTEL_MIN_TOURISM, F.coalesce(airport <= V.AIRPORT_MAX_KM, F.lit(False))
    late = F.coalesce(hour_of(c("time_start")) >= V.LATE_START_HOUR, F.lit(False))
    rail = F.when(station > 1.5, 0.85).otherwise(0.6)
    hotel = F.lit(0.5) + tourism * F.lit(0.3)
    air = F.when(airport <= 8, 0.8).otherwise(0.6)
    pre, post, all_day = (w["pre_start"], w["pre_end"]), (w["post_start"], w["post_end"]), (F.lit("00:00"), F.lit("23:59"))
    yes = F.lit(True)

    # fixed texts: reasons and advice per opportunity type, in output order
    table = [
        ("HOME_TO_VENUE", yes, F.lit(0.9), pre, [F.lit("Local arrivals before start"), F.lit("Pre-event pickup demand")],
         "Position drivers in residential zones 2–3h before start; promote pre-booking to {place}."),
        ("VENUE_TO_HOME", yes, F.lit(1.0), post, [F.lit("Peak departure surge at end"), F.lit("Largest single demand spike")],
         "Stage vehicles near {place} exits from the end time; enable surge-ready dispatch."),
        ("STATION_TO_VENUE", has_station, rail, pre,
         [fill("Nearest station ≈ {km} km", km=_km(station)), F.lit("Rail arrivals need last-mile transfer")],
         "Advertise station-to-venue transfers; rank at station taxi rank."),
        ("VENUE_TO_STATION", has_station, rail, post, [F.lit("Rail return journeys after event"), F.lit("Last train pressure")],
         "Offer fixed-price venue→station fares."),
        ("HOTEL_TO_VENUE", has_hotels, hotel, pre,
         [fill("Tourism factor {t}", t=F.bround(tourism, 1).cast("string")), F.lit("Visitors staying in hotels")],
         "Partner with hotel concierges; place QR booking cards."),
        ("VENUE_TO_HOTEL", has_hotels, hotel, post, [F.lit("Hotel returns after event")], "Target hotel-district returns in dispatch."),
        ("AIRPORT_TO_VENUE", has_airport, air, pre, [fill("Airport ≈ {km} km", km=F.bround(airport, 0).cast("int").cast("string"))],
         "Bid on airport-transfer keywords for event dates."),
        ("VENUE_TO_AIRPORT", has_airport, air * 0.9, post, [F.lit("Post-event airport transfers")], "Offer pre-bookable airport transfers."),
        ("LATE_NIGHT_RETURN", late, F.lit(0.95), post, [F.lit("Evening start — late finish"), F.lit("Reduced public transport late night")],
         "Extend night shift coverage; push 'safe ride home' messaging."),
        ("PRE_BOOKING", yes, F.lit(0.8), all_day, [F.lit("Advance bookings reduce dispatch pressure")], "Run pre-booking campaign 3–7 days ahead."),
    ]
    shared = [
        fill("Event quality {level} ({score})", level=F.coalesce(c("quality_level"), F.lit("n/a")),
             score=F.coalesce(c("event_quality_score"), F.lit(0)).cast("string")),
        F.when(c("in_area"), F.lit("Inside service area")).otherwise(F.lit("Outside configured service area")),
    ]
    options = [
        F.when(cond, F.struct(
            F.lit(kind).alias("opportunity_type"), F.lit(V.OPPORTUNITY_FACTORS[kind]).alias("type_factor"), factor.cast("double").alias("legacy_factor"),
            window[0].alias("window_start"), window[1].alias("window_end"), F.array(*reasons, *shared).alias("reasons"),
            fill(advice, place=place).alias("recommended_action")))
        for kind, cond, factor, window, reasons, advice in table
    ]
    return F.array(*options)


def action_rows(events: DataFrame, as_of) -> DataFrame:
    """Every action of each event whose gate is open, in template order."""
    c, day = F.col, as_date(as_of)
    open_events = (
        pin(events, _closed=gate_failure(day)).where(c("_closed").isNull())
        .withColumn("reason", F.array_join(gate_facts(day), "; "))
    )
    open_events = pin(open_events, _kept=F.array_compact(_action_options()))
    return open_events.select(
        "event_id", "date_start", "opportunity_score", F.coalesce("marketing_priority", F.lit("P3")).alias("priority"), "reason",
        F.posexplode("_kept").alias("ordinal", "a"),
    ).select("event_id", "a.*", "priority", "reason", "ordinal", "date_start", "opportunity_score")


@functools.cache
def _action_options() -> Column:
    """array<struct>: one entry per action type, null where its condition fails."""
    c = F.col
    d = c("date_start")
    venue = F.coalesce(c("v_name"), c("venue_name_raw"), F.lit("the venue"))
    city = F.coalesce(c("c_name"), c("city_name_raw"), F.lit(""))
    city_or_venue = F.coalesce(F.nullif(city, F.lit("")), venue)
    city_or_area = F.coalesce(F.nullif(city, F.lit("")), F.lit("the area"))

    def back(days: int) -> Column:
        return F.date_sub(d, days).cast("string")

    slots = {
        "venue": venue, "title": c("title"), "day": d.cast("string"), "before": back(1), "lead": back(7), "far": back(14),
        "date": F.date_format(d, "E dd MMM yyyy"), "slug": F.concat(F.lit("/taxi-"), slugify(venue), F.lit("/")), "area": city_or_area,
        "near": city_or_venue, "category": c("category"), "capacity": F.coalesce(F.format_number(c("v_capacity"), 0), F.lit("")),
    }
    audience = "Adults 18–55 within 25 km of {near}, interests: {category}"
    hot = c("opportunity_score") >= V.GATE_MIN_SCORE
    large = F.coalesce(c("v_capacity") >= V.PARTNERSHIP_MIN_CAPACITY, F.lit(False)) & (c("opportunity_score") >= V.PARTNERSHIP_MIN_SCORE)
    yes = F.lit(True)

    # fixed texts: (type, condition, title, keyword, channel, description, time, date slot, audience), in output order
    table = [
        ("SEO", yes, "Optimise for “taxi to {venue}”", "taxi to {venue}", "Website/SEO",
         "Add an FAQ + fare guide block targeting 'taxi to {venue}' and '{venue} taxi'. Mention {title} on {date}.",
         "Publish by {lead}", "lead", "Organic search"),
        ("GOOGLE_ADS", yes, "Search campaign: “taxi near {venue}”", "taxi near {venue}", "Google Search",
         "Exact/phrase match on 'taxi near {venue}', '{venue} taxi', 'cab from {venue}'. Schedule ads {before} → event night.",
         "{before} to {day} 23:59", "before", "Searchers within 15 km of {venue}"),
        ("LANDING_PAGE", yes, "Landing page {slug}", "taxi to {venue}", "Website",
         "Create {slug} with pickup points, fixed fares to stations/hotels, and a booking CTA. Reuse for all {venue} events.",
         "Live by {lead}", "lead", "Paid + organic traffic"),
        ("GBP_POST", yes, "Google Business Profile update for {title}", "{venue} taxi", "Google Business Profile",
         "Post: 'Heading to {title} at {venue} on {date}? Book your ride in advance.'", "{before} 10:00", "before", "Local map-pack searchers"),
        ("SOCIAL_POST", yes, "Social post: {title}", None, "Instagram/Facebook/X",
         "'Heading home after {title}? Pre-book now and skip the queue at {venue}.' Post afternoon of event.", "{day} 14:00", "day", audience),
        ("META_ADS", hot, "Meta Ads: {title}", None, "Meta Ads",
         "Geo-fenced awareness + conversion ads around {venue} on event day. Creative: 'Safe ride home from {venue}'.",
         "{before} to {day}", "before", audience),
        ("WHATSAPP_CTA", hot, "WhatsApp booking CTA", None, "WhatsApp",
         "Broadcast to opted-in customers: 'Going to {title}? Reply BOOK for a fixed-price return.'", "{before} 18:00", "before", "Opted-in customer list"),
        ("EMAIL", large, "Email campaign: {title}", None, "Email",
         "Send to past customers in {area}: fixed-price returns for {title} at {venue} ({date}). Include pre-booking link.",
         "{lead} 09:00", "lead", "Existing customer list (opted-in)"),
        ("PARTNERSHIP", large, "Partnership outreach: {venue}", None, "Direct outreach",
         "Approach {venue} operations / nearby hotels about an official pickup point or concierge referral for {title} (capacity {capacity}). "
         "Reusable for future events at this venue.", "By {far}", "far", "Venue operations, hotel concierges"),
    ]
    options = [
        F.when(cond, F.struct(
            F.lit(kind).alias("action_type"), fill(title, **slots).alias("title"),
            (fill(keyword, **slots) if keyword else F.lit(None).cast("string")).alias("suggested_keyword"), F.lit(channel).alias("suggested_channel"),
            fill(text, **slots).alias("description"), fill(time, **slots).alias("recommended_time"), slots[date].alias("recommended_date"),
            fill(who, **slots).alias("suggested_audience")))
        for kind, cond, title, keyword, channel, text, time, date, who in table
    ]
    return F.array(*options)


def cap_new_actions(new_actions: DataFrame, limit: int) -> DataFrame:
    """The run-wide cap on new rows, in event then template order: a top-k plan, not a global window."""
    return new_actions.orderBy("event_id", "ordinal").limit(limit)
