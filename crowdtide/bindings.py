"""The domain tables derived from the star-schema test tables.

orders -> event, customer -> venue, nation -> city, region -> region, supplier -> source, lineitem -> event_source (bridge),
events -> booking, source_run and event_change.  Every derived value is an expression of the row's keys and columns, so the work of each
query grows with the given tables.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as V
from .functions.scoring import score_events, score_quality, venue_importance, with_freshness
from .functions.text import normalize_name, normalize_title
from .operators.fanout import action_rows, opportunity_rows
from .operators.filters import mark_service_area
from .operators.views import with_dimensions

AS_OF = dt.date(1998, 6, 15)
NOW = "1998-06-15 12:00:00"
LOG_NOW = "2024-01-31 00:00:00"
AREA = ["NATION_1", "NATION_2", "NATION_3", "Nation 7", "NATION_11"]

CATEGORIES = ["music", "sports", "theatre", "comedy", "education", "festival", "conference", "family", "arts", "community", "nightlife", "other"]
SUBCATEGORIES = ["concert", "football", "show", "standup", "school", "general", "business", "attraction", "exhibition", "talk", "club", "general"]
TITLES = ["Orchestra Night", "City v United", "Macbeth at the Playhouse", "Stand-up Special", "School Concert", "Street Food Festival", "Careers Fair", "Circus Spectacular",
          "Gallery Opening", "Guest Lecture", "DJ Set Saturday", "The Open Evening"]
VENUE_TYPES = {"AUTOMOBILE": "stadium", "BUILDING": "arena", "FURNITURE": "theatre", "HOUSEHOLD": "hall"}
CONFIDENCES = {"1-URGENT": "OFFICIAL", "2-HIGH": "TRUSTED", "3-MEDIUM": "CURATED", "4-NOT SPECIFIED": "SECONDARY"}


def now() -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{NOW}'")


def log_now() -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{LOG_NOW}'")


def _pick(values: list[str], key: str, n: int) -> Column:
    items = ", ".join(f"'{v}'" for v in values)
    return F.expr(f"element_at(array({items}), cast(pmod({key}, {n}) as int) + 1)")


def _pairs(mapping: dict[str, str], column: str, default: str) -> Column:
    whens = " ".join(f"when {column} = '{k}' then '{v}'" for k, v in mapping.items())
    return F.expr(f"case {whens} else '{default}' end")


class Domain:
    """Lazily bound tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ---- dimensions
    @cached_property
    def region(self) -> DataFrame:
        return self.table("region").selectExpr("cast(r_regionkey as bigint) region_id", "r_name name", "'England' country")

    @cached_property
    def city(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "cast(n_nationkey as bigint) city_id", "n_name name", "array(concat('Greater ', n_name)) aliases", "cast(n_regionkey as bigint) region_id",
            "cast(pmod(n_nationkey * 7, 10) * 10 + 10 as int) priority", "pmod(n_nationkey * 3, 11) / 10.0D tourism",
            "cast(50 + n_nationkey * 0.2D as double) latitude", "cast(-3 + pmod(n_nationkey * 7, 25) * 0.2D as double) longitude").withColumn("normalized_name", normalize_name("name"))

    @cached_property
    def venue(self) -> DataFrame:
        v = self.table("customer").selectExpr(
            "c_custkey venue_id", "c_name name", "array(concat('Hall ', cast(c_custkey as string))) aliases", "cast(c_nationkey as bigint) city_id",
            "case when c_acctbal > 0 then cast(c_acctbal * 10 as int) end capacity", "'registry' capacity_source",
            "case when pmod(c_custkey, 7) <> 0 then pmod(c_custkey, 50) / 10.0D end station_distance_km",
            "case when pmod(c_custkey, 6) <> 0 then cast(pmod(c_custkey * 3, 40) as double) end airport_distance_km",
            "pmod(c_custkey, 10) <> 9 is_seeded", "concat('M', cast(pmod(c_custkey, 9) + 1 as string), ' ', cast(pmod(c_custkey, 9) as string), 'AB') postcode",
            "50 + pmod(c_custkey, 500) / 100.0D latitude", "-3 + pmod(c_custkey * 7, 500) / 100.0D longitude", "c_mktsegment")
        return v.withColumn("venue_type", _pairs(VENUE_TYPES, "c_mktsegment", "other")).withColumn(
            "importance_score", venue_importance(F.col("capacity"), F.col("venue_type"))).drop("c_mktsegment")

    @cached_property
    def source(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "s_suppkey source_id", "s_name key", "case when pmod(s_suppkey, 3) = 0 then 'api' else 'feed' end type", "cast(pmod(s_suppkey, 10) * 10 as int) priority",
            "pmod(s_suppkey, 8) <> 7 enabled", "case when pmod(s_suppkey, 6) = 5 then concat('KEY_', cast(s_suppkey as string)) end requires_key",
            "element_at(array('HEALTHY','DEGRADED','EMPTY','BLOCKED','FAILED','DISABLED'), cast(pmod(s_suppkey, 6) as int) + 1) status",
            f"timestampadd(HOUR, cast(-pmod(s_suppkey * 5, 120) as int), TIMESTAMP_NTZ '{LOG_NOW}') last_success_at",
            "cast(case when s_acctbal > 0 then s_acctbal / 100 else 0 end as int) last_events_collected", "cast(null as string) last_error")

    # ---- events
    def event_between(self, days_back: int | None = None, days_ahead: int | None = None) -> DataFrame:
        """Events with date_start in [as_of - days_back, as_of + days_ahead]; the bound reaches the scan of the stored timestamp."""
        o = self.table("orders")
        if days_back is not None:
            o = o.where(F.col("o_orderdate") >= F.lit(AS_OF - dt.timedelta(days=days_back)).cast("timestamp_ntz"))
        if days_ahead is not None:
            o = o.where(F.col("o_orderdate") < F.lit(AS_OF + dt.timedelta(days=days_ahead + 1)).cast("timestamp_ntz"))
        k = "o_orderkey"
        ev = o.selectExpr(
            f"{k} event_id", "to_date(o_orderdate) date_start", f"case when pmod({k}, 5) = 0 then date_add(to_date(o_orderdate), cast(pmod({k}, 3) as int)) end date_end",
            f"case when pmod({k}, 9) <> 0 then concat(lpad(cast(8 + pmod({k}, 15) as string), 2, '0'), case when pmod({k}, 2) = 0 then ':30' else ':00' end) end time_start",
            f"case when pmod({k}, 9) <> 0 and pmod({k}, 4) = 0 then concat(lpad(cast(pmod(10 + pmod({k}, 15) + pmod({k}, 3), 24) as string), 2, '0'), ':15') end time_end",
            f"case when pmod({k}, 13) <> 0 then o_custkey end venue_id", f"case when pmod({k}, 17) <> 0 then concat('Customer#', lpad(cast(o_custkey as string), 9, '0')) end venue_name_raw",
            f"case when pmod({k}, 19) = 0 then null else concat('NATION_', cast(pmod({k}, 25) as string)) end city_name_raw",
            f"case when pmod({k}, 23) = 0 then 'CANCELLED' when pmod({k}, 11) = 0 then 'SOLD_OUT' when pmod({k}, 14) = 0 then 'RESCHEDULED' "
            "when o_orderstatus = 'F' then 'CONFIRMED' when o_orderstatus = 'P' and pmod(o_custkey, 4) = 0 then 'POSTPONED' else 'SCHEDULED' end status",
            f"concat('Supplier#', lpad(cast(pmod({k}, 10) as string), 9, '0')) primary_source", f"cast(pmod({k}, 3) + 1 as int) source_count",
            f"timestampadd(HOUR, cast(-pmod({k} * 7, 700) as int), TIMESTAMP_NTZ '{NOW}') last_verified_at",
            f"case when pmod({k}, 4) <> 1 then concat('https://tickets.example/e/', cast({k} as string)) end official_url",
            f"case when pmod({k}, 6) = 1 then concat('https://tickets.example/buy/', cast({k} as string)) end ticket_url",
            f"case when pmod({k}, 13) <> 0 then 50 + pmod(o_custkey, 500) / 100.0D end latitude", f"case when pmod({k}, 13) <> 0 then -3 + pmod(o_custkey * 7, 500) / 100.0D end longitude",
            f"case when pmod({k}, 8) = 0 then concat('Organiser ', cast(pmod(o_custkey, 20) as string)) end organizer",
            f"case when pmod({k}, 3) = 0 then 'M1 1AA' end postcode", "o_orderpriority", "o_totalprice", "o_custkey", k)
        ev = ev.withColumns({
            "category": _pick(CATEGORIES, k, 12), "subcategory": _pick(SUBCATEGORIES, k, 12),
            "title": F.concat(_pick(TITLES, k, 12), F.lit(" "), F.expr("cast(pmod(o_custkey, 40) as string)")),
            "source_confidence": _pairs(CONFIDENCES, "o_orderpriority", "UNVERIFIED"),
            "school_confidence": F.expr("case when pmod(o_custkey, 3) = 0 then 'HIGH' else 'LOW' end"),
            "last_seen_at": F.col("last_verified_at"), "last_updated_at": F.col("last_verified_at"),
            "status_reason": F.expr(f"case when pmod({k}, 29) = 0 then 'SOURCE SILENT: not returned' else 'Listed by source' end"),
        })
        return ev.drop("o_orderpriority", "o_custkey", k)

    def event_touching(self, days_ahead: int) -> DataFrame:
        """Events that begin by as_of + days_ahead and are not over before as_of, whenever they began."""
        return self.event_between(None, days_ahead).where(F.coalesce("date_end", "date_start") >= F.lit(AS_OF))

    @cached_property
    def event(self) -> DataFrame:
        return self.event_between()

    def with_places(self, events: DataFrame) -> DataFrame:
        """Event plus venue, city (of the venue) and region names."""
        linked = events.join(self.venue.select("venue_id", "city_id", F.col("capacity").alias("venue_capacity")), "venue_id", "left")
        linked = linked.join(self.city.select("city_id", "region_id"), "city_id", "left")
        return with_dimensions(linked, self.venue, self.city, self.region)

    def scored(self, events: DataFrame | None = None) -> DataFrame:
        """Events with dimensions, normalised title, quality, freshness, service area and demand score."""
        ev = self.with_places(self.event if events is None else events).withColumn("normalized_title", normalize_title("title"))
        return score_events(mark_service_area(score_quality(with_freshness(ev, now())), AREA))

    @cached_property
    def scored_event(self) -> DataFrame:
        return self.scored()

    def scored_between(self, days_back: int | None = None, days_ahead: int | None = None) -> DataFrame:
        return self.scored(self.event_between(days_back, days_ahead))

    def opportunity(self, scored: DataFrame | None = None) -> DataFrame:
        return opportunity_rows(self.scored_event if scored is None else scored)

    def action(self, scored: DataFrame | None = None) -> DataFrame:
        """Proposed actions with a stored-looking id and status."""
        a = action_rows(self.scored_event if scored is None else scored, AS_OF)
        status = "element_at(array('NEW','PLANNED','DONE','NEW','DISMISSED_AUTO'), cast(pmod(event_id + ordinal, 5) as int) + 1)"
        return a.withColumns({"action_id": F.expr("event_id * 10 + ordinal"), "status": F.expr(status),
                              "created_at": F.expr(f"timestampadd(HOUR, cast(-pmod(event_id, 200) as int), TIMESTAMP_NTZ '{NOW}')")}).drop("date_start", "opportunity_score")

    # ---- bridge and logs
    @cached_property
    def event_source(self) -> DataFrame:
        return self.table("lineitem").selectExpr("l_orderkey event_id", "l_suppkey source_id", "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) external_id")

    @cached_property
    def source_run(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id run_id", "user_id source_id", "ts started_at", "timestampadd(SECOND, cast(pmod(event_id, 90) as int), ts) completed_at",
            "case event_type when 'error' then 'FAILED' when 'click' then 'HEALTHY' when 'view' then 'DEGRADED' when 'signup' then 'EMPTY' else 'HEALTHY' end status",
            "case when event_type in ('error', 'signup') then 0 else cast(value as int) end events_collected", "cast(pmod(event_id * 37, 900) as int) response_ms",
            "case when event_type = 'error' then concat('timeout ', cast(pmod(event_id, 7) as string)) end error")

    @cached_property
    def pipeline_run(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id run_id", "case when pmod(event_id, 4) = 0 then 'manual' else 'cron' end trigger",
            "case event_type when 'error' then 'FAILED' when 'click' then 'SUCCESS' when 'view' then 'PARTIAL' when 'signup' then 'RUNNING' else 'SUCCESS' end status",
            "ts started_at", "case when event_type <> 'signup' then timestampadd(SECOND, cast(pmod(event_id, 90) as int), ts) end completed_at",
            "cast(pmod(event_id, 90) as double) duration_seconds", "cast(pmod(event_id, 13) as int) sources_attempted", "cast(value as int) events_raw", "cast(value / 2 as int) events_valid")

    @cached_property
    def event_change(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id change_id", "user_id * 7 event_id", "ts detected_at",
            "case event_type when 'error' then 'CANCELLED' when 'click' then 'TIME_CHANGED' when 'view' then 'UPDATED' when 'signup' then 'NEW' else 'DATE_CHANGED' end change_type",
            "get_json_object(props, '$.k') new_value", "cast(value as string) old_value")

    @cached_property
    def snapshot(self) -> DataFrame:
        return self.table("events").selectExpr("event_id snapshot_id", "user_id event_id", "ts taken_at", "event_type reason", "concat(event_type, '-', cast(cast(value as int) as string)) snapshot_hash")

    # ---- bookings
    @cached_property
    def booking(self) -> DataFrame:
        lat = "50 + pmod(user_id, 500) / 100.0D + (pmod(event_id, 7) - 3) * 0.002D"
        lon = "-3 + pmod(user_id * 7, 500) / 100.0D + (pmod(event_id, 5) - 2) * 0.003D"
        return self.table("events").selectExpr(
            "event_id booking_id", "ts pickup_datetime", f"{lat} pickup_lat", f"{lon} pickup_lon",
            f"case when pmod(event_id, 2) = 0 then {lat} + 0.001D end dropoff_lat", f"case when pmod(event_id, 2) = 0 then {lon} + 0.001D end dropoff_lon", "value fare")

    @cached_property
    def booking_event(self) -> DataFrame:
        """Every order as an event in the booking month: start spread over 700 hours, at the coordinates of its customer."""
        start = "timestampadd(HOUR, cast(pmod(o_orderkey * 5, 700) as int), TIMESTAMP_NTZ '2024-01-01 00:00:00')"
        o = self.table("orders").selectExpr("o_orderkey event_id", f"{start} s", "50 + pmod(o_custkey, 500) / 100.0D latitude", "-3 + pmod(o_custkey * 7, 500) / 100.0D longitude",
                                            "o_orderkey", "case when o_totalprice > 20000 then cast(o_totalprice / 10 as int) end venue_capacity")
        return o.select("event_id", F.to_date("s").alias("date_start"), F.date_format("s", "HH:mm").alias("time_start"), "latitude", "longitude",
                        _pick(CATEGORIES, "o_orderkey", 12).alias("category"), "venue_capacity")




__all__ = ["AREA", "AS_OF", "Domain", "V", "log_now", "now"]
