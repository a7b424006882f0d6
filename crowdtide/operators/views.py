"""Denormalised views over the event tables.  Dimension joins carry no hint: Catalyst broadcasts a dimension only while its measured
size is below the session threshold and sort-merges it (with AQE skew splitting) beyond that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V


def with_dimensions(events: DataFrame, venues: DataFrame | None = None, cities: DataFrame | None = None,
                    regions: DataFrame | None = None) -> DataFrame:
    """Left joins event -> venue, city, region, adding v_*, c_*, r_name."""
    out = events
    if venues is not None:
        out = out.join(venues.select(
            "venue_id", F.col("name").alias("v_name"), F.col("capacity").alias("v_capacity"), F.col("capacity_source").alias("v_capacity_source"),
            F.col("importance_score").alias("v_importance"), F.col("is_seeded").alias("v_seeded"),
            F.col("station_distance_km").alias("v_station_km"), F.col("airport_distance_km").alias("v_airport_km")), "venue_id", "left")
    if cities is not None:
        out = out.join(cities.select(
            "city_id", F.col("name").alias("c_name"), F.col("priority").alias("c_priority"), F.col("tourism").alias("c_tourism")), "city_id", "left")
    if regions is not None:
        out = out.join(regions.select("region_id", F.col("name").alias("r_name")), "region_id", "left")
    return out


def event_summary(events: DataFrame) -> DataFrame:
    """Resolved-or-raw summary with a venue struct; needs with_dimensions."""
    c = F.col
    return events.select(
        "event_id", "title", "category", "subcategory", "date_start", "date_end", "time_start", "time_end",
        F.struct(F.when(c("v_name").isNotNull(), c("venue_id")).alias("id"), F.coalesce("v_name", "venue_name_raw").alias("name"),
                 c("v_capacity").alias("capacity")).alias("venue"),
        F.coalesce("c_name", "city_name_raw").alias("city"), c("r_name").alias("region"), "postcode", "latitude", "longitude", "status",
        "opportunity_score", "demand_level", "marketing_priority", "primary_source", "official_url", "ticket_url", "last_updated_at",
        "source_confidence", "event_quality_score", "quality_level", "freshness_score", "last_verified_at", "status_reason", "source_count",
    )


def flatten(df: DataFrame) -> DataFrame:
    """One level of nesting into parent_child columns; arrays, maps and deeper structs become JSON text."""
    def scalar(t: T.DataType) -> bool:
        return not isinstance(t, (T.StructType, T.ArrayType, T.MapType))

    out: list[Column] = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            for g in f.dataType.fields:
                x = F.col(f"`{f.name}`.`{g.name}`")
                out.append((x if scalar(g.dataType) else F.to_json(x)).alias(f"{f.name}_{g.name}"))
        elif scalar(f.dataType):
            out.append(F.col(f"`{f.name}`"))
        else:
            out.append(F.to_json(F.col(f"`{f.name}`")).alias(f.name))
    return df.select(*out)


def first_new_action(actions: DataFrame) -> DataFrame:
    """Title of the lowest-id NEW action per event (map-side combined)."""
    return (actions.where(F.col("status") == "NEW").groupBy("event_id")
            .agg(F.min_by("title", "action_id").alias("top_action")))


def event_brief(events: DataFrame, actions: DataFrame) -> DataFrame:
    c = F.col
    return events.join(first_new_action(actions), "event_id", "left").select(
        "event_id", "title", "date_start", "time_start", F.coalesce("v_name", "venue_name_raw").alias("venue"),
        F.coalesce("c_name", "city_name_raw").alias("city"), "opportunity_score", "demand_level", "category", "marketing_priority", "top_action",
        c("windows.post_start").alias("post_start"), c("windows.post_end").alias("post_end"), "quality_level", "source_confidence", "status",
        c("v_capacity").alias("capacity"))


def opportunity_view(opportunities: DataFrame) -> DataFrame:
    return opportunities.select("event_id", "opportunity_type", "score", "demand_level",
                                F.struct("window_start", "window_end", "window_label").alias("window"), "reasons", "recommended_action", "score_components", "confidence")


def event_detail(event_ids: DataFrame, events: DataFrame, opportunities: DataFrame, actions: DataFrame, changes: DataFrame,
                 sources: DataFrame) -> dict[str, DataFrame]:
    """Detail of the wanted events.  Opportunities and actions have at most 10 and 9 rows per event and are nested into arrays; changes
    and source links have no bound per event and stay as ordered row sets next to the facts."""
    def wanted(df: DataFrame) -> DataFrame:
        return df.join(event_ids.select("event_id").distinct(), "event_id", "left_semi")

    opp = wanted(opportunities).groupBy("event_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("score"), "opportunity_type", "demand_level", "window_start", "window_end", "confidence")), asc=False)
        .alias("opportunities"))
    act = wanted(actions).groupBy("event_id").agg(
        F.sort_array(F.collect_list(F.struct("action_id", "action_type", "priority", "title", "status"))).alias("marketing_actions"))
    head = (wanted(events).join(opp, "event_id", "left").join(act, "event_id", "left"))
    c = F.col
    provenance = head.select(
        "event_id",
        F.struct("title", "date_start", "date_end", "time_start", "time_end", F.coalesce("v_name", "venue_name_raw").alias("venue"),
                 c("v_capacity").alias("venue_capacity"), c("v_capacity_source").alias("venue_capacity_source"),
                 F.coalesce("c_name", "city_name_raw").alias("city"), "postcode", "status", "status_reason", "official_url", "ticket_url",
                 "organizer", "source_confidence", "last_verified_at").alias("facts"),
        F.struct("opportunity_score", "demand_level", "components", "reasons", "attendance_estimate", "attendance_confidence", "windows",
                 "event_quality_score", "quality_level", "quality_reasons", "freshness_score", F.lit("MODELLED").alias("label")).alias("modelled"),
        F.struct(c("opportunities"), F.filter("marketing_actions", lambda a: a["status"] != "DISMISSED_AUTO").alias("marketing_actions"),
                 F.lit("RECOMMENDATION").alias("label")).alias("recommendations"),
        c("opportunities"), c("marketing_actions"),
    )
    return {
        "detail": provenance,
        "changes": wanted(changes).orderBy("event_id", F.desc("detected_at"), "change_id"),
        "sources": wanted(sources).orderBy("event_id", "source_id", "external_id"),
    }


def venue_view(venues: DataFrame, cities: DataFrame) -> DataFrame:
    return venues.join(cities.select("city_id", F.col("name").alias("city")), "city_id", "left").select(
        "venue_id", "name", "city", "postcode", "latitude", "longitude", "capacity", "capacity_source", "venue_type", "importance_score",
        "station_distance_km", "airport_distance_km", "is_seeded")


def source_view(sources: DataFrame, configured_keys: list[str] | None = None) -> DataFrame:
    """Source rows with the derived DISABLED status and its reason.  ``configured_keys`` names the API keys present in the job."""
    c = F.col
    needs = c("requires_key").isNotNull()
    has_key = c("requires_key").isin(configured_keys) if configured_keys else F.lit(False)
    reason = (F.when(needs & ~has_key, F.concat(F.lit("API key not configured ("), c("requires_key"), F.lit(")")))
              .when(~c("enabled"), F.lit("Disabled in settings"))
              .when(c("status") == "DISABLED", F.coalesce(F.nullif(c("last_error"), F.lit("")), F.lit("Disabled"))))
    return sources.withColumns({
        "disabled_reason": reason,
        "key_configured": F.when(needs, has_key),
        "shown_status": F.when((needs & ~has_key) | ~c("enabled"), F.lit("DISABLED")).otherwise(c("status")),
    })


def change_view(changes: DataFrame, events: DataFrame) -> DataFrame:
    """Change rows with the embedded event; ``events`` carries c_name."""
    ev = events.select("event_id", F.struct("event_id", "title", "date_start", F.coalesce("c_name", "city_name_raw").alias("city")).alias("event"))
    return changes.join(ev, "event_id", "left")


SNAPSHOT_FIELDS = ["title", "date_start", "date_end", "time_start", "time_end", "venue_name_raw", "venue_id", "city_id", "status",
                   "status_reason", "official_url", "ticket_url", "source_confidence", "source_count", "primary_source"]


def snapshot_struct() -> Column:
    return F.struct(*[F.col(f) for f in SNAPSHOT_FIELDS])


def service_area_names(override: list[str] | str | None = None, default: list[str] = V.DEFAULT_SERVICE_AREA,
                       structured: dict | None = None) -> tuple[list[str], str]:
    """(city names, origin): explicit list, else the structured setting, else the default.  Parameter-sized, so a plain list."""
    chosen = override
    if chosen is None and structured:
        first = structured.get("primary_city")
        rest = [x for x in structured.get("priority_cities") or [] if x and x != first]
        chosen = ([first] if first else []) + rest
    if isinstance(chosen, str):
        chosen = [x.strip() for x in chosen.split(",") if x.strip()]
    return (list(chosen), "settings") if chosen else (list(default), "default")


def service_area_dimension(spark, names: list[str]) -> DataFrame:
    from ..functions.text import normalize_name

    rows = spark.createDataFrame([(n,) for n in names], "city_name string")
    return rows.select("city_name", normalize_name("city_name").alias("normalized_name")).where("normalized_name <> ''").dropDuplicates(["normalized_name"])


def miles_to_km(miles: Column) -> Column:
    return miles * F.lit(1.609)
