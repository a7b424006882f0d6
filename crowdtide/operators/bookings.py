"""Historical bookings: canonical rows, upsert, space-time matching with events, labels, features, forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.dates import hour_of, local_datetime, minutes_interval, parse_booking_timestamp, weekend
from ..functions.geo import box_half_widths, haversine_km, match_confidence
from ..functions.text import normalize_postcode
from ..session import cut_lineage, pin, split_join
from .filters import as_date

STAMPS = ["booking_created_at", "pickup_datetime", "dropoff_datetime"]
DOUBLES = ["pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon", "fare"]


def map_columns(raw: DataFrame, column_map: dict[str, str] | None = None) -> DataFrame:
    """Source columns under their canonical names; a missing source column becomes null."""
    names = {**{f: f for f in V.BOOKING_FIELDS}, **{k: v for k, v in (column_map or {}).items() if v}}
    have = set(raw.columns)
    extra = [F.col(x) for x in ("read_order",) if x in have]
    return raw.select(*[(F.col(f"`{names[f]}`") if names[f] in have else F.lit(None).cast("string")).alias(f) for f in V.BOOKING_FIELDS], *extra)


def judge(raw: DataFrame, column_map: dict[str, str] | None = None) -> DataFrame:
    """Canonical rows in one pass, with ``accepted``: rows without an id or a readable pickup time are not."""
    m = map_columns(raw, column_map)
    c = F.col
    types = dict(m.dtypes)

    def stamp(name: str) -> Column:
        return c(name).cast("timestamp_ntz") if types[name].startswith("timestamp") else parse_booking_timestamp(c(name).cast("string"))

    rest = m.columns
    out = pin(m, booking_id=F.nullif(c("booking_id").cast("string"), F.lit("")), **{x: stamp(x) for x in STAMPS})
    out = out.select(
        "booking_id", *STAMPS, *[normalize_postcode(x).alias(x) for x in ("pickup_postcode", "dropoff_postcode")],
        *[c(x).try_cast("double").alias(x) for x in DOUBLES],
        F.nullif(c("status").cast("string"), F.lit("")).alias("status"), F.nullif(c("vehicle_type").cast("string"), F.lit("")).alias("vehicle_type"),
        *[c(x) for x in ("read_order",) if x in rest],
    )
    return out.withColumn("accepted", c("booking_id").isNotNull() & c("pickup_datetime").isNotNull())


def to_canonical(raw: DataFrame, column_map: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(bookings, rejected); each of the two reads and parses the rows for itself, see ``judge`` for both at once."""
    rows = judge(raw, column_map)
    return rows.where("accepted").drop("accepted"), rows.where("NOT accepted").drop("accepted")


def upsert(stored: DataFrame, incoming: DataFrame, source_label: str | None = None) -> DataFrame:
    """Last row per id of the batch wins over the stored one; column ``merge_action`` is created, updated or kept."""
    order = F.col("read_order") if "read_order" in incoming.columns else F.col("pickup_datetime")
    rows = incoming.drop("read_order").columns
    last = incoming.groupBy("booking_id").agg(F.max_by(F.struct(*rows), order).alias("n"))
    both = stored.select(F.col("booking_id"), F.struct(*[F.col(x) for x in rows]).alias("o"), *[F.col(x) for x in ("source_file",) if x in stored.columns]).join(
        last, "booking_id", "full")
    if "source_file" not in stored.columns:
        both = both.withColumn("source_file", F.lit(None).cast("string"))
    action = F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "created").otherwise("updated")
    merged = both.select(F.coalesce("n", "o").alias("r"), F.when(F.col("o").isNull(), F.lit(source_label)).otherwise(F.col("source_file")).alias("source_file"), action.alias("merge_action"))
    return merged.select("r.*", "source_file", "merge_action")


def upsert_counts(raw: DataFrame, accepted: DataFrame, rejected: DataFrame, stored: DataFrame) -> DataFrame:
    """read, created, updated, rejected: the first row of an unseen id is a create, every further row an update."""
    ids = accepted.groupBy("booking_id").count().join(stored.select("booking_id", F.lit(True).alias("known")).distinct(), "booking_id", "left")
    made = ids.agg(F.count_if(F.col("known").isNull()).alias("created"), F.coalesce(F.sum("count"), F.lit(0)).alias("accepted"))
    out = made.withColumn("_k", F.lit(1)).join(
        rejected.agg(F.count("*").alias("rejected")).withColumn("_k", F.lit(1)), "_k").drop("_k")
    return out.select((F.col("accepted") + F.col("rejected")).alias("read"), "created", (F.col("accepted") - F.col("created")).alias("updated"), "rejected")


# ---- matching ------------------------------------------------------------------------------------------------------------------
def booking_legs(bookings: DataFrame) -> DataFrame:
    """One row per leg with coordinates."""
    legs = bookings.select("booking_id", "pickup_datetime", F.explode(F.array(
        F.struct(F.lit("DROPOFF").alias("leg"), F.col("dropoff_lat").alias("lat"), F.col("dropoff_lon").alias("lon")),
        F.struct(F.lit("PICKUP").alias("leg"), F.col("pickup_lat").alias("lat"), F.col("pickup_lon").alias("lon")))).alias("l"))
    return legs.select("booking_id", "pickup_datetime", "l.*").where("lat IS NOT NULL AND lon IS NOT NULL")


class Grid:
    """Match parameters and the join grid they imply: cells about as large as the search box and slots as long as the search window, so an
    event touches at most two per axis, eight keys in all (more only where meridians converge)."""

    def __init__(self, radius_km: float = V.RADIUS_KM, pre: int = V.PRE_MINUTES, post: int = V.AFTER_MINUTES, duration: int = V.EVENT_MINUTES):
        self.radius_km, self.pre, self.post, self.duration = radius_km, pre, post, duration
        self.lat_step = 2.2 * radius_km / V.KM_PER_DEGREE
        self.lon_step = 1.6 * self.lat_step
        self.slot_minutes = pre + duration + post

    def slot(self, ts: Column) -> Column:
        return F.floor(F.timestamp_diff("MINUTE", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts) / self.slot_minutes).cast("long")

    def y(self, lat: Column) -> Column:
        return F.floor(lat / self.lat_step).cast("int")

    def x(self, lon: Column) -> Column:
        return F.floor(lon / self.lon_step).cast("int")


CELL = ["slot", "y", "x"]


def event_windows(events: DataFrame, grid: Grid) -> DataFrame:
    """Events with a place and a start: their search window in time and their search box."""
    c = F.col
    start = local_datetime(c("date_start"), c("time_start"))
    ev = events.where("latitude IS NOT NULL AND longitude IS NOT NULL AND time_start IS NOT NULL").select(
        "event_id", c("latitude").alias("e_lat"), c("longitude").alias("e_lon"), start.alias("e_start"))
    dlat, dlon = box_half_widths(c("e_lat"), grid.radius_km)
    return ev.withColumns({
        "e_from": c("e_start") - minutes_interval(F.lit(grid.pre)),
        "e_to": c("e_start") + minutes_interval(F.lit(grid.duration + grid.post)),
        "dlat": dlat, "dlon": dlon,
    })


def event_cells(events: DataFrame, grid: Grid) -> DataFrame:
    """Events exploded over the grid keys their search window touches."""
    return _cells(event_windows(events, grid), grid)


def _cells(ev: DataFrame, grid: Grid) -> DataFrame:
    c = F.col
    axes = (("slot", grid.slot, c("e_from"), c("e_to")), ("y", grid.y, c("e_lat") - c("dlat"), c("e_lat") + c("dlat")), ("x", grid.x, c("e_lon") - c("dlon"), c("e_lon") + c("dlon")))
    for name, key, lo, hi in axes:
        ev = ev.withColumn(name, F.explode(F.sequence(key(lo), key(hi))))
    return ev


def leg_cells(bookings: DataFrame, grid: Grid) -> DataFrame:
    c = F.col
    return booking_legs(bookings).withColumns({"slot": grid.slot(c("pickup_datetime")), "y": grid.y(c("lat")), "x": grid.x(c("lon"))})


def in_reach(near: DataFrame, grid: Grid) -> DataFrame:
    """The box and distance rules over legs and places that met in a cell; column ``dist``."""
    c = F.col
    near = near.where((F.abs(c("lat") - c("e_lat")) <= c("dlat")) & (F.abs(c("lon") - c("e_lon")) <= c("dlon")))
    return near.withColumn("dist", haversine_km(c("lat"), c("lon"), c("e_lat"), c("e_lon"))).where(c("dist") <= grid.radius_km)


def exact_matches(near: DataFrame, grid: Grid) -> DataFrame:
    """The exact window, box, distance and leg rules over pairs that met in a cell."""
    c = F.col
    near = in_reach(near.where((c("pickup_datetime") >= c("e_from")) & (c("pickup_datetime") <= c("e_to"))), grid)
    micros = F.timestamp_diff("MICROSECOND", c("e_start"), c("pickup_datetime"))
    near = near.withColumn("time_delta_min", F.floor(micros / F.lit(60_000_000)).cast("int"))
    drop = c("leg") == "DROPOFF"
    near = near.where((drop & (c("time_delta_min") <= V.DROPOFF_LATEST_MINUTES)) | (~drop & (c("time_delta_min") >= 0)))
    delta = F.when(drop, c("time_delta_min")).otherwise(c("time_delta_min") - grid.duration)
    window = F.when(drop, F.lit(grid.pre)).otherwise(F.lit(grid.post + grid.duration))
    return near.select("event_id", "booking_id", "leg", F.bround("dist", 3).alias("distance_km"), "time_delta_min",
                       match_confidence(c("dist"), delta, window, grid.radius_km).alias("match_confidence"))


def correlate(events: DataFrame, bookings: DataFrame, grid: Grid | None = None, since=None, until=None, rows_per_split: int = 1_000_000) -> DataFrame:
    """Event x booking-leg matches by an equi-join on time slot and grid cell.  A leg lies in exactly one cell, so no pair meets twice; hot
    cells (a city centre at a busy hour) are cut by split_join."""
    grid = grid or Grid()
    if since is not None:
        events = events.where(F.col("date_start") >= as_date(since))
    if until is not None:
        events = events.where(F.col("date_start") <= as_date(until))
    return exact_matches(split_join(leg_cells(bookings, grid), event_cells(events, grid), CELL, rows_per_split=rows_per_split), grid)


def likely_matches(events: DataFrame, bookings: DataFrame, least: float, grid: Grid | None = None) -> DataFrame:
    """The matches of ``correlate`` with a confidence of ``least`` or more, out of a grid as fine as that allows.

    Such a pair is near and its leg close to the start (drop-offs) or the end (pick-ups) of the event: confidence is near * (0.5 + 0.5 * soon).
    """
    grid, c = grid or Grid(), F.col
    floor = least - 0.0005  # confidences are rounded to three decimals
    apart, soon = max(0.0, min(1.0, 1 - floor)), max(0.0, 2 * floor - 1)
    drop, pick = (1 - soon) * grid.pre, (1 - soon) * (grid.post + grid.duration)  # minutes
    fine = Grid(grid.radius_km, grid.pre, grid.post, grid.duration)
    fine.lat_step, fine.lon_step = grid.lat_step * max(apart, 1e-3), grid.lon_step * max(apart, 1e-3)
    fine.slot_minutes = int(2 * max(drop, pick)) + 2
    ev = event_windows(events, grid).withColumnsRenamed({"dlat": "box_lat", "dlon": "box_lon", "e_from": "all_from", "e_to": "all_to"})
    # one minute and one part in a hundred wider than needed: the exact rules follow
    narrow = F.greatest(F.cos(F.radians(F.least(F.abs("e_lat") + 0.1, F.lit(90.0)))), F.lit(1e-6))
    reach = grid.radius_km * apart * 1.01 / 110
    ev = ev.withColumns({"dlat": F.least("box_lat", F.lit(reach)), "dlon": F.least("box_lon", F.lit(reach) / narrow)})
    mid = c("e_start") + F.when(c("leg") == "PICKUP", minutes_interval(F.lit(grid.duration))).otherwise(minutes_interval(F.lit(0)))
    half = F.when(c("leg") == "PICKUP", F.lit(int(pick) + 2)).otherwise(F.lit(int(drop) + 2))
    ev = ev.withColumn("leg", F.explode(F.array(F.lit("DROPOFF"), F.lit("PICKUP"))))
    ev = ev.withColumns({"e_from": F.greatest(c("all_from"), mid - minutes_interval(half)), "e_to": F.least(c("all_to"), mid + minutes_interval(half))}).where("e_from <= e_to").drop("all_from", "all_to")
    near = split_join(leg_cells(bookings, fine), _cells(ev, fine).drop("dlat", "dlon").withColumnsRenamed({"box_lat": "dlat", "box_lon": "dlon"}), [*CELL, "leg"])
    return exact_matches(near, grid).where(c("match_confidence") >= least)


LIKELY = (0.998, 0.98, 0.9, 0.7)


def list_best_matches(events: DataFrame, bookings: DataFrame, number: int = 1, size: int = 50, grid: Grid | None = None) -> DataFrame:
    """The page of ``list_matches`` over all matches, which are only listed as far down as the page needs: confidence comes first in its order."""
    if size < 1:
        raise ValueError("a page holds one row at least")
    for least in LIKELY:
        found = cut_lineage(likely_matches(events, bookings, least, grid))
        if found.limit(number * size).count() == number * size:
            return list_matches(found, number=number, size=size)
    return list_matches(correlate(events, bookings, grid), number=number, size=size)


def list_matches(matches: DataFrame, event_id=None, number: int = 1, size: int = 50) -> DataFrame:
    if size < 1:
        raise ValueError("a page holds one row at least")
    out = matches if event_id is None else matches.where(F.col("event_id") == event_id)
    return out.orderBy(F.desc("match_confidence"), "event_id", "booking_id", "leg").offset((number - 1) * size).limit(size)


# ---- labels, features, forecast -------------------------------------------------------------------------------------------------
def labels(matches: DataFrame) -> DataFrame:
    return matches.groupBy("event_id").agg(F.count("*").alias("label_bookings"))


def count_labels(events: DataFrame, bookings: DataFrame, grid: Grid | None = None) -> DataFrame:
    """What ``labels(correlate(events, bookings))`` counts, without a row per match.

    A leg meets each place (coordinates of events) of its time slot once.  Within place, slot and kind of leg one pass in time order counts the legs up to the beginning
    and the end of every window; equal windows are counted once.  So rows grow with legs and windows, not with their product.
    """
    grid, c = grid or Grid(), F.col
    own = event_windows(events, grid)
    spot, at = ["e_lat", "e_lon", "slot"], ["e_lat", "e_lon", "e_start"]
    windows = own.drop("event_id").distinct()
    cells = _cells(windows, grid).select(*CELL, "e_lat", "e_lon", "dlat", "dlon").distinct()
    met = in_reach(split_join(leg_cells(bookings, grid), cells, CELL), grid).groupBy(*spot, "leg", c("pickup_datetime").alias("t")).agg(F.count("*").alias("n"))

    after = F.expr("INTERVAL '1' MICROSECOND")
    latest = c("e_start") + minutes_interval(F.lit(V.DROPOFF_LATEST_MINUTES + 1)) - after  # whole minutes are rounded down
    kinds = F.array(F.struct(F.lit("DROPOFF").alias("leg"), c("e_from").alias("lo"), F.least(c("e_to"), latest).alias("hi")),
                    F.struct(F.lit("PICKUP").alias("leg"), F.greatest(c("e_from"), c("e_start")).alias("lo"), c("e_to").alias("hi")))
    bounds = windows.withColumn("slot", F.explode(F.sequence(grid.slot(c("e_from")), grid.slot(c("e_to"))))).select(*at, "slot", F.inline(kinds)).where("lo <= hi")
    # at equal times a beginning comes before the legs and an end behind them
    marks = bounds.select(*at, "slot", "leg", F.inline(F.array(F.struct(c("lo").alias("t"), F.lit(0).alias("o"), F.lit(-1).alias("sign")),
                                                               F.struct(c("hi").alias("t"), F.lit(2).alias("o"), F.lit(1).alias("sign")))))
    line = marks.withColumn("n", F.lit(0).cast("long")).unionByName(met.withColumns({"o": F.lit(1), "sign": F.lit(0), "e_start": F.lit(None).cast("timestamp_ntz")}))
    upto = F.sum("n").over(Window.partitionBy(*spot, "leg").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0))
    counted = line.withColumn("n", upto).where("sign <> 0").groupBy(*at).agg(F.sum(c("n") * c("sign")).alias("n")).where("n > 0")
    return own.select("event_id", *at).join(counted.hint("merge"), at).groupBy("event_id").agg(F.sum("n").alias("label_bookings"))


def forecast_mode(labelled: DataFrame, required: int) -> DataFrame:
    """FORECAST once ``required`` events have labels; ``labelled`` comes from labels()."""
    return labelled.agg(F.count("*").alias("labelled_events")).select(
        F.when(F.col("labelled_events") >= required, "FORECAST").otherwise("DETERMINISTIC").alias("model_mode"), "labelled_events", F.lit(required).alias("required"))


def booking_status(bookings: DataFrame, labelled: DataFrame, required: int) -> DataFrame:
    b = bookings.agg(F.count("*").alias("bookings"), F.min("pickup_datetime").alias("first_pickup"), F.max("pickup_datetime").alias("last_pickup"))
    m = labelled.agg(F.coalesce(F.sum("label_bookings"), F.lit(0)).alias("correlations"), F.count("*").alias("labelled_events"))
    mode = F.when(F.col("labelled_events") >= required, "FORECAST").otherwise("DETERMINISTIC")
    return b.withColumn("_k", F.lit(1)).join(m.withColumn("_k", F.lit(1)), "_k").drop("_k").withColumn("model_mode", mode).withColumn("required", F.lit(required))


def features(events: DataFrame, weather: DataFrame | None = None, traffic: DataFrame | None = None, transport: DataFrame | None = None) -> DataFrame:
    """Typed feature row per event.  The three external hooks are optional tables keyed on event_id; without one the column is null."""
    c = F.col
    out = events.select(
        "event_id", "date_start", c("category").alias("event_type"), c("subcategory").alias("event_subtype"), c("opportunity_score").alias("event_score"),
        c("event_quality_score").alias("quality_score"), "venue_id", c("venue_capacity").alias("capacity"), "city_id",
        F.weekday("date_start").alias("day_of_week"), hour_of(c("time_start")).alias("start_hour"), weekend(c("date_start")).alias("is_weekend"), "status", "source_confidence")
    for name, table in (("weather", weather), ("traffic", traffic), ("transport_disruptions", transport)):
        out = out.withColumn(name, F.lit(None).cast("string")) if table is None else out.join(table.select("event_id", name), "event_id", "left")
    return out


def feature_table(events: DataFrame, matches: DataFrame | None, required: int, since=None, labelled: DataFrame | None = None, **hooks) -> DataFrame:
    """Full recompute of features with labels (null when an event has none) and the model mode.  The match runs once: labels are stored before both uses.

    ``labelled`` (from count_labels) takes the place of listed matches.
    """
    labelled = cut_lineage(labels(matches) if labelled is None else labelled)
    if since is not None:
        events = events.where(F.col("date_start") >= as_date(since))
    mode = forecast_mode(labelled, required).select("model_mode", F.lit(1).alias("_k"))
    return (features(events, **hooks).join(labelled, "event_id", "left").withColumn("_k", F.lit(1)).join(mode, "_k", "left").drop("_k"))


def _weighted_median(df: DataFrame, by: str, value: str, alias: str) -> DataFrame:
    """Exact median per key: equal values are counted first, so a task holds distinct values, not rows."""
    return (df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
            .groupBy(by).agg(F.percentile(F.col(value), F.lit(0.5), F.col("_n")).alias(alias), F.sum("_n").alias(f"{alias}_n")))


def category_models(table: DataFrame) -> DataFrame:
    """Median label and median capacity of labelled events per category."""
    known = table.where("label_bookings IS NOT NULL")
    y = _weighted_median(known, "event_type", "label_bookings", "median_label")
    cap = _weighted_median(known.where("coalesce(capacity, 0) <> 0"), "event_type", "capacity", "median_capacity").drop("median_capacity_n")
    return y.join(cap, "event_type", "left").withColumnRenamed("median_label_n", "sample")


def forecast(events: DataFrame, table: DataFrame, required: int, category_sample: int) -> DataFrame:
    """Explainable estimate per event: category median scaled by the clamped capacity ratio; null while fewer than ``required`` events or ``category_sample`` events of
    the category have labels."""
    c = F.col
    labelled = table.where("label_bookings IS NOT NULL").agg(F.countDistinct("event_id").alias("labelled_events")).withColumn("_k", F.lit(1))
    ratio = F.when((F.coalesce("venue_capacity", F.lit(0)) != 0) & c("median_capacity").isNotNull(), c("venue_capacity") / c("median_capacity")).otherwise(F.lit(1.0))
    out = events.select("event_id", "category", "venue_capacity").join(category_models(table).withColumnRenamed("event_type", "category"), "category", "left")
    out = out.withColumn("_k", F.lit(1)).join(labelled, "_k").drop("_k")
    ready = c("labelled_events") >= required
    enough = F.coalesce(c("sample"), F.lit(0)) >= category_sample
    return out.select(
        "event_id", "category", F.when(ready, "FORECAST").otherwise("DETERMINISTIC").alias("model_mode"),
        F.when(ready & enough, F.bround(c("median_label") * F.least(F.greatest(ratio, F.lit(0.2)), F.lit(5.0)), 0).cast("long")).alias("estimate"),
        F.coalesce("sample", F.lit(0)).alias("sample"))
