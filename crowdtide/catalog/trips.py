"""Bookings: readers, canonical rows, upsert, matching, labels, features, forecast."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import bookings as bk
from ..session import scratch
from ..sources import files
from .registry import check
from .shape import iso

c = F.col
RAW = ["case when pmod(event_id, 50) = 0 then '' else cast(event_id as string) end booking_id",
       "case pmod(event_id, 4) when 0 then date_format(ts, 'yyyy-MM-dd HH:mm') when 1 then date_format(ts, 'dd/MM/yyyy HH:mm') when 2 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:00\") else case when pmod(event_id, 44) = 3 then 'NULL' else date_format(ts, 'yyyy-MM-dd') end end pickup_datetime",
       "case when pmod(user_id, 3) = 0 then 'ls11 0es' else 'bad' end pickup_postcode", "cast(value as string) fare", "case when event_type = 'view' then '' else event_type end status"]
RAW_SQL = """SELECT CASE WHEN event_id % 50 <> 0 THEN event_id::VARCHAR END AS booking_id, CASE WHEN event_id % 4 < 3 THEN strftime(ts, '%Y-%m-%d %H:%M:00') WHEN event_id % 44 = 3 THEN NULL ELSE strftime(ts, '%Y-%m-%d 00:00:00') END AS pickup_datetime,
    CASE WHEN user_id % 3 = 0 THEN 'LS11 0ES' END AS pickup_postcode, value AS fare, CASE WHEN event_type <> 'view' THEN event_type END AS status FROM events"""
GOOD_SQL = f"SELECT * FROM ({RAW_SQL}) WHERE booking_id IS NOT NULL AND pickup_datetime IS NOT NULL"
SHOWN = ["booking_id", "pickup_datetime", "pickup_postcode", "fare", "status"]


def raw(t):
    return t.table("events").selectExpr(*RAW)


@check("src02_booking_csv", GOOD_SQL)
def src02(t):
    path = scratch(t.spark, "bookings_in") + ".csv"
    raw(t).write.mode("overwrite").option("header", True).csv(path)
    return iso(bk.to_canonical(files.read_bookings(t.spark, path))[0].select(*SHOWN))


JSON_DOC = "concat(case pmod(hash(booking_id), 3) when 0 then '[' when 1 then '{\"bookings\":[' else '{\"data\":[' end, to_json(struct(*)), case pmod(hash(booking_id), 3) when 0 then ']' else ']}' end)"


@check("src03_booking_json", GOOD_SQL)
def src03(t):
    docs = raw(t).selectExpr(f"{JSON_DOC} value")
    return iso(bk.to_canonical(files.bookings_from_json(docs))[0].select(*SHOWN))


@check("src05_suffix_dispatch", f"SELECT '.csv' AS kind, count(*) AS n FROM ({RAW_SQL}) UNION ALL SELECT '.json', count(*) FROM ({RAW_SQL})")
def src05(t):
    base = scratch(t.spark, "dispatch")
    raw(t).write.mode("overwrite").option("header", True).csv(f"{base}.csv")
    # each partition of the table becomes one file with one array
    docs = raw(t).select(F.to_json(F.struct("booking_id", "pickup_datetime", "fare")).alias("j"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"))
    edge = Window.partitionBy("p").orderBy("at")
    lines = docs.withColumns({"first": F.lag("at").over(edge).isNull(), "last": F.lead("at").over(edge).isNull()}).sortWithinPartitions("p", "at")
    text = F.concat(F.when(c("first"), "[").otherwise(","), c("j"), F.when(c("last"), "]").otherwise(""))
    lines.select("p", text.alias("value")).write.mode("overwrite").partitionBy("p").text(f"{base}.json")
    out = [files.read_bookings(t.spark, f"{base}{k}").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k in (".csv", ".json")]
    return out[0].union(out[1])


@check("src06_column_mapping", "SELECT event_id::VARCHAR AS booking_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS pickup_datetime, NULL::DOUBLE AS fare FROM events")
def src06(t):
    src = t.table("events").selectExpr("cast(event_id as string) `Job No`", "ts `Pickup Time`", "value other")
    good, _ = bk.to_canonical(src, {"booking_id": "Job No", "pickup_datetime": "Pickup Time"})
    return iso(good.select("booking_id", "pickup_datetime", "fare"))


@check("src23_booking_api_payload", GOOD_SQL)
def src23(t):
    docs = raw(t).selectExpr("concat('{\"data\":[', to_json(struct(*)), '], \"page\": 1}') value")
    return iso(bk.to_canonical(files.bookings_from_json(docs))[0].select(*SHOWN))


@check("prj08_canonical_bookings", f"""SELECT booking_id, pickup_datetime, 'ok' AS verdict FROM ({GOOD_SQL}) UNION ALL SELECT booking_id, pickup_datetime, 'rejected' FROM ({RAW_SQL}) WHERE booking_id IS NULL OR pickup_datetime IS NULL""")
def prj08(t):
    return iso(bk.judge(raw(t)).select("booking_id", "pickup_datetime", F.when(c("accepted"), "ok").otherwise("rejected").alias("verdict")))


@check("ups01_booking_upsert", """SELECT coalesce(n.booking_id, o.booking_id) AS booking_id, coalesce(n.fare, o.fare) AS fare, CASE WHEN n.booking_id IS NULL THEN 'kept' WHEN o.booking_id IS NULL THEN 'created' ELSE 'updated' END AS merge_action
    FROM (SELECT event_id AS booking_id, value AS fare FROM events WHERE event_id % 3 <> 0) o FULL JOIN (SELECT id AS booking_id, max_by(fare, event_id) AS fare FROM (SELECT event_id - event_id % 5 AS id, value + 1 AS fare, event_id FROM events) GROUP BY 1) n USING (booking_id)""")
def ups01(t):
    e = t.table("events")
    stored = e.where("pmod(event_id, 3) <> 0").selectExpr("event_id booking_id", "ts pickup_datetime", "value fare")
    batch = e.selectExpr("event_id - pmod(event_id, 5) booking_id", "ts pickup_datetime", "value + 1 fare", "event_id read_order")
    return bk.upsert(stored, batch, "batch").select("booking_id", "fare", "merge_action")


@check("ups01b_upsert_counts", """SELECT count(*) AS read, count(DISTINCT id) FILTER (id % 3 = 0) AS created, count(*) - count(DISTINCT id) FILTER (id % 3 = 0) AS updated, 0::BIGINT AS rejected FROM (SELECT event_id - event_id % 5 AS id FROM events)""")
def ups01b(t):
    e = t.table("events")
    stored = e.where("pmod(event_id, 3) <> 0").selectExpr("event_id booking_id")
    batch = e.selectExpr("event_id - pmod(event_id, 5) booking_id")
    return bk.upsert_counts(batch, batch, batch.where("booking_id IS NULL"), stored)


def matches(t):
    return bk.correlate(t.booking_event, t.booking)


def labelled(t):
    return bk.count_labels(t.booking_event, t.booking)


@check("join05_space_time_match", "SELECT event_id, booking_id, leg, distance_km, time_delta_min, match_confidence FROM d_match")
def join05(t):
    return matches(t)


@check("join18_labels", "SELECT e.event_id, m.n AS label_bookings FROM d_bevent e LEFT JOIN (SELECT event_id, count(*) AS n FROM d_match GROUP BY 1) m USING (event_id)")
def join18(t):
    return t.booking_event.select("event_id").join(labelled(t), "event_id", "left")


@check("agg17_booking_status", """SELECT * FROM (SELECT count(*) AS bookings, strftime(min(pickup_datetime), '%Y-%m-%d %H:%M:%S') AS first_pickup, strftime(max(pickup_datetime), '%Y-%m-%d %H:%M:%S') AS last_pickup FROM d_booking),
    (SELECT count(*) AS correlations, count(DISTINCT event_id) AS labelled_events, CASE WHEN count(DISTINCT event_id) >= 200 THEN 'FORECAST' ELSE 'DETERMINISTIC' END AS model_mode FROM d_match)""")
def agg17(t):
    return iso(bk.booking_status(t.booking, labelled(t), V.MIN_LABELLED_EVENTS).drop("required"))


@check("agg18_mode_switch", "SELECT CASE WHEN count(DISTINCT event_id) >= 200 THEN 'FORECAST' ELSE 'DETERMINISTIC' END AS model_mode, count(DISTINCT event_id) AS labelled_events, 200 AS required FROM d_match")
def agg18(t):
    return bk.forecast_mode(labelled(t), V.MIN_LABELLED_EVENTS)


@check("agg19_label_counts", "SELECT event_id, count(*) AS label_bookings FROM d_match GROUP BY 1")
def agg19(t):
    return labelled(t)


MODEL = """model AS (SELECT e.category, median(m.n) AS median_label, count(*) AS sample, median(e.venue_capacity) FILTER (e.venue_capacity > 0) AS median_capacity FROM d_bevent e
    JOIN (SELECT event_id, count(*) AS n FROM d_match GROUP BY 1) m USING (event_id) GROUP BY 1)"""


def table(t):
    ev = t.booking_event.withColumns({"subcategory": F.lit("x"), "opportunity_score": F.lit(0), "event_quality_score": F.lit(0), "venue_id": F.lit(0), "city_id": F.lit(0),
                                      "status": F.lit("SCHEDULED"), "source_confidence": F.lit("TRUSTED")})
    return bk.feature_table(ev, None, V.MIN_LABELLED_EVENTS, labelled=labelled(t))


@check("agg20_category_medians", f"WITH {MODEL} SELECT category AS event_type, median_label, sample, median_capacity FROM model")
def agg20(t):
    return bk.category_models(table(t))


@check("mth16_forecast", f"""WITH {MODEL}, n AS (SELECT count(DISTINCT event_id) AS labelled FROM d_match)
    SELECT e.event_id, e.category, CASE WHEN n.labelled >= 200 THEN 'FORECAST' ELSE 'DETERMINISTIC' END AS model_mode, coalesce(m.sample, 0) AS sample,
      CASE WHEN n.labelled >= 200 AND coalesce(m.sample, 0) >= 10 THEN round_even(m.median_label * least(greatest(CASE WHEN e.venue_capacity > 0 AND m.median_capacity IS NOT NULL THEN e.venue_capacity / m.median_capacity ELSE 1e0 END, 0.2::DOUBLE), 5e0), 0)::BIGINT END AS estimate
    FROM d_bevent e LEFT JOIN model m USING (category), n""")
def mth16(t):
    return bk.forecast(t.booking_event, table(t), V.MIN_LABELLED_EVENTS, V.MIN_CATEGORY_SAMPLE)


@check("ups13_feature_table", """SELECT e.event_id, e.category AS event_type, isodow(e.start::DATE) - 1 AS day_of_week, hour(e.start) AS start_hour, m.n AS label_bookings,
    (SELECT CASE WHEN count(DISTINCT event_id) >= 200 THEN 'FORECAST' ELSE 'DETERMINISTIC' END FROM d_match) AS model_mode FROM d_bevent e LEFT JOIN (SELECT event_id, count(*) AS n FROM d_match GROUP BY 1) m USING (event_id)""")
def ups13(t):
    return table(t).select("event_id", "event_type", "day_of_week", "start_hour", "label_bookings", "model_mode")
