"""Batch run end to end: idempotency, duplicates, changes, cancelled events."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crowdtide.plans.run import empty_state, run_batch
from crowdtide.session import cut_lineage
from crowdtide.sources.files import CITY_SCHEMA, VENUE_SCHEMA, registry_from_rows, seed_dimensions
from crowdtide.sources.staging import STAGED_SCHEMA

AS_OF = dt.date(2026, 9, 18)
DAY = AS_OF + dt.timedelta(days=5)


def listings(spark, time="19:30", status="SCHEDULED"):
    base = {"source_key": "curated", "date_start": DAY, "city_name": "London", "status": "SCHEDULED", "sold_out": False, "source_confidence": "CURATED"}
    rows = [
        {**base, "external_id": "x1", "title": "Big Concert Tour", "category_hint": "concert", "time_start": time, "venue_name": "The O2", "status": status, "raw": f"{{{time}{status}}}"},
        {**base, "external_id": "x2", "title": "Arsenal v Chelsea", "time_start": "15:00", "venue_name": "Emirates Stadium", "raw": "{2}"},
        {**base, "external_id": "x3", "title": "Arsenal v Chelsea", "time_start": "15:00", "venue_name": "Emirates Stadium", "raw": "{3}"},
        {**base, "external_id": "x4", "title": "Car park voucher", "time_start": "15:00", "venue_name": "Emirates Stadium", "raw": "{4}"},
    ]
    names = [p.strip().split(" ")[0] for p in STAGED_SCHEMA.split(",")]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], STAGED_SCHEMA)
    return df.withColumn("ordinal", F.regexp_extract("external_id", r"(\d+)", 1).cast("bigint"))


@pytest.fixture(scope="module")
def state(spark):
    cities = registry_from_rows(spark, [{"name": "London", "region": "Greater London", "latitude": 51.5, "longitude": -0.12, "priority": 100, "tourism": 1.0}], CITY_SCHEMA)
    venues = registry_from_rows(spark, [
        {"name": "The O2", "aliases": ["O2 Arena"], "city": "London", "capacity": 20000, "venue_type": "arena", "latitude": 51.5, "longitude": 0.0, "station_distance_km": 0.2, "airport_distance_km": 5.0, "postcode": "SE10 0DX"},
        {"name": "Emirates Stadium", "city": "London", "capacity": 60704, "venue_type": "stadium", "latitude": 51.55, "longitude": -0.11, "station_distance_km": 0.4, "airport_distance_km": 25.0, "postcode": "N7 7AJ"}], VENUE_SCHEMA)
    source = spark.createDataFrame([("curated", 50)], "key string, priority int")
    return empty_state(spark, source=source, **{k: cut_lineage(v) for k, v in seed_dimensions(cities, venues).items()})


STORED = ("event", "event_source", "event_change", "event_snapshot", "raw_event", "opportunity")


def keep(tables):
    """What a writer would have stored between runs; the other tables are checkpointed by the run itself."""
    return {k: cut_lineage(v) if k in STORED else v for k, v in tables.items()}


def test_first_run(spark, state):
    _, metrics = run_batch(state, listings(spark), AS_OF, dt.datetime(2026, 9, 18, 12), 1)
    m = metrics.first()
    assert (m.status, m.events_raw, m.events_valid, m.events_created, m.duplicates_removed, m.snapshots) == ("SUCCESS", 4, 3, 2, 1, 2)
    assert m.opportunities_generated >= 5 and m.actions_generated >= 5


def test_three_runs(spark, state):
    now = dt.datetime(2026, 9, 18, 12)
    s1, m1 = run_batch(state, listings(spark), AS_OF, now, 1)
    m1 = m1.first()
    assert (m1.status, m1.events_raw, m1.events_valid, m1.events_created, m1.duplicates_removed) == ("SUCCESS", 4, 3, 2, 1)
    s1 = keep(s1)
    n_raw = s1["raw_event"].count()

    s2, m2 = run_batch(s1, listings(spark), AS_OF, now + dt.timedelta(hours=1), 2)
    m2 = m2.first()
    assert (m2.events_created, m2.events_updated, m2.changes_detected, m2.snapshots, m2.opportunities_generated, m2.actions_generated) == (0, 0, 0, 0, 0, 0)
    s2 = keep(s2)
    assert s2["event"].count() == 2 and s2["raw_event"].count() == n_raw and s2["event_source"].count() == 3

    s3, _ = run_batch(s2, listings(spark, "20:00", "CANCELLED"), AS_OF, now + dt.timedelta(hours=2), 3)
    s3 = keep(s3)
    kinds = {r.change_type for r in s3["event_change"].where("run_id = 3").collect()}
    assert {"TIME_CHANGED", "CANCELLED"} <= kinds
    show = s3["scored_event"].where("title = 'Big Concert Tour'").first()
    assert show.status == "CANCELLED" and show.opportunity_score == 0
    acts = s3["action"].where(F.col("event_id") == show.event_id).collect()
    assert acts and all(a.status == "DISMISSED" for a in acts)
    match = s3["scored_event"].where("title = 'Arsenal v Chelsea'").first()
    assert match.v_capacity == 60704 and match.c_name == "London" and match.opportunity_score > 60 and match.windows.label == "Modelled demand window"
    assert s3["opportunity"].where(F.col("event_id") == match.event_id).count() >= 5
    assert s3["action"].where(F.col("event_id") == match.event_id).count() >= 5
    assert s3["rejection"].first().problem == "non_event_title"
