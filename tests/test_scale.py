"""Steps that have to stay off the driver and off single tasks, whatever the planner guesses."""

from __future__ import annotations

import datetime as dt
import random
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import functions as F

from crowdtide.operators import bookings as bk
from crowdtide.operators import entities as en
from crowdtide.operators import geography as geo
from crowdtide.plans import reports
from crowdtide.session import left_lookup, split_join
from crowdtide.sources import feeds, html

from .similarity_reference import token_set_of


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_exploded_names_are_not_broadcast(spark):
    names = spark.sql("select * from values ('customer 12 main stage'), ('hall'), ('customer 0000') t(key)")
    index = spark.sql("select * from values ('customer 12', 1L), ('hall 77', 2L), ('customer 000012', 3L) t(key, venue_id)")
    pairs = geo._contains_pairs(names, index, "venue_id")
    assert "Broadcast" not in plan(pairs)
    assert {tuple(r) for r in pairs.collect()} == {("customer 12 main stage", "customer 12", 1), ("hall", "hall 77", 2), ("customer 0000", "customer 000012", 3)}


def test_split_join_sends_no_side_to_the_driver(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    few = spark.range(3).select(F.col("id").alias("k"), F.explode(F.array(F.lit(1), F.lit(2))).alias("x"))
    out = split_join(rows, few, ["k"], rows_per_split=20)
    assert "ResolvedHint (strategy=merge)" in plan(out)
    assert out.count() == 200


def trips(spark, n=400, m=60, seed=5):
    """Events at few places and full minutes, bookings around them to the second; some keys twice, some fields null."""
    rnd, day = random.Random(seed), dt.datetime(2026, 9, 10)
    places = [(53.8 + rnd.random() / 40, -1.55 + rnd.random() / 40) for _ in range(6)] + [(None, -1.5), (85.0, 10.0)]
    events = []
    for i in range(m):
        lat, lon = rnd.choice(places)
        events.append((i // 2, day.date() + dt.timedelta(days=rnd.randint(0, 1)), rnd.choice(["19:00", "19:30", "20:15", "00:10", None]), lat, lon))
    stops = []
    for i in range(n):
        lat, lon = rnd.choice(places[:6] + places[7:])
        when = day + dt.timedelta(minutes=rnd.choice([960, 1140, 1170, 1171, 1290, 1380, 1620, rnd.randint(0, 3000)]), seconds=rnd.choice([0, 0, 59, 1]))
        stops.append((i // 2, None if rnd.random() < 0.03 else when, lat + rnd.uniform(-0.01, 0.01), lon + rnd.uniform(-0.01, 0.01), lat if rnd.random() < 0.6 else None, lon))
    return (spark.createDataFrame(events, "event_id long, date_start date, time_start string, latitude double, longitude double"),
            spark.createDataFrame(stops, "booking_id long, pickup_datetime timestamp_ntz, pickup_lat double, pickup_lon double, dropoff_lat double, dropoff_lon double"))


def test_labels_are_counted_without_listing_matches(spark):
    events, bookings = trips(spark)
    for grid in (bk.Grid(), bk.Grid(0.4, 20, 15, 30)):
        want = bk.labels(bk.correlate(events, bookings, grid))
        got = bk.count_labels(events, bookings, grid)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert got.dtypes == want.dtypes and got.count() > 5


def test_best_matches_are_the_top_of_all(spark):
    events, bookings = trips(spark, 800, 120, seed=6)
    every = bk.correlate(events, bookings)
    for least in (0.998, 0.9, 0.7, 0.3):
        want = every.where(F.col("match_confidence") >= least)
        assert sorted(map(tuple, bk.likely_matches(events, bookings, least).collect())) == sorted(map(tuple, want.collect())) and (want.count() or least > 0.9)
    for number, size in ((2, 5), (2, 60), (3, 10_000)):
        assert bk.list_best_matches(events, bookings, number, size).collect() == bk.list_matches(every, number=number, size=size).collect()


def test_titles_of_other_cities_meet_only_if_nearly_equal(spark, monkeypatch):
    """Same rows as comparing all listings of the day, and far fewer titles compared."""
    rnd, rows = random.Random(9), []
    for i in range(120):
        rows.append((f"k{i}", dt.date(2026, 1, 1 + i % 2), f"orchestra night {rnd.randint(1, 30)}", rnd.choice(["the o2", "the o2 arena", "royal hall", None]), f"city {rnd.randint(1, 8)}",
                     rnd.choice(["19:00", "20:00", None]), rnd.choice(["a", "b"])))
    ev = spark.createDataFrame(rows, "l_key string, date_start date, norm_title string, venue string, city string, time_start string, source_key string").withColumn("title", F.col("norm_title"))
    met, split = [], en.split_join

    def spy(many, few, keys, *rest, **named):
        met.append(few.count() if keys == ["l_id"] else 0)
        return split(many, few, keys, *rest, **named)

    monkeypatch.setattr(en, "split_join", spy)
    got = {(r.l_key, r.r_key, r.confidence) for r in en.fuzzy_matches(ev, ev.withColumnRenamed("l_key", "r_key")).collect()}

    def minutes(x):
        return int(x[:2]) * 60 + int(x[3:])

    best = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] or a[1] != b[1] or not a[3] or not b[3]:
                continue
            if a[5] and b[5] and a[5] != b[5] and abs(minutes(a[5]) - minutes(b[5])) >= (1 if a[6] == b[6] else 120):
                continue
            venue = 1.0 if a[3] == b[3] else token_set_of(a[3], b[3]) / 100
            score = 0.6 * (token_set_of(a[2], b[2]) / 100) + 0.25 * venue + 0.15 * (1.0 if a[4] == b[4] else 0.3)
            score = float(Decimal(repr(score)).quantize(Decimal("0.001"), ROUND_HALF_EVEN))
            if score >= 0.88:
                best[a[0]] = min(best.get(a[0], (0, "~")), (-score, b[0]))
    assert got == {(k, r, -s) for k, (s, r) in best.items()} and len(got) > 20
    titles_met = sum(met)
    titles = {(r[1], r[2]) for r in rows if r[3]}
    assert titles_met < 0.7 * sum(x[0] == y[0] for x in titles for y in titles)


def test_rows_without_a_key_are_spread(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = spark.range(2000).select("id", F.when(F.col("id") < 50, F.col("id")).alias("k"))
        out = left_lookup(rows, spark.range(20).select(F.col("id").alias("k"), F.lit("x").alias("v")), ["k"])
        assert out.columns == ["k", "id", "v"] and out.count() == 2000 and out.where("v = 'x'").count() == 20
        assert max(r["count"] for r in out.where("k is null").groupBy(F.spark_partition_id()).count().collect()) < 1000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_bookings_are_judged_in_one_pass(spark):
    raw = spark.sql("select * from values ('a', '2026-09-10 18:30'), ('', '2026-09-10'), ('b', 'soon'), (null, null) t(booking_id, pickup_datetime)")
    good, bad = bk.to_canonical(raw)
    rows = bk.judge(raw)
    assert rows.where("accepted").drop("accepted").collect() == good.collect() and rows.where("NOT accepted").count() == bad.count() == 3 and good.count() == 1


def test_feed_dates_are_parsed_once(spark):
    items = spark.sql("select 'Macbeth | 12 November 2026 (7:30PM)' title, 'l' link, 'g' guid, '' description, cast(null as string) startdate, cast(null as string) enddate, cast(null as string) location, cast(null as string) pubdate, 'u' feed_url")
    out = feeds.normalize_rss(items.repartition(1))
    assert out.select("title", F.col("date_start").cast("string"), "time_start").first()[:2] == ("Macbeth", "2026-11-12")
    optimised = out._jdf.queryExecution().optimizedPlan().toString()
    assert optimised.count("regexp_extract(_squeezed") <= 12


def test_deep_nodes_go_in_small_batches(spark):
    from pyspark.util import PythonEvalType

    assert html._deep_nodes.evalType == PythonEvalType.SQL_BATCHED_UDF


def test_listings_score_their_events_once(spark, monkeypatch):
    cut = []
    monkeypatch.setattr(reports, "cut_lineage", lambda df: cut.append(df) or df)
    monkeypatch.setattr(reports, "canned", lambda ev, n, as_of: ev)
    assert reports.canned_listings(spark.range(3), dt.date(2026, 1, 1)).count() == 21 and len(cut) == 1
