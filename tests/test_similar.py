"""Similarity and cell joins against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from crowdtide.functions import similarity
from crowdtide.operators import bookings as bk
from crowdtide.operators import similar
from crowdtide.session import split_join

from .similarity_reference import ratio_of, token_set_of

WORDS = "arena royal hall the park city stadium festival jazz night club rock show o2 academy london leeds theatre grand a b c x new old".split()


def titles(n, seed):
    rnd, out = random.Random(seed), set()
    while len(out) < n:
        ws = [rnd.choice(WORDS) for _ in range(rnd.randint(1, 6))]
        if rnd.random() < 0.5:
            i = rnd.randrange(len(ws))
            j = rnd.randrange(len(ws[i]) + 1)
            ws[i] = ws[i][:j] + rnd.choice("abcxyz") + ws[i][j:]
        out.add(" ".join(ws))
    return sorted(out)


def sides(spark, a, b, text=lambda x: x):
    left = spark.createDataFrame([(x, x, 1) for x in a], "l_id string, l_text string, d int").withColumn("l_text", text(F.col("l_text")))
    return left, spark.createDataFrame([(x, x, 1) for x in b], "r_id string, r_text string, d int").withColumn("r_text", text(F.col("r_text")))


def test_pairs_are_complete(spark):
    a, b = titles(150, 1), titles(150, 2)
    left, right = sides(spark, a, b, similar.word_set_text)
    for t in (0.7, 0.8, 0.97):
        want = {(x, y) for x in a for y in b if token_set_of(x, y) >= 100 * t}
        got = set(map(tuple, similar.pair_prefixes(left, right, t, ["d"]).union(similar.word_pairs(left, right, t, ["d"])).distinct().collect()))
        assert want and want <= got


def test_plain_pairs_are_complete(spark):
    """Short names and slips of the pen, in letters of several scripts; most pairs are never compared."""
    rnd, names = random.Random(8), []
    for n in range(300):
        name = "".join(rnd.choice("abcdeäжλ") for _ in range(rnd.randint(1, 12)))
        at = rnd.randrange(len(name))
        names += [name, name[:at] + rnd.choice("abz ") + name[at + rnd.randint(0, 1):]]
    names = sorted({x.strip() for x in names} - {""})
    left, right = sides(spark, names, names)
    for t in (0.75, 0.88):
        want = {(x, y) for x in names for y in names if ratio_of(x, y) >= 100 * t}
        got = set(map(tuple, similar.pair_prefixes(left, right, t).collect()))
        assert want <= got and len(got) < len(names) ** 2 / 4


def test_columns_equal_the_dynamic_program(spark):
    rnd = random.Random(3)
    rows = [("", ""), ("a", ""), (None, "a"), ("a b", "b a"), (" a  b ", "a b c"), ("éß jazz", "jazz eß"), ("x" * 62, "x" * 63), ("ab " * 60, "ba " * 70)]
    for n in (5, 30, 61, 62, 63, 64, 124, 125, 200):
        for _ in range(6):
            rows.append(tuple("".join(rnd.choice("abcd éλ ") for _ in range(rnd.randint(max(1, n - 3), n + 3))) for _ in range(2)))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string")
    for r in df.select("k", "a", "b", similarity.ratio("a", "b").alias("r"), similarity.token_set_ratio("a", "b").alias("t"), similarity.token_set_ratio("a", "b", 60.0).alias("f")).collect():
        assert r.f == (None if r.t is None else r.t if r.t >= 60 else 0.0)
        assert (r.r, r.t) == ((None, None) if r.a is None else (ratio_of(r.a, r.b), token_set_of(r.a, r.b))), (r.a, r.b)


def test_split_join_equals_plain_join(spark):
    many = spark.range(500).selectExpr("id", "case when id < 200 then 1 else id % 7 end k")
    few = spark.range(20).selectExpr("id % 9 k", "id v")
    for how in ("inner", "left"):
        got = sorted(map(tuple, split_join(many, few, ["k"], how, rows_per_split=30).select("id", "k", "v").collect()), key=str)
        assert got == sorted(map(tuple, many.join(few, "k", how).select("id", "k", "v").collect()), key=str)


def test_correlate_equals_brute_force(spark):
    rnd = random.Random(5)
    day = dt.date(2026, 9, 10)
    events = spark.createDataFrame([(i, day, f"{rnd.randint(10, 22):02d}:00", 53.8 + rnd.random() * 0.05, -1.55 + rnd.random() * 0.05) for i in range(40)],
                                   "event_id int, date_start date, time_start string, latitude double, longitude double")
    trips = spark.createDataFrame(
        [(i, dt.datetime(2026, 9, 10, rnd.randint(6, 23), rnd.randint(0, 59)), *[x + rnd.random() * 0.05 for x in (53.8, -1.55, 53.8, -1.55)]) for i in range(300)],
        "booking_id int, t timestamp, pickup_lat double, pickup_lon double, dropoff_lat double, dropoff_lon double").select("*", F.col("t").cast("timestamp_ntz").alias("pickup_datetime"))
    grid = bk.Grid()
    cells = bk.event_cells(events, grid).drop("slot", "y", "x").distinct()
    brute = bk.exact_matches(bk.booking_legs(trips).crossJoin(cells), grid)
    want = sorted(map(tuple, brute.collect()))
    assert want and sorted(map(tuple, bk.correlate(events, trips, rows_per_split=5).collect())) == want


def test_close_pairs_are_complete_and_few(spark):
    rnd, names = random.Random(4), titles(30, 5)
    numbers = [f"{rnd.randint(0, 99_999):09d} customer" for _ in range(100)] + [f"hall {rnd.randint(0, 99_999)}" for _ in range(100)]
    for x in list(numbers) + names:
        at = rnd.randrange(len(x))
        names += [x, (x[:at] + rnd.choice("7ab") + x[at + rnd.randint(0, 1):]).strip()]
    names = sorted({" ".join(x.split()) for x in names})
    left, right = (df.drop("d") for df in sides(spark, names, names))
    for t in (0.75, 0.9):
        want = {(x, y) for x in names for y in names if ratio_of(x, y) >= 100 * t}
        got = set(map(tuple, similar.close_pairs(left, right, t).collect()))
        assert want <= got
    many = similar.pair_prefixes(left, right, 0.9).count()
    assert len(got) < many / 5
    left, right = (df.drop("d") for df in sides(spark, names[::4], names[::3], similar.word_set_text))
    want = {(x, y) for x in names[::4] for y in names[::3] if token_set_of(x, y) >= 90}
    assert want <= set(map(tuple, similar.close_pairs(left, right, 0.9).union(similar.word_pairs(left, right, 0.9)).collect()))
