"""Matching that keeps its result while fewer rows and files are made on the way."""

import datetime as dt
import os
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from crowdtide.functions.similarity import common_subsequence
from crowdtide.functions.text import normalize_title
from crowdtide.operators import entities as en
from crowdtide.operators import geography as geo
from crowdtide.operators import similar
from crowdtide.session import cut_lineage, dealt_by_part_of_keys, join_in_blocks, settled, shared_folder


def cuts(spark):
    return {x for x in os.listdir(urlparse(shared_folder(spark)).path) if x.startswith("cut-")}


def listings(spark, rows):
    day = dt.date(2026, 3, 1)
    rows = spark.createDataFrame([(k, day, t, v, c, h, "s") for k, t, v, c, h in rows], "l_key long, date_start date, title string, venue string, city string, time_start string, source_key string")
    return rows.withColumn("norm_title", normalize_title("title"))


def test_matching_leaves_one_stored_frame(spark):
    ev = listings(spark, [(1, "Jazz Night Special", "Old Hall", "Leeds", "19:00"), (2, "Jazz Night Special", "Old Hall", "Leeds", "19:00"), (3, "Jazz Night Special", "Old Hall", "York", "19:00")])
    before = cuts(spark)
    found = en.fuzzy_matches(ev, ev.withColumnRenamed("l_key", "r_key"))
    assert len(cuts(spark) - before) == 1
    assert sorted(map(tuple, found.collect())) == [(1, 2, 1.0), (2, 1, 1.0), (3, 1, 0.895)]


def test_a_surer_match_in_the_own_city_is_not_sought_elsewhere(spark, monkeypatch):
    asked, words = [], en.word_pairs

    def spy(left, right, t, block):
        asked.append((tuple(block), sorted(r.l_text for r in left.collect())))
        return words(left, right, t, block)

    monkeypatch.setattr(en, "word_pairs", spy)
    ev = listings(spark, [(1, "Jazz Night Special", "Old Hall", "Leeds", "19:00"), (2, "Jazz Night Special", "Old Hall", "Leeds", "19:00"), (3, "Folk Evening", "Mill", "York", "19:00"),
                          (4, "Folk Evening", "Mill", "Hull", "19:00"), (5, "Poets", "Barn", None, "19:00"), (5, "Poets", "Barn", None, "19:00")])
    found = en.fuzzy_matches(ev, ev.withColumnRenamed("l_key", "r_key"))
    assert sorted(map(tuple, found.collect())) == [(1, 2, 1.0), (2, 1, 1.0), (3, 4, 0.895), (4, 3, 0.895)]
    assert [x for block, x in asked if block == ("date_start",)] == [["evening folk", "poets"]]


def test_texts_that_meet_in_blocks_are_nearly_equal(spark, monkeypatch):
    met, join = [], en.join_in_blocks

    def spy(left, links, right, block, *rest):
        met.append((len(block), sorted((r.l_text, r.r_text) for r in links.collect())))
        return join(left, links, right, block, *rest)

    monkeypatch.setattr(en, "join_in_blocks", spy)
    ev = listings(spark, [(k, f"Macbeth at the Playhouse {k}", "Old Hall", f"city {k % 3}", "19:00") for k in (4, 41, 57, 7)])
    assert [tuple(x) for x in en.fuzzy_matches(ev, ev.withColumnRenamed("l_key", "r_key")).select("l_key", "r_key").orderBy("l_key").collect()] == [(4, 7), (7, 4), (41, 4), (57, 7)]
    texts = {k: f"{k} macbeth playhouse" for k in (4, 41, 57, 7)}
    own, other = (set(x[1]) for x in met)
    assert (texts[4], texts[7]) in own and not any(x in own for x in ((texts[4], texts[41]), (texts[7], texts[57])))
    assert (texts[41], texts[4]) in other and (texts[41], texts[57]) not in other


def test_words_that_cover_too_little_make_no_pairs(spark):
    left = spark.createDataFrame([(1, "a b orchestra"), (2, "night orchestra")], "l_id int, l_text string")
    right = spark.createDataFrame([(1, "gala late orchestra show"), (2, "late night orchestra")], "r_id int, r_text string")
    assert set(map(tuple, similar.word_pairs(left, right, 0.97).collect())) == {(2, 2)}


def test_names_with_all_words_in_common_are_not_compared_further(spark, monkeypatch):
    sizes, close = [], geo.close_pairs

    def spy(left, right, t):
        sizes.append(left.count())
        return close(left, right, t)

    monkeypatch.setattr(geo, "close_pairs", spy)
    venues = spark.createDataFrame([(1, "Customer 000000012", None, True), (2, "Customer 000000013", None, True), (3, "Hall 4711", None, True)],
                                   "venue_id int, name string, aliases array<string>, is_seeded boolean")
    names = spark.createDataFrame([("000000012 Customer",), ("Hal 4711",), ("Elsewhere",)], "name string")
    got = {r.name: (r.venue_id, r.venue_method) for r in geo.match_venues(names, venues).collect()}
    assert got == {"000000012 Customer": (1, "venue_fuzzy_100"), "Hal 4711": (3, "venue_fuzzy_94"), "Elsewhere": (None, "venue_unmatched")}
    assert sizes == [2]


@pytest.mark.parametrize("rows_per_split", [7, 1000])
def test_join_in_blocks_equals_two_joins(spark, rows_per_split):
    left = spark.range(200).selectExpr("id % 5 d", "string(id % 20) l_text", "id l_key")
    links = spark.range(100).selectExpr("id % 5 d", "string(id % 20) l_text", "string((id + 5) % 20) r_text").distinct()
    links = cut_lineage(links)
    right = spark.range(200).selectExpr("id % 5 d", "string(id % 20) r_text", "id r_key")
    want = left.join(links, ["d", "l_text"]).join(right, ["d", "r_text"]).select("d", "l_key", "r_key")
    with dealt_by_part_of_keys(spark):
        met = join_in_blocks(left, links, right, ["d"], "l_text", "r_text", rows_per_split)
        assert sorted(map(tuple, met.select("d", "l_key", "r_key").collect())) == sorted(map(tuple, want.collect()))
        plan = met._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "hashpartitioning" in x and "_text" in x.split("hashpartitioning")[1]]


def test_settled_keeps_its_result_and_what_was_cut_outside(spark):
    outer = cut_lineage(spark.range(3))
    before = cuts(spark)
    out = settled(spark, lambda: settled(spark, lambda: cut_lineage(outer.selectExpr("id + 1 id")).selectExpr("id * 2 id")).selectExpr("id - 1 id"))
    assert sorted(r.id for r in out.collect()) == [1, 3, 5] and outer.count() == 3 and len(cuts(spark) - before) == 1


def test_common_subsequence_without_common_ends(spark):
    rows = [("head\0x tail", "head\0y tail", 10), ("abcXdef", "abcdef", 6), ("aXa", "aa", 2), ("aaaa", "aa", 2), ("line\none", "line\ntwo", 6), ("same", "same", 4), ("", "a", 0), (None, "a", None)]
    df = spark.createDataFrame(rows, "a string, b string, n int")
    assert [r.got for r in df.select(F.col("n"), common_subsequence(F.col("a"), F.col("b")).alias("got")).collect()] == [r[2] for r in rows]
