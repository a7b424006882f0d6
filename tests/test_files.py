"""Booking files: one large array read in many splits, braces and quotes inside texts, nested objects, lists inside objects."""

import json
import random

import pytest

from crowdtide.sources.files import array_elements, read_bookings

TEXTS = ["plain", "a } b { c", 'say "hi"', "back\\slash", "}", '\\"}', "{}", "é ü {", "", "line\nend } x", '"}"{"', "\\\\"]


def bookings(n, seed):
    rng = random.Random(seed)
    return [{"booking_id": str(k), "status": rng.choice(TEXTS), "other": {"deep": {"x": rng.choice(TEXTS)}, "list": [{"y": 1}, rng.choice(TEXTS)]}, "fare": rng.choice(["1.5", None])} for k in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_one_array_in_many_splits(spark, tmp_path, indent):
    folder = tmp_path / "in.json"
    folder.mkdir()
    rows = bookings(400, 1)
    (folder / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=indent is None))
    (folder / "b.json").write_text("[]")
    (folder / "c.json").write_text(json.dumps({"data": [{"booking_id": "w", "status": "} {"}]}))
    (folder / "d.json").write_text(" \n" + json.dumps([{"booking_id": "s", "status": "x"}]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        elements, fragments = array_elements(spark, str(folder / "a.json"))
        assert fragments.select("start").distinct().count() > 10
        got = sorted((json.loads(r.value) for r in elements.collect()), key=lambda r: int(r["booking_id"]))
        assert got == rows
        df = read_bookings(spark, str(folder))
        found = {r.booking_id: r.status for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {**{r["booking_id"]: r["status"] for r in rows}, "w": "} {", "s": "x"}


def test_unknown_suffix(spark):
    with pytest.raises(ValueError):
        read_bookings(spark, "x.parquet")
