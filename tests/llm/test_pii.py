"""Base spans against a plain reading of their patterns; added spans and odd rows."""

import random
import re

from pyspark.sql import functions as F

from crowdtide.llm.pii import KINDS, detect, joined, reliabilities

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", joined(F.col("base")), joined(F.col("spans"))).collect()), key=str)


def test_random(spark):
    rng = random.Random(2)
    bits = ["a@b.co", "x.y@z", "@", ".", "1.2.3.4", "300.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+1", " ", " ", "é😀", "-", "12", "(", "%", "\n", "+44 20 7946 0958", "5"]
    docs = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for k in range(400)]
    docs += [(500, None), (501, ""), (502, "a" * 100_000 + " 7" * 20_000 + "1." * 20_000 + "b@c" + ".d" * 20_000), (503, "1" * 60_000)]
    got = rows_of(detect(spark.createDataFrame(docs, "doc_id long, text string")))
    assert [g[:2] for g in got] == sorted(((d, base(t)) for d, t in docs), key=str)
    for _, b, s in got:
        assert set(filter(None, b.split(","))) <= set(filter(None, s.split(",")))


def test_generated(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [g[:2] for g in rows_of(detect(df))] == sorted(((r.doc_id, base(r.text)) for r in df.collect()), key=str)


def test_added_and_odd(spark):
    docs = [(k, f"please call phone 0{20 + k} 7946 {1000 + 37 * k} now, ip 10.0.0.{k}") for k in range(30)] + [(40, "version 100 200 300 here")]
    docs += [(None, "mail a@b.com"), (None, "mail a@b.com")]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, base string, kind string")
    got = {g[0]: g for g in rows_of(detect(df))}
    assert "phone:18:" in got[3][2] and "phone" not in got[3][1]
    assert len(rows_of(detect(df))) == len(docs)
    assert detect(df.limit(0)).count() == 0


def test_em():
    patterns = [((1, 1), False, 80), ((0, 0), False, 100), ((1, 0), False, 10), ((0, 1), False, 10), ((1, None), True, 50)]
    _, rates, chance = reliabilities(patterns, 2)
    assert chance[(1, 1), False] > 0.9 > 0.1 > chance[(0, 0), False]
    assert all(yes > no for yes, no in rates)
