"""Decontamination against brute force over word lists."""

import random
import re
from collections import defaultdict

from crowdtide.llm.winnowing import contamination, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    known = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            known[tuple(w[k: k + n])].add(item)
    sizes = {len(k) for k in known}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k: k + n])) in known:
                    hit.update(range(k, k + n))
                    found |= known[g]
        out.append((doc, len(w), len(hit), len(found), sorted(str(x) for x in found), bool(hit)))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in df.collect()), key=str)


def test_generated(spark):
    d, b = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    got = rows_of(contamination(d, b))
    assert got == sorted(brute([(r.doc_id, r.text) for r in d.collect()], [tuple(r) for r in b.collect()]), key=str)
    assert any(r[5] for r in got)


def test_random_words(spark):
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice(["a", "b", "C", "é", "x-y", "7"]) for _ in range(n))
    items = [(k, line(rng.choice([0, 1, 3, 4, 5, 6, 9, 10, 11, 14, 30]))) for k in range(25)] + [(90, None), (91, "")]
    docs = [(k, line(rng.randrange(60)) + "." + (rng.choice(items)[1] or "") + "\n" + line(5)) for k in range(60)] + [(70, None), (71, ""), (72, "!!")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(contamination(d, b)) == sorted(brute(docs, items), key=str)


def test_odd_rows(spark):
    text = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(None, text, 1), (None, text, 1), (5, "nothing of it", 2)], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame([(3, text), (3, text)], "item_id long, text string")
    assert rows_of(contamination(d, b)) == sorted([(None, 11, 11, 1, ["3"], True), (None, 11, 11, 1, ["3"], True), (5, 3, 0, 0, [], False)], key=str)
    assert [tuple(r) for r in decontaminate(d, b).collect()] == [(5, "nothing of it", 2)]
    assert contamination(d.limit(0), b).count() == 0
    assert contamination(d, b.limit(0)).where("contaminated").count() == 0
