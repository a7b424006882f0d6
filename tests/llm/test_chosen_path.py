"""Jaccard join and components against brute force."""

import random
import re

from crowdtide.llm import chosen_path
from crowdtide.llm.chosen_path import keep_one, link
from crowdtide.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(w))
    return frozenset(tuple(w[k: k + n]) for k in range(len(w) - n + 1)) if n else frozenset()


def brute(docs, threshold=0.8):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(docs)
    for x in range(len(docs)):
        for y in range(x + 1, len(docs)):
            both = len(sets[x] & sets[y])
            if both and both >= threshold * (len(sets[x]) + len(sets[y]) - both) - 1e-9:
                links[x] += 1
                links[y] += 1
                a, b = sorted((find(x), find(y)))
                root[b] = a
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return sorted(((d, least.get(find(k)), links[k]) for k, (d, _) in enumerate(docs)), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=str)


def test_random(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "TILE", 8)
    monkeypatch.setattr(chosen_path, "HOT", 12)
    rng = random.Random(4)
    docs = []
    hot = " ".join(f"h{k}" for k in range(12))
    for family in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.choice([1, 2, 3, 30])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                text[rng.randrange(len(text))] = f"w{rng.randrange(3000)}"
            docs.append((len(docs), " ".join(text) + (". " + hot if family % 2 else "")))
    docs += [(900, None), (901, ""), (902, "?"), (903, "one two"), (904, "One, two!"), (None, docs[0][1]), (7, docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert rows_of(link(df)) == want
    kept = keep_one(df).collect()
    classes = {c for d, c, _ in want if d not in (900, 901, 902)}
    assert len(kept) == len(classes) + 3


def test_generated(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert rows_of(link(df)) == brute(docs)
    assert link(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(70)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_sets_without_a_possible_partner_get_no_tile(spark, monkeypatch):
    frames, stored = {}, chosen_path.stored

    def spy(df, name):
        frames[name] = stored(df, name)
        return frames[name]

    monkeypatch.setattr(chosen_path, "stored", spy)
    monkeypatch.setattr(chosen_path, "HOT", 50)
    monkeypatch.setattr(chosen_path, "PROBE", 1, raising=False)
    rng, base = random.Random(5), [f"w{k}" for k in range(100)]
    docs = [(k, " ".join(base[:at] + [f"own{k}"] + base[at:])) for k, at in enumerate(rng.choices(range(100), k=120))]
    # one passage in all of them, nothing else in common: no pair is similar
    passage = " ".join(f"p{k}" for k in range(12))
    docs += [(1000 + k, " ".join([passage, *(f"x{k}y{i}" for i in range(60))])) for k in range(150)]
    assert rows_of(link(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    assert frames["tiles"].count() <= 12 * 120 and frames["tiles"].select("rep").distinct().count() == 120


def test_hot_buckets_part_each_other(spark, monkeypatch):
    for name, value in (("HOT", 8), ("TILE", 8), ("PROBE", 1)):
        monkeypatch.setattr(chosen_path, name, value)
    parted, seen = chosen_path._parted, []
    monkeypatch.setattr(chosen_path, "_parted", lambda first: seen.append(parted(first)) or seen[-1])
    rng = random.Random(6)
    lines = [" ".join(f"l{k}w{i}" for i in range(5)) for k in range(60)]
    docs = []
    for k in range(120):
        text = " ".join(rng.sample(lines, 5))
        docs += [(2 * k, text), (2 * k + 1, text + f" own{k}")]
    assert rows_of(link(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    assert seen[0].count() > 0
