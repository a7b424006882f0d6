"""The trie against a dictionary of prefixes, its parentheses against a stack, and the SQL on whole tables."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from crowdtide.llm.prefix_trie import Parentheses, prefix_nodes
from crowdtide.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) if kids[path] else 1
        saved[path] = sum(saved[k] for k in kids[path]) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
                   for p, m in members.items()), key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def random_rows(seed, convs=40, turns=9):
    rng = random.Random(seed)
    ids = rng.sample(range(330), convs)
    return [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ccc", "", None, "Grüße"])) for c in ids for t in range(rng.randint(1, turns))]


@pytest.mark.parametrize("seed,band,shard", [(1, 512, 200_000), (2, 512, 7), (3, 2, 200_000), (4, 3, 5), (5, 1, 9)])
def test_random(spark, seed, band, shard):
    rows = random_rows(seed)
    assert found(prefix_nodes(spark.createDataFrame(rows, SCHEMA), band, shard)) == brute(rows)


def test_many_copies(spark):
    """A third of the conversations is one and the same; its spine is shared by many shards and its list of ends is carried from shard to shard."""
    rows = [(100 * k, t, "user", f"same {t}") for k in range(300) for t in range(4)] + random_rows(9)
    assert found(prefix_nodes(spark.createDataFrame(rows, SCHEMA), 512, 50)) == brute(rows)


def test_long_conversation(spark):
    rows = [(7, t, "user", f"t{t % 3}") for t in range(1300)] + [(107, t, "user", f"t{t % 3}") for t in range(1200)] + [(8, 0, "user", "x")]
    assert found(prefix_nodes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (5, None, None, None), (5, None, None, None), (5, 1, "user", "y" * 100_000), (205, 1, "u", "x"), (205, 1, "u", "x")]
    docs = spark.createDataFrame([(*r, "z", "z") for r in rows], f"{SCHEMA}, idx string, path string")
    assert found(prefix_nodes(docs)) == brute(rows)
    assert prefix_nodes(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_parentheses(seed):
    rng = random.Random(seed)
    bits, open_, stack, want = [], 0, [], {}
    while len(bits) < 3000 or open_:
        if open_ == 0 or len(bits) < 3000 and rng.random() < (0.5 if seed % 2 else 0.52):
            stack.append(len(bits))
            bits.append(1)
            open_ += 1
        else:
            want[stack.pop()] = len(bits)
            bits.append(0)
            open_ -= 1
    p = Parentheses(np.array(bits, np.int8), block=8)
    assert p.findclose(p.opens).tolist() == [want[k] for k in p.opens.tolist()]


def test_sql(spark):
    folder = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view conversations as select * from '{folder}/conversations.parquet'")
    want = duckdb.sql(ORACLES["op13_conversation_prefix_trie"])
    got = QUERIES["op13_conversation_prefix_trie"](spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert found(got) == sorted(want.select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall(), key=str)
