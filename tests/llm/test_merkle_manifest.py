"""The manifest against a plain recursive tree in Python, and its SQL on whole tables."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from crowdtide.llm import merkle_manifest
from crowdtide.llm.merkle_manifest import climb, descend, manifest
from crowdtide.llm.queries import QUERIES


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(doc, source, lang, n, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def tree(digests):
    """Root, and the siblings of every leaf from the bottom up."""
    paths = [[] for _ in digests]
    members = [[k] for k in range(len(digests))]
    while len(digests) > 1:
        nexts, groups = [], []
        for a in range(0, len(digests), 8):
            run = digests[a: a + 8]
            for k in range(len(run)):
                for m in members[a + k]:
                    paths[m].append(("".join(run[:k]), "".join(run[k + 1:])))
            nexts.append(h("".join(run)))
            groups.append([m for g in members[a: a + 8] for m in g])
        digests, members = nexts, groups
    return digests[0], paths


def brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    subs, parts = [], []
    for lang in order:
        own = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        leaves = [leaf_of(*r) for r in own]
        root, paths = tree(leaves)
        subs.append(root)
        parts.append((own, leaves, paths))
    if not subs:
        return []
    root, tops = tree(subs)
    out = []
    for (own, leaves, paths), sub, top in zip(parts, subs, tops, strict=True):
        for r, leaf, path in zip(own, leaves, paths, strict=True):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(x.lower() if "A" <= x <= "Z" else x for x in text)
            got = leaf_of(*r[:4], text)
            for before, after in [*path, *top]:
                got = h(before + got + after)
            out.append((r[0], leaf, sub, root, h("".join(b + a for b, a in [*path, *top])), got, got == root))
    return sorted(out, key=str)


def written(spark, tmp_path, rows, schema="doc_id long, source string, lang string, n_chars int, text string"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return [tuple(r) for r in QUERIES["op11_merkle_dataset_manifest"](spark, str(tmp_path)).collect()]


@pytest.mark.parametrize("n", [1, 9, 65, 600])
def test_sizes(spark, tmp_path, n):
    rows = [(k * 7, "s", "en" if k % 5 else None, k, f"Text {k} ÄB") for k in range(n)]
    assert sorted(written(spark, tmp_path, rows), key=str) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "", None, None), (1, None, "", None, None), (1, "s", "", 3, "Abc"), (None, "s", "", 0, ""), (None, None, None, None, None), (-3, "S", "É", 9, "ÀB" * 5000),
            *[(k, "x", f"l{k}", 1, "A") for k in range(70)]]
    assert sorted(written(spark, tmp_path, rows), key=str) == brute(rows)


def test_empty(spark, tmp_path):
    assert written(spark, tmp_path, []) == []


def test_clashing_columns(spark):
    rows = [(k, "s", "en", 1, "A b", "x") for k in range(20)]
    for name in ("idx", "total", "digest", "tree", "_salt", "before"):
        docs = spark.createDataFrame(rows, f"doc_id long, source string, lang string, n_chars int, text string, {name} string")
        assert manifest(docs).count() == 20


def test_hot_language_spreads(spark):
    """Two thousand rows of one language: no task of the sweeps takes more than a block."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.concat(F.lit("T "), "id").alias("text"))
    rows = manifest(docs).collect()
    want = {r[0]: r[1:5] for r in brute([(k, "s", "en", 1, f"T {k}") for k in range(2000)])}
    assert {r.doc_id: (r.leaf, r.subroot, r.root, h("".join(b + a for b, a in zip(r.before, r.after, strict=True)))) for r in rows} == want


def test_sweeps():
    leaves = [h(str(k)) for k in range(100)]
    levels = climb(leaves, 100)
    root, paths = tree(leaves)
    assert levels[-1] == [root]
    assert [(list(zip(b, a, strict=True))) for _, b, a in sorted(descend(levels, [], []))] == paths


def test_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view documents as select * from '{folder}/documents.parquet'")
    from crowdtide.llm.queries import ORACLES

    want = duckdb.sql(ORACLES["op11_merkle_dataset_manifest"])
    got = QUERIES["op11_merkle_dataset_manifest"](spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall())
    assert not all(r.verified for r in got.collect()) and merkle_manifest.BLOCK == 512
