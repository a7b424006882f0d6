"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, chosen_path, divergence, fuzzy_lines, main_text, merkle_manifest, packing, pair_index_bpe, pii, prefix_trie, rule_ensemble, suffix_dedup, winnowing
from .common import table, whole

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def wrap(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


OP6_SQL = rf"""
with d as (select row_number() over () as row, doc_id, lang, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
grams as (select row, i, array_to_string(words[i:i + 7], ' ') as g from (select row, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)),
repeats as (select row, i from grams qualify count(*) over (partition by row, g) > 1),
covered as (select row, sum(least(8, coalesce(next - i, 8))) as n from (select row, i, lead(i) over (partition by row order by i) as next from repeats) group by row),
hist as (select row, doc_id, lang, len(words) as n_words, length(array_to_string(words, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
                len(lines) - len(list_distinct(lines)) as n_dup_lines, length(text) as n_chars,
                [{", ".join(f"len(regexp_extract_all(text, '{p.replace(chr(92) + 'x22', '"').replace(chr(39), chr(39) * 2)}'))" for p in divergence.CLASSES)}] as classes,
                list_transform(words, lambda x: lower(x)) as lowered from w),
counts as (select h.row, x.k, count(*) as n from (select row, unnest(lowered) as word from hist) h join (select unnest([{", ".join(f"'{x}'" for x in divergence.WORDS)}]) as word,
                  unnest(range(1, {len(divergence.WORDS) + 1})) as k) x using (word) group by all),
mass as (select row, 'chars' as kind, k, n from (select row, unnest(range(1, len(classes) + 1)) as k, unnest(classes) as n from hist)
         union all select row, 'chars', 0, n_chars - list_sum(classes) from hist
         union all select row, 'common', k, n from counts
         union all select row, 'common', 0, n_words - coalesce((select sum(n) from counts c where c.row = hist.row), 0) from hist),
langs as (select lang from hist where lang is not null group by lang having sum(n_words) >= {divergence.MIN_REFERENCE_WORDS}),
used as (select hist.row, langs.lang as ref from hist left join langs using (lang)),
refs as (select hist.lang as ref, kind, k, sum(n) as n from mass join hist using (row) where hist.lang in (select lang from langs) group by all
         union all select null, kind, k, sum(n) from mass group by all),
own as (select row, kind, sum(n) as total from mass group by all),
ref_total as (select ref, kind, sum(n) as total from refs group by all),
pairs as (select u.row, r.kind, coalesce(m.n, 0) / nullif(o.total, 0) as p, r.n / nullif(t.total, 0) as q
          from used u join refs r on u.ref is not distinct from r.ref join ref_total t on t.ref is not distinct from r.ref and t.kind = r.kind
          join own o on o.row = u.row and o.kind = r.kind left join mass m on m.row = u.row and m.kind = r.kind and m.k = r.k),
apart as (select row, kind, sqrt(greatest(0, sum((case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end)) / 2)) as dist
          from pairs where p is not null group by all),
wide as (select h.*, coalesce(c.n, 0) as n_repeat_words, (select dist from apart a where a.row = h.row and kind = 'chars') as cd, (select dist from apart a where a.row = h.row and kind = 'common') as wd
         from hist h left join covered c using (row)),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
                  coalesce((n_chars >= {divergence.MIN_CHARS} and cd > {divergence.MAX_CHAR_DISTANCE}) or (n_words >= {divergence.MIN_WORDS} and cd > {divergence.MAX_BOTH[0]} and wd > {divergence.MAX_BOTH[1]}), false) as odd from wide)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       base_failed, not base_failed and not odd as kept from judged
"""


@query("op6_quality_rules", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.measure(table(spark, sf_dir, "documents")).select("doc_id", *divergence.COUNTS, "base_failed", "kept")


OP7_SQL = r"""
with d as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
windows as (select distinct item_id, n, array_to_string(words[i:i + n - 1], ' ') as g from (select item_id, words, least(10, len(words)) as n, unnest(range(1, len(words) - least(10, len(words)) + 2)) as i from b where len(words) > 0)),
sizes as (select distinct n from windows),
grams as (select row, n, i, array_to_string(words[i:i + n - 1], ' ') as g from (select row, words, n, unnest(range(1, len(words) - n + 2)) as i from d cross join sizes where len(words) >= n)),
hits as (select row, n, i, item_id from grams join windows using (n, g)),
words as (select row, count(distinct w) as n_hit from (select row, unnest(range(i, i + n)) as w from (select distinct row, n, i from hits)) group by row),
items as (select row, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct row, item_id::varchar as item from hits) group by row)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (row) left join items using (row)
"""


@query("op7_benchmark_decontamination", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = winnowing.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


@query("op10_lm_scoring")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(backoff_lm.with_fold(table(spark, sf_dir, "documents")))


@query("op9_suffix_array_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


@query("op8_ngram_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.link(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query("op4_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = fuzzy_lines.deduplicate(table(spark, sf_dir, "documents"), exact_words=1)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(whole("text"), 256).alias("kept_sha256"))


@query("op12_bpe_encoding_and_decoding")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = pair_index_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


# crc32 of a decimal number: the bits of each digit go through the polynomial one after another
CRC32_SQL = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split({x}::varchar, ''), lambda s: ascii(s)::bigint)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"""


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({v}::varchar)::varchar || ':' || {v}::varchar, '-')" for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP11_SQL = f"""
with recursive d as (select *, case when {CRC32_SQL.format(x="doc_id")} % 3 = 0 then translate(text, '{merkle_manifest.CAPITALS}', '{merkle_manifest.CAPITALS.lower()}') else text end as shown from documents),
l as (select doc_id, coalesce('=' || lang, '') as tree, {_leaf_sql("text")} as leaf, {_leaf_sql("shown")} as other from d),
o as (select row_number() over () as row, *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by tree) as total from l),
up as (select tree, 0 as level, idx, total, leaf as h from o
       union all select tree, level + 1, idx // 8, (total + 7) // 8, sha256(string_agg(h, '' order by idx)) from up where total > 1 group by tree, level, idx // 8, total),
tops as (select tree as member, row_number() over (order by tree) - 1 as idx, count(*) over () as total, h from up where total = 1),
top_up as (select 0 as level, idx, total, h from tops
           union all select level + 1, idx // 8, (total + 7) // 8, sha256(string_agg(h, '' order by idx)) from top_up where total > 1 group by level, idx // 8, total),
sides as (select o.row, u.level, coalesce(string_agg(u.h, '' order by u.idx) filter (where u.idx < o.idx >> (3 * u.level)), '') as before, coalesce(string_agg(u.h, '' order by u.idx) filter (where u.idx > o.idx >> (3 * u.level)), '') as after
          from o join up u on u.tree = o.tree and u.total > 1 and u.idx >> 3 = o.idx >> (3 * u.level + 3) group by o.row, u.level
          union all
          select o.row, 1000 + u.level, coalesce(string_agg(u.h, '' order by u.idx) filter (where u.idx < t.idx >> (3 * u.level)), ''), coalesce(string_agg(u.h, '' order by u.idx) filter (where u.idx > t.idx >> (3 * u.level)), '')
          from o join tops t on t.member = o.tree join top_up u on u.total > 1 and u.idx >> 3 = t.idx >> (3 * u.level + 3) group by o.row, u.level),
steps as (select *, row_number() over (partition by row order by level) as k from sides),
proof as (select row, sha256(string_agg(before || after, '' order by k)) as proof_sha256, max(k) as n from steps group by row),
fold as (select row, 0 as k, other as h from o union all select f.row, s.k, sha256(s.before || f.h || s.after) from fold f join steps s on s.row = f.row and s.k = f.k + 1),
ends as (select fold.row, fold.h from fold left join proof using (row) where fold.k = coalesce(n, 0))
select doc_id, leaf, tops.h as subroot, (select h from top_up where total = 1) as root, coalesce(proof_sha256, sha256('')) as proof_sha256, ends.h as folded_root, ends.h = (select h from top_up where total = 1) as verified
from o join tops on member = tree join ends using (row) left join proof using (row)
"""


@query("op11_merkle_dataset_manifest", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    sealed = merkle_manifest.manifest(table(spark, sf_dir, "documents"), shown=merkle_manifest.tampered_leaf())
    checked = sealed.withColumn("folded_root", merkle_manifest.folded(F.col("shown"), F.col("before"), F.col("after")))
    return checked.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("before"), F.col("after")).alias("proof_sha256"), "folded_root",
                          (F.col("folded_root") == F.col("root")).alias("verified"))


OP13_SQL = f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as idx
           from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 100 as base, {CRC32_SQL.format(x="conv_id")} % 6 as head from (select distinct conv_id from t)),
r as (select c.conv_id, t.idx, role, text from c join t on t.conv_id = c.base where t.idx < head union all select c.conv_id, 1000000 + t.idx, role, text from c join t using (conv_id) where t.idx >= head),
p as (select conv_id, row_number() over w as depth, length(text) as size, string_agg(sha256(strlen(role)::varchar || ':' || role || text), '') over w as path from r window w as (partition by conv_id order by idx)),
m as (select conv_id, depth, size, path from p union all select conv_id, 0, 0, '' from c),
ends as (select conv_id, max(depth) as depth from m group by conv_id),
n as (select path, any_value(m.depth) as depth, any_value(size) as size, min(m.conv_id) as conv_id, count(*) as n_convs, string_agg(ends.conv_id::varchar, ',' order by ends.conv_id) as ids
      from m left join ends on ends.conv_id = m.conv_id and ends.depth = m.depth group by path),
kids as (select left(path, length(path) - 64) as path, count(*) as n_children from n where depth > 0 group by 1),
full_n as (select n.*, coalesce(n_children, 0) as n_children from n left join kids using (path)),
up as (select left(path, 64 * unnest(range(0, depth + 1))::int) as path, (n_children = 0)::int as leaf, (n_convs - 1) * size as own from full_n),
sums as (select path, sum(leaf) as n_leaves, sum(own) as saved_tokens from up group by path)
select n.conv_id, n.depth::bigint as depth, a.conv_id as parent_conv_id, n.n_convs, n.n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, sha256(coalesce(n.ids, '')) as ends_sha256
from full_n n join sums using (path) left join n a on n.depth > 0 and a.path = left(n.path, length(n.path) - 64)
"""


@query("op13_conversation_prefix_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))
