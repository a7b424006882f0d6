"""Personal data by weak supervision, in DataFrame functions only.

Base detectors give the spans of four kinds, exactly as their patterns say.  Looser patterns give further candidates (parts of names, addresses and numbers in
other notations).  Regex, gazetteer and context labelers vote on every candidate: yes, no, or nothing.  Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is and how likely each pattern is to be personal data; a log-odds classifier over features of the span is trained on these
probabilities, and the candidates it accepts join the base spans.

The counts of vote patterns and of features are small tables (their sizes depend on the labelers only), whatever the number of documents.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .common import stored, whole

KINDS = ("email", "ip", "card", "phone")

# Base patterns.  A match may begin only where the run of its first class begins or where the last match ended: the same leftmost matches, without
# trying every later start of a long run.  Possessive repeats are used where what follows cannot match what they hold.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

# Looser patterns of the candidates that labelers vote on.
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+[\x20]?(?:\(at\)|\[at\]|[\x20]at[\x20])[\x20]?[A-Za-z0-9-]{1,63}+(?:(?:\.|[\x20]?(?:\(dot\)|\[dot\]|[\x20]dot[\x20])[\x20]?)[A-Za-z0-9-]{1,63}+){1,4}",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\(0?[0-9]{2,4}\)|0[0-9]{2,4}|[0-9]{3})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,6}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|schreib\w*|courriel|correo)\b[^\n]{0,20}$",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|appel\w*|tel[eé]fono|movil)\b[^\n]{0,20}$",
    "card": r"(?i)\b(?:ssn|social|security|card|account|konto|carte|tarjeta)\b[^\n]{0,20}$",
    "ip": r"(?i)\b(?:ip|address|host|server|login|adresse|direcci[oó]n)\b[^\n]{0,20}$",
}
TOP_DOMAINS = "com org net edu gov io co uk de fr es eu info biz us ch at it nl".split()
LABELERS = ("shape", "gazetteer", "context", "digits")
ROUNDS = 25


SPAN = "struct<kind:string,start:int,end:int,value:string>"


def spans_of(text: Column, pattern: str, kind: str, checked: bool) -> Column:
    """The matches of ``pattern`` as structs (kind, start, end, value), in code points; ``checked``: only those that pass.

    The pieces between the matches give the places: one walk over both, which appends what passes.
    """
    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.char_length(x["g"])
        end = start + F.char_length(x["m"])
        more = F.concat(a["out"], F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("value"))))
        return F.struct(end.alias("at"), (F.when(passes(kind, x["m"]), more).otherwise(a["out"]) if checked else more).alias("out"))

    def walk(s: Column) -> Column:
        both = F.arrays_zip(s["m"].alias("m"), F.slice(s["gap"], 1, F.size(s["m"])).alias("g"))
        return F.aggregate(both, F.struct(F.lit(0).alias("at"), _none().alias("out")), step, lambda a: a["out"])

    return F.transform(F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))), walk)[0]


def passes(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern counts."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "phone":
        return F.char_length(digits).between(8, 15)
    if kind == "card":
        doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
        return F.char_length(digits).between(16, 19) & (F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0)
    return F.lit(True)


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def base_spans(text: Column) -> Column:
    """The base spans of a text by kind as listed, then start.  A cheap test keeps most texts from the patterns."""
    signs = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": text.rlike(r"\+[0-9]")}
    return F.concat(*[F.when(signs[k], spans_of(text, BASE[k], k, True)).otherwise(_none()) for k in KINDS])


def candidate_spans(text: Column) -> Column:
    signs = {"email": text.rlike(r"(?:\(at\)|\[at\]|\x20at\x20)[^\n]{1,80}(?:\.|dot)"), "phone": text.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}"), "card": text.rlike(r"[0-9]{3}-[0-9]{2}-"), "ip": text.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:")}
    return F.concat(*[F.when(signs[k], spans_of(text, CANDIDATES[k], k, False)).otherwise(_none()) for k in KINDS])


# ---- voting ---------------------------------------------------------------------------------------------------------------

def votes(spans: DataFrame) -> DataFrame:
    """Votes (1 yes, 0 no, null nothing) of every labeler on spans with kind, value, before (the text in front), and is_base."""
    digits = F.regexp_replace("value", "[^0-9]", "")
    domain = F.lower(F.regexp_extract("value", r"([A-Za-z]+)$", 1))
    spread = F.size(F.array_distinct(F.split(digits, "")))
    shape = F.when(F.col("is_base"), 1).when(F.col("kind").isin("card", "ip"), 1).when((F.col("kind") == "phone") & F.char_length(digits).between(9, 11), 1).when(F.col("kind") == "email", F.lit(None)).otherwise(0)
    gazetteer = F.when(F.col("kind") == "email", domain.isin(TOP_DOMAINS).cast("int")).when((F.col("kind") == "phone") & (digits.startswith("000") | digits.startswith("111")), 0)
    context = reduce(lambda acc, k: acc.when((F.col("kind") == k) & F.col("before").rlike(CONTEXT[k]), 1), KINDS, F.when(F.col("before").rlike(r"(?i)\b(?:version|isbn|page|figure|example)\b[^\n]{0,12}$"), 0))
    variety = F.when(F.char_length(digits) >= 7, (spread >= 4).cast("int"))
    return spans.withColumns({"shape": shape, "gazetteer": gazetteer, "context": context, "digits": variety})


def reliabilities(patterns: list[tuple], labelers: int, rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]], dict[tuple, float]]:
    """EM over counted vote patterns [(votes, is_base, count)]: prior, each labeler's (P(yes | personal), P(yes | not)), and the probability of each pattern.

    Base spans are known to be personal data and pin their patterns.
    """
    prior, rates = 0.5, [(0.8, 0.2)] * labelers
    chance: dict[tuple, float] = {}
    for _ in range(rounds):
        for v, base, _ in patterns:
            if base:
                chance[v, base] = 1.0
                continue
            odds = math.log(prior / (1 - prior))
            for x, (yes, no) in zip(v, rates, strict=True):
                if x is not None:
                    odds += math.log(yes / no) if x else math.log((1 - yes) / (1 - no))
            chance[v, base] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        total = sum(n for _, _, n in patterns)
        true = sum(n * chance[v, b] for v, b, n in patterns)
        prior = min(max((true + 1) / (total + 2), 0.01), 0.99)
        new = []
        for k in range(labelers):
            seen = [(v[k], chance[v, b], n) for v, b, n in patterns if v[k] is not None]
            yes = (sum(n * p * x for x, p, n in seen) + 4) / (sum(n * p for _, p, n in seen) + 5)
            no = (sum(n * (1 - p) * x for x, p, n in seen) + 1) / (sum(n * (1 - p) for _, p, n in seen) + 5)
            new.append((min(max(yes, 0.02), 0.98), min(max(no, 0.02), 0.98)))
        rates = new
    return prior, rates, chance


def features(spans: DataFrame) -> DataFrame:
    """A few discrete features of a span."""
    return spans.withColumns({
        "f_kind": F.col("kind"), "f_length": F.least(F.char_length("value"), F.lit(40)).cast("int") / 4,
        "f_digits": F.least(F.char_length(F.regexp_replace("value", "[^0-9]", "")), F.lit(20)), "f_context": F.coalesce(F.col("context"), F.lit(-1)),
        "f_separators": F.least(F.char_length(F.regexp_replace("value", "[A-Za-z0-9]", "")), F.lit(6))})


FEATURES = ("f_kind", "f_length", "f_digits", "f_context", "f_separators")


def detect(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, base, spans) for every row of ``docs`` (doc_id, text): arrays of struct(kind, start, end) by kind as listed, then start.

    ``spans`` holds the base spans and the accepted candidates that touch no base span of their kind.  Places are code points, the end exclusive.  Null and empty
    texts have none.  Repeated rows are searched each.  Other columns are not read.
    """
    found = docs.select("doc_id", whole("text").alias("text"))
    found = pin(found, base=base_spans(F.col("text")), loose=candidate_spans(F.col("text")))
    free = F.filter("loose", lambda c: ~F.exists("base", lambda b: (b["kind"] == c["kind"]) & (b["start"] < c["end"]) & (c["start"] < b["end"])))
    found = found.withColumn("loose", free)

    def with_front(column: str) -> Column:
        return F.transform(column, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
                                                      F.substring(F.col("text"), F.greatest(s["start"] - 31, F.lit(1)), F.least(s["start"], F.lit(32))).alias("before")))

    kept = stored(found.select("doc_id", with_front("base").alias("base"), with_front("loose").alias("loose")), "spans")
    every = kept.select(F.explode(F.concat(F.transform("base", lambda s: s.withField("is_base", F.lit(True))), F.transform("loose", lambda s: s.withField("is_base", F.lit(False))))).alias("x")).select("x.*")
    voted = features(votes(every))
    patterns = [(tuple(r[k] for k in LABELERS), r["is_base"], r["n"]) for r in voted.groupBy(*LABELERS, "is_base").agg(F.count("*").alias("n")).collect()]  # at most 2 * 3**4 rows
    _, _, chance = reliabilities(patterns, len(LABELERS)) if patterns else (0, [], {})

    def likely() -> Column:
        out = F.lit(0.0)
        for (v, base), p in chance.items():
            same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.lit(x).cast("int")) for n, x in zip(LABELERS, v, strict=True)], F.col("is_base") == base)
            out = F.when(same, p).otherwise(out)
        return out

    # Log-odds of each feature value from the probabilities; as many rows as values (under a hundred).
    cells = voted.withColumn("p", likely()).select("p", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in FEATURES])).alias("x"))
    table = cells.groupBy("x.f", "x.v").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    sums = {f: (sum(r.yes for r in table if r.f == f), sum(r.no for r in table if r.f == f)) for f in FEATURES}
    yes, no = sums[FEATURES[0]] if table else (0.0, 0.0)
    weights = {(r.f, r.v): math.log((r.yes + 1) / (sums[r.f][0] + 2)) - math.log((r.no + 1) / (sums[r.f][1] + 2)) for r in table}
    odds = F.lit(math.log((yes + 1) / (no + 1)))
    for f in FEATURES:
        column = F.lit(0.0)
        for (g, v), w in weights.items():
            if g == f:
                column = F.when(F.col(f).cast("string") == v, w).otherwise(column)
        odds = odds + column

    limit = math.log(threshold / (1 - threshold))
    has = kept.where(F.size("loose") > 0).select("doc_id", F.monotonically_increasing_id().alias("_row"), "base", "loose")
    judged = features(votes(has.select("doc_id", "_row", "base", F.explode("loose").alias("x")).select("doc_id", "_row", "base", "x.*", F.lit(False).alias("is_base"))))
    accepted = (judged.withColumn("ok", odds > limit).groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("base").alias("base"), F.collect_list(F.when(F.col("ok"), F.struct("kind", "start", "end"))).alias("more")))  # of one text
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rank = {k: i for i, k in enumerate(KINDS)}

    def ordered(column: Column) -> Column:
        number = lambda s: F.when(s["kind"] == "email", rank["email"]).when(s["kind"] == "ip", rank["ip"]).when(s["kind"] == "card", rank["card"]).otherwise(rank["phone"])
        return F.transform(F.array_sort(F.transform(column, lambda s: F.struct(number(s).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
                           lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    without = kept.where(F.size("loose") == 0).select("doc_id", plain.alias("base"), plain.alias("spans"))
    return without.unionByName(accepted.select("doc_id", plain.alias("base"), ordered(F.concat(plain, "more")).alias("spans")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


