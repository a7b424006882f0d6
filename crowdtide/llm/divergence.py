"""Document quality by distribution divergence.

Each document's histograms of character classes and of common words are compared with those of its language by Jensen-Shannon distance.  The language
references are sums over all documents of the table.  Short texts are guarded: a histogram of few observations says little.  All steps are DataFrame
functions; the text is read once, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .common import free_name, stored, whole

# Classes of characters, as patterns.
SPACE = r"\x20\x09-\x0D"
CLASSES = [r"[a-z]", r"[A-Z]", r"[0-9]", rf"[{SPACE}]", r"[.,;:]", r"[!?]", r"[#*$%&|<>=+^~_\\/@{}\[\]()-]", r"['\x22`]"]  # and all the rest: letters beyond ASCII
# Frequent function words of the four languages.
COMMON = {
    "en": "the of and to in a is that it for on was be with as by this are at an from",
    "fr": "de la le et les des en un une que est pour qui dans sur au par pas du elle avec",
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es",
    "es": "de la que el en y los se del las un por con no una su para es al lo",
}
WORDS = list(dict.fromkeys(w for ws in COMMON.values() for w in ws.split()))

MIN_CHARS = 200
MIN_WORDS = 50
MIN_REFERENCE_WORDS = 5000
MAX_CHAR_DISTANCE = 0.25  # characters alone
MAX_BOTH = (0.17, 0.30)  # characters and words together


def base_counts(df: DataFrame, words: Column, text: Column, lines: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines of a text from its words and the lines that hold a word."""
    long = "long"
    return {
        "n_words": F.size(words).cast(long),
        "word_chars": F.char_length(F.array_join(words, "")).cast(long),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast(long),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast(long),
    }


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def window_hashes(words: str, n: int = 8) -> Column:
    """A hash of every window of n consecutive words of the array column ``words``."""
    return F.expr(f"transform(sequence(1, greatest(size({words}) - {n - 1}, 1)), i -> xxhash64(slice({words}, i, {n})))")


def repeated_words(hashes: Column, n: int = 8) -> Column:
    """How many words lie in windows whose hash occurs twice or more.

    Windows are sorted by (hash, place); equal neighbours are repeats; their places, sorted again, cover up to n words each.
    """
    def places(s: Column) -> Column:
        same = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
        return _let(same, lambda e: F.sort_array(F.array_compact(F.zip_with(
            F.zip_with(s, e, lambda x, b: F.struct(x["i"].alias("i"), b.alias("b"))), F.concat(F.array(F.lit(False)), e), lambda x, b: F.when(x["b"] | b, x["i"])))))

    def covered(p: Column) -> Column:
        return F.aggregate(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.coalesce(F.least(F.lit(n), b - a), F.lit(n))), F.lit(0).cast("long"), lambda t, x: t + x)

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(_let(placed, places), covered)


def word_histogram(words: Column) -> Column:
    """Counts of all other words, then of each common word in their order."""
    known = "array(" + ", ".join(f"'{w}'" for w in WORDS) + ")"
    codes = F.array_remove(F.transform(words, lambda w: F.array_position(F.expr(known), w).cast("int")), 0)
    return _let(codes, lambda c: F.concat(F.array(F.size(words) - F.size(c)),
                                          F.transform(F.sequence(F.lit(1), F.lit(len(WORDS))), lambda k: F.size(c) - F.size(F.array_remove(c, k)))))


def class_histogram(text: Column) -> Column:
    counts = [F.regexp_count(text, F.lit(p)) for p in CLASSES]
    return F.array(*counts)


def profile(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", lang_column: str = "lang") -> DataFrame:
    """(doc_id, h: hash of the text, lang, base counts, chars, words): everything that later steps need, without the text."""
    df = docs.select(F.col(id_column).alias("doc_id"), F.col(lang_column).alias("lang"), whole(text_column).alias("text"))
    df = pin(df, words=split_words(F.col("text")), lines=F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    df = pin(df, hashes=F.when(F.size("words") >= 8, window_hashes("words")).otherwise(F.array().cast("array<bigint>")), classes=class_histogram(F.col("text")))
    repeats = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), repeated_words(F.col("hashes"))).otherwise(F.lit(0).cast("long"))
    chars = F.concat("classes", F.array((F.char_length("text") - F.aggregate("classes", F.lit(0), lambda a, x: a + x))))
    return df.select("doc_id", F.xxhash64("text").alias("h"), "lang", *[c.alias(k) for k, c in base_counts(df, F.col("words"), F.col("text"), F.col("lines")).items()],
                     repeats.alias("n_repeat_words"), chars.alias("chars"),
                     word_histogram(F.transform("words", lambda w: F.lower(w))).alias("common"))


def references(profiles: DataFrame) -> DataFrame:
    """Summed histograms per language over all documents, and under a null language those of the whole table."""
    sums = [F.array(*[F.sum(F.col(g)[k]).cast("double") for k in range(size)]).alias(f"ref_{g}") for g, size in (("chars", len(CLASSES) + 1), ("common", len(WORDS) + 1))]
    return profiles.groupingSets([["lang"], []], "lang").agg(F.grouping("lang").alias("all"), F.sum("n_words").alias("ref_words"), *sums)


def _distance(own: str, ref: str) -> Column:
    """Jensen-Shannon distance (square root, base 2) of two arrays of counts; null when one of them has no mass."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    def apart(s: Column) -> Column:
        parts = F.zip_with(F.col(own).cast("array<double>"), ref, lambda x, y: term(x / s["l"], y / s["r"]) + term(y / s["r"], x / s["l"]))
        return F.when((s["l"] > 0) & (s["r"] > 0), F.sqrt(F.greatest(F.lit(0.0), total(parts) / 2)))

    return _let(F.struct(total(F.col(own).cast("array<double>")).alias("l"), total(F.col(ref)).alias("r")), apart)


def verdicts(profiles: DataFrame) -> DataFrame:
    """Add char_distance, word_distance, base_failed and kept to stored profiles.

    A document is compared with its own language; with the whole table where its language is null or has under ``MIN_REFERENCE_WORDS`` words.
    """
    refs = references(profiles)
    known = refs.where((F.col("all") == 0) & F.col("lang").isNotNull() & (F.col("ref_words") >= MIN_REFERENCE_WORDS)).drop("all", "ref_words")
    whole_table = refs.where(F.col("all") == 1).select(F.lit(None).cast("string").alias("lang"), "ref_chars", "ref_common")
    names = known.select(F.col("lang").alias("ref_lang"))
    df = profiles.join(names, F.col("lang") == F.col("ref_lang"), "left")
    df = df.join(known.unionByName(whole_table).withColumnRenamed("lang", "_ref"), F.col("ref_lang").eqNullSafe(F.col("_ref")), "left").drop("_ref")
    df = df.withColumns({"char_distance": _distance("chars", "ref_chars"), "word_distance": _distance("common", "ref_common")})
    n_chars = F.aggregate("chars", F.lit(0), lambda a, x: a + x)
    both = (F.col("char_distance") > MAX_BOTH[0]) & (F.col("word_distance") > MAX_BOTH[1])
    odd = ((n_chars >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)) | ((F.col("n_words") >= MIN_WORDS) & both)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(odd, F.lit(False))).drop("chars", "common", "ref_chars", "ref_common", "ref_lang")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, char_distance, word_distance, base_failed and kept for every row of ``docs``.

    Null and empty texts have no words and fail.  Repeated rows are measured each.  A null or rare language is
    compared with the whole table.  Columns other than doc_id, text and lang are not read.
    """
    return verdicts(stored(profile(docs), "profiles"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns; equal (doc_id, text) rows share one verdict."""
    key, h = free_name(docs, "_id"), free_name(docs, "_h")
    good = measure(docs).where("kept").select(F.col("doc_id").alias(key), F.col("h").alias(h)).distinct()
    return docs.join(good, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64(whole("text")) == F.col(h)), "left_semi")

