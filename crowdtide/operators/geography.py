"""Venue and city resolution.  Every cascade works on the distinct names of the batch, then joins the verdict back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.geo import squared_degrees
from ..functions.similarity import ratio, token_set_ratio
from ..functions.text import normalize_name, normalize_postcode
from ..session import cut_lineage, left_lookup, settled
from .similar import close_pairs, word_pairs, word_set_text


def alias_index(registry: DataFrame, id_col: str, seeded: Column | None = None) -> DataFrame:
    """(key, id): one row per normalised name or alias; seeded entries win, names win over aliases, then the lowest id."""
    rows = registry.select(
        F.col(id_col).alias("_id"), (F.lit(True) if seeded is None else F.coalesce(seeded, F.lit(False))).alias("_seeded"),
        F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_pos", "_name"))
    keyed = rows.where("_seeded OR _pos = 0").select("_id", "_seeded", "_pos", normalize_name("_name").alias("key")).where("key <> ''")
    rank = F.struct(F.when(F.col("_seeded"), 0).otherwise(1), F.least("_pos", F.lit(1)), "_id")
    return keyed.groupBy("key").agg(F.min_by("_id", rank).alias(id_col))


ANCHOR = 6


def _grams(c: Column, n: int) -> Column:
    """Distinct character n-grams of texts with at least n characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))


def _contains_pairs(names: DataFrame, index: DataFrame, id_col: str) -> DataFrame:
    """(key, index_key, id) where one text contains the other and the index key has more than five characters.

    The contained text has all its n-grams inside the container, so the two meet on any one of them.  The anchor is the n-gram of the
    contained text that the fewest index keys hold, which keeps common beginnings from pairing everything.
    """
    idx = index.where(F.length("key") >= ANCHOR).select(F.col("key").alias("index_key"), id_col)
    grams = idx.select("index_key", id_col, F.explode(_grams(F.col("index_key"), ANCHOR)).alias("_gram"))
    usage = grams.groupBy("_gram").agg(F.count("*").alias("_uses"))
    # the planner takes exploded rows for no more than the texts they come from: without the hints it would send them to the driver
    anchors = grams.join(usage.hint("merge"), "_gram").groupBy("index_key", id_col).agg(F.min_by("_gram", F.struct("_uses", "_gram")).alias("_gram"))
    cols = ["key", "index_key", id_col]
    long_names = names.where(F.length("key") >= ANCHOR)
    name_grams = long_names.select("key", F.explode(_grams(F.col("key"), ANCHOR)).alias("_gram"))
    pairs = name_grams.join(anchors.hint("merge"), "_gram").where(F.contains("key", F.col("index_key"))).select(*cols)
    name_anchor = name_grams.join(usage.hint("merge"), "_gram", "left").groupBy("key").agg(
        F.min_by("_gram", F.struct(F.coalesce("_uses", F.lit(0)), "_gram")).alias("_gram"))
    pairs = pairs.unionByName(name_anchor.join(grams.hint("merge"), "_gram").where(F.contains("index_key", F.col("key"))).select(*cols))
    short = names.where(F.length("key").between(1, ANCHOR - 1))
    for n in sorted(r.n for r in short.select(F.length("key").alias("n")).distinct().collect()):  # shorter names are one gram themselves
        part = short.where(F.length("key") == n).select("key", F.col("key").alias("_gram")).join(
            idx.select("index_key", id_col, F.explode(_grams(F.col("index_key"), n)).alias("_gram")).hint("merge"), "_gram")
        pairs = pairs.unionByName(part.select(*cols))
    return pairs


def _word_pairs(names: DataFrame, index: DataFrame, id_col: str) -> DataFrame:
    """(key, index_key, id) where the index key occurs in the name as whole words: meet on the first word of the index key."""
    return (names.select("key", F.explode(F.array_distinct(F.split("key", " "))).alias("_word"))
            .join(index.select(F.col("key").alias("index_key"), id_col, F.get(F.split("key", " "), F.lit(0)).alias("_word")), "_word")
            .where(F.contains(F.concat(F.lit(" "), "key", F.lit(" ")), F.concat(F.lit(" "), F.col("index_key"), F.lit(" "))))
            .select("key", "index_key", id_col))


def _longest(pairs: DataFrame, id_col: str) -> DataFrame:
    """Best containment per name: longest index key, then alphabetical."""
    return pairs.groupBy("key").agg(F.min_by(id_col, F.struct(-F.length("index_key"), "index_key")).alias(id_col))


def _fuzzy_pairs(names: DataFrame, index: DataFrame, id_col: str, floor: float, scorer) -> DataFrame:
    """(key, index_key, id, score) at or above the floor; by words, a name with scores of 100 keeps only these."""
    t = floor / 100.0
    by_words = scorer is token_set_ratio
    text = word_set_text(F.col("key")) if by_words else F.col("key")
    left = names.select(F.col("key").alias("l_id"), text.alias("l_text"))
    right = index.select(F.col("key").alias("r_id"), text.alias("r_text"))
    ids = [F.col("l_id").alias("key"), F.col("r_id").alias("index_key")]

    def found() -> DataFrame:
        own, known = cut_lineage(left), cut_lineage(right)
        if not by_words:  # the built-in edit distance is never more than that of insertions and deletions alone
            near = F.levenshtein("l_id", "r_id") <= (F.length("l_id") + F.length("r_id")) * F.lit(1 - t) + F.lit(1e-9)
            return close_pairs(own, known, t).select(*ids, F.when(near, scorer("l_id", "r_id")).alias("score"))
        # nothing is better than names that hold each other's words: where there is one, the less similar ones need not be found
        full = cut_lineage(word_pairs(own, known, 1.0).select(*ids, token_set_ratio("l_id", "r_id", 100.0).alias("score")).where("score >= 100"))
        rest = cut_lineage(own.join(full.select(F.col("key").alias("l_id")).distinct(), "l_id", "left_anti"))
        pairs = close_pairs(rest, known, t).union(word_pairs(rest, known, t)).distinct()
        return full.unionByName(pairs.select(*ids, token_set_ratio("l_id", "r_id", floor).alias("score")))

    scored = settled(names.sparkSession, lambda: found().where(F.col("score") >= floor))
    return scored.join(index.select(F.col("key").alias("index_key"), id_col), "index_key")


def _best(scored: DataFrame, id_col: str, label: str) -> DataFrame:
    best = scored.groupBy("key").agg(F.max_by(F.struct(id_col, "score"), F.struct("score", "index_key")).alias("b"))
    return best.select("key", f"b.{id_col}", F.concat(F.lit(label), F.floor("b.score").cast("int").cast("string")).alias("method"))


def match_venues(names: DataFrame, venues: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Distinct raw names (column name) -> (name, venue_id, venue_method)."""
    index = cut_lineage(alias_index(venues, "venue_id", F.col("is_seeded")))  # every step looks names up in it
    raw = cut_lineage(names.select("name").distinct().withColumn("key", normalize_name("name")))
    keys = raw.where(~F.col("key").isin(["", *V.PLACEHOLDER_VENUES])).select("key").distinct()
    exact = cut_lineage(keys.join(index.hint("merge"), "key"))
    rest = cut_lineage(keys.join(exact.hint("merge"), "key", "left_anti"))
    inside = cut_lineage(_longest(_contains_pairs(rest, index, "venue_id"), "venue_id"))
    found = exact.withColumn("venue_method", F.lit("venue_exact")).unionByName(inside.withColumn("venue_method", F.lit("venue_contains")))
    if fuzzy:
        left = rest.join(inside.hint("merge"), "key", "left_anti")
        best = _best(_fuzzy_pairs(left, index, "venue_id", float(V.VENUE_FUZZY_RATIO), token_set_ratio), "venue_id", "venue_fuzzy_")
        found = found.unionByName(best.withColumnRenamed("method", "venue_method"))
    placeholder = F.col("key").isin(["", *V.PLACEHOLDER_VENUES])
    return raw.join(found.hint("merge"), "key", "left").select(
        "name", "venue_id", F.when(placeholder, F.lit("no_venue")).otherwise(F.coalesce("venue_method", F.lit("venue_unmatched"))).alias("venue_method"))


def match_cities(names: DataFrame, cities: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Distinct raw names (column name) -> (name, city_id, city_method)."""
    index = cut_lineage(alias_index(cities, "city_id"))
    raw = cut_lineage(names.select("name").distinct().withColumn("key", normalize_name("name")))
    keys = raw.where("key <> ''").select("key").distinct()
    exact = keys.join(index, "key")
    rest = cut_lineage(keys.join(exact, "key", "left_anti"))
    inside = cut_lineage(_longest(_word_pairs(rest, index, "city_id"), "city_id"))
    found = exact.withColumn("city_method", F.lit("city_exact")).unionByName(inside.withColumn("city_method", F.lit("city_contains")))
    if fuzzy:
        left = rest.join(inside, "key", "left_anti")
        best = _best(_fuzzy_pairs(left, index, "city_id", float(V.CITY_FUZZY_RATIO), ratio), "city_id", "city_fuzzy_")
        found = found.unionByName(best.withColumnRenamed("method", "city_method"))
    return raw.join(found, "key", "left").select(
        "name", "city_id", F.when(F.col("key") == "", F.lit("no_city")).otherwise(F.coalesce("city_method", F.lit("city_unmatched"))).alias("city_method"))


def nearest_city(points: DataFrame, cities: DataFrame, cell_degrees: float = 0.5, limit: float = 0.25) -> DataFrame:
    """(latitude, longitude) -> nearest city within sqrt(limit) degrees.

    The limit is half a degree, one grid cell, so a point meets every city in range by looking up its cell; each city is copied
    to its nine neighbouring cells (a constant factor on the dimension) and the points are never copied.
    """
    pts = points.select("latitude", "longitude").where("latitude IS NOT NULL AND longitude IS NOT NULL").distinct()
    cell = [F.floor(F.col(c) / cell_degrees).cast("int").alias(a) for c, a in (("latitude", "_y"), ("longitude", "_x"))]
    near = cities.where("latitude IS NOT NULL").select(
        "city_id", F.col("latitude").alias("_clat"), F.col("longitude").alias("_clon"),
        F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("_dy")).select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("_dx"))
    near = near.select("city_id", "_clat", "_clon", (F.floor(F.col("_clat") / cell_degrees) + F.col("_dy")).cast("int").alias("_y"),
                       (F.floor(F.col("_clon") / cell_degrees) + F.col("_dx")).cast("int").alias("_x"))
    d2 = squared_degrees(F.col("latitude"), F.col("longitude"), F.col("_clat"), F.col("_clon"))
    return (pts.select("latitude", "longitude", *cell).join(near, ["_y", "_x"]).withColumn("_d2", d2).where(F.col("_d2") < limit)
            .groupBy("latitude", "longitude").agg(F.min_by("city_id", F.struct("_d2", "city_id")).alias("near_city_id")))


def resolve_places(staged: DataFrame, venues: DataFrame, cities: DataFrame, postcodes: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """Adds venue_id, city_id, region_id, resolved names, coordinates, postcode and the method trace to staged records."""
    c = F.col
    v = venues.select("venue_id", c("name").alias("v_name"), c("city_id").alias("_v_city"), c("postcode").alias("_v_pc"),
                      c("latitude").alias("_v_lat"), c("longitude").alias("_v_lon"), c("capacity").alias("v_capacity"))
    ct = cities.select("city_id", c("name").alias("c_name"), "region_id", c("latitude").alias("_c_lat"), c("longitude").alias("_c_lon"))
    vm = cut_lineage(match_venues(staged.select(c("venue_name").alias("name")).where("name IS NOT NULL"), venues, fuzzy)).withColumnRenamed("name", "venue_name")
    cm = cut_lineage(match_cities(staged.select(c("city_name").alias("name")).where("name IS NOT NULL"), cities, fuzzy)).withColumnsRenamed({"name": "city_name", "city_id": "_m_city"})
    # names, venues, postcodes and cities are often missing: such rows must not land in one task
    out = left_lookup(left_lookup(left_lookup(staged, vm, ["venue_name"]), v, ["venue_id"]), cm, ["city_name"])
    out = (out
           .withColumn("_by_name", c("_v_city").isNull())
           .withColumn("city_id", F.coalesce("_v_city", "_m_city"))
           .withColumn("postcode", F.coalesce(normalize_postcode("postcode"), c("_v_pc")))
           .withColumn("_own", c("latitude").isNotNull())
           .withColumn("longitude", F.when(c("_own"), c("longitude")).otherwise(c("_v_lon")))
           .withColumn("latitude", F.coalesce("latitude", "_v_lat")))
    used_postcode = F.lit(False)
    if postcodes is not None:
        pc = postcodes.select("postcode", c("latitude").alias("_p_lat"), c("longitude").alias("_p_lon"))
        out = (left_lookup(out, pc, ["postcode"]).withColumn("_pc", c("latitude").isNull() & c("_p_lat").isNotNull())
               .withColumn("longitude", F.when(c("_pc"), c("_p_lon")).otherwise(c("longitude")))
               .withColumn("latitude", F.when(c("_pc"), c("_p_lat")).otherwise(c("latitude"))))
        used_postcode = c("_pc")
    unplaced = out.where("city_id IS NULL AND latitude IS NOT NULL")
    near = nearest_city(unplaced, cities)
    out = (left_lookup(out, near, ["latitude", "longitude"])
           .withColumn("_near", c("city_id").isNull() & c("near_city_id").isNotNull())
           .withColumn("city_id", F.coalesce("city_id", "near_city_id")))
    out = (left_lookup(out, ct, ["city_id"])
           .withColumn("_centroid", c("latitude").isNull() & c("_c_lat").isNotNull())
           .withColumn("longitude", F.when(c("_centroid"), c("_c_lon")).otherwise(c("longitude")))
           .withColumn("latitude", F.coalesce("latitude", "_c_lat")))
    method = F.concat_ws(
        "+", F.coalesce("venue_method", F.lit("no_venue")), F.when(c("_by_name"), F.coalesce("city_method", F.lit("no_city"))),
        F.when(used_postcode, F.lit("postcode_api")), F.when(c("_near"), F.lit("nearest_city")), F.when(c("_centroid"), F.lit("city_centroid")))
    drop = [x for x in out.columns if x.startswith("_")] + ["near_city_id", "venue_method", "city_method"]
    return out.withColumn("geo_method", method).drop(*drop)


def new_venues(resolved: DataFrame, venues: DataFrame) -> DataFrame:
    """Lightweight venue rows for named but unmatched venues: deterministic id, capacity only as the source gave it."""
    c = F.col
    key = normalize_name("venue_name")
    cand = (resolved.where("venue_id IS NULL AND venue_name IS NOT NULL").withColumn("normalized_name", key)
            .where(~c("normalized_name").isin(["", *V.PLACEHOLDER_VENUES])))
    known = venues.select(normalize_name("name").alias("normalized_name")).distinct()
    order = F.struct("ordinal", "external_id") if "ordinal" in resolved.columns else F.struct("external_id")
    first = F.struct(c("venue_name").alias("name"), "city_id", "postcode", "latitude", "longitude", c("venue_capacity").alias("capacity"))
    return (cand.join(known, "normalized_name", "left_anti").groupBy("normalized_name").agg(F.min_by(first, order).alias("f"))
            .select(F.abs(F.xxhash64("normalized_name")).alias("venue_id"), "normalized_name", "f.*",
                    F.when(c("f.capacity").isNotNull(), F.lit("source_provided")).alias("capacity_source"),
                    F.lit("unknown").alias("venue_type"), F.lit(False).alias("is_seeded")))
