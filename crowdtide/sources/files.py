"""Readers of landed files and the registry tables, and the versioned table folder."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..session import cut_lineage

BOOKING_STRINGS = ", ".join(f"{f} string" for f in V.BOOKING_FIELDS)


def read_booking_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header row; a leading byte-order mark in the first column name is dropped."""
    df = spark.read.option("header", True).csv(path)
    return df.toDF(*[x.lstrip("\ufeff").strip() for x in df.columns])


def bookings_from_json(payloads: DataFrame, schema: str = BOOKING_STRINGS) -> DataFrame:
    """Column ``value`` holding a list, or an object with a ``bookings`` or ``data`` list."""
    rows = f"array<struct<{schema.replace(' string', ':string')}>>"
    whole = F.from_json("value", rows)
    wrapped = F.from_json("value", f"struct<bookings:{rows},data:{rows}>")
    is_list = F.startswith(F.trim(F.col("value")), F.lit("["))
    items = F.when(is_list, whole).otherwise(F.coalesce(F.when(F.size(wrapped["bookings"]) > 0, wrapped["bookings"]), wrapped["data"]))
    return payloads.select(F.explode(items).alias("r")).where("r IS NOT NULL").select("r.*")


def array_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, value: JSON text of each object of a file that holds one JSON array), and the fragments behind it (file, start, at, text).

    The files are read as records that end at a closing brace, so that one large array is split among tasks.  Whether a brace stands inside a text, and how deep it lies, follows
    from the quotes and braces before it: sums inside a split plus those of the splits before it.  Fragments between two closing braces of the outermost level are one object.
    """
    c = F.col
    text = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), c("value").alias("text"))
    rows = cut_lineage(text.withColumn("at", F.monotonically_increasing_id()))
    bare = F.regexp_replace("text", r"\\.", "")  # without escaped letters every quote opens or closes a text

    def before(df: DataFrame, value: str, out: str) -> DataFrame:
        """Sum of ``value`` over all earlier fragments of the file."""
        whole = df.groupBy("file", "start").agg(F.sum(value).alias("_sum"))
        ahead = whole.select("file", "start", F.coalesce(F.sum("_sum").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
        inside = F.coalesce(F.sum(value).over(Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return df.withColumn("_inside", inside).join(ahead, ["file", "start"]).withColumn(out, c("_inside") + c("_ahead")).drop("_inside", "_ahead")

    quoted = before(rows.withColumns({"bare": bare, "quotes": F.char_length(bare) - F.char_length(F.replace(bare, F.lit('"')))}), "quotes", "quotes_before")
    opened = c("quotes_before") % 2 == 1
    plain = F.regexp_replace(F.when(opened, F.concat(F.lit('"'), c("bare"))).otherwise(c("bare")), r'"[^"]*("|$)', "")
    closes = ((c("quotes_before") + c("quotes")) % 2 == 0).cast("int")  # the brace that ends the fragment is one of the structure
    opens = F.char_length(plain) - F.char_length(F.replace(plain, F.lit("{")))
    deep = before(quoted.withColumns({"closes": closes, "step": opens - closes}), "step", "depth")
    ends = deep.withColumn("ends", ((c("closes") == 1) & (c("depth") + c("step") == 0)).cast("int"))
    placed = before(ends.select("file", "start", "at", "text", "ends"), "ends", "element")
    whole = placed.groupBy("file", "element").agg(F.sort_array(F.collect_list(F.struct("start", "at", "text", "ends"))).alias("parts"))  # of one object
    whole = whole.where(F.exists("parts", lambda p: p["ends"] == 1))
    joined = F.concat(F.array_join(F.transform("parts", lambda p: p["text"]), "}"), F.lit("}"))
    return whole.select("file", F.regexp_replace(joined, r"^[^{]*", "").alias("value")), rows


def read_booking_json(spark: SparkSession, path: str, schema: str = BOOKING_STRINGS) -> DataFrame:
    """Files that hold a list are read in splits; those that hold an object around their list (``bookings`` or ``data``) as one text each."""
    elements, fragments = array_elements(spark, path)
    first = fragments.groupBy("file").agg(F.min_by("text", F.struct("start", "at")).alias("text")).select("file", F.ltrim(F.translate("text", "\ufeff\r\n\t", "   ")).startswith("[").alias("listed"))
    others = [r.file for r in first.where("not listed").collect()]  # names of files, which the driver lists anyway
    record = f"struct<{schema.replace(' string', ':string')}>"
    rows = elements.join(first.where("listed"), "file", "left_semi").select(F.from_json("value", record).alias("r")).where("r IS NOT NULL").select("r.*")
    if not others:
        return rows
    return rows.unionByName(bookings_from_json(spark.read.text(others, wholetext=True), schema))


def read_booking_database(spark: SparkSession, url: str, query: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None,
                          partitions: int = 16, **options: str) -> DataFrame:
    """Any JDBC source; give a numeric partition column with bounds to read it in parallel."""
    r = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column is None:
        return r.option("query", query).load()
    lo, hi = bounds
    return (r.option("dbtable", f"({query}) src").option("partitionColumn", partition_column).option("lowerBound", lo)
            .option("upperBound", hi).option("numPartitions", partitions).load())


READERS = {".csv": read_booking_csv, ".json": read_booking_json}


def read_bookings(spark: SparkSession, path: str) -> DataFrame:
    ext = PurePosixPath(path).suffix.lower()
    if ext not in READERS:
        raise ValueError(f"unsupported booking file type: {ext}")
    return READERS[ext](spark, path)


# ---- registries ------------------------------------------------------------------------------------------------------------------
CITY_SCHEMA = ("name string, region string, country string, latitude double, longitude double, population bigint, population_source string, "
               "priority int, tourism double, aliases array<string>")
VENUE_SCHEMA = ("name string, aliases array<string>, city string, postcode string, latitude double, longitude double, capacity int, capacity_source string, "
                "venue_type string, station_distance_km double, airport_distance_km double, official_events_url string, events_json_url string, "
                "ical_url string, rss_url string, enabled boolean, verification_status string, category_hint string")
COUNCIL_SCHEMA = "council string, kind string, city string, region string, events_url string, enabled boolean, verification_status string"
INSTITUTION_SCHEMA = "name string, type string, city string, region string, enabled boolean, verification_status string, school_event_confidence string"


def registry_from_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Registry entries (operator-maintained configuration) as a table; absent keys become null, numbers take the declared type."""
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")


def read_registry(spark: SparkSession, path: str, schema: str, root: str | None = None) -> DataFrame:
    """YAML or JSON registry file, read by the driver (configuration, not data); parquet is read as a table."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    with open(path, encoding="utf-8") as fh:
        if path.endswith((".yaml", ".yml")):
            import yaml

            doc = yaml.safe_load(fh)
        else:
            doc = json.load(fh)
    return registry_from_rows(spark, doc[root] if root else doc, schema)


def seed_dimensions(cities: DataFrame, venues: DataFrame) -> dict[str, DataFrame]:
    """Region, city and venue dimensions with deterministic ids from the normalised names."""
    from ..functions.scoring import venue_importance
    from ..functions.text import normalize_name

    def key(c) -> F.Column:
        return F.xxhash64(normalize_name(c))

    c = F.col
    region = cities.select(F.coalesce("region", F.lit("Unknown")).alias("name"), F.coalesce("country", F.lit("England")).alias("country"))
    region = region.groupBy("name").agg(F.min("country").alias("country")).withColumn("region_id", key("name"))
    city = cities.select(
        key("name").alias("city_id"), "name", normalize_name("name").alias("normalized_name"), key(F.coalesce("region", F.lit("Unknown"))).alias("region_id"),
        F.coalesce("country", F.lit("England")).alias("country"), "latitude", "longitude", "population", "population_source",
        F.coalesce("priority", F.lit(50)).alias("priority"), F.coalesce("tourism", F.lit(0.3)).alias("tourism"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).dropDuplicates(["normalized_name"])
    venue = venues.select(
        key("name").alias("venue_id"), "name", normalize_name("name").alias("normalized_name"), F.when(c("city").isNotNull(), key("city")).alias("city_id"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "postcode", "latitude", "longitude", "capacity", "capacity_source", "venue_type",
        "station_distance_km", "airport_distance_km", F.lit(True).alias("is_seeded"), venue_importance(c("capacity"), c("venue_type")).alias("importance_score")).dropDuplicates(["normalized_name"])
    venue = venue.join(city.select("city_id", F.lit(True).alias("_known")), "city_id", "left").withColumn("city_id", F.when(c("_known"), c("city_id"))).drop("_known")
    return {"region": region, "city": city, "venue": venue}
