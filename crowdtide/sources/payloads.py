"""Landed JSON payloads of the structured sources to staged records, and the parser registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.dates import parse_schema_datetime, parse_time, parse_uk_date, split_local
from ..functions.text import external_id, normalize_name, normalize_status
from .staging import staged


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _prefix(c: Column, start: int, n: int) -> Column:
    return F.substring(c, start, n)


# ---- curated records ----------------------------------------------------------------------------------------------------------------
CURATED = ("external_id string, title string, category_hint string, date_start string, date_end string, time_start string, time_end string, venue string, "
           "city string, postcode string, organizer string, official_url string, ticket_url string, status string, capacity int")


def curated(payloads: DataFrame, source_key: str = "curated") -> DataFrame:
    """payloads.value: a JSON list of records; anything else yields nothing."""
    c = F.col
    is_list = F.startswith(F.ltrim("value"), F.lit("["))
    rows = payloads.where(is_list).select(F.explode(F.from_json("value", f"array<struct<{_colon(CURATED)}>>")).alias("r")).select("r.*")
    rows = rows.withColumn("d", parse_uk_date("date_start")).where("d IS NOT NULL")
    return staged(
        rows, source_key=F.lit(source_key), source_confidence=F.lit("CURATED"), external_id=c("external_id"), title=c("title"), category_hint=c("category_hint"),
        date_start=c("d"), date_end=parse_uk_date("date_end"), time_start=parse_time("time_start"), time_end=parse_time("time_end"), venue_name=c("venue"),
        city_name=c("city"), postcode=c("postcode"), organizer=c("organizer"), official_url=c("official_url"), ticket_url=c("ticket_url"),
        source_url=c("official_url"), status=c("status"), venue_capacity=c("capacity"), raw=F.to_json(F.struct(*rows.drop("d").columns)))


def _colon(ddl: str) -> str:
    """'a int, b string' as 'a:int,b:string'."""
    return ",".join(":".join(part.strip().split(" ", 1)) for part in ddl.split(","))


# ---- fixtures ---------------------------------------------------------------------------------------------------------------------------
FIXTURE = "MatchNumber string, RoundNumber string, DateUtc string, Location string, HomeTeam string, AwayTeam string, HomeTeamScore string"


def fixture_rows(payloads: DataFrame) -> DataFrame:
    keep = [x for x in payloads.columns if x != "value"]
    is_list = F.startswith(F.ltrim("value"), F.lit("["))
    return payloads.where(is_list).select(*keep, F.explode(F.from_json("value", f"array<struct<{_colon(FIXTURE)}>>")).alias("r")).select(*keep, "r.*")


def fixtures(matches: DataFrame, venues: DataFrame | None = None, source_key: str = "football_fixtures") -> DataFrame:
    """matches: FIXTURE columns with feed_url, competition, sport, feed_city, uk_only (optional).  Unknown kick-off is 00:00; matches
    with an unnamed team are dropped; a uk_only feed keeps matches at registry venues (semi-join on names and aliases)."""
    c = F.col
    for name, kind in (("feed_url", "string"), ("competition", "string"), ("sport", "string"), ("feed_city", "string"), ("uk_only", "boolean")):
        if name not in matches.columns:
            matches = matches.withColumn(name, F.lit(None).cast(kind))
    stamp = F.try_to_timestamp(F.regexp_extract("DateUtc", r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})Z$", 1), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    d, t = split_local(stamp)
    teams = F.lower(F.concat(F.coalesce("HomeTeam", F.lit("")), F.coalesce("AwayTeam", F.lit(""))))
    named = (F.length(F.coalesce("HomeTeam", F.lit(""))) > 0) & (F.length(F.coalesce("AwayTeam", F.lit(""))) > 0) & ~F.contains(teams, F.lit("to be announced"))
    rows = matches.where(named).withColumns({"d": d, "t": t, "place": F.trim(F.coalesce("Location", F.lit("")))}).where("d IS NOT NULL")
    if venues is not None:
        names = venues.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).select(normalize_name("n").alias("_key")).distinct()
        only = F.coalesce(c("uk_only"), F.lit(False))
        rows = rows.withColumn("_key", normalize_name("place"))
        rows = rows.where(~only).unionByName(rows.where(only).join(names, "_key", "left_semi")).drop("_key")
    comp = F.coalesce("competition", F.lit(""))
    return staged(
        rows, source_key=F.lit(source_key), source_confidence=F.lit("TRUSTED"), external_id=external_id(c("feed_url"), c("MatchNumber"), c("HomeTeam"), c("AwayTeam")),
        title=F.concat_ws(" v ", "HomeTeam", "AwayTeam"), category_hint=F.concat_ws(" ", F.coalesce("sport", F.lit("football")), comp),
        description=F.concat(comp, F.lit(" round "), F.coalesce("RoundNumber", F.lit(""))), date_start=c("d"), time_start=F.nullif("t", F.lit("00:00")),
        venue_name=F.when(~F.upper("place").isin("TBD", "TBA", "TBC", ""), c("Location")), organizer=comp, city_name=c("feed_city"), source_url=c("feed_url"),
        status=F.when(c("HomeTeamScore").isNotNull(), "COMPLETED").otherwise("SCHEDULED"), recurrence=F.lit("fixture"),
        raw=F.to_json(F.struct("MatchNumber", "RoundNumber", "DateUtc", "Location", "HomeTeam", "AwayTeam")))


# ---- ticketing API ------------------------------------------------------------------------------------------------------------------------
TICKETING = """struct<id:string,name:string,url:string,promoter:struct<name:string>,
 dates:struct<start:struct<localDate:string,localTime:string,dateTime:string,timeTBA:boolean>,end:struct<localDate:string,localTime:string>,status:struct<code:string>>,
 classifications:array<struct<segment:struct<name:string>,genre:struct<name:string>>>,
 _embedded:struct<venues:array<struct<name:string,postalCode:string,city:struct<name:string>,location:struct<latitude:string,longitude:string>>>>>""".replace("\n", "")


def ticketing(payloads: DataFrame, source_key: str = "ticketmaster") -> DataFrame:
    """payloads.value: one API page with _embedded.events."""
    c = F.col
    page = F.from_json("value", f"struct<_embedded:struct<events:array<{TICKETING}>>>")
    e = payloads.select(F.explode(page["_embedded"]["events"]).alias("e")).select("e.*")
    place, kind = F.get("_embedded.venues", F.lit(0)), F.get("classifications", F.lit(0))
    rows = e.withColumns({"d": F.coalesce(parse_uk_date("dates.start.localDate"), parse_schema_datetime("dates.start.dateTime")[0]), "p": place, "k": kind}).where("d IS NOT NULL")
    hint = F.nullif(F.concat_ws(" ", _text(c("k.segment.name")), _text(c("k.genre.name"))), F.lit(""))
    return staged(
        rows, source_key=F.lit(source_key), source_confidence=F.lit("TRUSTED"), external_id=c("id"), title=F.coalesce("name", F.lit("")), category_hint=hint, date_start=c("d"),
        date_end=parse_uk_date("dates.end.localDate"), time_start=F.when(~F.coalesce(c("dates.start.timeTBA"), F.lit(False)), parse_time("dates.start.localTime")),
        time_end=parse_time("dates.end.localTime"), venue_name=c("p.name"), city_name=c("p.city.name"), postcode=c("p.postalCode"),
        latitude=_text(c("p.location.latitude")).try_cast("double"), longitude=_text(c("p.location.longitude")).try_cast("double"), organizer=c("promoter.name"),
        official_url=c("url"), ticket_url=c("url"), source_url=c("url"), status=normalize_status("dates.status.code"),
        raw=F.to_json(F.struct("id", "name", "dates", c("p.name").alias("venue"), "url", hint.alias("classification"))))


# ---- organiser API --------------------------------------------------------------------------------------------------------------------------
ORGANISER = ("struct<id:string,name:struct<text:string>,url:string,status:string,start:struct<local:string>,end:struct<local:string>,"
             "venue:struct<name:string,latitude:string,longitude:string,address:struct<city:string,postal_code:string>>>")


def organiser(payloads: DataFrame, source_key: str = "eventbrite") -> DataFrame:
    """payloads.value: an object with an events list, or a single event object."""
    c = F.col
    many = F.from_json("value", f"struct<events:array<{ORGANISER}>>")["events"]
    one = F.from_json("value", ORGANISER)
    items = F.when(many.isNotNull(), many).when(one["id"].isNotNull(), F.array(one))
    e = payloads.select(F.explode(items).alias("e")).select("e.*")
    rows = e.withColumn("d", parse_uk_date(_prefix(c("start.local"), 1, 10))).where("d IS NOT NULL")
    return staged(
        rows, source_key=F.lit(source_key), source_confidence=F.lit("TRUSTED"), external_id=c("id"), title=F.coalesce("name.text", F.lit("")), date_start=c("d"),
        date_end=parse_uk_date(_prefix(c("end.local"), 1, 10)), time_start=parse_time(_prefix(c("start.local"), 12, 5)), time_end=parse_time(_prefix(c("end.local"), 12, 5)),
        venue_name=c("venue.name"), city_name=c("venue.address.city"), postcode=c("venue.address.postal_code"),
        latitude=_text(c("venue.latitude")).try_cast("double"), longitude=_text(c("venue.longitude")).try_cast("double"), official_url=c("url"), ticket_url=c("url"),
        source_url=c("url"), status=normalize_status("status"), raw=F.to_json(F.struct("id", c("name.text").alias("name"), c("start.local").alias("start"))))


# ---- music API -------------------------------------------------------------------------------------------------------------------------------
MUSIC = ("struct<identifier:string,`@id`:string,name:string,url:string,startDate:string,eventStatus:string,offers:array<struct<url:string>>,"
         "location:struct<name:string,address:struct<addressLocality:string,postalCode:string>,geo:struct<latitude:double,longitude:double>>>")


def music(payloads: DataFrame, source_key: str = "jambase") -> DataFrame:
    c = F.col
    e = payloads.select(F.explode(F.from_json("value", f"struct<events:array<{MUSIC}>>")["events"]).alias("e")).select("e.*")
    rows = e.withColumn("d", parse_uk_date(_prefix(c("startDate"), 1, 10))).where("d IS NOT NULL")
    return staged(
        rows, source_key=F.lit(source_key), source_confidence=F.lit("TRUSTED"), external_id=F.coalesce(_text(c("identifier")), c("`@id`")), title=F.coalesce("name", F.lit("")),
        category_hint=F.lit("concert"), date_start=c("d"), time_start=F.when(F.length("startDate") > 15, parse_time(_prefix(c("startDate"), 12, 5))),
        venue_name=c("location.name"), city_name=c("location.address.addressLocality"), postcode=c("location.address.postalCode"),
        latitude=c("location.geo.latitude"), longitude=c("location.geo.longitude"), official_url=c("url"), ticket_url=F.get("offers.url", F.lit(0)), source_url=c("url"),
        status=normalize_status("eventStatus"), raw=F.to_json(F.struct("identifier", "name", "startDate")))


# ---- registry -------------------------------------------------------------------------------------------------------------------------------
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"curated": curated, "ticketmaster": ticketing, "eventbrite": organiser, "jambase": music}


def register(source_key: str, parser: Callable[[DataFrame], DataFrame]) -> None:
    """Add a parser: a function from landed payloads to staged records."""
    PARSERS[source_key] = parser


def select_landed(landing: DataFrame, only: list[str] | None = None, city: str | None = None, sport: str | None = None, category: str | None = None) -> DataFrame:
    """Landing rows of the wanted sources; source_key is the partition column of the landing folder, so the filter prunes folders."""
    c = F.col
    keys = only
    if category is not None:
        if category not in V.CATEGORY_SOURCES:
            raise ValueError(f"unknown category {category}")
        keys = [k for k in (only or V.CATEGORY_SOURCES[category]) if k in V.CATEGORY_SOURCES[category]]
    out = landing if keys is None else landing.where(c("source_key").isin(keys))
    if city is not None:
        out = out.where(F.lower("target_city") == city.lower())
    return out if sport is None else out.where(c("sport") == sport)


def parse_landed(landing: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Union of every registered parser over its share of the landing rows (source_key, value)."""
    parts = [p(landing.where(F.col("source_key") == k)) for k, p in (parsers or PARSERS).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
