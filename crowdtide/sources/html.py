"""Landed web pages: JSON-LD events, detail links, page profile."""

from __future__ import annotations

import html as html_entities
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from ..functions.dates import parse_schema_datetime
from ..functions.text import external_id, merge_hint, normalize_status
from ..session import pin
from .staging import staged


def ld_json_blocks(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(V.LD_JSON_SCRIPT), F.lit(1))


NESTING = 6  # levels of nested nodes that are widened as columns; a block that goes on below them is walked by a small function


def _as_list(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))


def _event_type(v: Column) -> Column:
    """Whether one of a node's types is an event type."""
    kinds = F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(F.try_variant_get(v, "$['@type']", "string")))
    return F.exists(kinds, lambda k: F.coalesce(F.element_at(F.split(k, "/"), -1).isin(sorted(V.EVENT_TYPES)) | k.endswith("Event"), F.lit(False)))


def _escaped(block: Column) -> Column:
    """JSON text with the raw control characters inside its strings escaped, which page authors leave in."""
    def inside(token: Column) -> Column:
        for raw, escape in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            token = F.replace(token, F.lit(raw), F.lit(escape))
        return F.translate(token, "".join(map(chr, range(32))), " " * 32)

    tokens = F.regexp_extract_all(block, F.lit(r'"(?:[^"\\]++|\\.)*+"|[^"]++'), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.startswith('"'), inside(t)).otherwise(t)), "")


def _nested(nodes: Column) -> Column:
    """The nodes one level below: values under the nesting keys, list items unwrapped."""
    def below(v: Column) -> Column:
        inner = F.array_compact(F.array(*[F.try_variant_get(v, f"$['{k}']", "variant") for k in V.NESTED_EVENT_KEYS]))
        return F.transform(F.flatten(F.transform(inner, _as_list)), lambda x: F.coalesce(F.try_variant_get(x, "$.item", "variant"), x))

    return F.flatten(F.transform(F.flatten(F.transform(nodes, _as_list)), below))


def _below(nodes: list) -> list[dict]:
    """All objects under the nesting keys of the nodes, at any depth, level by level."""
    found, level = [], nodes
    while level:
        objects: list[dict] = []
        while level:  # lists in lists, and list items that wrap their object
            flat = [y for x in level for y in (x if isinstance(x, list) else [x])]
            objects += [x for x in flat if isinstance(x, dict)]
            level = [x for x in flat if isinstance(x, list)]
        found += objects
        inner = [o[k] for o in objects for k in V.NESTED_EVENT_KEYS if o.get(k) is not None]
        level = [x["item"] if isinstance(x, dict) and x.get("item") is not None else x for v in inner for x in (v if isinstance(v, list) else [v])]
    return found


@F.udf(T.ArrayType(T.StringType()), useArrow=False)
def _deep_nodes(text: str | None) -> list[str] | None:
    """Objects of a JSON array and below as JSON texts; null for null.  Row by row: every level repeats those below it, and a batch of 10,000 such rows fills a worker."""
    return None if text is None else [json.dumps(o, ensure_ascii=False) for o in _below(json.loads(text))]


@F.pandas_udf(T.IntegerType())
def _dated_events(blocks: pd.Series) -> pd.Series:
    """Objects anywhere in a page's blocks whose type speaks of an event and that have a start date."""
    def count(texts) -> int:
        n = 0
        for text in texts if texts is not None else ():
            try:
                level = [json.loads(text, strict=False)]
            except ValueError:
                continue
            while level:
                for x in level:
                    if isinstance(x, dict):
                        kind = x.get("@type") or ""
                        n += bool("Event" in (" ".join(map(str, kind)) if isinstance(kind, list) else str(kind)) and x.get("startDate"))
                level = [v for x in level for v in (x.values() if isinstance(x, dict) else x) if isinstance(v, dict | list)]
        return n

    return blocks.map(count)


def jsonld_events(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per event object at any depth, column ``item`` (JSON text), next to the page columns; a malformed block has none.

    A block is parsed once; its nodes are an array that is widened level by level in the same row, and the rare block that is nested deeper hands its last level to a
    function that walks on.
    """
    keep = [c for c in pages.columns if c != html]
    blocks = pages.select(*keep, F.posexplode(ld_json_blocks(F.col(html))).alias("block_no", "block"))
    blocks = blocks.where(F.contains("block", F.lit("Event")) | F.contains("block", F.lit("Festival")))
    parsed = F.coalesce(F.try_parse_json("block"), F.try_parse_json(_escaped(F.col("block"))))
    nodes = pin(blocks, level0=F.when(parsed.isNotNull(), F.flatten(F.transform(_as_list(parsed), _as_list)))).drop("block")
    for k in range(NESTING):
        nodes = pin(nodes, **{f"level{k + 1}": _nested(F.col(f"level{k}"))})
    last = F.col(f"level{NESTING}")
    deeper = F.transform(_deep_nodes(F.when(F.size(last) > 0, F.to_json(last))), F.try_parse_json)
    nodes = nodes.withColumn("deeper", F.coalesce(deeper, F.array().cast("array<variant>")))
    every = F.filter(F.concat(*[F.flatten(F.transform(f"level{k}", _as_list)) for k in range(NESTING)], "deeper"), _event_type)
    return nodes.select(*keep, "block_no", F.posexplode(every).alias("item_no", "v")).select(*keep, "block_no", "item_no", F.to_json("v").alias("item"))


def detail_links(page: Column, base_url: Column, pattern: str) -> Column:
    """Sorted distinct same-host links whose target matches the pattern; text after # or ? is dropped."""
    root = F.regexp_extract(base_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    host = F.regexp_extract(base_url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    hrefs = F.filter(F.regexp_extract_all(page, F.lit(V.LINK_HREF), F.lit(1)), lambda h: F.regexp_like(h, F.lit(pattern)))
    full = F.transform(hrefs, lambda h: F.when(h.startswith("http"), h).when(h.startswith("/"), F.concat(root, h)).otherwise(F.concat(root, F.lit("/"), h)))
    return F.array_sort(F.array_distinct(F.filter(full, lambda u: F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1) == host)))


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html_entities.unescape(x))


def page_profile(pages: DataFrame, html: str = "html") -> DataFrame:
    """kind (ICS, RSS, JSONLD, HAS_FEED_LINK, HTML_ONLY) and item count per landed page, next to its other columns.

    JSON-LD counts the objects with both an event type and a start date, under any key and at any depth; only blocks that hold both words are walked.
    """
    keep = [c for c in pages.columns if c != html]
    blocks = F.filter(ld_json_blocks(F.col(html)), lambda b: F.contains(b, F.lit("Event")) & F.contains(b, F.lit("startDate")))
    df = pin(pages, _blocks=blocks).withColumn("_ld", _dated_events(F.when(F.size("_blocks") > 0, F.col("_blocks"))))
    h, ld = F.col(html), F.coalesce("_ld", F.lit(0))
    ics = F.startswith(F.ltrim(h), F.lit("BEGIN:VCALENDAR"))
    rss = h.rlike(V.FEED_START)
    linked = h.rlike(V.FEED_LINK) | h.rlike(V.CALENDAR_LINK)
    kind = F.when(ics, "ICS").when(rss, "RSS").when(ld > 0, "JSONLD").when(linked, "HAS_FEED_LINK").otherwise("HTML_ONLY")
    n = F.when(ics, F.regexp_count(h, F.lit("BEGIN:VEVENT"))).when(rss, F.regexp_count(h, F.lit("<item|<entry"))).when(ld > 0, ld).otherwise(0)
    links = F.size(F.array_distinct(F.regexp_extract_all(h, F.lit(V.LINK_HREF), F.lit(1))))
    return df.select(*keep, html, kind.alias("kind"), n.cast("int").alias("n_items"), links.alias("n_links"))


# ---- schema.org item -> staged record ---------------------------------------------------------------------------------------------
def vtext(v: Column, *paths: str) -> Column:
    """First non-empty text among the paths of a variant."""
    return F.coalesce(*[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths])


def _shape(v: Column, path: str) -> Column:
    return F.left(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(5))


def _name_of(v: Column, field: str) -> Column:
    """Name of an object, or of the first object of a list."""
    return F.coalesce(F.try_variant_get(v, f"$.{field}.name", "string"), F.try_variant_get(v, f"$.{field}[0].name", "string"))


def _plain(v: Column, path: str) -> Column:
    return F.when(_shape(v, path) == "STRIN", F.try_variant_get(v, path, "string"))


def normalize_items(items: DataFrame, source_key: str, confidence: str = "OFFICIAL") -> DataFrame:
    """Schema.org or calendar-plugin items to staged records.

    items: item (JSON text), page_url and optionally page_venue, page_city, page_postcode, page_hint, prefer_schema_venue.
    """
    for name, kind in (("page_venue", "string"), ("page_city", "string"), ("page_postcode", "string"), ("page_hint", "string"), ("prefer_schema_venue", "boolean")):
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast(kind))
    c = F.col
    df = pin(items, v=F.try_parse_json("item"))
    v = c("v")
    df = pin(df, begins=vtext(v, "$.startDate", "$.start_date", "$.date"), ends=vtext(v, "$.endDate", "$.end_date"))
    (date, time), (end_date, end_time) = parse_schema_datetime("begins"), parse_schema_datetime("ends")
    df = pin(df, d=date, t=time, de=end_date, te=end_time)
    placeholder = F.year("de") < 1980
    df = df.withColumns({"te": F.when(placeholder, None).otherwise(c("te")), "de": F.when(placeholder, None).otherwise(c("de"))})
    df = df.withColumn("te", F.when((c("de") == c("d")) & c("te").eqNullSafe(c("t")), None).otherwise(c("te")))

    plugin_venue = _plain(v, "$.venue.venue")  # calendar plugin: venue.venue, venue.city, venue.zip
    loc_name = F.coalesce(_plain(v, "$.location"), _plain(v, "$.location[0]"), _plain(v, "$.venue"), plugin_venue,
                          vtext(v, "$.location.name", "$.location[0].name", "$.venue.name", "$.venue[0].name"))
    address_text = F.coalesce(_plain(v, "$.location.address"), _plain(v, "$.location[0].address"))
    locality = F.when(address_text.isNotNull(), c("page_city")).otherwise(F.coalesce(
        vtext(v, "$.location.address.addressLocality", "$.location[0].address.addressLocality", "$.venue.address.addressLocality"),
        F.when(plugin_venue.isNotNull(), vtext(v, "$.venue.city")), c("page_city")))
    postal = F.coalesce(F.when(address_text.isNull(), F.coalesce(
        vtext(v, "$.location.address.postalCode", "$.location[0].address.postalCode", "$.venue.address.postalCode"),
        F.when(plugin_venue.isNotNull(), vtext(v, "$.venue.zip")))), c("page_postcode"))
    availability = F.lower(F.coalesce(vtext(v, "$.offers.availability", "$.offers[0].availability"), F.lit("")))
    df = df.withColumns({
        "loc_name": loc_name, "locality": F.trim(locality, F.lit(", ")), "postal": F.nullif(F.trim(postal, F.lit(", ")), F.lit("")),
        "sold": F.contains(F.replace(availability, F.lit(" ")), F.lit("soldout")),
        "kind": F.coalesce(_plain(v, "$['@type']"), F.try_variant_get(v, "$['@type'][0]", "string")),
        "link": F.coalesce(vtext(v, "$.url"), c("page_url")),
        "raw_name": vtext(v, "$.name", "$.title"),
        "state": normalize_status(vtext(v, "$.eventStatus")),
    })
    df = df.withColumns({"title": F.trim(html_unescape("raw_name")), "shown_venue": html_unescape(F.coalesce(
        F.when(c("prefer_schema_venue"), F.nullif("loc_name", F.lit(""))), F.nullif("page_venue", F.lit("")), F.nullif("loc_name", F.lit("")))),
        "shown_city": html_unescape("locality")})
    df = df.where(c("d").isNotNull() & (F.length(F.coalesce("title", F.lit(""))) > 0))
    return staged(
        df, source_key=F.lit(source_key), source_confidence=F.lit(confidence),
        external_id=external_id(F.coalesce("page_venue", "loc_name"), c("title"), c("d"), c("t")),
        title=c("title"), date_start=c("d"), date_end=c("de"), time_start=c("t"), time_end=c("te"),
        category_hint=merge_hint(F.coalesce("kind", F.lit("")), c("page_hint")), event_subtype=c("kind"),
        venue_name=F.nullif(F.trim("shown_venue"), F.lit("")), city_name=F.nullif("shown_city", F.lit("")), postcode=c("postal"),
        official_url=c("link"), ticket_url=vtext(v, "$.offers.url", "$.offers[0].url"), source_url=F.coalesce("page_url", "link"),
        organizer=F.coalesce(_name_of(v, "organizer"), _plain(v, "$.organizer"), _plain(v, "$.organizer[0]")),
        description=_name_of(v, "performer"), sold_out=c("sold"),
        status=F.when(c("sold") & (c("state") == "SCHEDULED"), "SOLD_OUT").otherwise(c("state")), raw=c("item"))
