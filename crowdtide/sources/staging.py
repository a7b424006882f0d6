"""The staged record: the one flat shape every source parser emits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGED = {
    "source_key": "string", "external_id": "string", "title": "string", "description": "string", "category_hint": "string",
    "date_start": "date", "date_end": "date", "time_start": "string", "time_end": "string", "venue_name": "string", "city_name": "string",
    "postcode": "string", "latitude": "double", "longitude": "double", "organizer": "string", "official_url": "string", "ticket_url": "string",
    "source_url": "string", "status": "string", "source_confidence": "string", "event_subtype": "string", "sold_out": "boolean",
    "venue_capacity": "int", "recurrence": "string", "raw": "string",
}
STAGED_SCHEMA = ", ".join(f"{k} {v}" for k, v in STAGED.items())
DEFAULTS = {"status": "SCHEDULED", "sold_out": False}
URLS = ("official_url", "ticket_url", "source_url")


def staged(df: DataFrame, keep: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """Select the staged columns, missing ones null or at their default; URLs trimmed, empty ones null."""
    unknown = set(columns) - set(STAGED)
    if unknown:
        raise ValueError(f"not staged columns: {sorted(unknown)}")
    out = []
    for name, kind in STAGED.items():
        x = columns.get(name, F.lit(None)).cast(kind)
        if name in DEFAULTS:
            x = F.coalesce(x, F.lit(DEFAULTS[name]))
        if name in URLS:
            x = F.nullif(F.trim(x), F.lit(""))
        out.append(x.alias(name))
    return df.select(*out, *keep)
