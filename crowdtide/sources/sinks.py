"""Exports: CSV or JSON folders of the report frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.dates import within_days
from ..operators.filters import as_date, filter_events
from ..operators.views import event_summary, flatten, opportunity_view
from ..plans.reports import RUN_COLUMNS

FORMATS = ("csv", "json")


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    if fmt not in FORMATS:
        raise ValueError("format must be csv or json")
    if fmt == "json":
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    else:
        flatten(df).write.mode("overwrite").option("header", True).csv(path)


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """All rows, unless the caller asks for the first ones."""
    return df if limit is None else df.limit(limit)


def events_export(events: DataFrame, as_of, limit: int | None = None, **filters) -> DataFrame:
    return first_rows(event_summary(filter_events(events, as_of, **filters)).orderBy("date_start", "event_id"), limit)


def opportunities_export(opportunities: DataFrame, events: DataFrame, as_of, min_score: int = 0, days: int = 30, limit: int | None = None) -> DataFrame:
    near = events.where(within_days(F.col("date_start"), as_date(as_of), days)).select("event_id")
    wanted = opportunity_view(opportunities.where(F.col("score") >= min_score).join(near, "event_id", "left_semi"))
    return first_rows(wanted.orderBy(F.desc("score"), "event_id", "opportunity_type"), limit)


def actions_export(actions: DataFrame, status: str | None = None, action_type: str | None = None, limit: int | None = None) -> DataFrame:
    out = actions
    if status:
        out = out.where(F.col("status") == status.upper())
    if action_type:
        out = out.where(F.col("action_type") == action_type.upper())
    return first_rows(out.orderBy(F.desc("priority"), F.desc("action_id")), limit)


def runs_export(runs: DataFrame, limit: int | None = None) -> DataFrame:
    return first_rows(runs.select(*[c for c in RUN_COLUMNS if c in runs.columns]).orderBy(F.desc("run_id")), limit)


def snapshot_bundle(frames: dict[str, DataFrame], folder: str) -> list[str]:
    """Named result sets side by side, one JSON folder each."""
    for name, df in frames.items():
        export(df, f"{folder}/{name}", "json")
    return list(frames)


def sheets_bundle(report: dict[str, DataFrame], folder: str) -> list[str]:
    """The daily report as three sheets: summary, top opportunities, today's events."""
    sheets = {"daily_reports": report["summary"], "opportunities": report["top_opportunities"], "events": report["today"]}
    for name, df in sheets.items():
        export(df, f"{folder}/{name}", "csv")
    return list(sheets)
