"""Upserts and retention on plain tables: read version n, join, produce version n + 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import payload_hash
from .filters import as_date


def insert_raw(stored: DataFrame, landed: DataFrame) -> DataFrame:
    """Landed payloads not stored yet, one row per (source, external id, hash)."""
    key = ["source_key", "external_id", "hash"]
    order = F.col("ordinal") if "ordinal" in landed.columns else F.col("external_id")
    once = landed.groupBy(*key).agg(F.min_by(F.struct(*[x for x in landed.columns if x not in key]), order).alias("r")).select(*key, "r.*")
    return once.join(stored.select(*key), key, "left_anti")


def with_payload_hash(landed: DataFrame, fields: list[str]) -> DataFrame:
    return landed.withColumn("hash", payload_hash(F.struct(*[F.col(f) for f in sorted(fields)])))


def upsert_children(stored: DataFrame, regenerated: DataFrame, processed: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new table, obsolete rows): children of processed events are replaced by the regenerated set, others stay."""
    done = processed.select("event_id").distinct()
    kept = stored.join(done, "event_id", "left_anti")
    obsolete = stored.join(done, "event_id", "left_semi").join(regenerated.select(*key), key, "left_anti")
    return kept.unionByName(regenerated, allowMissingColumns=True), obsolete


def upsert_actions(stored: DataFrame, proposed: DataFrame, events: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Next action table with ``merge_action``: created, updated, kept, dismissed.

    stored: event_id, action_type, status, created_at, payload columns.  proposed: fanout.action_rows.  events: processed events with
    status.  User-managed statuses are never overwritten; a closed gate dismisses untouched rows.
    ``limit`` keeps the first new rows of a run only; none by default.
    """
    c = F.col
    key = ["event_id", "action_type"]
    payload = ["title", "description", "suggested_keyword", "suggested_audience", "suggested_channel", "recommended_time", "recommended_date", "reason", "priority"]
    fresh = proposed.join(stored.select(*key), key, "left_anti")
    if limit is not None:
        fresh = fresh.orderBy("event_id", "ordinal").limit(limit)
    created = fresh.select(*key, *payload, F.lit("NEW").alias("status"), now.alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("scheduled_for"), F.lit("created").alias("merge_action"))
    new = proposed.select(*key, F.struct(*payload).alias("n"))
    open_events = proposed.select("event_id").distinct().withColumn("_open", F.lit(True))
    ev = events.select("event_id", c("status").alias("_event_status"))
    cur = stored.join(new, key, "left").join(open_events, "event_id", "left").join(ev, "event_id", "left")
    renew = c("n").isNotNull() & c("status").isin("NEW", "DISMISSED_AUTO")
    dead = c("_event_status").isin(V.DEAD_STATUSES)
    shut = c("_event_status").isNotNull() & c("_open").isNull() & ((c("status") == "NEW") | (dead & (c("status") == "PLANNED")))
    status = F.when(renew, "NEW").when(shut, F.when(dead, "DISMISSED").otherwise("DISMISSED_AUTO")).otherwise(c("status"))
    kept = cur.select(
        *key, *[F.when(renew, c(f"n.{p}")).otherwise(c(p)).alias(p) for p in payload], status.alias("status"), "created_at", "scheduled_for",
        F.when(renew, "updated").when(shut, "dismissed").otherwise("kept").alias("merge_action"))
    return kept.unionByName(created)


def gate_counters(next_actions: DataFrame, proposed: DataFrame, processed: DataFrame, stored: DataFrame) -> DataFrame:
    """events_scored, events_passing_gate, actions_created, actions_capped, actions_auto_dismissed."""
    a = next_actions.agg(F.count_if(F.col("merge_action") == "created").alias("actions_created"),
                         F.count_if(F.col("merge_action") == "dismissed").alias("actions_auto_dismissed"))
    key = ["event_id", "action_type"]
    b = proposed.join(stored.select(*key, F.lit(True).alias("_had")), key, "left").agg(
        F.countDistinct("event_id").alias("events_passing_gate"), F.count_if(F.col("_had").isNull()).alias("_wanted"))
    p = processed.agg(F.count("*").alias("events_scored"))
    one = [x.withColumn("_k", F.lit(1)) for x in (a, b, p)]
    out = one[0].join(one[1], "_k").join(one[2], "_k").drop("_k")
    return out.withColumn("actions_capped", F.col("_wanted") - F.col("actions_created")).drop("_wanted")


TRANSITIONS = {"complete": "DONE", "dismiss": "DISMISSED", "schedule": "SCHEDULED", "plan": "PLANNED", "reopen": "NEW", "start": "IN_PROGRESS"}


def apply_transitions(actions: DataFrame, commands: DataFrame) -> DataFrame:
    """commands: action_id, command, issued_at [, scheduled_for]; the latest command per action wins."""
    c = F.col
    verb = F.coalesce(*[F.when(c("command") == k, F.lit(v)) for k, v in TRANSITIONS.items()])
    cmd = commands.withColumn("_to", verb).where("_to IS NOT NULL")
    slot = c("scheduled_for") if "scheduled_for" in commands.columns else F.lit(None).cast("timestamp_ntz")
    last = cmd.groupBy("action_id").agg(F.max_by(F.struct("_to", F.when(c("command") == "schedule", slot).alias("_slot")), F.struct("issued_at", "command")).alias("_c"))
    out = actions.join(last, "action_id", "left")
    return out.withColumns({"status": F.coalesce("_c._to", "status"), "scheduled_for": F.coalesce("_c._slot", "scheduled_for")}).drop("_c")


def toggle_sources(sources: DataFrame, commands: DataFrame) -> DataFrame:
    """commands: source_id, one row per toggle; an odd number of toggles flips the flag."""
    n = commands.groupBy("source_id").agg(F.count("*").alias("_n"))
    flipped = F.coalesce(F.col("_n"), F.lit(0)) % 2 == 1
    out = sources.join(n, "source_id", "left").withColumn("enabled", F.when(flipped, ~F.col("enabled")).otherwise(F.col("enabled")))
    return out.withColumn("status", F.when(flipped & ~F.col("enabled"), "DISABLED").otherwise(F.col("status"))).drop("_n")


def upsert_dimension(stored: DataFrame, seed: DataFrame, key: str, operator_owned: tuple[str, ...] = ()) -> DataFrame:
    """Seed values win except for operator-owned columns, which are seeded once; stored rows without a seed stay."""
    cols = [x for x in seed.columns if x != key]
    s = seed.select(key, F.struct(*cols).alias("n"))
    o = stored.select(key, F.struct(*[F.col(x) for x in cols]).alias("o"))
    both = o.join(s, key, "full")
    pick = {x: (F.coalesce(F.col(f"o.{x}"), F.col(f"n.{x}")) if x in operator_owned else F.when(F.col("n").isNotNull(), F.col(f"n.{x}")).otherwise(F.col(f"o.{x}"))) for x in cols}
    action = F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "kept").otherwise("updated")
    return both.select(key, *[v.alias(k) for k, v in pick.items()], action.alias("merge_action"))


def maintain_sources(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Source status, last success and last counters from each source's latest run."""
    c = F.col
    latest = runs.groupBy("source_id").agg(
        F.max_by(F.struct("status", "events_collected", "response_ms", "error"), "run_id").alias("l"),
        F.max(F.when(c("status").isin("HEALTHY", "DEGRADED", "EMPTY"), c("completed_at"))).alias("ok_at"))
    out = sources.join(latest, "source_id", "left")
    ran = c("l").isNotNull()
    return out.select(
        *[x for x in sources.columns if x not in ("status", "last_success_at", "last_events_collected", "last_response_ms", "last_error")],
        F.when(ran, c("l.status")).otherwise(c("status")).alias("status"), F.greatest("ok_at", "last_success_at").alias("last_success_at"),
        F.when(ran, c("l.events_collected")).otherwise(c("last_events_collected")).alias("last_events_collected"),
        F.when(ran, c("l.response_ms")).otherwise(c("last_response_ms")).alias("last_response_ms"),
        F.when(ran, c("l.error")).otherwise(c("last_error")).alias("last_error"))


def recover_stale_runs(runs: DataFrame, now: Column) -> DataFrame:
    old = (F.col("status") == "RUNNING") & (F.col("started_at") < now - F.expr(f"INTERVAL {V.STALE_RUN_HOURS} HOURS"))
    return runs.withColumns({
        "recovered": old, "completed_at": F.when(old, now).otherwise(F.col("completed_at")), "status": F.when(old, "ABORTED").otherwise(F.col("status"))})


def keep_recent(table: DataFrame, stamp: str, now: Column, days: int) -> DataFrame:
    """Time retention: a plain range filter, so a table partitioned by date drops whole partitions."""
    return table.where((F.col(stamp) >= now - F.expr(f"INTERVAL {int(days)} DAYS")) | F.col(stamp).isNull())


def expired_runs(runs: DataFrame, now: Column, days: int = V.RETENTION_DAYS["run"]) -> DataFrame:
    return runs.where(F.col("started_at") < now - F.expr(f"INTERVAL {int(days)} DAYS")).select("run_id")


def forget_runs(children: DataFrame, expired: DataFrame) -> DataFrame:
    """Null the run reference of rows whose run expired; the rows stay."""
    gone = expired.select("run_id", F.lit(True).alias("_gone"))
    return children.join(gone, "run_id", "left").withColumn("run_id", F.when(F.col("_gone"), None).otherwise(F.col("run_id"))).drop("_gone")


def drop_runs(children: DataFrame, expired: DataFrame) -> DataFrame:
    return children.join(expired.select("run_id"), "run_id", "left_anti")


def complete_past_events(events: DataFrame, as_of) -> DataFrame:
    """Past active events become COMPLETED; canonical events are never deleted."""
    past = (F.col("date_start") < F.date_sub(as_date(as_of), 1)) & F.col("status").isin(V.ACTIVE_STATUSES)
    return events.withColumns({"status_reason": F.when(past, F.lit("Event date has passed")).otherwise(F.col("status_reason")),
                               "status": F.when(past, "COMPLETED").otherwise(F.col("status"))})


def run_metrics(counters: DataFrame, run_id, started: Column, finished: Column, stage_errors: int = 0) -> DataFrame:
    """One row per run with its status: SUCCESS without errors, PARTIAL with errors and valid events, else FAILED."""
    valid = F.coalesce(F.col("events_valid"), F.lit(0)) if "events_valid" in counters.columns else F.lit(0)
    status = F.when(F.lit(stage_errors) == 0, "SUCCESS").when(valid > 0, "PARTIAL").otherwise("FAILED")
    seconds = F.bround(F.timestamp_diff("MICROSECOND", started, finished) / 1e6, 2)
    return counters.withColumns({"run_id": F.lit(run_id), "started_at": started, "completed_at": finished, "duration_seconds": seconds,
                                 "errors": F.lit(stage_errors), "status": status})


def merge_stages(left: Column, right: Column) -> Column:
    """Map of stage metadata; later entries replace earlier ones of the same key."""
    kept = F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(kept, right)
