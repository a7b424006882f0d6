"""Ordered-history operators over runs, snapshots and listings.

Keys may be hot, so none of these orders a whole key in one task: top-k windows carry a per-task pre-limit (WindowGroupLimit), "latest"
is a map-side combined max_by, and the running look-back is cut into id ranges of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V


def latest_runs(runs: DataFrame, n: int = V.HEALTH_RUNS) -> DataFrame:
    """The n latest runs per source with their rank ``rn``; the planner limits each task's share before the shuffle."""
    w = Window.partitionBy("source_id").orderBy(F.desc("run_id"))
    return runs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def health_figures(recent: DataFrame, now: Column) -> DataFrame:
    """Per-source aggregates over latest_runs."""
    c = F.col
    week = c("started_at") >= now - F.expr(f"INTERVAL {V.HEALTH_AVERAGE_DAYS} DAYS")
    failed = c("status") == "FAILED"
    k = V.HEALTH_RECENT
    return recent.groupBy("source_id").agg(
        F.count("*").alias("runs_sampled"), F.count_if(failed).alias("failure_count"),
        F.bround(F.avg(F.when(week, c("events_collected"))), 1).alias("events_7_day_average"),
        F.max_by("started_at", F.when(failed, c("run_id"))).alias("last_failure_at"),
        F.bround(F.count_if(failed) / F.count("*"), 2).alias("failure_rate"),
        (F.sum(F.coalesce("response_ms", F.lit(0))) / F.count("*")).cast("int").alias("avg_response_ms"),
        ((F.count_if((c("rn") <= k) & (c("events_collected") == 0)) == k) & (F.count_if((c("rn") > k) & (c("events_collected") > 0)) > 0)).alias("silent_zero"),
    )


def previous_success(runs: DataFrame, range_size: int = 100_000) -> DataFrame:
    """Adds prev_events: events_collected of the source's previous HEALTHY or DEGRADED run.

    run_id is unique, so a (source, run_id range) holds at most range_size rows; the value carried into each range comes from
    one summary row per range.
    """
    c = F.col
    ok = c("status").isin("HEALTHY", "DEGRADED")
    r = runs.withColumn("_range", F.floor(c("run_id") / range_size).cast("long"))
    inner = Window.partitionBy("source_id", "_range").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_inside", F.last(F.when(ok, c("events_collected")), ignorenulls=True).over(inner))
    summary = r.groupBy("source_id", "_range").agg(F.max_by("events_collected", F.when(ok, c("run_id"))).alias("_last"))
    outer = Window.partitionBy("source_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.withColumn("_carry", F.last("_last", ignorenulls=True).over(outer)).select("source_id", "_range", "_carry")
    return r.join(carry, ["source_id", "_range"], "left").withColumn("prev_events", F.coalesce("_inside", "_carry")).drop("_range", "_inside", "_carry")


def regressions(runs: DataFrame) -> DataFrame:
    """Runs of a productive source that returned less than half of its previous successful run."""
    flagged = previous_success(runs).where((F.col("prev_events") >= V.REGRESSION_MIN_EVENTS) & (F.col("events_collected") < F.lit(V.REGRESSION_RATIO) * F.col("prev_events")))
    return flagged.withColumn("message", F.concat(F.lit("regression: "), F.col("events_collected").cast("string"), F.lit(" events vs "),
                                                  F.col("prev_events").cast("string"), F.lit(" in previous successful run")))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order, as a map-side combined min_by."""
    rest = [x for x in df.columns if x not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def feed_fallback(rows: DataFrame) -> DataFrame:
    """Of several feed kinds per target keep the rows of the lowest kind_rank that yielded any."""
    best = rows.groupBy("target").agg(F.min("kind_rank").alias("_best"))
    return rows.join(best, "target").where(F.col("kind_rank") == F.col("_best")).drop("_best")


def latest_hash(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("event_id").agg(F.max_by("snapshot_hash", "snapshot_id").alias("last_hash"))


def survivors(records: DataFrame, key: str, fields: list[str], priority: str, seen: str, ordinal: str) -> DataFrame:
    """Per field the first non-null value by (priority desc, seen, ordinal)."""
    rank = F.struct((-F.col(priority)).alias("p"), F.col(seen), F.col(ordinal))
    return records.groupBy(key).agg(*[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), rank)).alias(f) for f in fields])


def collector_outcome(fetches: DataFrame) -> DataFrame:
    """fetches: source_key, ok, blocked, warned, events, failed -> outcome per source."""
    c = F.col
    a = fetches.groupBy("source_key").agg(
        F.count_if(c("attempted")).alias("attempted"), F.count_if(c("ok")).alias("ok"), F.count_if(c("blocked")).alias("blocked"),
        F.count_if(c("warned")).alias("warnings"), F.sum("events").alias("events"))
    outcome = (F.when((c("attempted") == 0) & (c("events") == 0), "EMPTY")
               .when((c("attempted") > 0) & (c("ok") == 0), F.when((c("blocked") > 0) & (c("blocked") >= c("attempted")), "BLOCKED").otherwise("FAILED"))
               .when(c("warnings") > 0, "DEGRADED").otherwise("HEALTHY"))
    return a.withColumn("outcome", outcome)


def top_values(df: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """Top-k values per key by count; the window sees counts, not rows."""
    n = df.groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), F.col(value).asc_nulls_last())
    return n.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
