"""KPI, trend, coverage, data-quality and digest reports: one conditional-aggregate pass per table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.dates import overlaps_day, within_days
from ..operators.filters import active, as_date, canned
from ..operators.history import health_figures, latest_runs, regressions
from ..operators.views import event_brief
from ..session import cut_lineage


def one_row(*frames: DataFrame) -> DataFrame:
    """Side-by-side one-row frames."""
    keyed = [f.withColumn("_k", F.lit(1)) for f in frames]
    return reduce(lambda a, b: a.join(b, "_k"), keyed).drop("_k")


def horizon_counts(events: DataFrame, as_of, **where) -> DataFrame:
    for k, v in where.items():
        events = events.where(F.col(k) == v)
    day = as_date(as_of)
    return events.agg(*[F.count_if(within_days(F.col("date_start"), day, n)).alias(f"h_{name}") for name, n in V.HORIZON_DAYS])


def event_counters(events: DataFrame, as_of) -> DataFrame:
    day, c = as_date(as_of), F.col
    live = active()
    week = within_days(c("date_start"), day, 7) & live
    return events.agg(
        F.count_if(overlaps_day(c("date_start"), c("date_end"), day) & live).alias("events_today"),
        F.count_if(overlaps_day(c("date_start"), c("date_end"), F.date_add(day, 1)) & live).alias("events_tomorrow"),
        F.count_if(week).alias("events_next_7_days"),
        F.count_if(within_days(c("date_start"), day, 30) & live).alias("events_next_30_days"),
        F.count_if(week & (c("demand_level") == "HIGH")).alias("high"),
        F.count_if(week & (c("demand_level") == "VERY_HIGH")).alias("very_high"),
        F.count_if(week & (c("demand_level") == "MEDIUM")).alias("medium"))


def change_counters(changes: DataFrame, as_of) -> DataFrame:
    since = F.date_sub(as_date(as_of), 1).cast("timestamp_ntz")
    t = F.col("change_type")
    kind = F.when(t == "NEW", "new").when(t == "CANCELLED", "cancelled").otherwise("changed")
    # distinct per (event, class) first, so a hot event or type costs one row per task
    d = changes.where(F.col("detected_at") >= since).select("event_id", kind.alias("kind")).distinct()
    return d.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_events") for k in ("new", "changed", "cancelled")])


def source_counters(sources: DataFrame) -> DataFrame:
    s = F.col("status")
    return sources.agg(F.count_if("enabled").alias("sources_total"), F.count_if(s.isin("HEALTHY", "DEGRADED", "EMPTY")).alias("sources_healthy"),
                       F.count_if(s == "EMPTY").alias("sources_empty"), F.count_if(s == "BLOCKED").alias("sources_blocked"))


def open_action_counter(actions: DataFrame, events: DataFrame, as_of, days: int = 14) -> DataFrame:
    near = events.where(within_days(F.col("date_start"), as_date(as_of), days)).select("event_id")
    return actions.where(F.col("status").isin(V.OPEN_ACTION_STATUSES)).join(near, "event_id", "left_semi").agg(F.count("*").alias("open_actions"))


def latest_regressions(source_runs: DataFrame) -> DataFrame:
    """(ordinal, message) of the productive sources that fell off on the day of the last run, by source."""
    last = source_runs.agg(F.to_date(F.max("started_at")).alias("_day"))
    found = regressions(source_runs).join(last, F.to_date("started_at") == F.col("_day"))
    return found.select(F.concat_ws(" ", F.col("source_id").cast("string"), "message").alias("message"), F.struct("source_id", "run_id").alias("o"))


def regression_text(source_runs: DataFrame) -> DataFrame:
    """source_regressions: the messages of the last day in one text, one a line; at most one per source and run of that day."""
    lines = latest_regressions(source_runs).agg(F.sort_array(F.collect_list(F.struct("o", "message"))).alias("a"))
    return lines.select(F.array_join(F.transform("a", lambda x: x["message"]), "\n").alias("source_regressions"))


def pipeline_status(runs: DataFrame) -> DataFrame:
    """Status of the last run that is not running, one row."""
    return runs.where(F.col("status") != "RUNNING").agg(F.coalesce(F.max_by("status", "run_id"), F.lit("UNKNOWN")).alias("pipeline_status"))


def silent_counter(events: DataFrame, as_of) -> DataFrame:
    silent = F.startswith(F.coalesce("status_reason", F.lit("")), F.lit("SOURCE SILENT"))
    return events.agg(F.count_if((F.col("date_start") >= as_date(as_of)) & silent).alias("source_silent_events"))


def summary(events: DataFrame, changes: DataFrame, sources: DataFrame, actions: DataFrame, as_of, source_runs: DataFrame | None = None) -> DataFrame:
    parts = [event_counters(events, as_of), change_counters(changes, as_of), source_counters(sources), open_action_counter(actions, events, as_of)]
    return one_row(*parts, *([regression_text(source_runs)] if source_runs is not None else []))


def data_freshness(runs: DataFrame, events: DataFrame, as_of, now: Column) -> DataFrame:
    done = runs.where(F.col("status").isin("SUCCESS", "PARTIAL")).agg(F.max_by("completed_at", "run_id").alias("at"))
    hours = F.bround(F.timestamp_diff("MICROSECOND", F.col("at"), now) / 3.6e9, 1)
    label = F.when(F.col("hours") <= V.FRESH_RUN_HOURS, "FRESH").when(F.col("hours").isNotNull(), "STALE").otherwise("UNKNOWN")
    fresh = events.where(F.col("date_start") >= as_date(as_of)).agg(F.bround(F.avg("freshness_score"), 1).alias("avg_freshness_score"))
    return one_row(done.select(hours.alias("hours")).select(F.col("hours").alias("hours_since_last_success"), label.alias("label")), fresh)


# ---- tops ------------------------------------------------------------------------------------------------------------------------
def top_events(events: DataFrame, as_of, days: int = 7, limit: int = 5) -> DataFrame:
    return (events.where(within_days(F.col("date_start"), as_date(as_of), days) & active())
            .orderBy(F.desc("opportunity_score"), "date_start", "event_id").limit(limit))


def service_area_top(events: DataFrame, as_of, days: int = 7, limit: int = 5) -> DataFrame:
    inside = F.col("in_area") & F.col("c_name").isNotNull() & F.col("quality_level").isin("HIGH", "MEDIUM")
    return top_events(events.where(inside), as_of, days, limit)


def todays_events(events: DataFrame, as_of, limit: int = 20) -> DataFrame:
    return events.where((F.col("date_start") == as_date(as_of)) & active()).orderBy(F.desc("opportunity_score"), "event_id").limit(limit)


# ---- trends ------------------------------------------------------------------------------------------------------------------------
def upcoming(events: DataFrame, as_of, days: int = 30) -> DataFrame:
    return events.where(within_days(F.col("date_start"), as_date(as_of), days) & active())


def grouped(up: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    out = up.groupBy(key).agg(F.count("*").alias("n"), F.bround(F.coalesce(F.avg("opportunity_score"), F.lit(0)), 1).alias("avg_score"))
    out = out.orderBy(F.desc("n"), key)
    return out.limit(limit) if limit else out


def top_places(up: DataFrame, key: str, limit: int) -> DataFrame:
    """Count, average and maximum score per resolved place."""
    return (up.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("n"), F.bround(F.avg("opportunity_score"), 1).alias("avg_score"), F.max("opportunity_score").alias("max_score"))
        .orderBy(F.desc("n"), key).limit(limit))


def by_day(up: DataFrame) -> DataFrame:
    return up.groupBy("date_start").agg(F.count("*").alias("n"), F.count_if(F.col("demand_level").isin("HIGH", "VERY_HIGH")).alias("high_or_above"))


def score_bucket() -> Column:
    s = F.col("opportunity_score")
    return F.when(s >= 80, "80-100").when(s >= 65, "65-79").when(s >= 50, "50-64").when(s >= 35, "35-49").otherwise("0-34")


def score_histogram(up: DataFrame) -> DataFrame:
    return up.groupBy(score_bucket().alias("bucket")).agg(F.count("*").alias("n"))


def change_trend(changes: DataFrame, now: Column, days: int = 14, change_type: str | None = None) -> DataFrame:
    recent = changes.where(F.col("detected_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    if change_type:
        recent = recent.where(F.col("change_type") == change_type)
    return recent.groupBy(F.to_date("detected_at").alias("day"), "change_type").agg(F.count("*").alias("n"))


def dimension_counts(dim: DataFrame, events: DataFrame, key: str, as_of) -> DataFrame:
    """Dimension rows with their number of upcoming events, zero included: aggregate first, then join one row per key."""
    n = events.where(F.col("date_start") >= as_date(as_of)).groupBy(key).agg(F.count("*").alias("upcoming_events"))
    return dim.join(n, key, "left").withColumn("upcoming_events", F.coalesce("upcoming_events", F.lit(0)))


# ---- source health -------------------------------------------------------------------------------------------------------------------
def future_events_per_source(links: DataFrame, events: DataFrame, as_of) -> DataFrame:
    future = events.where(F.col("date_start") >= as_date(as_of)).select("event_id")
    return links.join(future, "event_id", "left_semi").groupBy("source_id").agg(F.countDistinct("event_id").alias("future_events"))


def source_health(sources: DataFrame, runs: DataFrame, links: DataFrame, events: DataFrame, as_of, now: Column) -> DataFrame:
    c = F.col
    out = (sources.join(health_figures(latest_runs(runs), now), "source_id", "left")
           .join(future_events_per_source(links, events, as_of), "source_id", "left"))
    quiet = c("last_success_at") < now - F.expr(f"INTERVAL {V.HEALTH_SILENT_DAYS} DAYS")
    silent = c("enabled") & (c("status") != "DISABLED") & (F.coalesce(quiet, F.lit(False)) | F.coalesce(c("silent_zero"), F.lit(False)))
    empty = c("status").isin("HEALTHY", "DEGRADED") & (F.coalesce("last_events_collected", F.lit(0)) == 0)
    status = F.when(silent, "SOURCE SILENT").when(~c("enabled"), "DISABLED").when(empty, "EMPTY").otherwise(c("status"))
    return out.select(
        "source_id", "key", "type", "priority", "enabled", status.alias("health"), c("status").alias("raw_status"), "requires_key",
        F.when(c("requires_key").isNotNull(), "key").otherwise("none").alias("auth"), "last_success_at", "last_failure_at", "last_events_collected",
        "events_7_day_average", F.coalesce("failure_count", F.lit(0)).alias("failure_count"), F.coalesce("future_events", F.lit(0)).alias("future_events"),
        F.coalesce("runs_sampled", F.lit(0)).alias("runs_sampled"), "failure_rate", "avg_response_ms", "last_error")


# ---- coverage --------------------------------------------------------------------------------------------------------------------------
def configured_targets(sources: DataFrame, venues: DataFrame, councils: DataFrame, institutions: DataFrame) -> DataFrame:
    """Flat list of collection targets from the four registries."""
    c = F.col
    a = sources.select(F.lit("source").alias("kind"), "key", c("key").alias("name"), "enabled", "requires_key", F.lit(None).cast("string").alias("declared_status"),
                       F.lit(None).cast("string").alias("city"), "type")
    feed = F.coalesce(*[F.nullif(c(x), F.lit("")) for x in ("official_events_url", "events_json_url", "ical_url", "rss_url")])
    b = venues.where(feed.isNotNull()).select(F.lit("venue").alias("kind"), c("name").alias("key"), "name", F.coalesce("enabled", F.lit(True)).alias("enabled"), "city",
                                              c("verification_status").alias("declared_status"), F.lit("venue_pages").alias("source_key"), c("venue_type").alias("type"))
    kind = F.coalesce(c("kind"), F.lit("council"))
    d = councils.select(kind.alias("kind"), c("council").alias("key"), c("council").alias("name"), F.coalesce("enabled", F.lit(True)).alias("enabled"), "city",
                        c("verification_status").alias("declared_status"), F.when(c("kind") == "tourism", "tourism").otherwise("councils").alias("source_key"), c("kind").alias("type"))
    ik = F.when(c("type") == "university", "university").when(c("type").isin("college", "sixth_form"), "college").otherwise("school")
    e = institutions.select(ik.alias("kind"), c("name").alias("key"), "name", F.coalesce("enabled", F.lit(True)).alias("enabled"), "city",
                            c("verification_status").alias("declared_status"),
                            F.when(ik == "university", "universities").when(ik == "college", "colleges").otherwise("schools").alias("source_key"), "type")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [a, b, d, e])


def target_status(targets: DataFrame, health: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """Targets with future_events and derived status."""
    c = F.col
    future = events.where(c("date_start") >= as_date(as_of))
    by_venue = future.where("v_name IS NOT NULL").groupBy(c("v_name").alias("key")).agg(F.count("*").alias("_v"))
    by_org = future.where("organizer IS NOT NULL").groupBy(c("organizer").alias("key")).agg(F.count("*").alias("_o"))
    src = health.select("key", c("health").alias("_health"), c("future_events").alias("_s"))
    t = targets.join(by_venue, "key", "left").join(by_org, "key", "left").join(src, "key", "left")
    is_source = c("kind") == "source"
    got = F.when(is_source, c("_s")).when(c("kind") == "venue", c("_v")).otherwise(c("_o"))
    t = t.withColumn("future_events", F.coalesce(got, F.lit(0)))
    raw = F.coalesce("_health", F.when(c("enabled"), "UNVERIFIED").otherwise("DISABLED"))
    src_status = F.when(raw.isin("HEALTHY", "DEGRADED") & (c("future_events") == 0), "EMPTY").when(raw == "HEALTHY", "ACTIVE").otherwise(raw)
    page_status = F.when(~c("enabled"), "DISABLED").when(c("future_events") > 0, "ACTIVE").otherwise(F.coalesce("declared_status", F.lit("EMPTY")))
    return t.withColumn("status", F.when(is_source, src_status).otherwise(page_status)).drop("_v", "_o", "_s", "_health")


def target_weight() -> Column:
    return F.coalesce(*[F.when(F.col("kind") == k, F.lit(w)) for k, w in V.TARGET_WEIGHTS.items()], F.lit(1.0))


def coverage_index(targets: DataFrame) -> DataFrame:
    """Weighted share of enabled key-less targets that are ACTIVE, 0..100."""
    counts = targets.where("enabled AND requires_key IS NULL").withColumn("w", target_weight())
    a = counts.agg(F.coalesce(F.sum(F.when(F.col("status") == "ACTIVE", F.col("w"))), F.lit(0.0)).alias("weighted_active"),
                   F.coalesce(F.sum("w"), F.lit(0.0)).alias("weighted_configured"))
    pct = F.when(F.col("weighted_configured") > 0, F.bround(F.lit(100.0) * F.col("weighted_active") / F.col("weighted_configured"), 0).cast("int")).otherwise(0)
    return a.select(F.bround("weighted_active", 2).alias("weighted_active"), F.bround("weighted_configured", 2).alias("weighted_configured"), pct.alias("coverage_index"))


def mix(events: DataFrame, column: str, as_of=None) -> DataFrame:
    """Row counts per value; over future events when a date is given."""
    rows = events if as_of is None else events.where(F.col("date_start") >= as_date(as_of))
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def mixes(events: DataFrame, as_of) -> DataFrame:
    """All value mixes of the coverage report in one long table: sources, confidence, quality over future events, status over all."""
    future = F.col("date_start") >= as_date(as_of)
    parts = F.array(*[F.struct(F.lit(name).alias("mix"), F.col(col).cast("string").alias("value"), keep.alias("keep")) for name, col, keep in (
        ("source", "primary_source", future), ("confidence", "source_confidence", future), ("quality", "quality_level", future), ("status", "status", F.lit(True)))])
    return events.select(F.explode(parts).alias("m")).where("m.keep").groupBy("m.mix", "m.value").agg(F.count("*").alias("n"))


def city_gaps(cities: DataFrame, events: DataFrame, as_of) -> DataFrame:
    seen = events.where(F.col("date_start") >= as_date(as_of)).select("city_id").distinct()
    return cities.join(seen, "city_id", "left_anti").select("city_id", F.col("name").alias("city")).orderBy("city")


def region_rollup(cities: DataFrame, regions: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """Future events per region and city with subtotals; configured cities without events count zero."""
    n = dimension_counts(cities.select("city_id", "name", "region_id"), events, "city_id", as_of)
    named = n.join(regions.select("region_id", F.col("name").alias("region")), "region_id", "left").select(
        F.coalesce("region", F.lit("Unknown")).alias("region"), F.col("name").alias("city"), "upcoming_events")
    return named.groupingSets([[F.col("region"), F.col("city")], [F.col("region")]], F.col("region"), F.col("city")).agg(
        F.sum("upcoming_events").alias("n"), F.grouping("city").cast("int").alias("is_total"))


def coverage_totals(events: DataFrame, venues: DataFrame, as_of) -> DataFrame:
    future = events.where(F.col("date_start") >= as_date(as_of))
    a = future.agg(F.count("*").alias("future_total"), F.countDistinct("venue_id").alias("venues_with_events"),
                   F.count_if(F.startswith(F.coalesce("status_reason", F.lit("")), F.lit("SOURCE SILENT"))).alias("source_silent"))
    return one_row(a, venues.agg(F.count("*").alias("venues_registered")))


# ---- data quality ------------------------------------------------------------------------------------------------------------------------
def data_quality(events: DataFrame, as_of) -> DataFrame:
    """All data-quality counters of future events as (metric, n, pct), one scan."""
    c = F.col
    tests = {
        "missing_time_start": c("time_start").isNull(), "missing_venue_id": c("venue_id").isNull(), "missing_city_id": c("city_id").isNull(),
        "missing_official_url": c("official_url").isNull() & c("ticket_url").isNull(), "missing_coordinates": c("latitude").isNull(),
        "missing_venue_capacity": c("venue_capacity").isNull(), "category_other": c("category") == "other",
        "multi_source": c("source_count") >= 2,
        **{f"quality_{q}": c("quality_level") == q for q in ("HIGH", "MEDIUM", "LOW")},
        **{f"confidence_{q}": c("source_confidence") == q for q in V.CONFIDENCE_RANK},
        "source_silent": F.startswith(F.coalesce("status_reason", F.lit("")), F.lit("SOURCE SILENT")),
    }
    one = events.where(c("date_start") >= as_date(as_of)).agg(F.count("*").alias("_total"), *[F.count_if(t).alias(k) for k, t in tests.items()])
    long = one.select("_total", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), c(k).alias("n")) for k in tests])).alias("m"))
    pct = F.when(c("_total") > 0, F.bround(F.lit(100.0) * c("m.n") / c("_total"), 1)).otherwise(0.0)
    return long.select("m.metric", "m.n", pct.alias("pct"))


def quality_averages(events: DataFrame, as_of) -> DataFrame:
    return events.where(F.col("date_start") >= as_date(as_of)).agg(
        F.count("*").alias("future_events"), F.bround(F.avg("event_quality_score"), 1).alias("avg_quality_score"),
        F.bround(F.avg("freshness_score"), 1).alias("avg_freshness"), F.min("freshness_score").alias("min_freshness"))


def possible_duplicates(events: DataFrame, as_of) -> DataFrame:
    return (events.where(F.col("date_start") >= as_date(as_of)).groupBy("normalized_title", "date_start").agg(F.count("*").alias("n")).where("n > 1"))


# ---- health, runs ------------------------------------------------------------------------------------------------------------------------
def system_counts(sources: DataFrame, notifications: DataFrame | None = None) -> DataFrame:
    s = F.col("status")
    out = sources.agg(F.count("*").alias("total"), F.count_if(s == "HEALTHY").alias("healthy"), F.count_if(s == "DEGRADED").alias("degraded"),
                      F.count_if(s == "FAILED").alias("failed"), F.count_if((s == "DISABLED") | ~F.col("enabled")).alias("disabled"))
    if notifications is None:
        return out
    return one_row(out, notifications.agg(F.count_if(s == "SENT").alias("sent"), F.count_if(s == "FAILED").alias("send_failed")))


RUN_COLUMNS = ["run_id", "trigger", "status", "started_at", "completed_at", "duration_seconds", "sources_attempted", "sources_successful", "sources_failed",
               "events_raw", "events_valid", "events_created", "events_updated", "duplicates_removed", "changes_detected", "opportunities_generated", "actions_generated"]


def run_history(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.select(*[x for x in RUN_COLUMNS if x in runs.columns]).orderBy(F.desc("run_id")).limit(limit)


def rejections(rejected: DataFrame) -> DataFrame:
    """Rejected records per source and reason, with the source totals."""
    ex = rejected.select("source_key", F.explode("problems").alias("problem"))
    return ex.groupBy("source_key", "problem").agg(F.count("*").alias("n"))


def dry_run(staged: DataFrame, as_of) -> DataFrame:
    """Collected, valid and rejected counts per source."""
    from ..operators.filters import validation_problems

    p = staged.withColumn("_bad", F.size(validation_problems(as_date(as_of))) > 0)
    return p.groupBy("source_key").agg(F.count("*").alias("collected"), F.count_if(~F.col("_bad")).alias("valid"), F.count_if("_bad").alias("rejected"))


# ---- daily bundle and digest ---------------------------------------------------------------------------------------------------------------
def daily_report(events: DataFrame, changes: DataFrame, sources: DataFrame, actions: DataFrame, as_of, source_runs: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    """The frames of the daily report.  ``events`` and ``actions`` are read by each of them: pass stored frames, not long plans."""
    week = events.where(within_days(F.col("date_start"), as_date(as_of), 7) & active())
    return {
        "summary": one_row(summary(events, changes, sources, actions, as_of, source_runs), horizon_counts(events, as_of), silent_counter(events, as_of)),
        "pipeline": pipeline_status(runs),
        "by_category_7d": week.groupBy("category").agg(F.count("*").alias("n")),
        "service_area_top": event_brief(service_area_top(events, as_of), actions),
        "top_opportunities": event_brief(top_events(events, as_of), actions),
        "today": event_brief(todays_events(events, as_of), actions),
    }


def _section(df: DataFrame, name: str, label: Column, value: Column, ordinal: Column) -> DataFrame:
    return df.select(F.lit(name).alias("section"), ordinal.cast("int").alias("ordinal"), label.cast("string").alias("label"), value.cast("string").alias("value"))


def digest(report: dict[str, DataFrame], limit: int = 5) -> DataFrame:
    """(section, ordinal, label, value): counters, the top events that clear the bar (service area first, else overall) or word of a quiet day, changes,
    categories, sources and pipeline, warnings."""
    c = F.col
    counted = cut_lineage(one_row(report["summary"], report["pipeline"]))  # one row that every section reads

    def counters(name: str, cols: list[str], keep: Column | None = None) -> DataFrame:
        arr = F.array(*[F.struct(F.lit(x).alias("label"), c(x).cast("string").alias("value")) for x in cols])
        d = counted.select(F.posexplode(arr).alias("i", "x"))
        return _section(d if keep is None else d.where(keep), name, c("x.label"), c("x.value"), c("i") + 1)

    bar = c("demand_level").isin("VERY_HIGH", "HIGH", "MEDIUM") & (c("quality_level").isNull() | c("quality_level").isin("HIGH", "MEDIUM"))
    area, top = report["service_area_top"].withColumn("_rank", F.lit(0)), report["top_opportunities"].withColumn("_rank", F.lit(1))
    both = area.unionByName(top)
    which = both.agg(F.min("_rank").alias("_use"))
    chosen = both.join(which, both["_rank"] == which["_use"]).where(bar)
    # at most 2 x 5 rows here: the numbering collects them into one bounded array
    listed = chosen.agg(F.sort_array(F.collect_list(F.struct((-c("opportunity_score")).alias("s"), "date_start", "event_id", "title"))).alias("a")).select(
        F.posexplode(F.slice("a", 1, limit)).alias("i", "x"))
    listed = cut_lineage(listed)
    quiet = counted.where("very_high + high = 0").join(listed.agg(F.count("*").alias("_n")).where("_n = 0"), F.lit(True))  # one row each
    quiet = _section(quiet, "top", F.lit("quiet day"), F.lit("No high-priority taxi opportunities detected today."), F.lit(0))
    cats = report["by_category_7d"].where(c("category").isin("education", "sports", "music"))
    fallen = counted.select(F.posexplode(F.filter(F.split("source_regressions", "\n"), lambda x: x != "")).alias("i", "message"))
    parts = [
        quiet,
        counters("warnings", ["source_silent_events", "sources_blocked"], c("x.value") != "0"),
        _section(fallen, "regressions", F.lit("source"), c("message"), c("i") + 1),
        counters("levels", ["very_high", "high", "medium"]),
        _section(listed, "top", c("x.title"), -c("x.s"), c("i") + 1),
        counters("changes", ["new_events", "changed_events", "cancelled_events"]),
        _section(cats, "categories", c("category"), c("n"), F.when(c("category") == "education", 1).when(c("category") == "sports", 2).otherwise(3)),
        counters("system", ["sources_healthy", "sources_total", "pipeline_status"]),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def canned_listings(events: DataFrame, as_of, names: tuple[str, ...] = ("today", "tomorrow", "week", "high", "concerts", "sports", "education")) -> DataFrame:
    events = cut_lineage(events)  # scored once, not once a listing
    return reduce(lambda a, b: a.unionByName(b), [canned(events, n, as_of).withColumn("listing", F.lit(n)) for n in names])
