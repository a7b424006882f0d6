"""Date and time expressions. Wall-clock values are timestamp_ntz or HH:MM text, so no result depends on the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .text import _col


# (pattern, rewrite, date format): each form is rewritten to year-month-day text; a form that does not match yields no date
_DATE_FORMS = [
    (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", "$3-$2-$1", "yyyy-M-d"),
    (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2})$", "20$3-$2-$1", "yyyy-M-d"),
    (r"(?s)^(?:.*?\D)??(\d{4})-(\d{1,2})-(\d{1,2})(?:\D.*)?$", "$1-$2-$3", "yyyy-M-d"),
    (r"(?s)^(?:.*?\D)??(\d{1,2})/(\d{1,2})/(\d{4})(?:\D.*)?$", "$3-$2-$1", "yyyy-M-d"),
    (r"(?is)^(?:.*?\D)??(\d{1,2})(?:st|nd|rd|th)?(?:\s+of)?[\s-]+([a-z]{3})[a-z]{0,6}\.?,?[\s-]+(\d{4})(?:\D.*)?$", "$3-$2-$1", "yyyy-MMM-d"),
    (r"(?is)^(?:.*?[^a-z])??([a-z]{3})[a-z]{0,6}\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?:\D.*)?$", "$3-$1-$2", "yyyy-MMM-d"),
]


def parse_uk_date(c: Column | str, as_of: Column | None = None) -> Column:
    """Day-first date from numeric, ISO or 'd Month yyyy' text found anywhere in the value; null for an impossible date.

    With ``as_of`` a text without a year ('21 September') takes its year.
    """
    s = F.trim(_col(c))
    found = []
    for pattern, rewrite, form in _DATE_FORMS:
        text = F.regexp_replace(s, pattern, rewrite)
        found.append(F.try_to_date(F.initcap(text) if "MMM" in form else text, form))
    if as_of is not None:
        text = F.concat_ws(" ", F.regexp_replace(s, r"(?s)^.*?(?<!\d)(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3})[a-z]*(?![A-Za-z]).*$", "$1 $2"), F.year(as_of).cast("string"))
        found.append(F.try_to_date(F.initcap(text), "d MMM yyyy"))
    return F.coalesce(*found)


_CLOCK = r"^(\d{1,2})[.:](\d{2})\s*(am|pm)?$"
_CLOCK_INSIDE = r"(?:^|[^\d])(\d{1,2}):(\d{2})(?::\d{2})?(?:\.\d+)?\s*(am|pm)?"
_HOUR_INSIDE = r"(?:^|[^\d])(\d{1,2})\s*(am|pm)\b"


def _hhmm(h: Column, m: Column, half: Column) -> Column:
    h = h.try_cast("int")
    m = m.try_cast("int")
    h = F.when((half == "pm") & (h < 12), h + 12).when((half == "am") & (h == 12), F.lit(0)).otherwise(h)
    ok = (h < 24) & (m < 60)
    return F.when(ok, F.concat_ws(":", F.lpad(h.cast("string"), 2, "0"), F.lpad(m.cast("string"), 2, "0")))


def parse_time(c: Column | str) -> Column:
    """HH:MM from 24-hour or am/pm text; null when unknown."""
    s = F.lower(F.trim(_col(c)))

    def g(p: str, i: int) -> Column:
        return F.regexp_extract(s, p, i)

    return (
        F.when(s.isin(V.UNKNOWN_TIME_WORDS), F.lit(None).cast("string"))
        .when(s.rlike(_CLOCK), _hhmm(g(_CLOCK, 1), g(_CLOCK, 2), g(_CLOCK, 3)))
        .when(s.rlike(_CLOCK_INSIDE), _hhmm(g(_CLOCK_INSIDE, 1), g(_CLOCK_INSIDE, 2), g(_CLOCK_INSIDE, 3)))
        .when(s.rlike(_HOUR_INSIDE), _hhmm(g(_HOUR_INSIDE, 1), F.lit("0"), g(_HOUR_INSIDE, 2)))
    )


def utc_to_local(ts_ntz: Column) -> Column:
    """UTC wall clock to Europe/London wall clock, both timestamp_ntz."""
    return F.convert_timezone(F.lit("UTC"), F.lit(V.LOCAL_ZONE), ts_ntz.cast("timestamp_ntz"))


def hhmm(ts_ntz: Column) -> Column:
    return F.date_format(ts_ntz, "HH:mm")


def split_local(ts_ntz: Column) -> tuple[Column, Column]:
    local = utc_to_local(ts_ntz)
    return F.to_date(local), hhmm(local)


def local_datetime(d: Column, t: Column) -> Column:
    """Wall-clock timestamp from a date and HH:MM text."""
    return (d.cast("timestamp_ntz") + minutes_interval(minute_of_day(t)))


def minutes_interval(minutes: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0).cast("decimal(18,6)"))


def minute_of_day(t: Column) -> Column:
    h = F.regexp_extract(t, r"^(\d{1,2}):(\d{2})", 1).try_cast("int")
    m = F.regexp_extract(t, r"^(\d{1,2}):(\d{2})", 2).try_cast("int")
    return h * 60 + m


def hour_of(t: Column) -> Column:
    return F.left(t, F.lit(2)).try_cast("int")


_STAMP = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(?::(\d{2}))?(?:[.,]\d+)?\s*(Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)?$"


def _offset_minutes(tz: Column) -> Column:
    sign = F.when(tz.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    digits = F.regexp_replace(tz, "[^0-9]", "")
    return F.when(tz.isin("Z", ""), F.lit(0)).otherwise(
        sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")))


def parse_schema_datetime(c: Column | str) -> tuple[Column, Column]:
    """(date, HH:MM or null) in local wall clock from a schema.org date or datetime."""
    v = F.nullif(F.trim(_col(c)), F.lit(""))
    day, clock, tz = (F.regexp_extract(v, _STAMP, i) for i in (1, 2, 4))
    is_stamp = v.rlike(_STAMP)
    naive = F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    shifted = utc_to_local(naive - minutes_interval(_offset_minutes(tz)))
    local = F.when(tz == "", naive).otherwise(shifted)
    date = F.when(is_stamp, F.to_date(local)).otherwise(parse_uk_date(F.substring(v, 1, 10)))
    time = (F.when(F.length(v) <= 10, F.lit(None).cast("string"))
            .when(is_stamp, hhmm(local)).otherwise(parse_time(F.substring(v, 12, 5))))
    return date, time


def parse_booking_timestamp(c: Column | str) -> Column:
    """Dispatch-export timestamp: ISO or day-first, time optional; empty and NULL text are missing."""
    s = F.when(~F.trim(_col(c)).isin("", "NULL"), F.trim(_col(c)))
    day = parse_uk_date(F.regexp_extract(s, r"^(\S+?(?:\s+[A-Za-z]{3,9}\s+\d{4})?)(?:[T\s]|$)", 1))
    sec = F.regexp_extract(s, r"\d{1,2}:\d{2}:(\d{2})", 1)
    clock = F.when(s.rlike(r"\d{1,2}[:.]\d{2}(?::\d{2})?\s*(?i:am|pm)?(?:\.\d+)?Z?$"),
                   parse_time(F.regexp_extract(s, r"(?i)(\d{1,2}[:.]\d{2}(?::\d{2})?(?:\.\d+)?\s*(?:am|pm)?)Z?$", 1)))
    minutes = F.coalesce(minute_of_day(clock), F.lit(0))
    seconds = F.when(sec != "", sec.try_cast("int")).otherwise(F.lit(0))
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes, seconds.cast("decimal(18,6)"))


def different_session(a: Column, b: Column, gap_minutes: Column | int = V.SESSION_GAP_MINUTES) -> Column:
    """Both start times known, different, and at least the gap apart."""
    gap = F.lit(gap_minutes) if isinstance(gap_minutes, int) else gap_minutes
    return F.coalesce((a != b) & (F.abs(minute_of_day(a) - minute_of_day(b)) >= gap), F.lit(False))


def within_days(d: Column, as_of: Column, days: int) -> Column:
    return (d >= as_of) & (d <= F.date_add(as_of, days))


def overlaps_day(start: Column, end: Column, day: Column) -> Column:
    return (start <= day) & (F.coalesce(end, start) >= day)


def weekend(d: Column) -> Column:
    return F.weekday(d) >= 5


def elapsed_seconds(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1e6


def freshness_score(verified_at: Column, now: Column) -> Column:
    """100 at verification, linear to the floor after the decay period."""
    age = F.greatest(F.lit(0.0), elapsed_seconds(now, verified_at) / 86400.0)
    span = float(100 - V.FRESHNESS_FLOOR)
    decayed = F.bround(F.lit(100.0) - F.lit(span) * (age / F.lit(float(V.DECAY_DAYS))), 0).cast("int")
    return F.when(verified_at.isNull() | (age >= V.DECAY_DAYS), F.lit(V.FRESHNESS_FLOOR)).otherwise(decayed)


def source_silent(verified_at: Column, date_start: Column, now: Column) -> Column:
    old = elapsed_seconds(now, verified_at) > V.SILENT_AFTER_DAYS * 86400
    return F.coalesce((date_start >= F.to_date(now)) & old, F.lit(False))
