"""Dates and times: mixed-format parsing, ISO weeks, spines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ts(s: Column) -> Column:
    """Compact stamps (20240115T120000Z), compact dates, ISO dates and date-times -> timestamp; anything else NULL."""
    t = F.trim(s)
    compact = F.when(t.rlike("^[0-9]{8}T[0-9]{6}Z$"), F.try_to_timestamp(t, F.lit("yyyyMMdd'T'HHmmss'Z'")))
    day = F.when(t.rlike("^[0-9]{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd")))
    iso = F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(t))
    return F.coalesce(compact, day, iso)


def week_start(ts: Column) -> Column:
    """Monday of the ISO week."""
    return F.to_date(F.date_trunc("week", ts))


def week_end(ts: Column) -> Column:
    """Sunday of the ISO week: the label of a weekly bucket and the as-of cutoff."""
    return F.date_add(week_start(ts), 6)


def week_spine(first: Column, last: Column) -> Column:
    """Array of the Mondays from that of first's week up to last, inclusive."""
    monday, end = week_start(first), F.to_date(last)
    return F.when(monday <= end, F.sequence(monday, end, F.expr("interval 7 days"))).otherwise(F.array().cast("array<date>"))


def month_windows(first: Column, last: Column) -> Column:
    """Half-open calendar months [from, to) that cover first's month to last's month."""
    start = F.trunc(first, "month")
    return F.transform(F.sequence(start, F.trunc(last, "month"), F.expr("interval 1 month")), lambda m: F.struct(m.alias("from"), F.add_months(m, 1).alias("to")))


def period_to_date(p: Column) -> Column:
    """'2024M12' -> 2024-12-01; anything else NULL."""
    ok = p.rlike("^[0-9]{4}M(0[1-9]|1[0-2])$")
    return F.when(ok, F.make_date(F.substring(p, 1, 4).cast("int"), F.substring(p, 6, 2).try_cast("int"), F.lit(1)))


def is_weekday(ts: Column) -> Column:
    """Monday to Friday; NULL for NULL."""
    return ~F.dayofweek(ts).isin(1, 7)


def utc_now() -> Column:
    """This moment as an ISO stamp in UTC, for rows that say when they were written; the same all over one query."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
