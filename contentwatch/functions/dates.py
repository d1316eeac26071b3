"""Dates: raw strings to dates, windows of plans, next runs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Shapes of dates in text, in the order in which they are looked for, and relative phrases in seconds.
DATE_SHAPES = [
    r"\b\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}\b",
    r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}\b",
    r"\b\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]{3,9}\s+\d{4}\b",
    r"\b[A-Za-z]{3,9}\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}\b",
    r"\b\d{1,2}[\-\s][A-Za-z]{3,9}[\-\s]\d{4}\b",
    r"\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,\s+[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}\b",
    r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+\-]\d{2}:?\d{2})?\b",
    r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}\s+\d{1,2}:\d{2}\s*(?:AM|PM|am|pm)?\b",
    r"\b\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}\s+\d{1,2}:\d{2}\s*(?:IST|UTC|GMT|EST|PST)?\b",
]
NAMED = {"just now": 0, "today": 0, "yesterday": 86_400}
AGO = {"minute": 60, "hour": 3_600, "day": 86_400, "week": 7 * 86_400, "month": 30 * 86_400, "year": 365 * 86_400}
PERIODS = {"day": 1, "week": 7, "month": 30}
RANGES = {"last7": 7, "last15": 15, "last30": 30, "last90": 90}
WEEK_DAYS = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]
WORKING_DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri"]
ISO = r"^\s*(\d{4}-\d{2}-\d{2})([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?\s*$"


def at(now: datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now)


def find_date_text(text: Column) -> Column:
    """The first hit of the first shape that has one; null for none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, shape, 0), F.lit("")) for shape in DATE_SHAPES])


def _readings(raws: Iterable[str | None]) -> dict:
    """Free-form dates as dateutil reads them, missing parts from 1900-01-01; each distinct string once."""
    from dateutil import parser

    found = {}
    for raw in set(raws):
        try:
            found[raw] = parser.parse(raw, fuzzy=True, default=datetime(1900, 1, 1)).date()
        except (ValueError, OverflowError, TypeError, AttributeError):
            found[raw] = None
    return found


@F.pandas_udf(T.DateType())
def fuzzy_date(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The readings of free-form dates."""
    for s in batches:
        known = _readings(s.dropna())
        yield pd.Series([known.get(x) for x in s], dtype=object)


@F.pandas_udf(T.ArrayType(T.DateType()))
def fuzzy_dates(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``fuzzy_date`` of every string of an array."""
    for s in batches:
        known = _readings(x for listed in s if listed is not None for x in listed)
        yield pd.Series([None if listed is None else [known[x] for x in listed] for listed in s], dtype=object)


def relative_date(raw: Column, now: datetime | Column) -> Column:
    """The day of a phrase like "3 weeks ago", looked for in a fixed order; null without one."""
    found = [F.when(raw.rlike(rf"(?i)\b{name}\b"), F.lit(seconds)) for name, seconds in NAMED.items()]
    for unit, seconds in AGO.items():
        number = F.nullif(F.regexp_extract(raw, rf"(?i)(\d{{1,9}})\s+{unit}s?\s+ago", 1), F.lit("")).cast("long")
        found.append(number * seconds)
    return F.timestamp_seconds(F.unix_timestamp(at(now)) - F.coalesce(*found)).cast("date")


def _iso(raw: Column) -> Column:
    return F.try_to_timestamp(F.nullif(F.regexp_extract(raw, ISO, 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")


def _free(raw: Column) -> Column:
    """What of a string has to be read as a free-form date; null for none."""
    return F.when(_iso(F.trim(raw)).isNull() & (F.trim(raw) != ""), F.trim(raw))


def _normalized(raw: Column, read: Column, now: datetime | Column) -> Column:
    """The date of a string, given what ``_free`` of it reads as."""
    date = F.coalesce(_iso(F.trim(raw)), read)
    return F.coalesce(relative_date(F.trim(raw), now), F.when(F.year(date).between(F.lit(1995), F.year(at(now)) + 1), date))


def normalize_date(raw: Column, now: datetime | Column) -> Column:
    """The date that a string states: relative phrases first, then absolute dates from 1995 to the year after ``now``."""
    return _normalized(raw, fuzzy_date(_free(raw)), now)


def first_date(candidates: Column, now: datetime | Column) -> Column:
    """The first of an array of strings that ``normalize_date`` gives a date for."""
    every = F.zip_with(candidates, fuzzy_dates(F.transform(candidates, _free)), lambda raw, read: _normalized(raw, read, now))
    return F.get(F.filter(every, lambda d: d.isNotNull()), F.lit(0))


def parse_lastmod(raw: Column) -> Column:
    """A sitemap's ISO-8601 time; an offset is dropped and the wall clock kept."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(raw), r"(Z|[+-]\d{2}:?\d{2})$", ""), "T", " ")
    plain = F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}"), plain)
    shapes = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(s)) for s in shapes])


def prefilter_lastmod(lastmod: Column, cutoff: Column) -> Column:
    """Whether a candidate may be fetched: unknown dates may."""
    return lastmod.isNull() | (lastmod >= cutoff)


def plan_window(now: datetime | Column, period: Column, days: Column, date_range: Column | None = None, date_from: Column | None = None, date_to: Column | None = None) -> Column:
    """struct(cutoff, stop) of a plan; no period is a week, an unknown one goes by the date range, and without that 30 days."""
    nothing = F.lit(None).cast("string")
    date_range, date_from, date_to = (nothing if c is None else c for c in (date_range, date_from, date_to))
    back = lambda n: at(now) - F.make_interval(days=n if isinstance(n, Column) else F.lit(n))
    period = F.coalesce(period, F.lit("week"))
    cutoff = F.when(period == "custom", back(F.coalesce(days.try_cast("int"), F.lit(7))))
    for name, n in PERIODS.items():
        cutoff = cutoff.when(period == name, back(n))
    own = F.try_to_timestamp(date_from, F.lit("yyyy-MM-dd"))
    cutoff = cutoff.when((date_range == "custom") & own.isNotNull(), own)
    for name, n in RANGES.items():
        cutoff = cutoff.when(date_range == name, back(n))
    stop = F.when(date_range == "custom", F.try_to_timestamp(date_to, F.lit("yyyy-MM-dd")))
    return F.struct(cutoff.otherwise(back(30)).alias("cutoff"), stop.alias("stop"))


def in_date_window(date: Column, cutoff: Column, stop: Column, now: datetime | Column, keep_undated: bool = False) -> Column:
    """Whether a day lies in the closed window from cutoff to stop, or to today."""
    day = date.cast("date")
    return F.coalesce(day.between(cutoff.cast("date"), F.coalesce(stop.cast("date"), at(now).cast("date"))), F.lit(keep_undated))


def recent_instant(ts: Column, now: datetime | Column, days: int, start: Column | None = None, stop: Column | None = None) -> Column:
    """Whether an instant is at most ``days`` times 24 hours old, or within start and stop; over a day ahead or unknown is false."""
    inside = ts >= at(now) - F.expr(f"INTERVAL {24 * days} HOURS") if start is None else ts.between(start, F.coalesce(stop, ts))
    return F.coalesce(inside & (ts <= at(now) + F.expr("INTERVAL 24 HOURS")), F.lit(False))


def next_run(now: datetime | Column, freq: Column, time: Column, week_days: Column, month_day: Column, minutes: Column) -> Column:
    """The next time after ``now`` that a plan runs: daily, weekly, monthly or by an interval of minutes."""
    now = at(now)
    clock = F.coalesce(time, F.lit("06:30"))
    on = lambda day: (day.cast("timestamp").cast("long") + 3600 * F.split(clock, ":")[0].cast("int") + 60 * F.split(clock, ":")[1].cast("int")).cast("timestamp")
    today = now.cast("date")
    days = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.date_add(today, i))
    wanted = F.when(F.size(F.coalesce(week_days, F.array().cast("array<string>"))) > 0, week_days).otherwise(F.array(*map(F.lit, WORKING_DAYS)))
    name = lambda d: F.element_at(F.array(*map(F.lit, WEEK_DAYS)), F.dayofweek(d))
    weekly = F.try_element_at(F.filter(days, lambda d: F.array_contains(wanted, name(d)) & (on(d) > now)), F.lit(1))
    first = F.date_add(F.trunc(today, "MM"), F.coalesce(month_day, F.lit(1)) - 1)
    after = F.date_add(F.add_months(F.trunc(today, "MM"), 1), F.coalesce(month_day, F.lit(1)) - 1)
    daily = F.when(on(today) > now, on(today)).otherwise(on(F.date_add(today, 1)))
    monthly = F.when(on(first) > now, on(first)).otherwise(on(after))
    every = F.timestamp_seconds(F.unix_timestamp(now) + 60 * F.greatest(F.coalesce(minutes, F.lit(1)), F.lit(1)))
    return F.when(freq == "daily", daily).when(freq == "weekly", on(weekly)).when(freq == "monthly", monthly).otherwise(every)


def format_duration(seconds: Column) -> Column:
    """``1h 12m 45s`` without parts of zero; ``0s`` for none."""
    s = F.coalesce(seconds.cast("long"), F.lit(0))
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    text = F.concat_ws(" ", part(F.floor(s / 3600), "h"), part(F.floor(s % 3600 / 60), "m"), part(s % 60, "s"))
    return F.when(text == "", "0s").otherwise(text)
