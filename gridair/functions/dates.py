"""Calendar features, request dates and dates written in text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridair import constants as C


def doy_sin(day: Column) -> Column:
    return F.sin(F.dayofyear(day) * (2 * math.pi) / C.YEAR_DAYS)


def doy_cos(day: Column) -> Column:
    return F.cos(F.dayofyear(day) * (2 * math.pi) / C.YEAR_DAYS)


def day_of_week(day: Column) -> Column:
    """Monday = 0."""
    return F.weekday(day)


def weekend(day: Column) -> Column:
    return (F.weekday(day) >= 5).cast("int")


def in_season(day: Column, months: list[int]) -> Column:
    return F.array_contains(F.array(*[F.lit(m) for m in months]), F.month(day))


def population_epoch(day: Column) -> Column:
    """Nearest earlier five-year epoch, at most 2030."""
    return F.least(F.lit(2030), (F.floor(F.year(day) / F.lit(5.0)) * 5).cast("int"))


def usable_day(requested: Column, today: Column, lag_days: int = 6) -> Column:
    """Requested day moved back to the newest day with complete inputs; missing means that day."""
    latest = F.date_sub(today, lag_days)
    return F.least(F.coalesce(requested, latest), latest)


def product_choice(day: Column, today: Column, offline_after_days: int = 12) -> Column:
    return F.when(F.datediff(today, day) > offline_after_days, "OFFL").otherwise("NRTI")


def path_date(path: Column) -> Column:
    """Last YYYY-MM-DD in a path; null when there is none."""
    hits = F.regexp_extract_all(path, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1))
    return F.try_element_at(hits, F.lit(-1)).try_cast("date")


_SLASHED = r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b"


def text_date(text: Column, today: Column) -> Column:
    """First date named in a message: ISO, day/month/year, or today / yesterday / tomorrow."""
    iso = F.regexp_extract(text, r"\b(\d{4}-\d{2}-\d{2})\b", 1).try_cast("date")
    d, m, y = (F.regexp_extract(text, _SLASHED, i) for i in (1, 2, 3))
    slashed = F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).try_cast("date")
    low = F.lower(text)
    word = (F.when(low.contains("today"), today).when(low.contains("yesterday"), F.date_sub(today, 1))
            .when(low.contains("tomorrow"), F.date_add(today, 1)))
    return F.coalesce(iso, slashed, word)


def text_hours(text: Column) -> Column:
    """Forecast length named in a message, in hours."""
    low = F.lower(text)
    hours = F.regexp_extract(low, r"(?:for\s+)?(\d+)\s*(?:hour|hr|h)\b", 1).try_cast("int")
    days = F.regexp_extract(low, r"(?:for\s+)?(\d+)\s*(?:day|d)\b", 1).try_cast("int")
    words = (F.when(low.contains("two hour"), 2).when(low.contains("three hour"), 3).when(low.contains("six hour"), 6)
             .when(low.contains("twelve hour") | low.contains("half day"), 12)
             .when(low.contains("one day") | low.contains("24 hour") | low.contains("a day"), 24))
    return F.coalesce(hours, days * 24, words)
