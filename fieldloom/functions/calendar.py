"""Season and date columns. Seasons cross the turn of the year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START_MONTH, END_MONTH = 9, 4
#: Months of the growing season in order.
SEASON_MONTHS = (9, 10, 11, 12, 1, 2, 3, 4)
#: First month of a harvest; report dates before it belong to the season's second year.
HARVEST_MONTH = 4


def check_season(start_month: int, end_month: int) -> None:
    if not 1 <= start_month <= 12:
        raise ValueError("start_month must be between 1 and 12.")
    if not 1 <= end_month <= 12:
        raise ValueError("end_month must be between 1 and 12.")
    if start_month <= end_month:
        raise ValueError("Growing season must cross the calendar-year boundary (start_month > end_month).")


def harvest_year(year: Column, month: Column, start_month: int = START_MONTH, end_month: int = END_MONTH) -> Column:
    """Year in which the growing season of a month ends; null outside of it."""
    check_season(start_month, end_month)
    return F.when(month >= start_month, year + 1).when(month <= end_month, year).cast("int")


def in_growing_season(month: Column, start_month: int = START_MONTH, end_month: int = END_MONTH) -> Column:
    check_season(start_month, end_month)
    return (month >= start_month) | (month <= end_month)


def two_digits(year: Column) -> Column:
    return F.lpad(F.pmod(year, F.lit(100)).cast("string"), 2, "0")


def season_label(start_year: Column) -> Column:
    """``YY-YY`` of the harvest that starts in a year."""
    return F.concat_ws("-", two_digits(start_year), two_digits(start_year + 1))


def assigned_season(year: Column, month: Column) -> Column:
    """Label of the harvest that follows a growing-season month; other months raise when evaluated."""
    outside = F.raise_error(F.concat(F.lit("Month "), month.cast("string"), F.lit(" is outside the September-April growing season."))).cast("int")
    return season_label(F.when(month >= 9, year + 1).when(month <= 4, year).otherwise(outside))


def season_start_year(label: Column) -> Column:
    """2026 of ``26-27``."""
    return (F.split(label, "-")[0].cast("int") + 2000).cast("int")


def days_in_month(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def period_end_date(label: Column, period: Column, season_end_inclusive: bool = False) -> Column:
    """Date of ``DD/MM`` in a season. A day 01/04 opens the season unless ``season_end_inclusive``."""
    day, month = F.split(period, "/")[0].cast("int"), F.split(period, "/")[1].cast("int")
    closes = (month == HARVEST_MONTH) & (day == 1) if season_end_inclusive else F.lit(False)
    return F.make_date(season_start_year(label) + F.when((month >= HARVEST_MONTH) & ~closes, 0).otherwise(1), month, day)


def matched_cutoff(start_year: Column, reference: Column, rollover: bool = False) -> Column:
    """The reference report's month and day in another season.

    By default always in the start year, also for a report of January to
    March; ``rollover`` puts those into the year after.
    """
    month = F.month(reference)
    later = F.when(month < HARVEST_MONTH, 1).otherwise(0) if rollover else F.lit(0)
    return F.make_date(start_year + later, month, F.dayofmonth(reference))


def growing_season_start(harvest_start_year: Column) -> Column:
    return F.make_date(harvest_start_year - 1, F.lit(9), F.lit(1))


def growing_season_end(harvest_start_year: Column) -> Column:
    return F.make_date(harvest_start_year, F.lit(4), F.lit(30))


def day_text(date: Column) -> Column:
    """``2026-06-01``."""
    return F.date_format(date, "yyyy-MM-dd")


def month_day_text(date: Column) -> Column:
    """``June 01``."""
    return F.date_format(date, "MMMM dd")
