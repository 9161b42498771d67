"""Agronomic features of a daily panel: rolling windows, crop stages, heat and extremes, harvest-weighted means.

Sums run over decimals and means are one division of exact sums at the end, so results don't
hang on the order of rows or on how a mean is put together from parts. Thresholds,
base temperatures and crop calendars are parameters: none is a scientific constant.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .contracts import require_columns
from .features import DRY_DAY, DRY_SPELL, longest_dry_spell

EXACT = "decimal(18,4)"
RAIN, HEAT, WET = "PRECTOTCORR", "T2M", "RH2M"


def exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(EXACT)


def quotient(total: Column, count: Column) -> Column:
    """An exact sum over a count; null for none."""
    return F.when(count > 0, total.cast("double") / count)


@dataclass(frozen=True)
class Rolling:
    """A feature of the days before: ``kind`` is ``sum``, ``mean`` or ``dry_days``."""

    name: str
    days: int
    kind: str
    column: str = RAIN


ROLLING = (
    Rolling("rainfall_previous_30d", 30, "sum"),
    Rolling("temperature_previous_90d", 90, "mean", HEAT),
    Rolling("dry_days_previous_120d", 120, "dry_days"),
    Rolling("temperature_maturation_150d", 150, "mean", HEAT),
)


def rolling(daily: DataFrame, features: Sequence[Rolling] = ROLLING, key: str = "ibge_code", today: bool = True, dry_day: float = DRY_DAY) -> DataFrame:
    """``key``, ``date``, each feature over the calendar days up to each day, and ``observed_<days>d``, the days there are.

    Frames go by day numbers, so a missing day shortens a window and never stretches it.
    With ``today=False`` a window ends the day before. All frames share one sort of a station's days.
    """
    require_columns(daily, [key, "date", *(f.column for f in features)], "Daily weather dataset")
    last = 0 if today else -1
    order = Window.partitionBy(key).orderBy(F.unix_date("date"))
    made: dict[str, Column] = {}
    for f in features:
        frame = order.rangeBetween(last - f.days + 1, last)
        if f.kind == "dry_days":
            made[f.name] = F.count_if(F.col(f.column) <= dry_day).over(frame)
        elif f.kind in ("sum", "mean"):
            total = F.sum(exact(f.column)).over(frame)
            made[f.name] = total.cast("double") if f.kind == "sum" else quotient(total, F.count(f.column).over(frame))
        else:
            raise ValueError(f"A rolling feature is a sum, a mean or dry_days: {f.kind}")
        made[f"observed_{f.days}d"] = F.count(F.lit(1)).over(frame)
    return daily.select(key, "date", *(c.alias(n) for n, c in made.items()))


def stage_instances(calendar: DataFrame, years: DataFrame) -> DataFrame:
    """A crop calendar ``(state, stage, start_month, start_day, end_month, end_day)`` as dated windows ``(state, stage, stage_year, first, last)``.

    A window that ends before it starts in the calendar crosses the turn of the year and ends in the
    next. ``years``: ``(state, first_year, last_year)`` of the days; the window that began the year before is there too.
    """
    spans = calendar.join(years, "state").withColumn("stage_year", F.explode(F.sequence(F.col("first_year") - 1, F.col("last_year"))))
    crosses = (F.col("end_month") < F.col("start_month")) | ((F.col("end_month") == F.col("start_month")) & (F.col("end_day") < F.col("start_day")))
    # A day that a month lacks is its last.
    day = lambda y, m, d: F.least(F.date_add(F.make_date(y, m, F.lit(1)), d - 1), F.last_day(F.make_date(y, m, F.lit(1))))
    first = day(F.col("stage_year"), F.col("start_month"), F.col("start_day"))
    last = day(F.col("stage_year") + crosses.cast("int"), F.col("end_month"), F.col("end_day"))
    return spans.select("state", "stage", "stage_year", first.alias("first"), last.alias("last"))


def in_stages(daily: DataFrame, calendar: DataFrame) -> DataFrame:
    """``daily`` with ``stage`` and ``stage_year`` of every window that a day lies in.

    Windows are dealt to the months that they touch, and days meet those of their state and month: an equi-join, then a comparison of dates.
    """
    years = daily.groupBy("state").agg(F.min(F.year("date")).alias("first_year"), F.max(F.year("date")).alias("last_year"))
    windows = stage_instances(calendar, years)
    months = F.explode(F.sequence(F.trunc("first", "MM"), F.col("last"), F.expr("interval 1 month")))
    dealt = windows.withColumn("_month", months).withColumnRenamed("state", "_state")
    days = daily.withColumn("_bucket", F.trunc("date", "MM"))
    met = days.join(dealt, (F.col("state") == F.col("_state")) & (F.col("_bucket") == F.col("_month")) & F.col("date").between(F.col("first"), F.col("last")))
    return met.drop("_month", "_state", "_bucket", "first", "last")


STAGE_KEYS = ("ibge_code", "state", "stage", "stage_year")


def stage_features(daily: DataFrame, calendar: DataFrame, dry_day: float = DRY_DAY, dry_spell: float = DRY_SPELL) -> DataFrame:
    """Rainfall, mean temperature, dry days, days and longest dry spell of every station and crop-stage window; a spell ends with its window."""
    days = in_stages(daily, calendar)
    sums = days.groupBy(*STAGE_KEYS).agg(
        F.sum(exact(RAIN)).cast("double").alias("rainfall"),
        quotient(F.sum(exact(HEAT)), F.count(HEAT)).alias("temperature"),
        F.count_if(F.col(RAIN) <= dry_day).alias("dry_days"),
        F.count("date").alias("days"),
    )
    spells = longest_dry_spell(days, STAGE_KEYS, threshold=dry_spell).withColumnRenamed("max_consecutive_dry_days", "dry_spell")
    return sums.join(spells, list(STAGE_KEYS), "left").withColumn("dry_spell", F.coalesce("dry_spell", F.lit(0)).cast("bigint"))


def extremes(daily: DataFrame, keys: Sequence[str], base: float = 10.0, hot: float = 35.0, cool: float = 15.0, heavy: float = 20.0, humid: float = 80.0, arid: float = 40.0, dry_day: float = DRY_DAY) -> DataFrame:
    """Heat, rain and humidity of each group: degree-days over ``base``, days beyond thresholds, ranges, spread, and missing days of each variable."""
    rain, heat, wet = (F.col(c) for c in (RAIN, HEAT, WET))
    rainy = F.count_if(rain > dry_day)
    return daily.groupBy(*keys).agg(
        F.sum(F.greatest(exact(heat) - F.lit(base).cast(EXACT), F.lit(0).cast(EXACT))).cast("double").alias("growing_degree_days"),
        F.count_if(heat > hot).alias("hot_days"),
        F.count_if(heat < cool).alias("cool_days"),
        F.max(heat).alias("max_temperature"),
        F.min(heat).alias("min_temperature"),
        F.count_if(rain > heavy).alias("heavy_rain_days"),
        quotient(F.sum(exact(rain)), rainy).alias("rainfall_intensity"),
        F.stddev_samp(rain).alias("rainfall_variability"),
        F.stddev_samp(wet).alias("humidity_std"),
        F.count_if(wet > humid).alias("high_humidity_days"),
        F.count_if(wet < arid).alias("low_humidity_days"),
        *(F.count_if(c.isNull() | F.isnan(c)).alias(f"{n}_missing_days") for n, c in (("rainfall", rain), ("temperature", heat), ("humidity", wet))),
    )


def weighted_sums(df: DataFrame, keys: Sequence[str], weight: str, values: Sequence[str]) -> DataFrame:
    """For each group ``<value>_wx`` (sum of weight times value) and ``<value>_w`` (of the weights where there is a value): parts of weighted means."""
    # Means have repeating digits: twelve of them are kept, in products that fit 38.
    w = F.col(weight).cast("decimal(14,0)")
    parts = [(F.sum(F.when(F.col(v).isNotNull(), w * F.col(v).cast("decimal(22,12)"))).alias(f"{v}_wx"), F.sum(F.when(F.col(v).isNotNull(), w)).alias(f"{v}_w")) for v in values]
    return df.groupBy(*keys).agg(*(c for pair in parts for c in pair))


def summed_up(sums: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The parts of coarser groups: sums of sums, never means of means."""
    return sums.groupBy(*keys).agg(*(F.sum(f"{v}_{part}").alias(f"{v}_{part}") for v in values for part in ("wx", "w")))


def weighted_means(sums: DataFrame, values: Sequence[str], prefix: str = "harvest_weighted_") -> DataFrame:
    """The means of such parts; null without weight."""
    keys = [c for c in sums.columns if c not in {f"{v}_{part}" for v in values for part in ("wx", "w")}]
    return sums.select(*keys, *(F.when(F.col(f"{v}_w") > 0, F.col(f"{v}_wx").cast("double") / F.col(f"{v}_w").cast("double")).alias(f"{prefix}{v}") for v in values))


def harvest_periods(daily: DataFrame, history: DataFrame, states: dict[str, str], maturation: int = 150) -> DataFrame:
    """Each harvest period of the history with its state's weather: rainfall and dry days of the period (by station), its mean temperature, and that of the ``maturation`` days before its end.

    A period begins after the one before of its season and region, the first one with its season's month.
    """
    place = F.create_map(*(F.lit(x) for pair in states.items() for x in pair))
    before = F.lag("period_end_date").over(Window.partitionBy("season", "region").orderBy("period_end_date"))
    periods = history.withColumns({"state": F.try_element_at(place, "region"), "first": F.coalesce(F.date_add(before, 1), F.trunc("period_end_date", "MM"))}).where("state is not null")
    # Days of a state are few: sums by day, then by day number up to each period's ends.
    days = daily.groupBy("state", "date").agg(F.sum(exact(RAIN)).alias("rain"), F.count_if(F.col(RAIN) <= DRY_DAY).alias("dry"), F.sum(exact(HEAT)).alias("heat"), F.count(HEAT).alias("n"), F.count_distinct("ibge_code").alias("stations"))
    earliest = F.least("first", F.date_sub("period_end_date", maturation - 1))
    dealt = periods.withColumn("_month", F.explode(F.sequence(F.trunc(earliest, "MM"), F.col("period_end_date"), F.expr("interval 1 month"))))
    met = dealt.join(days.withColumn("_month", F.trunc("date", "MM")), ["state", "_month"]).where(F.col("date").between(earliest, F.col("period_end_date")))
    within, ripening = F.col("date") >= F.col("first"), F.col("date") > F.date_sub("period_end_date", maturation)
    some = lambda c, when: F.sum(F.when(when, F.col(c)))
    return met.groupBy("season", "period_end_date", "region", "state", "crush_tonnes").agg(
        quotient(some("rain", within), some("stations", within)).alias("rainfall"),
        quotient(some("heat", within), some("n", within)).alias("temperature"),
        quotient(some("dry", within), some("stations", within)).alias("dry_days"),
        quotient(some("heat", ripening), some("n", ripening)).alias("maturation_temperature"),
    )
