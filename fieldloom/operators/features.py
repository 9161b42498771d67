"""Weather features of a daily panel: per month and per growing season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar
from ..functions.formats import half_even
from .contracts import Expectations, require_columns, require_rows, require_unique, union_all

DAILY_COLUMNS = ("Date", "PRECTOTCORR", "T2M", "RH2M", "municipality", "ibge_code", "state", "latitude", "longitude")
STATION = ("ibge_code", "municipality", "state", "latitude", "longitude")
MONTH_KEYS = (*STATION, "year", "month")
MONTHLY_COLUMNS = (
    *MONTH_KEYS, "total_rainfall", "average_temperature", "average_humidity", "rainy_days", "dry_days", "max_daily_rainfall", "temperature_std",
    "weather_observation_days", "max_consecutive_dry_days", "missing_weather_days", "weather_coverage_ratio", "has_complete_weather_period",
)
SEASON_KEYS = ("ibge_code", "municipality", "state", "harvest_year")
#: Millimetres: a dry spell needs less, a dry day has at most, a rainy day more.
DRY_SPELL, DRY_DAY = 1.0, 1.0


def longest_dry_spell(df: DataFrame, keys: Sequence[str], rainfall: str = "PRECTOTCORR", date: str = "date", threshold: float = DRY_SPELL) -> DataFrame:
    """``keys`` and the longest run of calendar days with rainfall under the threshold.

    Dates less their number in order are equal within a run. Keys without a dry
    day aren't returned; join and take 0. Dates must be unique by key.
    """
    dry = df.where(F.col(rainfall) < threshold)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(date))
    runs = dry.select(*keys, F.date_sub(F.col(date), number).alias("_run")).groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_days"))
    return runs.groupBy(*keys).agg(F.max("_days").alias("max_consecutive_dry_days"))


def with_dry_run(df: DataFrame, keys: Sequence[str], rainfall: str = "PRECTOTCORR", date: str = "date", threshold: float = DRY_SPELL) -> DataFrame:
    """``df`` with ``_dry_run``: how many dry calendar days in a row a day ends, 0 on others. Dates must be unique by key.

    A run is the distance to the last break: a day that isn't dry, or the day before one that follows a gap. All
    windows share one sort by key and date, over which a group's other aggregates run too.
    """
    order = Window.partitionBy(*keys).orderBy(date)
    number, before = F.row_number().over(order), F.lag(date).over(order)
    follows = F.coalesce(F.datediff(F.col(date), before) == 1, F.lit(False))
    dry = F.coalesce(F.col(rainfall) < threshold, F.lit(False))
    marked = df.withColumns({"_number": number, "_break": F.when(~dry, number).when(~follows, number - 1)})
    return marked.withColumn("_dry_run", F.col("_number") - F.max("_break").over(order)).drop("_number", "_break")


def strict_average(value: Column) -> Column:
    """Mean of a group; null for none, an error if any value is missing."""
    return F.when(F.count_if(value.isNull() | F.isnan(value)) > 0, F.raise_error(F.lit("temperature contains missing values.")).cast("double")).otherwise(F.avg(value))


def prepare_daily(df: DataFrame) -> DataFrame:
    """Typed daily rows that meet the contract, with date, year and month."""
    require_columns(df, DAILY_COLUMNS, "Daily weather dataset")
    numbers = {c: F.col(c).try_cast("double") for c in ("PRECTOTCORR", "T2M", "RH2M", "latitude", "longitude")}
    typed = df.withColumns({**numbers, "Date": F.col("Date").try_cast("date"), "ibge_code": F.col("ibge_code").try_cast("bigint")})
    typed = Expectations(typed).present(DAILY_COLUMNS).non_negative(["PRECTOTCORR"]).check()
    require_unique(typed, ["ibge_code", "Date"])
    return with_calendar(typed)


def with_calendar(df: DataFrame) -> DataFrame:
    return df.withColumns({"date": F.col("Date").cast("date"), "year": F.year("Date"), "month": F.month("Date")})


def monthly_features(daily: DataFrame, dry_day: float = DRY_DAY, dry_spell: float = DRY_SPELL) -> DataFrame:
    """One row for each station and month; runs of dry days end with the month."""
    rain = F.col("PRECTOTCORR")
    return with_dry_run(daily, MONTH_KEYS, threshold=dry_spell).groupBy(*MONTH_KEYS).agg(
        half_even(F.sum(rain), 2).alias("total_rainfall"),
        half_even(F.avg("T2M"), 2).alias("average_temperature"),
        half_even(F.avg("RH2M"), 2).alias("average_humidity"),
        F.count_if(rain > dry_day).alias("rainy_days"),
        F.count_if(rain <= dry_day).alias("dry_days"),
        half_even(F.max(rain), 2).alias("max_daily_rainfall"),
        half_even(F.stddev_samp("T2M"), 2).alias("temperature_std"),
        F.count("date").alias("weather_observation_days"),
        F.max("_dry_run").cast("bigint").alias("max_consecutive_dry_days"),
    )


def with_coverage(monthly: DataFrame) -> DataFrame:
    """Missing days, share of observed days and completeness of each month."""
    days = calendar.days_in_month(F.col("year"), F.col("month"))
    missing = (days - F.col("weather_observation_days")).cast("bigint")
    return monthly.withColumns(
        {"missing_weather_days": missing, "weather_coverage_ratio": half_even(F.col("weather_observation_days") / days, 4), "has_complete_weather_period": missing == 0}
    ).select(*MONTHLY_COLUMNS)


def merge_monthly(parts: Sequence[DataFrame]) -> DataFrame:
    from .contracts import check_monthly

    return check_monthly(union_all(parts, "At least one monthly weather dataset is required."), MONTHLY_COLUMNS)


def annotate_growing_season(df: DataFrame, start_month: int = calendar.START_MONTH, end_month: int = calendar.END_MONTH) -> DataFrame:
    require_columns(df, ("year", "month"))
    calendar.check_season(start_month, end_month)
    Expectations(df).never(~F.col("month").between(1, 12) | F.col("month").isNull(), "Month values must be between 1 and 12.").check()
    return _annotated(df, start_month, end_month)


def _annotated(df: DataFrame, start_month: int, end_month: int) -> DataFrame:
    year, month = F.col("year"), F.col("month")
    return df.withColumns({"is_growing_season": calendar.in_growing_season(month, start_month, end_month), "harvest_year": calendar.harvest_year(year, month, start_month, end_month)})


def select_growing_season(df: DataFrame, start_month: int = calendar.START_MONTH, end_month: int = calendar.END_MONTH) -> DataFrame:
    return _annotated(require_columns(df, ("year", "month")), start_month, end_month).where("is_growing_season")


def growing_season_features(daily: DataFrame, dry_day_threshold: float = DRY_SPELL, start_month: int = calendar.START_MONTH, end_month: int = calendar.END_MONTH) -> DataFrame:
    """One row for each station and harvest year, in one lazy plan."""
    require_columns(daily, ("ibge_code", "municipality", "state", "date", "year", "month", "PRECTOTCORR", "T2M"))
    season = select_growing_season(daily, start_month, end_month).withColumn("date", F.col("date").cast("date"))
    return with_dry_run(season, SEASON_KEYS, threshold=dry_day_threshold).groupBy(*SEASON_KEYS).agg(
        half_even(F.sum("PRECTOTCORR"), 2).alias("growing_season_total_rainfall"),
        half_even(F.avg("T2M"), 2).alias("growing_season_average_temperature"),
        F.count("date").alias("growing_season_observation_days"),
        F.min("date").alias("growing_season_start_date"),
        F.max("date").alias("growing_season_end_date"),
        F.max("_dry_run").cast("bigint").alias("growing_season_max_consecutive_dry_days"),
    )


def of_harvest_years(features: DataFrame, years: Sequence[int]) -> DataFrame:
    return features.where(F.col("harvest_year").isin(list(years)))


def build_monthly(daily: DataFrame) -> DataFrame:
    """Daily rows to checked monthly rows."""
    from .contracts import check_monthly

    require_rows(daily, "Daily weather dataset is empty.")
    return check_monthly(with_coverage(monthly_features(prepare_daily(daily))), MONTHLY_COLUMNS)
