"""State and season rollups, the matched reporting cutoff, and the join of weather and harvest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar, text
from .contracts import checked_join, require_columns, require_rows, require_unique, unique_when_read

# Fixed values.
REGION_STATE = {"sao_paulo": "SP"}
WEATHER_SOURCE, HARVEST_SOURCE = "NASA POWER", "UNICA"

WEATHER_HARVEST_COLUMNS = (
    "state", "harvest_season", "growing_season_start", "growing_season_end", "latest_report_date", "matched_cutoff_date", "municipality_count", "growing_season_month_count",
    "has_complete_growing_season", "total_growing_season_rainfall", "average_growing_season_temperature", "average_growing_season_humidity", "total_growing_season_rainy_days",
    "total_growing_season_dry_days", "maximum_daily_rainfall", "average_temperature_std", "average_max_consecutive_dry_days", "maximum_consecutive_dry_days",
    "harvest_period_count", "cumulative_crush_tonnes", "weather_source", "harvest_source",
)


def state_months(monthly: DataFrame) -> DataFrame:
    """One row for each state and month; stations weigh alike."""
    means = {"total_rainfall": "average_municipality_rainfall", "average_temperature": "average_temperature", "average_humidity": "average_humidity", "rainy_days": "average_rainy_days", "dry_days": "average_dry_days"}
    require_columns(monthly, ("ibge_code", "state", "year", "month", *means, "max_daily_rainfall", "temperature_std", "max_consecutive_dry_days"), "Weather dataframe")
    return monthly.groupBy("state", "year", "month").agg(
        F.countDistinct("ibge_code").alias("municipality_count"),
        *(F.avg(c).alias(name) for c, name in means.items()),
        F.max("max_daily_rainfall").alias("state_max_daily_rainfall"),
        F.avg("temperature_std").alias("average_temperature_std"),
        F.avg("max_consecutive_dry_days").alias("average_max_consecutive_dry_days"),
        F.max("max_consecutive_dry_days").alias("state_max_consecutive_dry_days"),
    )


def season_months(states: DataFrame) -> DataFrame:
    """Growing-season months with the label of the harvest that follows."""
    chosen = states.where(F.col("month").isin(list(calendar.SEASON_MONTHS)))
    return chosen.withColumn("harvest_season", calendar.assigned_season(F.col("year"), F.col("month")))


def season_weather(months: DataFrame) -> DataFrame:
    """One row for each state and harvest season: sums of monthly means, not means of days."""
    out = months.groupBy("state", "harvest_season").agg(
        F.max("municipality_count").alias("municipality_count"),
        F.count("month").alias("growing_season_month_count"),
        F.sum("average_municipality_rainfall").alias("total_growing_season_rainfall"),
        F.avg("average_temperature").alias("average_growing_season_temperature"),
        F.avg("average_humidity").alias("average_growing_season_humidity"),
        F.sum("average_rainy_days").alias("total_growing_season_rainy_days"),
        F.sum("average_dry_days").alias("total_growing_season_dry_days"),
        F.max("state_max_daily_rainfall").alias("maximum_daily_rainfall"),
        F.avg("average_temperature_std").alias("average_temperature_std"),
        F.avg("average_max_consecutive_dry_days").alias("average_max_consecutive_dry_days"),
        F.max("state_max_consecutive_dry_days").alias("maximum_consecutive_dry_days"),
    )
    return out.withColumn("has_complete_growing_season", F.col("growing_season_month_count") == len(calendar.SEASON_MONTHS))


def weather_summary(monthly: DataFrame) -> DataFrame:
    return season_weather(season_months(state_months(monthly)))


def harvest_summary(history: DataFrame, regions: dict[str, str] | None = None, rollover: bool = False) -> DataFrame:
    """Harvest to date of every season, up to the month and day of the newest season's last report."""
    require_columns(history, ("season", "period_end_date", "region", "crush_tonnes"), "Harvest dataframe")
    data = history.withColumn("state", text.mapped(F.col("region"), regions or REGION_STATE, keep=False)).where(F.col("state").isNotNull())
    data = data.select(
        "state",
        text.harvest_season(F.col("season")).alias("harvest_season"),
        F.col("period_end_date").cast("date").alias("period_end_date"),
        F.col("crush_tonnes").cast("bigint").alias("crush_tonnes"),
    ).withColumn("start_year", calendar.season_start_year(F.col("harvest_season")))
    # One row: the last report of the newest season.
    reference = data.agg(F.max(F.struct("start_year", "period_end_date")).alias("newest")).select(F.col("newest.period_end_date").alias("reference"))
    data = data.join(F.broadcast(reference)).withColumn("matched_cutoff_date", calendar.matched_cutoff(F.col("start_year"), F.col("reference"), rollover))
    return (
        data.where(F.col("period_end_date") <= F.col("matched_cutoff_date"))
        .groupBy("state", "harvest_season")
        .agg(F.max("period_end_date").alias("latest_report_date"), F.max("matched_cutoff_date").alias("matched_cutoff_date"), F.sum("crush_tonnes").alias("cumulative_crush_tonnes"), F.count("period_end_date").alias("harvest_period_count"))
    )


def weather_harvest(weather: DataFrame, harvest: DataFrame, checked: bool = True) -> DataFrame:
    """Weather of the growing season beside the harvest to date, one row of each by state and season.

    ``checked`` raises before the join and wants rows in the result; otherwise the contract of the keys is part of the plan.
    """
    keys = ["state", "harvest_season"]
    sides = [unique_when_read(df, keys, f"Merge keys are not unique in the {name} dataset: ") for df, name in ((weather, "left"), (harvest, "right"))]
    joined = checked_join(weather, harvest, keys) if checked else sides[0].join(sides[1], keys)
    start = calendar.season_start_year(F.col("harvest_season"))
    out = joined.withColumns(
        {"growing_season_start": calendar.growing_season_start(start), "growing_season_end": calendar.growing_season_end(start), "weather_source": F.lit(WEATHER_SOURCE), "harvest_source": F.lit(HARVEST_SOURCE)}
    ).select(*WEATHER_HARVEST_COLUMNS)
    if checked:
        require_rows(out, "Weather and harvest summaries have no matching state-season records.")
        require_unique(out, keys)
    return out
