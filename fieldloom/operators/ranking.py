"""Seasons against each other: ranks, tables, trends and panels, as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar
from ..functions.formats import number_text, ordinal, rank_color

# Column, label, decimals, scale of the table of seasons.
TABLE = (
    ("total_growing_season_rainfall", "Rainfall (mm)", 0, 1.0),
    ("average_growing_season_temperature", "Avg temp (°C)", 1, 1.0),
    ("total_growing_season_rainy_days", "Rainy days", 1, 1.0),
    ("total_growing_season_dry_days", "Dry days", 1, 1.0),
    ("average_max_consecutive_dry_days", "Avg max CDD", 1, 1.0),
    ("cumulative_crush_tonnes", "Crush (Mt)", 2, 1_000_000.0),
)
# Column, title, unit, scale of ranked and charted metrics.
TREND = (
    ("total_growing_season_rainfall", "Growing-Season Rainfall", "mm", 1.0),
    ("average_growing_season_temperature", "Average Temperature", "°C", 1.0),
    ("average_max_consecutive_dry_days", "Average Maximum CDD", "days", 1.0),
    ("cumulative_crush_tonnes", "Matched-Cutoff Crush", "Mt", 1_000_000.0),
)
# Column, title, unit, decimals, scale of the panel of one season.
PANEL = (
    ("total_growing_season_rainfall", "Growing-season rainfall", "mm", 0, 1.0),
    ("average_growing_season_temperature", "Average temperature", "°C", 1, 1.0),
    ("average_growing_season_humidity", "Average humidity", "%", 1, 1.0),
    ("total_growing_season_rainy_days", "Rainy days", "days", 1, 1.0),
    ("total_growing_season_dry_days", "Dry days", "days", 1, 1.0),
    ("average_max_consecutive_dry_days", "Average maximum CDD", "days", 1, 1.0),
    ("maximum_consecutive_dry_days", "Maximum CDD", "days", 0, 1.0),
    ("cumulative_crush_tonnes", "Cumulative crush", "Mt", 2, 1_000_000.0),
)


def descending_rank(column: str, by: list[str] | None = None) -> Column:
    """1 for the highest; equals share the best rank. Meant for a row by season: it gathers each partition."""
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return F.rank().over(window.orderBy(F.col(column).desc()))


def season_table(seasons: DataFrame) -> DataFrame:
    """Formatted cells of every season."""
    return seasons.select("state", "harvest_season", *(number_text(F.col(c), d, s).alias(c) for c, _, d, s in TABLE))


def _long(seasons: DataFrame, metrics) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(m[1]).alias("metric"), F.lit(m[2]).alias("unit"), (F.col(m[0]).cast("double") / m[-1]).alias("value")) for m in metrics))
    return seasons.select("state", "harvest_season", F.explode(rows).alias("m")).select("state", "harvest_season", "m.*")


def trend(seasons: DataFrame) -> DataFrame:
    """Scaled value of each charted metric and season."""
    return _long(seasons, TREND)


def rank_panel(seasons: DataFrame, by_state: bool = False) -> DataFrame:
    """Rank of the newest season in each metric, among all seasons of the table (or of its state)."""
    keys = ["metric", *(["state"] if by_state else [])]
    every = trend(seasons)
    ranked = every.withColumns({"rank": descending_rank("value", keys).cast("bigint"), "total": F.count(F.lit(1)).over(Window.partitionBy(*keys)), "last": F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("state").desc(), F.col("harvest_season").desc()))})
    return ranked.where("last = 1").select("state", "harvest_season", "metric", "unit", "value", "rank", "total", ordinal(F.col("rank")).alias("rank_text"), rank_color(F.col("rank"), F.col("total")).alias("color"))


def newest(seasons: DataFrame) -> DataFrame:
    """The last row in order of state and season."""
    return seasons.orderBy(F.col("state").desc(), F.col("harvest_season").desc()).limit(1)


def season_panel(seasons: DataFrame) -> DataFrame:
    """Formatted metrics of the newest season."""
    rows = F.array(*(F.struct(F.lit(t).alias("metric"), number_text(F.col(c), d, s, u).alias("value")) for c, t, u, d, s in PANEL))
    dates = [calendar.day_text(F.col(c)).alias(c) for c in ("growing_season_start", "growing_season_end", "latest_report_date")]
    return newest(seasons).select("state", "harvest_season", *dates, F.explode(rows).alias("m")).select("state", "harvest_season", "growing_season_start", "growing_season_end", "latest_report_date", "m.*")


def cutoff_note(seasons: DataFrame) -> DataFrame:
    """``June 01``: the cutoff that the comparison goes by."""
    return newest(seasons).select(calendar.month_day_text(F.col("matched_cutoff_date")).alias("cutoff"))
