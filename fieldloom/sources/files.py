"""Readers of interchange files, with declared schemas and the usual guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, text
from ..operators import contracts
from ..operators.history import keep_last
from ..operators.rollup import WEATHER_HARVEST_COLUMNS

DAILY = "Date date, PRECTOTCORR double, T2M double, RH2M double, municipality string, ibge_code bigint, state string, latitude double, longitude double"
HISTORY = "season string, period_end_date date, region string, crush_tonnes bigint"
REPORT = f"{HISTORY}, variation_percent double"
SUGAR = "season string, period_end_date date, region string, sugar_tonnes bigint"
MUNICIPALITIES = "municipality string, state string, ibge_code bigint, latitude double, longitude double"
STATE_PRODUCTION = "state string, harvest_year string, production_thousand_tonnes double"
MONTHLY = (
    "ibge_code bigint, municipality string, state string, latitude double, longitude double, year int, month int, total_rainfall double, average_temperature double, "
    "average_humidity double, rainy_days bigint, dry_days bigint, max_daily_rainfall double, temperature_std double, weather_observation_days bigint, "
    "max_consecutive_dry_days bigint, missing_weather_days bigint, weather_coverage_ratio double, has_complete_weather_period boolean"
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system that Spark reads it with."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def file_order(paths: Sequence[str]) -> Column:
    """A sequence of rows as they stand in their files: place of the path in the list, file, first byte of the block, number within it.

    Spark packs files and blocks into tasks by size, so a row's task says nothing of its order.
    A block is read by one task from its first row to its last, so numbers that tasks count up are in order within a block.
    """
    file = F.col("_metadata.file_path")
    listed = F.coalesce(*(F.when(F.contains(file, F.lit(p.split("://")[-1].removeprefix("file:").rstrip("/"))), k) for k, p in enumerate(paths)), F.lit(len(paths)))
    return F.struct(listed.alias("listed"), file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, name: str = "CSV file", sequence: str | None = None, **options) -> DataFrame:
    """CSV with a header. Columns are matched by name; without a schema types are inferred. ``sequence`` names a column of :func:`file_order`."""
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths:
        if not exists(spark, p):
            raise FileNotFoundError(f"{name} not found: {p}")
    reader = spark.read.option("header", True).option("mode", "FAILFAST").options(**options)
    order = [file_order(paths).alias(sequence)] if sequence else []
    try:
        if schema is None:
            return reader.option("inferSchema", True).csv(paths).select("*", *order)
        raw = reader.csv(paths)  # all text: the file's own order of columns
        wanted = [part.strip().split()[:2] for part in schema.split(",")]
        contracts.require_columns(raw, [c for c, _ in wanted], name)
        return raw.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c, kind in wanted), *order)
    except AnalysisException as failed:
        if "PATH_NOT_FOUND" in str(failed):
            raise FileNotFoundError(f"{name} not found: {paths}") from failed
        raise


def read_years(spark: SparkSession, folder: str, years: Sequence[int], schema: str | None = None, **options) -> DataFrame:
    """``<year>.csv`` of each year in one scan, with the year of the file as ``_year``."""
    if not years:
        raise ValueError("At least one year must be provided.")
    if not exists(spark, folder):
        raise FileNotFoundError(f"Input folder not found: {folder}")
    paths = [f"{folder.rstrip('/')}/{y}.csv" for y in years]
    # One scan of all files; each row's year is that of its file.
    df = read_csv(spark, paths, schema, sequence="_place", **options)
    return df.withColumn("_year", F.get(F.array(*(F.lit(int(y)) for y in years)), F.col("_place.listed"))).drop("_place")


def daily_weather(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path, DAILY, "Daily weather dataset")
    return contracts.require_rows(df, "Daily weather dataset is empty.")


def monthly_weather(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path, MONTHLY, "Monthly weather dataset")
    return contracts.require_rows(df, "Monthly weather dataset is empty.")


def harvest_history(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Checked history; of rows with one key the last in the order of files and rows stays."""
    raw = read_csv(spark, path, HISTORY, "Historical database", sequence="_sequence")
    contracts.require_rows(raw, "Historical crushing dataset is empty.")
    contracts.Expectations(raw).present(["season", "period_end_date", "region", "crush_tonnes"]).non_negative(["crush_tonnes"]).check()
    return keep_last(raw, ["season", "period_end_date", "region"], "_sequence").drop("_sequence")


def weather_harvest(spark: SparkSession, path: str) -> DataFrame:
    """The joined dataset, with its dates and the flag of completeness parsed."""
    raw = read_csv(spark, path, None, "Weather-harvest dataset", inferSchema=False)
    contracts.require_columns(raw, WEATHER_HARVEST_COLUMNS, "Weather-harvest dataset")
    contracts.require_rows(raw, "Weather-harvest dataset is empty.")
    kinds = dict.fromkeys(("growing_season_start", "growing_season_end", "latest_report_date", "matched_cutoff_date"), "date") | dict.fromkeys(("municipality_count", "growing_season_month_count", "harvest_period_count", "cumulative_crush_tonnes"), "bigint")
    texts = ("state", "harvest_season", "weather_source", "harvest_source", "has_complete_growing_season")
    typed = raw.select(*(F.col(c).cast("string" if c in texts else kinds.get(c, "double")).alias(c) for c in WEATHER_HARVEST_COLUMNS))
    return typed.withColumn("has_complete_growing_season", text.boolean_text(F.col("has_complete_growing_season")))


def comparison(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """Complete seasons of the joined dataset with their start year; at least three of them."""
    df = weather_harvest(spark, path).where("has_complete_growing_season").withColumn("season_start_year", calendar.season_start_year(F.col("harvest_season")))
    contracts.require_unique(df, ["state", "harvest_season"])
    if (found := df.count()) < least:
        raise ValueError(f"At least {least} complete seasons are required, but {found} were found.")
    return df


def municipal_matrix(spark: SparkSession, path: str, preamble: int = 3) -> tuple[DataFrame, list[str]]:
    """A CSV of municipalities x years below a preamble: its rows, and the years of its header line."""
    if not exists(spark, path):
        raise FileNotFoundError(f"CSV file not found: {path}")
    lines = spark.read.text(path).limit(preamble + 1).collect()
    if len(lines) <= preamble:
        raise ValueError("Production dataset is empty.")
    years = [c.strip().strip('"') for c in lines[preamble][0].split(",")][1:]
    if not years:
        raise ValueError("Dataset does not contain production columns.")
    schema = ", ".join(["municipality string", *(f"`{y}` string" for y in years)])
    return spark.read.schema(schema).csv(path), years
