"""Data contracts. All row rules of a suite are counted in one aggregate pass."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import is_season_label


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, or not a number in a floating-point column."""
    c = F.col(f"`{column}`")
    return c.isNull() | F.isnan(c) if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def without_nan(df: DataFrame) -> DataFrame:
    """Floating-point NaN as null."""
    return df.withColumns({f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


class Expectations:
    """Rules on rows: each is a name, a condition of violation and a message."""

    def __init__(self, df: DataFrame):
        self.df, self.rules, self.keys = df, [], []

    def never(self, condition: Column, message: str) -> Expectations:
        self.rules.append((condition, message))
        return self

    def present(self, columns: Iterable[str], message: str = "Missing values found:\n") -> Expectations:
        for c in columns:
            self.never(is_missing(self.df, c), f"{message}{c}")
        return self

    def non_negative(self, columns: Iterable[str]) -> Expectations:
        for c in columns:
            self.never(F.col(c) < 0, f"Negative values found in '{c}':\n")
        return self

    def counts(self) -> list[int]:
        if not self.rules:
            return []
        return list(self.df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"r{k}") for k, (c, _) in enumerate(self.rules))).first())

    def report(self) -> DataFrame:
        """One row ``(rule, violations)`` for each rule, from one pass and in no order."""
        one = self.df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"r{k}") for k, (c, _) in enumerate(self.rules)))
        return one.select(F.explode(F.array(*(F.struct(F.lit(message.strip()).alias("rule"), F.col(f"r{k}").alias("violations")) for k, (_, message) in enumerate(self.rules)))).alias("r")).select("r.*")

    def check(self) -> DataFrame:
        """The rows, or ValueError with the first broken rule's message and its number of rows."""
        for n, (_, message) in zip(self.counts(), self.rules, strict=True):
            if n:
                raise ValueError(f"{message} ({n} rows)")
        return self.df


def require_columns(df: DataFrame, columns: Iterable[str], name: str = "Dataframe") -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{name} is missing required columns: {missing}")
    return df


def require_exact_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    if df.columns != list(expected):
        raise ValueError(f"Unexpected columns or column order.\nExpected: {list(expected)}\nFound: {df.columns}")
    return df


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row ``(column, missing)`` for each column, from one pass."""
    names = list(columns or df.columns)
    if absent := [c for c in names if c not in df.columns]:
        raise ValueError(f"Cannot check missing values because columns are absent: {absent}")
    one = df.agg(*(F.count_if(is_missing(df, c)).alias(c) for c in names))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing")) for c in names))).alias("r")).select("r.*")


def require_present(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns or df.columns)
    if absent := [c for c in names if c not in df.columns]:
        raise ValueError(f"Cannot check missing values because columns are absent: {absent}")
    return Expectations(df).present(names).check()


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str] | None = None, message: str = "Duplicate observations found:\n") -> DataFrame:
    keys = list(keys or df.columns)
    if absent := [c for c in keys if c not in df.columns]:
        raise ValueError(f"Cannot check duplicates because columns are absent: {absent}")
    if found := repeated_keys(df, keys).orderBy(*(F.col(f"`{k}`").asc_nulls_last() for k in keys)).limit(5).collect():
        raise ValueError(f"{message}{[tuple(r) for r in found]}")
    return df


def unique_when_read(df: DataFrame, keys: Sequence[str], message: str = "Duplicate observations found: ") -> DataFrame:
    """``df`` as it is, whose rows raise as they are made if their key is there again. Costs no job of its own, nor an exchange where ``df`` is dealt by its keys."""
    rows, shown = "_rows_of_key", F.concat_ws(", ", *(F.col(f"`{k}`").cast("string") for k in keys))
    counted = df.withColumn(rows, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return counted.where(F.when(F.col(rows) > 1, F.raise_error(F.concat(F.lit(message), shown)).cast("boolean")).otherwise(True)).drop(rows)


def repeat_masks(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``repeated`` (other rows have the key too) and ``again`` (a row before it in the order has it)."""
    same = Window.partitionBy(*keys)
    return df.withColumns({"repeated": F.count(F.lit(1)).over(same) > 1, "again": F.row_number().over(same.orderBy(*(order or keys))) > 1})


def require_numeric(df: DataFrame, column: str) -> DataFrame:
    if column not in df.columns:
        raise ValueError(f"Column not found: {column}")
    if not isinstance(df.schema[column].dataType, T.NumericType):
        raise ValueError(f"Column is not numeric: {column}")
    return df


def require_non_negative(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        require_numeric(df, c)
    return Expectations(df).non_negative(columns).check()


def require_values(df: DataFrame, column: str, allowed: Iterable) -> DataFrame:
    """Only allowed values in a column; nulls pass."""
    if column not in df.columns:
        raise ValueError(f"Column not found: {column}")
    allowed = sorted(allowed)
    if found := df.where(~F.col(column).isin(allowed)).select(column).distinct().limit(20).collect():
        raise ValueError(f"Unexpected values found in '{column}'.\nUnexpected: {sorted(r[0] for r in found)}\nAllowed: {allowed}")
    return df


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", validate: str = "one_to_one") -> DataFrame:
    """Join whose sides hold each key once where ``validate`` says ``one``."""
    first, second = validate.split("_to_")
    for side, frame, name in ((first, left, "left"), (second, right, "right")):
        if side == "one":
            require_unique(frame, keys, f"Merge keys are not unique in the {name} dataset: ")
    return left.join(right, list(keys), how)


# Harvest reports.

REPORT_COLUMNS = ("season", "period_end_date", "region", "crush_tonnes", "variation_percent")
REPORT_KEY = ("season", "period_end_date", "region")
REGIONS = ("sao_paulo", "other_states", "centre_south")


def check_report(df: DataFrame, value: str = "crush_tonnes", columns: Sequence[str] = REPORT_COLUMNS, regions: Sequence[str] = REGIONS) -> DataFrame:
    """Harvest reports: not empty, columns, no missing, unique key, values, date type, season labels, regions."""
    require_rows(df, "Historical crushing dataset is empty.")
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"Missing columns: {missing}")
    Expectations(df).present(columns, "Harvest dataset contains missing values:\n").check()
    require_unique(df, REPORT_KEY, "Harvest dataset contains duplicate season-date-region records.")
    if not isinstance(df.schema[value].dataType, T.NumericType):
        raise ValueError(f"{value} must be numeric.")
    if not isinstance(df.schema["period_end_date"].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError("period_end_date must use a date type.")
    rules = Expectations(df).never(F.col(value) < 0, f"{value} cannot contain negative values.").never(~is_season_label(F.col("season")), "Invalid season labels: ")
    rules.never(~F.col("region").isin(list(regions)), "Unexpected regions: ").check()
    return df


# Monthly weather.

MONTHLY_KEY = ("ibge_code", "year", "month")
MONTHLY_COUNTS = ("rainy_days", "dry_days", "weather_observation_days", "max_consecutive_dry_days", "missing_weather_days")


def monthly_rules(df: DataFrame, columns: Sequence[str]) -> Expectations:
    """All row rules of monthly weather."""
    rules = Expectations(df).present(columns).non_negative(["total_rainfall", "max_daily_rainfall", *MONTHLY_COUNTS])
    rules.never(F.col("rainy_days") + F.col("dry_days") != F.col("weather_observation_days"), "Rainy days and dry days do not add up to weather observation days for monthly records.")
    rules.never(~F.col("weather_coverage_ratio").between(0, 1), "Weather coverage ratio must be between 0 and 1.")
    rules.never(F.col("max_consecutive_dry_days") > F.col("dry_days"), "Maximum consecutive dry days cannot exceed the total number of dry days.")
    return rules.never(~F.col("month").between(1, 12), "Month values must be between 1 and 12.")


def check_monthly(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Monthly weather: columns, keys, and all row rules in one pass."""
    require_exact_columns(df, columns)
    monthly_rules(df, columns).check()
    return require_unique(df, MONTHLY_KEY)


def union_all(frames: Sequence[DataFrame], message: str = "At least one dataset is required.") -> DataFrame:
    """All rows by column name; columns that a part lacks are null there."""
    if not frames:
        raise ValueError(message)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
