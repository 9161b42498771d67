"""Writers: plain CSV and Parquet, files by value, summaries. Verified versions: ``versions``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.contracts import is_missing


def save_csv(df: DataFrame, path: str, files: int | None = 1) -> None:
    """CSV with a header; by default one file, which suits small results only."""
    (df.coalesce(files) if files else df).write.mode("overwrite").option("header", True).csv(path)


def save_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_by(df: DataFrame, folder: str, column: str, *order: str) -> list[str]:
    """``<value>.csv`` for each value of a column, in one write. Returns the values in order.

    With ``order`` the rows of a value are in one file, in that order.
    """
    spark, staged = df.sparkSession, f"{folder.rstrip('/')}/_staged"
    dealt = df.repartition(F.col(column)).sortWithinPartitions(column, *order) if order else df
    dealt.write.mode("overwrite").option("header", True).partitionBy(column).csv(staged)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(s.getPath().getName() for s in fs.listStatus(path(staged)) if s.getPath().getName().startswith(f"{column}="))
    for name in found:
        if not fs.rename(path(f"{staged}/{name}"), path(f"{folder}/{name.split('=', 1)[1]}.csv")):
            raise OSError(f"{staged}/{name} could not be renamed")
    fs.delete(path(staged), True)
    return [name.split("=", 1)[1] for name in found]


def summary(df: DataFrame, date_column: str | None = None) -> DataFrame:
    """One row: rows, columns, repeated rows, missing by column, and the range of dates. One pass."""
    if date_column and date_column not in df.columns:
        raise ValueError(f"Column not found: {date_column}")
    every = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    parts = [F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), (F.count(F.lit(1)) - F.countDistinct(F.to_json(every, {"ignoreNullFields": "false"}))).alias("duplicate_rows")]
    parts.append(F.map_from_arrays(F.array(*(F.lit(c) for c in df.columns)), F.array(*(F.count_if(is_missing(df, c)) for c in df.columns))).alias("missing"))
    if date_column:
        parts += [F.min(date_column).alias("first_date"), F.max(date_column).alias("last_date")]
    return df.agg(*parts)
