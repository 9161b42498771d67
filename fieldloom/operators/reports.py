"""Cumulative harvest reports: wide rows to periods, sums to differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar, text
from .contracts import require_columns

#: Day and month on which every season's first period ends.
FIRST_PERIOD = "04-16"
REGION_CELLS = (("sao_paulo", 1), ("centre_south", 2), ("other_states", 3))


def report_rows(table: DataFrame) -> DataFrame:
    """Rows ``(row_idx, cells)`` of a reconstructed table to one row by season, period and region.

    The third row names two seasons; rows whose first cell is ``DD/MM`` follow.
    Empty cells are periods that are still to come.
    """
    seasons = table.where("row_idx = 2").select(text.header_seasons(F.col("cells")).alias("seasons"))
    rows = table.where((F.col("row_idx") > 2) & F.get("cells", F.lit(0)).rlike(text.PERIOD)).join(F.broadcast(seasons))
    regions = F.array(*(F.struct(F.lit(name).alias("region"), F.get("cells", F.lit(k)).alias("cell")) for name, k in REGION_CELLS))
    each = rows.select("seasons", F.get("cells", F.lit(0)).alias("period"), F.explode(regions).alias("r")).where("r.cell is not null")
    each = each.select("seasons", "period", "r.region", text.region_cell(F.col("r.cell")).alias("value"))
    two = F.array(*(F.struct(F.col(f"seasons.{s}").alias("season"), F.col(f"value.{s}").alias("cumulative_crush_tonnes")) for s in ("previous", "current")))
    out = each.select("period", "region", F.col("value.variation_percent").alias("variation_percent"), F.explode(two).alias("s")).select("s.*", "period", "region", "variation_percent")
    return out.select("season", calendar.period_end_date(F.col("season"), F.col("period")).alias("period_end_date"), "region", "cumulative_crush_tonnes", "variation_percent")


def per_period(cumulative: DataFrame, value: str = "cumulative_crush_tonnes", into: str = "crush_tonnes", checked: bool = True) -> DataFrame:
    """Differences of a running total by season and region; the first value stays."""
    require_columns(cumulative, ("season", "period_end_date", "region", value), "Cumulative report")
    window = Window.partitionBy("season", "region").orderBy("period_end_date")
    out = cumulative.withColumn(into, (F.col(value) - F.coalesce(F.lag(value).over(window), F.lit(0))).cast("bigint"))
    if checked:
        bad = out.groupBy("season", "region").agg(F.min("period_end_date").alias("first"), F.count_if(F.col(into) < 0).alias("falls"))
        late = F.date_format("first", "MM-dd") != FIRST_PERIOD
        for row in bad.where(late | (F.col("falls") > 0)).limit(1).collect():
            what = "contains decreasing values" if row.falls else "does not begin on 16 April"
            raise ValueError(f"Cumulative report of {row.season}, {row.region} {what}.")
    return out.drop(value)


def normalized_report(table: DataFrame) -> DataFrame:
    """A reconstructed table as per-period tonnes in the order of the report's columns."""
    return per_period(report_rows(table)).select("season", "period_end_date", "region", "crush_tonnes", "variation_percent")


def normalized_reports(tables: DataFrame) -> DataFrame:
    """Reconstructed tables ``(doc, page, row_idx, cells)`` of many documents as per-period tonnes, in one lazy plan.

    The contract is part of the plan: a document with several tables or without data rows, a
    season that doesn't begin on 16 April and a running total that falls raise as rows are
    made, and the error names the document and the row.
    """
    fail = lambda *parts: F.raise_error(F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))
    docs = tables.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("page", "row_idx", "cells"))).alias("rows"), F.min("page").alias("first"), F.max("page").alias("last"))
    one = F.when(F.col("first") != F.col("last"), fail("Expected exactly one historical crushing table: ", F.col("doc"))).when(F.size("rows") < 4, fail("The table does not contain the expected header and data rows: ", F.col("doc")))
    docs = docs.select("doc", F.coalesce(one.cast("array<struct<page:int,row_idx:int,cells:array<string>>>"), F.col("rows")).alias("rows"))
    docs = docs.select("doc", "rows", text.header_seasons(F.get("rows", F.lit(2))["cells"]).alias("seasons"))
    docs = docs.select("doc", "seasons", F.explode(F.slice("rows", 4, F.size("rows"))).alias("row"))
    cell = lambda k: F.get("row.cells", F.lit(k))
    regions = F.array(*(F.struct(F.lit(name).alias("region"), cell(k).alias("cell")) for name, k in REGION_CELLS))
    each = docs.where(cell(0).rlike(text.PERIOD)).select("doc", "seasons", cell(0).alias("period"), F.explode(regions).alias("r")).where("r.cell is not null")
    each = each.select("doc", "seasons", "period", "r.region", text.region_cell(F.col("r.cell")).alias("value"))
    two = F.array(*(F.struct(F.col(f"seasons.{s}").alias("season"), F.col(f"value.{s}").alias("total")) for s in ("previous", "current")))
    long = each.select("doc", "period", "region", F.col("value.variation_percent").alias("variation_percent"), F.explode(two).alias("s")).select("doc", "s.*", "period", "region", "variation_percent")
    long = long.withColumn("period_end_date", calendar.period_end_date(F.col("season"), F.col("period")))
    window = Window.partitionBy("doc", "season", "region").orderBy("period_end_date")
    before = F.lag("total").over(window)
    long = long.withColumn("before", before)
    where = (F.lit(" in "), F.col("doc"), F.lit(", "), F.col("season"), F.lit(", "), F.col("region"), F.lit(", "), F.col("period_end_date"))
    late = F.col("before").isNull() & (F.date_format("period_end_date", "MM-dd") != FIRST_PERIOD)
    tonnes = F.when(late, fail("The season does not begin on 16 April", *where).cast("bigint")).when(F.col("total") < F.col("before"), fail("Running totals fall", *where).cast("bigint"))
    tonnes = tonnes.otherwise(F.col("total") - F.coalesce("before", F.lit(0)))
    return long.select("doc", "season", "period_end_date", "region", tonnes.alias("crush_tonnes"), "variation_percent")
