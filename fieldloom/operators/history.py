"""The append-only harvest history: agreeing overlap is nothing new, disagreement stops everything."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .contracts import Expectations, require_columns, require_unique

COLUMNS = ("season", "period_end_date", "region", "crush_tonnes")
KEY = ("season", "period_end_date", "region")
HISTORY_REGIONS = ("sao_paulo", "other_states")
#: Totals that a report may carry and the history doesn't.
REPORT_ONLY_REGIONS = ("centre_south",)


def typed(df: DataFrame, name: str) -> DataFrame:
    """The history's columns in its types."""
    require_columns(df, COLUMNS, name)
    return df.select(text.strip(F.col("season").cast("string")).alias("season"), F.col("period_end_date").cast("date").alias("period_end_date"), text.strip(F.col("region").cast("string")).alias("region"), F.col("crush_tonnes").cast("bigint").alias("crush_tonnes"))


def rules(df: DataFrame, name: str) -> Expectations:
    """Row rules of a history or a report."""
    every = Expectations(df).present(KEY, f"Missing key values found in {name}:\n").never(F.col("crush_tonnes").isNull(), f"Missing crush_tonnes values found in {name}:\n")
    return every.never(F.col("crush_tonnes") < 0, f"Negative crush_tonnes values found in {name}:\n")


def prepare(df: DataFrame, name: str) -> DataFrame:
    """The history's columns in its types, checked."""
    out = typed(df, name)
    rules(out, name).check()
    return require_unique(out, KEY, f"Duplicate keys found in {name}:\n")


def conflicts(history: DataFrame, report: DataFrame) -> DataFrame:
    """Keys of both with different values."""
    both = history.alias("h").join(report.alias("r"), list(KEY))
    return both.where(F.col("h.crush_tonnes") != F.col("r.crush_tonnes")).select(*KEY, F.col("h.crush_tonnes").alias("crush_tonnes_history"), F.col("r.crush_tonnes").alias("crush_tonnes_report"))


def additions(history: DataFrame, report: DataFrame) -> DataFrame:
    """Rows of the report whose key the history lacks."""
    return report.join(history.select(*KEY), list(KEY), "left_anti")


def lost_or_changed(history: DataFrame, combined: DataFrame) -> DataFrame:
    """Rows of the history that aren't in the combined table as they were."""
    return history.select(*COLUMNS).exceptAll(combined.select(*COLUMNS))


def keep_last(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row of each key with the greatest sequence number."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(sequence).desc()))
    return df.withColumn("_n", number).where("_n = 1").drop("_n")


@dataclass
class Update:
    """What an update found: ``combined`` is lazy, in no order."""

    combined: DataFrame
    history_rows: int
    new_rows: int
    overlap_rows: int


def check_regions(history: DataFrame, report: DataFrame) -> DataFrame:
    """The report without its totals, if all regions are known."""
    def others(df: DataFrame, known) -> list[str]:
        return sorted(r[0] for r in df.where(~F.col("region").isin(list(known))).select("region").distinct().limit(20).collect())

    if found := others(history, HISTORY_REGIONS):
        raise ValueError(f"Historical database contains unsupported regions: {found}")
    if found := others(report, (*HISTORY_REGIONS, *REPORT_ONLY_REGIONS)):
        raise ValueError(f"Normalized report contains unsupported regions: {found}")
    kept = report.where(F.col("region").isin(list(HISTORY_REGIONS)))
    if kept.isEmpty():
        raise ValueError("Normalized report contains no rows for the historical database regions.")
    return kept


def update(history: DataFrame, report: DataFrame) -> Update:
    """History and report to their union; ValueError on any conflict, before anything is written."""
    history, report = prepare(history, "historical database"), prepare(report, "normalized report")
    report = check_regions(history, report).persist()
    history = history.persist()
    try:
        if found := conflicts(history, report).limit(5).collect():
            raise ValueError(f"Conflicting observations detected. The historical database was not modified:\n{[tuple(r) for r in found]}")
        new = additions(history, report)
        combined = history.unionByName(new)
        before, added, reported = history.count(), new.count(), report.count()
        total = combined.count()
        if total != before + added:
            raise ValueError(f"Unexpected final row count. Expected {before + added}, but obtained {total}.")
        if not lost_or_changed(history, combined).isEmpty():
            raise ValueError("Some historical observations disappeared during the merge. No file was modified.")
        return Update(combined, before, added, reported - added)
    finally:
        history.unpersist()
        report.unpersist()
