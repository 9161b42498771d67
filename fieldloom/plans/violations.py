"""Registered queries in which contracts fail, and files are written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts, features, history
from ..sources import files, shared, sinks
from .catalog import _MONTH, query
from .panel import HISTORY_SQL, daily, table
from .panel import history as harvest


def _raised(spark: SparkSession, cases: dict[str, Callable]) -> DataFrame:
    """One row ``(contract, message)`` for each case: what it raises, or ``passed``."""
    rows = []
    for name, case in cases.items():
        try:
            case()
            rows.append((name, "passed"))
        except (ValueError, FileNotFoundError) as error:
            rows.append((name, str(error).strip()))
    return spark.createDataFrame(rows, "contract string, message string")


@query("""SELECT * FROM (
  SELECT 'Missing values found: text' AS rule, count(*) FILTER (text IS NULL) AS violations FROM documents UNION ALL
  SELECT 'Missing values found: lang', count(*) FILTER (lang IS NULL) FROM documents UNION ALL
  SELECT 'Negative values found in ''n_chars'':', count(*) FILTER (n_chars < 0) FROM documents UNION ALL
  SELECT 'A text is longer than ten characters for each of its counted ones.', count(*) FILTER (length(text) > 10 * n_chars) FROM documents UNION ALL
  SELECT 'A source is known for odd documents only.', count(*) FILTER (doc_id % 2 = 0 AND source IS NOT NULL) FROM documents)""")
def rule_violations(spark, sf_dir):
    """Row rules of documents that do break: the number of rows for each, in one pass."""
    rules = contracts.Expectations(table(spark, sf_dir, "documents")).present(["text", "lang"], "Missing values found: ").non_negative(["n_chars"])
    rules.never(F.length("text") > 10 * F.col("n_chars"), "A text is longer than ten characters for each of its counted ones.")
    return rules.never((F.col("doc_id") % 2 == 0) & F.col("source").isNotNull(), "A source is known for odd documents only.").report()


@query("SELECT 'c_acctbal' AS \"column\", count(*) FILTER (c_acctbal IS NULL) AS missing FROM customer UNION ALL SELECT 'lang', (SELECT count(*) FILTER (lang IS NULL) FROM documents)")
def missing_values(spark, sf_dir):
    """Missing values by column, of a table without and one with some."""
    customers, documents = table(spark, sf_dir, "customer"), table(spark, sf_dir, "documents")
    return contracts.missing_counts(customers, ["c_acctbal"]).unionByName(contracts.missing_counts(documents, ["lang"]))


@query("""WITH s AS (SELECT '[' || string_agg(chr(39) || s || chr(39), ', ' ORDER BY s) || ']' AS found FROM (SELECT DISTINCT o_orderstatus AS s FROM orders WHERE o_orderstatus NOT IN ('F'))),
n AS (SELECT count(*) AS n FROM customer WHERE c_acctbal < 0), k AS (SELECT '[' || string_agg('(' || c_nationkey || ', ' || n || ')', ', ' ORDER BY c_nationkey) || ']' AS n FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 5))
SELECT 'absent column' AS contract, 'Orders is missing required columns: [''season'']' AS message
UNION ALL SELECT 'column order', 'Unexpected columns or column order.' || chr(10) || 'Expected: [''r_name'', ''r_regionkey'']' || chr(10) || 'Found: [''r_regionkey'', ''r_name'']'
UNION ALL SELECT 'no rows', 'Daily weather dataset is empty.'
UNION ALL SELECT 'unexpected values', 'Unexpected values found in ''o_orderstatus''.' || chr(10) || 'Unexpected: ' || found || chr(10) || 'Allowed: [''F'']' FROM s
UNION ALL SELECT 'negative values', CASE WHEN n > 0 THEN 'Negative values found in ''c_acctbal'':' || chr(10) || ' (' || n || ' rows)' ELSE 'passed' END FROM n
UNION ALL SELECT 'not numeric', 'Column is not numeric: c_name'
UNION ALL SELECT 'absent key', 'Cannot check duplicates because columns are absent: [''year'']'
UNION ALL SELECT 'repeated keys', coalesce('Duplicate observations found:' || chr(10) || n, 'passed') FROM k
UNION ALL SELECT 'keys of a join', coalesce('Merge keys are not unique in the left dataset: ' || n, 'passed') FROM k
UNION ALL SELECT 'no frames', 'At least one dataset is required.'
UNION ALL SELECT 'no years', 'At least one year must be provided.'
UNION ALL SELECT 'absent file', 'Historical database not found'
UNION ALL SELECT 'unique keys', 'passed'""")
def broken_contracts(spark, sf_dir):
    """What each general contract says of a table that breaks it."""
    orders, customers, regions = (table(spark, sf_dir, n) for n in ("orders", "customer", "region"))
    head = lambda case: lambda: _headed(case)
    cases = {
        "absent column": lambda: contracts.require_columns(orders, ["o_orderkey", "season"], "Orders"),
        "column order": lambda: contracts.require_exact_columns(regions.select("r_regionkey", "r_name"), ["r_name", "r_regionkey"]),
        "no rows": lambda: contracts.require_rows(orders.where("o_orderkey < 0"), "Daily weather dataset is empty."),
        "unexpected values": lambda: contracts.require_values(orders, "o_orderstatus", ["F"]),
        "negative values": lambda: contracts.require_non_negative(customers, "c_acctbal"),
        "not numeric": lambda: contracts.require_non_negative(customers, "c_name"),
        "absent key": lambda: contracts.require_unique(regions, ["year"]),
        "repeated keys": lambda: contracts.require_unique(customers, ["c_nationkey"]),
        "keys of a join": lambda: contracts.checked_join(customers.withColumnRenamed("c_nationkey", "n_nationkey"), table(spark, sf_dir, "nation"), ["n_nationkey"]),
        "no frames": lambda: contracts.union_all([]),
        "no years": lambda: files.read_years(spark, sf_dir, []),
        "absent file": head(lambda: files.harvest_history(spark, f"{sf_dir}/none.csv")),
        "unique keys": lambda: contracts.require_unique(regions, ["r_regionkey"]),
    }
    return _raised(spark, cases)


def _headed(case: Callable) -> None:
    """Raise the part of a message before its examples, which are in no order."""
    try:
        case()
    except (ValueError, FileNotFoundError) as error:
        raise ValueError(str(error).split(":")[0]) from error


@query(f"""WITH h AS ({HISTORY_SQL}), n AS (SELECT count(*) AS n FROM h), r AS (SELECT count(*) AS n FROM h WHERE region = 'centre_south')
SELECT 'negative' AS contract, 'crush_tonnes cannot contain negative values. (' || n || ' rows)' AS message FROM n
UNION ALL SELECT 'label', 'Invalid season labels:  (' || n || ' rows)' FROM n
UNION ALL SELECT 'region', 'Unexpected regions:  (' || n || ' rows)' FROM r
UNION ALL SELECT 'missing', 'Harvest dataset contains missing values:' || chr(10) || 'crush_tonnes (' || n || ' rows)' FROM n
UNION ALL SELECT 'repeated', 'Harvest dataset contains duplicate season-date-region records.'
UNION ALL SELECT 'date type', 'period_end_date must use a date type.'
UNION ALL SELECT 'value type', 'crush_tonnes must be numeric.'
UNION ALL SELECT 'empty', 'Historical crushing dataset is empty.'
UNION ALL SELECT 'columns', 'Missing columns: [''region'']'
UNION ALL SELECT 'history regions', 'Historical database contains unsupported regions: [''centre_south'']'
UNION ALL SELECT 'no history rows', 'Normalized report contains no rows for the historical database regions.'
UNION ALL SELECT 'conflict', 'Conflicting observations detected. The historical database was not modified'
UNION ALL SELECT 'negative report', 'Negative crush_tonnes values found in normalized report'
UNION ALL SELECT 'sound', 'passed'""")
def broken_reports(spark, sf_dir):
    """What the contracts of harvest reports and of the history say of each fault."""
    report = harvest(spark, sf_dir).withColumn("variation_percent", F.lit(0.0))
    known = report.where("region <> 'centre_south'").select(*history.COLUMNS)
    changed = lambda column, value: report.withColumn(column, value)
    head = lambda case: lambda: _headed(case)
    cases = {
        "negative": lambda: contracts.check_report(changed("crush_tonnes", -F.col("crush_tonnes") - 1)),
        "label": lambda: contracts.check_report(changed("season", F.concat(F.lit("20"), "season"))),
        "region": lambda: contracts.check_report(report, regions=history.HISTORY_REGIONS),
        "missing": lambda: contracts.check_report(changed("crush_tonnes", F.lit(None).cast("bigint"))),
        "repeated": lambda: _sentence(lambda: contracts.check_report(report.unionByName(report))),
        "date type": lambda: contracts.check_report(changed("period_end_date", F.col("period_end_date").cast("string"))),
        "value type": lambda: contracts.check_report(changed("crush_tonnes", F.col("crush_tonnes").cast("string"))),
        "empty": lambda: contracts.check_report(report.limit(0)),
        "columns": lambda: contracts.check_report(report.drop("region")),
        "history regions": lambda: history.update(report, known),
        "no history rows": lambda: history.update(known, report.where("region = 'centre_south'")),
        "conflict": head(lambda: history.update(known, known.withColumn("crush_tonnes", F.col("crush_tonnes") + 1))),
        "negative report": head(lambda: history.update(known, known.withColumn("crush_tonnes", -F.col("crush_tonnes") - 1))),
        "sound": lambda: contracts.check_report(report),
    }
    return _raised(spark, cases)


def _sentence(case: Callable) -> None:
    """Raise the first sentence of a message."""
    try:
        case()
    except ValueError as error:
        raise ValueError(str(error).split(".")[0] + ".") from error


@query(f"WITH h AS ({HISTORY_SQL}) SELECT season, period_end_date, region, crush_tonnes FROM h WHERE region <> 'centre_south'")
def history_file(spark, sf_dir):
    """The history written as CSV with each row twice, the second as it should be, and read with its checks: the last row of a key stays."""
    known = harvest(spark, sf_dir).where("region <> 'centre_south'").select(*history.COLUMNS)
    twice = known.withColumn("crush_tonnes", F.col("crush_tonnes") + 5).withColumn("_n", F.lit(1)).unionByName(known.withColumn("_n", F.lit(2)))
    with shared.scratch(spark) as folder:
        # Two files, the second of which counts.
        names = sinks.save_by(twice, folder, "_n")
        return shared.keep(files.harvest_history(spark, [f"{folder}/{n}.csv" for n in names]))


@query(f"{_MONTH} SELECT ibge_code, municipality, year, month, total_rainfall, rainy_days, missing_weather_days, has_complete_weather_period FROM w")
def monthly_file(spark, sf_dir):
    """Monthly weather written as CSV and read again."""
    made = features.with_coverage(features.monthly_features(daily(spark, sf_dir)))
    with shared.scratch(spark) as folder:
        made.write.option("header", True).csv(f"{folder}/monthly.csv")
        return shared.keep(files.monthly_weather(spark, f"{folder}/monthly.csv")).select("ibge_code", "municipality", "year", "month", "total_rainfall", "rainy_days", "missing_weather_days", "has_complete_weather_period")


@query(f"""{_MONTH}, f AS (SELECT count(*) FILTER (temperature_std IS NULL) AS n FROM w), g AS (SELECT count(*) AS n FROM w WHERE temperature_std IS NOT NULL)
SELECT 'missing' AS contract, CASE WHEN n > 0 THEN 'Missing values found:' || chr(10) || 'temperature_std (' || n || ' rows)' ELSE 'passed' END AS message FROM f
UNION ALL SELECT 'days', 'Rainy days and dry days do not add up to weather observation days for monthly records. (' || n || ' rows)' FROM g
UNION ALL SELECT 'coverage', 'Weather coverage ratio must be between 0 and 1. (' || n || ' rows)' FROM g
UNION ALL SELECT 'spell', 'Maximum consecutive dry days cannot exceed the total number of dry days. (' || n || ' rows)' FROM g
UNION ALL SELECT 'month', 'Month values must be between 1 and 12. (' || n || ' rows)' FROM g
UNION ALL SELECT 'negative', 'Negative values found in ''total_rainfall'':' || chr(10) || ' (' || n || ' rows)' FROM g
UNION ALL SELECT 'key', 'Duplicate observations found'
UNION ALL SELECT 'sound', 'passed'""")
def broken_months(spark, sf_dir):
    """What the contract of monthly weather says of each fault."""
    names = [c.split()[0] for c in files.MONTHLY.split(", ")]
    made = features.with_coverage(features.monthly_features(daily(spark, sf_dir))).select(*names)
    whole = made.where("temperature_std IS NOT NULL")
    check = lambda df: lambda: contracts.check_monthly(df.select(*names), names)
    cases = {
        "missing": check(made),
        "days": check(whole.withColumn("rainy_days", F.col("rainy_days") + 1)),
        "coverage": check(whole.withColumn("weather_coverage_ratio", F.lit(1.5))),
        "spell": check(whole.withColumn("max_consecutive_dry_days", F.col("dry_days") + 1)),
        "month": check(whole.withColumn("month", F.lit(13))),
        "negative": check(whole.withColumn("total_rainfall", F.lit(-1.0))),
        "key": lambda: _headed(check(whole.unionByName(whole))),
        "sound": check(whole),
    }
    return _raised(spark, cases)
