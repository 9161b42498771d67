"""Queries of contracts that are counted in the one job that uses the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, observed
from ..sources import files, shared, versions
from .catalog import _MONTH, _monthly, query
from .panel import HISTORY_SQL, table
from .panel import history as harvest

_REPEATED = "(SELECT count(*) FROM (SELECT count(*) OVER (PARTITION BY {0}) AS n FROM {1}) WHERE n > 1)"


@query(f"""SELECT 'customers to nations' AS contract, (SELECT count(*) FROM customer) AS joined, 0 AS repeated_left, 0 AS repeated_right, 'passed' AS message
UNION ALL SELECT 'nations to customers', (SELECT count(*) FROM customer), 0, {_REPEATED.format("c_nationkey", "customer")}, 'Merge keys are not unique in the right dataset: '
UNION ALL SELECT 'lines to lines', (SELECT sum(n * n)::BIGINT FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)), {_REPEATED.format("l_orderkey, l_linenumber", "lineitem")},
  {_REPEATED.format("l_orderkey, l_linenumber", "lineitem")}, 'Merge keys are not unique in the left dataset: '
UNION ALL SELECT 'lines to orders', (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey), 0, 0, 'passed'""")
def joins_in_one_pass(spark, sf_dir):
    """Cardinality contracts of joins that hold and that don't, counted while the join runs."""
    customers, nations = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("key")), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    cases = {
        "customers to nations": (customers, nations, ["key"], "many_to_one"),
        "nations to customers": (nations, customers, ["key"], "one_to_one"),
        "lines to lines": (lines, lines.withColumnRenamed("l_quantity", "other"), ["l_orderkey", "l_linenumber"], "one_to_one"),
        "lines to orders": (lines, orders, ["l_orderkey"], "many_to_one"),
    }
    rows = []
    for name, (left, right, keys, validate) in cases.items():
        run = observed.Pass()
        joined = run.observe(run.join(left, right, keys, validate=validate), {"joined": F.count(F.lit(1))})
        joined.write.format("noop").mode("overwrite").save()
        found, broken = run.metrics(), run.broken()
        rows.append((name, found["joined"], found.get("repeated left", 0), found.get("repeated right", 0), broken[0][0] if broken else "passed"))
    return spark.createDataFrame(rows, "contract string, joined bigint, repeated_left bigint, repeated_right bigint, message string")


_FAULTY = f"""h AS ({HISTORY_SQL}), f AS (SELECT CASE WHEN crush_tonnes % 11 = 0 THEN '20' || season ELSE season END AS season, CASE WHEN crush_tonnes % 13 = 0 THEN NULL ELSE period_end_date END AS period_end_date, region,
  CASE WHEN crush_tonnes % 17 = 0 THEN -crush_tonnes WHEN crush_tonnes % 19 = 0 THEN NULL ELSE crush_tonnes END AS crush_tonnes FROM h UNION ALL SELECT * FROM h WHERE crush_tonnes % 23 = 0)"""


@query(f"""WITH {_FAULTY}, k AS (SELECT count(*) OVER (PARTITION BY season, period_end_date, region) AS n FROM f)
SELECT 'Harvest dataset contains missing values:' || chr(10) || 'period_end_date' AS contract, count(*) FILTER (period_end_date IS NULL) AS broken FROM f
UNION ALL SELECT 'Harvest dataset contains missing values:' || chr(10) || 'crush_tonnes', count(*) FILTER (crush_tonnes IS NULL) FROM f
UNION ALL SELECT 'Harvest dataset contains duplicate season-date-region records. ', count(*) FILTER (n > 1) FROM k
UNION ALL SELECT 'crush_tonnes cannot contain negative values.', count(*) FILTER (crush_tonnes < 0) FROM f
UNION ALL SELECT 'Invalid season labels: ', count(*) FILTER (length(season) > 5) FROM f
UNION ALL SELECT 'Unexpected regions: ', count(*) FILTER (region = 'centre_south') FROM f""")
def report_in_one_pass(spark, sf_dir):
    """Every contract of harvest reports, of a table that breaks six of them: the numbers of rows while it is written."""
    every = harvest(spark, sf_dir)
    n = F.col("crush_tonnes")
    faulty = every.select(
        F.when(n % 11 == 0, F.concat(F.lit("20"), "season")).otherwise(F.col("season")).alias("season"),
        F.when(n % 13 != 0, F.col("period_end_date")).alias("period_end_date"),
        "region",
        F.when(n % 17 == 0, -n).when(n % 19 != 0, n).alias("crush_tonnes"),
    ).unionByName(every.where(n % 23 == 0))
    run = observed.Pass()
    passed = observed.report_pass(faulty.withColumn("variation_percent", F.lit(0.0)), run, regions=history.HISTORY_REGIONS)
    passed.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(m, n) for m, n, _ in run.broken()], "contract string, broken bigint")


@query(f"""{_MONTH}, b AS (SELECT CASE WHEN rainy_days % 3 = 0 THEN rainy_days + 1 ELSE rainy_days END AS rainy_days, dry_days, weather_observation_days, temperature_std, max_consecutive_dry_days + CASE WHEN month = 2 THEN 31 ELSE 0 END AS spell,
  weather_coverage_ratio * CASE WHEN state = 'ASIA' THEN 3 ELSE 1 END AS ratio FROM w)
SELECT * FROM (SELECT 'Missing values found:' || chr(10) || 'temperature_std' AS contract, count(*) FILTER (temperature_std IS NULL) AS broken FROM b
UNION ALL SELECT 'Rainy days and dry days do not add up to weather observation days for monthly records.', count(*) FILTER (rainy_days + dry_days <> weather_observation_days) FROM b
UNION ALL SELECT 'Weather coverage ratio must be between 0 and 1.', count(*) FILTER (ratio > 1) FROM b
UNION ALL SELECT 'Maximum consecutive dry days cannot exceed the total number of dry days.', count(*) FILTER (spell > dry_days) FROM b) WHERE broken > 0""")
def months_in_one_pass(spark, sf_dir):
    """Every contract of monthly weather, of a table that breaks some, while it is written."""
    names = [c.split()[0] for c in files.MONTHLY.split(", ")]
    months = _monthly(spark, sf_dir).withColumns(
        {
            "rainy_days": F.when(F.col("rainy_days") % 3 == 0, F.col("rainy_days") + 1).otherwise(F.col("rainy_days")),
            "max_consecutive_dry_days": F.col("max_consecutive_dry_days") + F.when(F.col("month") == 2, 31).otherwise(0),
            "weather_coverage_ratio": F.col("weather_coverage_ratio") * F.when(F.col("state") == "ASIA", 3).otherwise(1),
        }
    )
    run = observed.Pass()
    observed.monthly_pass(months.select(*names), run, names).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(m, n) for m, n, _ in run.broken()], "contract string, broken bigint")


@query(f"""WITH h AS (SELECT * FROM ({HISTORY_SQL}) WHERE region <> 'centre_south'), o AS (SELECT * FROM h WHERE period_end_date < DATE '2009-03-01'), n AS (SELECT * FROM h WHERE period_end_date >= DATE '2009-01-01')
SELECT h.*, (SELECT count(*) FROM o) AS before, (SELECT count(*) FROM n) AS reported, (SELECT count(*) FROM n WHERE period_end_date < DATE '2009-03-01') AS overlap,
  (SELECT count(*) FROM n WHERE period_end_date < DATE '2009-03-01' AND crush_tonnes % 2 = 0) AS conflicts FROM h""")
def append_in_one_pass(spark, sf_dir):
    """A report that conflicts and is refused, then one that agrees: what the store holds, with the numbers of both jobs."""
    every = harvest(spark, sf_dir)
    report = every.where("period_end_date >= DATE '2009-01-01'")
    with shared.scratch(spark) as folder:
        store = versions.Versions(spark, folder)
        store.write(every.where("period_end_date < DATE '2009-03-01' AND region <> 'centre_south'"), name="first")
        conflicts = 0
        try:
            observed.append_report(store, report.withColumn("crush_tonnes", F.col("crush_tonnes") + F.when(F.col("crush_tonnes") % 2 == 0, 1).otherwise(0)))
        except ValueError as refused:
            assert store.names() == ["first"]
            conflicts = int(str(refused).rsplit("(", 1)[1].split(" ")[0])
        found = observed.append_report(store, report)
        again = observed.append_report(store, report)
        assert again["added"] == 0 and len(store.names()) == 2
        numbers = {"before": found["history"], "reported": found["reported"], "overlap": found["overlap"], "conflicts": conflicts}
        return shared.keep(store.read().withColumns({k: F.lit(v).cast("bigint") for k, v in numbers.items()}))
