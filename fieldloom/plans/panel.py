"""Daily-panel and harvest analogues of the bench tables, as inputs of the registered queries.

Stations are nations, states are regions. Sums run over decimals, so results
don't hang on the order of rows. Season labels have two digits and mean years from
2000 on, so all dates are moved by ``SHIFT`` years, as a whole table each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import features


#: Years that all dates of the bench tables are moved by; leap years stay leap years.
SHIFT = 8


def moved(date: str) -> Column:
    return F.add_months(F.to_date(date), 12 * SHIFT)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each nation and ship date: rainfall, temperature and humidity in the daily columns."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_discount", "l_quantity", "l_tax")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # Small sides are broadcast by their size, where Spark finds it small.
    placed = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    days = placed.groupBy("s_nationkey", moved("l_shipdate").alias("Date")).agg(
        (F.sum(F.col("l_discount").cast("decimal(12,2)")) * 10).cast("double").alias("PRECTOTCORR"),
        F.max("l_quantity").alias("T2M"),
        (F.max(F.col("l_tax").cast("decimal(12,2)")) * 1000).cast("double").alias("RH2M"),
    )
    named = days.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return features.with_calendar(
        named.select(
            "Date", "PRECTOTCORR", "T2M", "RH2M", F.col("n_name").alias("municipality"), F.col("s_nationkey").cast("bigint").alias("ibge_code"), F.col("r_name").alias("state"),
            (F.col("s_nationkey") * 1.5).cast("double").alias("latitude"), (F.lit(100) - F.col("s_nationkey") * 2.5).cast("double").alias("longitude"),
        )
    )


DAILY_SQL = f"""
  SELECT day AS date, s_nationkey::BIGINT AS ibge_code, n_name AS municipality, r_name AS state, (s_nationkey * 1.5)::DOUBLE AS latitude, (100 - s_nationkey * 2.5)::DOUBLE AS longitude,
         year(day)::INT AS year, month(day)::INT AS month, p AS PRECTOTCORR, t AS T2M, h AS RH2M
  FROM (SELECT s_nationkey, (l_shipdate + INTERVAL {SHIFT} YEAR)::DATE AS day, (sum(l_discount::DECIMAL(12,2)) * 10)::DOUBLE AS p, max(l_quantity) AS t, (max(l_tax::DECIMAL(12,2)) * 1000)::DOUBLE AS h
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harvest history of orders: half-month sums by season and status, in the history's columns."""
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderdate", "o_totalprice")
    day = moved("o_orderdate")
    end = F.make_date(F.year(day), F.month(day), F.when(F.dayofmonth(day) <= 15, 15).otherwise(F.dayofmonth(F.last_day(day))))
    start = F.year(day) - F.when(F.month(day) < 4, 1).otherwise(0)
    region = F.when(F.col("o_orderstatus") == "F", "sao_paulo").when(F.col("o_orderstatus") == "O", "other_states").otherwise("centre_south")
    keys = (calendar.season_label(start).alias("season"), end.alias("period_end_date"), region.alias("region"))
    return orders.groupBy(*keys).agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("bigint").alias("crush_tonnes"))


HISTORY_SQL = f"""
  SELECT lpad(((y) % 100)::VARCHAR, 2, '0') || '-' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') AS season, e AS period_end_date, region, floor(sum(price))::BIGINT AS crush_tonnes
  FROM (SELECT o_totalprice::DECIMAL(12,2) AS price, year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END AS y,
               CASE WHEN day(o_orderdate) <= 15 THEN make_date(year(o_orderdate), month(o_orderdate), 15) ELSE last_day(o_orderdate::DATE) END AS e,
               CASE o_orderstatus WHEN 'F' THEN 'sao_paulo' WHEN 'O' THEN 'other_states' ELSE 'centre_south' END AS region
        FROM (SELECT * REPLACE ((o_orderdate + INTERVAL {SHIFT} YEAR)::DATE AS o_orderdate) FROM orders)) GROUP BY ALL
"""
