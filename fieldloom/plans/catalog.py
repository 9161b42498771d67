"""Registered queries of the panel engine and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar, formats, text
from ..operators import contracts, features, history, ranking, reports, rollup, tables, words
from ..sources import files, shared, sinks, weather
from .panel import DAILY_SQL, HISTORY_SQL, SHIFT, daily, moved, table
from .panel import history as harvest

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Register a function under its name, with SQL for the same rows."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def _runs(keys: str, source: str, value: str = "PRECTOTCORR") -> str:
    """SQL of the longest dry spell by keys."""
    return f"""SELECT {keys}, max(n) AS cdd FROM (SELECT {keys}, count(*) AS n FROM (SELECT {keys}, date - (row_number() OVER (PARTITION BY {keys} ORDER BY date))::INT AS run FROM {source} WHERE {value} < 1.0) GROUP BY {keys}, run) GROUP BY {keys}"""


_SEASON = f"""WITH d AS ({DAILY_SQL}), s AS (SELECT *, CASE WHEN month >= 9 THEN year + 1 ELSE year END AS harvest_year FROM d WHERE month >= 9 OR month <= 4),
c AS ({_runs("ibge_code, harvest_year", "s")})"""


@query(f"""{_SEASON}
SELECT s.ibge_code, municipality, state, s.harvest_year, round_even(sum(PRECTOTCORR::DECIMAL(18,2))::DOUBLE, 2) AS growing_season_total_rainfall, round_even(avg(T2M), 2) AS growing_season_average_temperature,
  count(*) AS growing_season_observation_days, min(date) AS growing_season_start_date, max(date) AS growing_season_end_date, coalesce(max(cdd), 0)::BIGINT AS growing_season_max_consecutive_dry_days
FROM s LEFT JOIN c ON s.ibge_code = c.ibge_code AND s.harvest_year = c.harvest_year GROUP BY 1, 2, 3, 4""")
def growing_season_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.growing_season_features(daily(spark, sf_dir))


_MONTH = f"""WITH d AS ({DAILY_SQL}), c AS ({_runs("ibge_code, year, month", "d")}),
m AS (SELECT d.ibge_code, municipality, state, latitude, longitude, d.year, d.month, round_even(sum(PRECTOTCORR::DECIMAL(18,2))::DOUBLE, 2) AS total_rainfall, round_even(avg(T2M), 2) AS average_temperature,
  round_even(avg(RH2M), 2) AS average_humidity, count(*) FILTER (PRECTOTCORR > 1.0) AS rainy_days, count(*) FILTER (PRECTOTCORR <= 1.0) AS dry_days, round_even(max(PRECTOTCORR), 2) AS max_daily_rainfall,
  round_even(stddev_samp(T2M), 2) AS temperature_std, count(*) AS weather_observation_days, coalesce(max(cdd), 0)::BIGINT AS max_consecutive_dry_days
  FROM d LEFT JOIN c ON d.ibge_code = c.ibge_code AND d.year = c.year AND d.month = c.month GROUP BY ALL),
w AS (SELECT *, (day(last_day(make_date(year, month, 1))) - weather_observation_days)::BIGINT AS missing_weather_days,
  round_even(weather_observation_days / day(last_day(make_date(year, month, 1))), 4) AS weather_coverage_ratio,
  day(last_day(make_date(year, month, 1))) = weather_observation_days AS has_complete_weather_period FROM m)"""


@query(f"{_MONTH} SELECT * FROM m")
def monthly_features(spark, sf_dir):
    return features.monthly_features(daily(spark, sf_dir))


def _monthly(spark, sf_dir):
    return features.with_coverage(features.monthly_features(daily(spark, sf_dir)))


@query(f"{_MONTH} SELECT * FROM w")
def weather_coverage(spark, sf_dir):
    return _monthly(spark, sf_dir)


@query(f"WITH d AS ({DAILY_SQL}) {_runs('ibge_code, year, month', 'd')}".replace("max(n) AS cdd", "max(n) AS max_consecutive_dry_days"))
def cdd_monthly(spark, sf_dir):
    return features.longest_dry_spell(daily(spark, sf_dir), ["ibge_code", "year", "month"])


@query(f"{_SEASON} SELECT ibge_code, harvest_year, cdd AS max_consecutive_dry_days FROM c")
def cdd_season(spark, sf_dir):
    return features.longest_dry_spell(features.select_growing_season(daily(spark, sf_dir)), ["ibge_code", "harvest_year"])


@query(f"WITH d AS ({DAILY_SQL}) SELECT ibge_code, date, (month >= 9 OR month <= 4) AS is_growing_season, (CASE WHEN month >= 9 THEN year + 1 WHEN month <= 4 THEN year END)::INT AS harvest_year FROM d")
def growing_season_annotation(spark, sf_dir):
    return features.annotate_growing_season(daily(spark, sf_dir)).select("ibge_code", "date", "is_growing_season", "harvest_year")


@query(f"{_SEASON} SELECT DISTINCT ibge_code, harvest_year FROM s WHERE harvest_year IN (2005, 2006)")
def output_harvest_years(spark, sf_dir):
    return features.of_harvest_years(features.growing_season_features(daily(spark, sf_dir)), [2005, 2006]).select("ibge_code", "harvest_year")


_STATE = f"""{_MONTH}, st AS (SELECT state, year, month, count(DISTINCT ibge_code) AS municipality_count, avg(total_rainfall) AS average_municipality_rainfall, avg(average_temperature) AS average_temperature,
  avg(average_humidity) AS average_humidity, avg(rainy_days) AS average_rainy_days, avg(dry_days) AS average_dry_days, max(max_daily_rainfall) AS state_max_daily_rainfall, avg(temperature_std) AS average_temperature_std,
  avg(max_consecutive_dry_days) AS average_max_consecutive_dry_days, max(max_consecutive_dry_days) AS state_max_consecutive_dry_days FROM w GROUP BY ALL)"""


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles at a fixed number of digits, so that the order of summing doesn't show."""
    return df.withColumns({n: F.round(n, digits) for n, kind in df.dtypes if kind == "double"})


_STATE_SELECT = """SELECT state, year, month, municipality_count, round(average_municipality_rainfall, 9) AS average_municipality_rainfall, round(average_temperature, 9) AS average_temperature, round(average_humidity, 9) AS average_humidity,
  round(average_rainy_days, 9) AS average_rainy_days, round(average_dry_days, 9) AS average_dry_days, round(state_max_daily_rainfall, 9) AS state_max_daily_rainfall, round(average_temperature_std, 9) AS average_temperature_std,
  round(average_max_consecutive_dry_days, 9) AS average_max_consecutive_dry_days, state_max_consecutive_dry_days FROM st"""


@query(f"{_STATE} {_STATE_SELECT}")
def state_month_rollup(spark, sf_dir):
    return _rounded(rollup.state_months(_monthly(spark, sf_dir)))


_WEATHER = f"""{_STATE}, g AS (SELECT *, CASE WHEN month >= 9 THEN year + 1 ELSE year END AS hy FROM st WHERE month >= 9 OR month <= 4),
ws AS (SELECT state, lpad((hy % 100)::VARCHAR, 2, '0') || '-' || lpad(((hy + 1) % 100)::VARCHAR, 2, '0') AS harvest_season, max(municipality_count) AS municipality_count, count(*) AS growing_season_month_count,
  sum(average_municipality_rainfall) AS total_growing_season_rainfall, avg(average_temperature) AS average_growing_season_temperature, avg(average_humidity) AS average_growing_season_humidity,
  sum(average_rainy_days) AS total_growing_season_rainy_days, sum(average_dry_days) AS total_growing_season_dry_days, max(state_max_daily_rainfall) AS maximum_daily_rainfall, avg(average_temperature_std) AS average_temperature_std,
  avg(average_max_consecutive_dry_days) AS average_max_consecutive_dry_days, max(state_max_consecutive_dry_days) AS maximum_consecutive_dry_days, count(*) = 8 AS has_complete_growing_season FROM g GROUP BY state, hy)"""
_WS_ROUND = ("total_growing_season_rainfall", "average_growing_season_temperature", "average_growing_season_humidity", "total_growing_season_rainy_days", "total_growing_season_dry_days", "maximum_daily_rainfall", "average_temperature_std", "average_max_consecutive_dry_days")
_WS_REPLACE = "* REPLACE (" + ", ".join(f"round({c}, 9) AS {c}" for c in _WS_ROUND) + ")"


@query(f"{_WEATHER} SELECT {_WS_REPLACE} FROM ws")
def season_rollup(spark, sf_dir):
    return _rounded(rollup.weather_summary(_monthly(spark, sf_dir)))


# Regions of the bench tables stand for the states of the harvest regions.
_STATES = {"sao_paulo": "AMERICA", "other_states": "EUROPE"}
_HARVEST = f"""h AS ({HISTORY_SQL}), hs AS (SELECT *, CASE region WHEN 'sao_paulo' THEN 'AMERICA' ELSE 'EUROPE' END AS state, 2000 + substr(season, 1, 2)::INT AS y FROM h WHERE region <> 'centre_south'),
rf AS (SELECT period_end_date AS r FROM hs ORDER BY y DESC, period_end_date DESC LIMIT 1),
hc AS (SELECT hs.*, make_date(y, month(r), day(r)) AS matched_cutoff_date FROM hs, rf),
hsum AS (SELECT state, season AS harvest_season, max(period_end_date) AS latest_report_date, max(matched_cutoff_date) AS matched_cutoff_date, sum(crush_tonnes)::BIGINT AS cumulative_crush_tonnes, count(*) AS harvest_period_count
  FROM hc WHERE period_end_date <= matched_cutoff_date GROUP BY 1, 2)"""


@query(f"WITH {_HARVEST} SELECT * FROM hsum")
def matched_cutoff(spark, sf_dir):
    return rollup.harvest_summary(harvest(spark, sf_dir), _STATES)


def _seasons(spark, sf_dir):
    return rollup.weather_harvest(rollup.weather_summary(_monthly(spark, sf_dir)), rollup.harvest_summary(harvest(spark, sf_dir), _STATES), checked=False)


_JOINED = f"""{_WEATHER}, {_HARVEST}, wh AS (SELECT state, harvest_season, make_date(2000 + substr(harvest_season, 1, 2)::INT - 1, 9, 1) AS growing_season_start, make_date(2000 + substr(harvest_season, 1, 2)::INT, 4, 30) AS growing_season_end,
  latest_report_date, matched_cutoff_date, municipality_count, growing_season_month_count, has_complete_growing_season, {", ".join(f"round({c}, 9) AS {c}" for c in _WS_ROUND)},
  maximum_consecutive_dry_days, harvest_period_count, cumulative_crush_tonnes, 'NASA POWER' AS weather_source, 'UNICA' AS harvest_source FROM ws JOIN hsum USING (state, harvest_season))"""


@query(f"{_JOINED} SELECT * FROM wh")
def weather_harvest_join(spark, sf_dir):
    return _rounded(_seasons(spark, sf_dir))


@query(f"{_JOINED} SELECT state, harvest_season, cumulative_crush_tonnes, rank() OVER (PARTITION BY state ORDER BY cumulative_crush_tonnes DESC) AS season_rank FROM wh")
def season_rank(spark, sf_dir):
    return _seasons(spark, sf_dir).select("state", "harvest_season", "cumulative_crush_tonnes", ranking.descending_rank("cumulative_crush_tonnes", ["state"]).cast("bigint").alias("season_rank"))


_TREND_SQL = " UNION ALL ".join(f"SELECT state, harvest_season, '{t}' AS metric, '{u}' AS unit, {c}::DOUBLE / {s} AS value FROM wh" for c, t, u, s in ranking.TREND)


@query(f"{_JOINED}, tr AS ({_TREND_SQL}) SELECT * REPLACE (round(value, 9) AS value) FROM tr")
def trend_series(spark, sf_dir):
    return _rounded(ranking.trend(_rounded(_seasons(spark, sf_dir))))


@query(f"""{_JOINED}, tr AS ({_TREND_SQL}), rk AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY value DESC) AS rank, count(*) OVER (PARTITION BY metric) AS total,
  row_number() OVER (PARTITION BY metric ORDER BY state DESC, harvest_season DESC) AS n FROM tr)
SELECT state, harvest_season, metric, unit, round(value, 9) AS value, rank, total, rank || CASE WHEN rank % 100 BETWEEN 10 AND 20 THEN 'th' WHEN rank % 10 = 1 THEN 'st' WHEN rank % 10 = 2 THEN 'nd' WHEN rank % 10 = 3 THEN 'rd' ELSE 'th' END AS rank_text,
  CASE WHEN rank <= 2 THEN '#2E7D32' WHEN rank >= total - 1 THEN '#C62828' ELSE '#616161' END AS color FROM rk WHERE n = 1""")
def rank_panel(spark, sf_dir):
    return _rounded(ranking.rank_panel(_rounded(_seasons(spark, sf_dir))))


def _number_sql(column: str, decimals: int, scale: float, unit: str = "") -> str:
    return f"format('{{{{:,.{decimals}f}}}}', {column}::DOUBLE / {scale})" + (f" || ' {unit}'" if unit else "")


@query(f"{_JOINED} SELECT state, harvest_season, " + ", ".join(f"{_number_sql(c, d, s)} AS {c}" for c, _, d, s in ranking.TABLE).replace("{{", "{").replace("}}", "}") + " FROM wh")
def season_table(spark, sf_dir):
    return ranking.season_table(_rounded(_seasons(spark, sf_dir)))


_PANEL_SQL = " UNION ALL ".join(f"SELECT state, harvest_season, growing_season_start, growing_season_end, latest_report_date, '{t}' AS metric, {_number_sql(c, d, s, u)} AS value FROM n" for c, t, u, d, s in ranking.PANEL).replace("{{", "{").replace("}}", "}")
_DATES = ("growing_season_start", "growing_season_end", "latest_report_date")


@query(f"{_JOINED}, n AS (SELECT * REPLACE ({', '.join(f'{c}::DATE::VARCHAR AS {c}' for c in _DATES)}) FROM wh ORDER BY state DESC, harvest_season DESC LIMIT 1) {_PANEL_SQL}")
def season_panel(spark, sf_dir):
    return ranking.season_panel(_rounded(_seasons(spark, sf_dir)))


@query(f"{_JOINED} SELECT strftime(matched_cutoff_date, '%B %d') AS cutoff FROM wh ORDER BY state DESC, harvest_season DESC LIMIT 1")
def cutoff_note(spark, sf_dir):
    return ranking.cutoff_note(_seasons(spark, sf_dir))


# Scalar functions over the bench tables.

_ORDER = f"SELECT o_orderkey, d, year(d)::INT AS y, month(d)::INT AS m, o_totalprice AS p, o_orderstatus AS s, o_orderpriority AS q FROM (SELECT *, (o_orderdate + INTERVAL {SHIFT} YEAR)::DATE AS d FROM orders)"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", moved("o_orderdate").alias("d"), F.year(moved("o_orderdate")).alias("y"), F.month(moved("o_orderdate")).alias("m"), F.col("o_totalprice").alias("p"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("q"))


@query(f"SELECT o_orderkey, lpad((h % 100)::VARCHAR, 2, '0') || '-' || lpad(((h + 1) % 100)::VARCHAR, 2, '0') AS season, h AS start_year FROM (SELECT o_orderkey, CASE WHEN m >= 9 THEN y + 1 ELSE y END AS h FROM ({_ORDER}) WHERE (m >= 9 OR m <= 4))")
def harvest_season_label(spark, sf_dir):
    chosen = _orders(spark, sf_dir).where(calendar.in_growing_season(F.col("m")))
    return chosen.select("o_orderkey", calendar.assigned_season(F.col("y"), F.col("m")).alias("season")).withColumn("start_year", calendar.season_start_year(F.col("season")))


@query(f"""SELECT o_orderkey, lpad((y % 100)::VARCHAR, 2, '0') || '-' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') AS season FROM ({_ORDER})""")
def season_spellings(spark, sf_dir):
    """Three spellings of a season, by order key, to one label."""
    y = F.col("y").cast("string")
    after = (F.col("y") + 1).cast("string")
    spelt = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws("/", y, after)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" "), y, F.lit("/"), F.right(after, F.lit(2)))).otherwise(F.concat(F.right(y, F.lit(2)), F.lit("-"), F.right(after, F.lit(2)), F.lit(" ")))
    return _orders(spark, sf_dir).select("o_orderkey", text.harvest_season(spelt).alias("season"))


@query(f"SELECT o_orderkey, make_date(y + CASE WHEN m >= 4 THEN 0 ELSE 1 END, m, 16) AS period_end_date FROM ({_ORDER})")
def period_end_date(spark, sf_dir):
    made = _orders(spark, sf_dir).select("o_orderkey", calendar.season_label(F.col("y")).alias("season"), F.concat(F.lit("16/"), F.lpad(F.col("m").cast("string"), 2, "0")).alias("period"))
    return made.select("o_orderkey", calendar.period_end_date(F.col("season"), F.col("period")).alias("period_end_date"))


@query(f"WITH h AS ({HISTORY_SQL}) SELECT season, period_end_date, region, crush_tonnes FROM h")
def cumulative_to_period(spark, sf_dir):
    """Running totals of the history and back."""
    window = Window.partitionBy("season", "region").orderBy("period_end_date")
    totals = harvest(spark, sf_dir).withColumn("cumulative_crush_tonnes", F.sum("crush_tonnes").over(window)).drop("crush_tonnes")
    return reports.per_period(totals, checked=False)


def _split_history(spark, sf_dir):
    """The history up to a day, and a report that overlaps it, with a value changed every eleventh day."""
    every = harvest(spark, sf_dir).where("region <> 'centre_south'")
    old = every.where("period_end_date < DATE '2009-03-01'")
    new = every.where("period_end_date >= DATE '2009-01-01'")
    return old, new


_SPLIT = f"WITH h AS (SELECT * FROM ({HISTORY_SQL}) WHERE region <> 'centre_south'), o AS (SELECT * FROM h WHERE period_end_date < DATE '2009-03-01'), n AS (SELECT * FROM h WHERE period_end_date >= DATE '2009-01-01')"


@query(f"{_SPLIT}, c AS (SELECT * REPLACE (CASE WHEN crush_tonnes % 2 = 0 THEN crush_tonnes + 1 ELSE crush_tonnes END AS crush_tonnes) FROM n) SELECT o.season, o.period_end_date, o.region, o.crush_tonnes AS crush_tonnes_history, c.crush_tonnes AS crush_tonnes_report FROM o JOIN c USING (season, period_end_date, region) WHERE o.crush_tonnes <> c.crush_tonnes")
def history_conflicts(spark, sf_dir):
    old, new = _split_history(spark, sf_dir)
    changed = new.withColumn("crush_tonnes", F.when(F.col("crush_tonnes") % 2 == 0, F.col("crush_tonnes") + 1).otherwise(F.col("crush_tonnes")))
    return history.conflicts(old, changed)


@query(f"{_SPLIT} SELECT n.* FROM n ANTI JOIN o USING (season, period_end_date, region)")
def history_new(spark, sf_dir):
    return history.additions(*_split_history(spark, sf_dir))


@query(f"{_SPLIT} SELECT * FROM h")
def history_append(spark, sf_dir):
    return history.update(*_split_history(spark, sf_dir)).combined


@query("SELECT l_orderkey, l_linenumber, max_by(l_partkey, q) AS l_partkey FROM (SELECT *, l_partkey * 100000000 + l_suppkey * 1000 + l_quantity::INT AS q FROM lineitem) GROUP BY 1, 2")
def keep_last_dedup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") * 100000000 + F.col("l_suppkey") * 1000 + F.col("l_quantity").cast("int")).alias("q"))
    return history.keep_last(lines, ["l_orderkey", "l_linenumber"], "q").drop("q")


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return contracts.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS repeated,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) > 1 AS again FROM lineitem""")
def dup_mask(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return contracts.repeat_masks(lines, ["l_orderkey", "l_linenumber"], ["l_partkey"])


@query("SELECT s AS state, harvest_year, production_thousand_tonnes FROM (SELECT o_orderstatus AS s, (year(o_orderdate) + 8)::VARCHAR AS harvest_year, sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS production_thousand_tonnes FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2)")
def unpivot_production(spark, sf_dir):
    """Yearly totals of each status as a wide sheet, and back to rows."""
    # Spark takes the years from the table.
    wide = _orders(spark, sf_dir).groupBy(F.col("s").alias("Estado/Safra")).pivot("y").agg(F.sum(F.col("p").cast("decimal(12,2)")).cast("double"))
    return tables.state_production(wide, ["F", "O"])


@query(f"SELECT o_orderkey, CASE s WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE s END AS status, CASE s WHEN 'F' THEN 'SP' END AS state FROM ({_ORDER}) WHERE q IN ('1-URGENT', '2-HIGH') AND s NOT IN ('X')")
def value_maps(spark, sf_dir):
    chosen = _orders(spark, sf_dir).where(F.col("q").isin("1-URGENT", "2-HIGH") & ~F.col("s").isin("X"))
    return chosen.select("o_orderkey", text.mapped(F.col("s"), {"F": "finished", "O": "open"}).alias("status"), text.mapped(F.col("s"), {"F": "SP"}, keep=False).alias("state"))


@query(f"SELECT o_orderkey, floor(p)::BIGINT AS n FROM ({_ORDER})")
def brazilian_number_parse(spark, sf_dir):
    grouped = F.replace(F.format_number(F.floor("p"), 0), F.lit(","), F.lit("."))
    return _orders(spark, sf_dir).select("o_orderkey", text.brazilian_integer(F.concat(F.lit(" "), grouped, F.lit("\t"))).alias("n"))


@query(f"SELECT o_orderkey, floor(p)::BIGINT AS previous, floor(p)::BIGINT * 2 AS current, (o_orderkey % 100) + 0.5::DOUBLE AS variation_percent FROM ({_ORDER})")
def region_cell_parse(spark, sf_dir):
    dotted = lambda c: F.replace(F.format_number(c, 0), F.lit(","), F.lit("."))
    cell = F.concat(dotted(F.floor("p")), F.lit("  "), dotted(F.floor("p") * 2), F.lit(" "), (F.col("o_orderkey") % 100).cast("string"), F.lit(",5%"))
    return _orders(spark, sf_dir).select("o_orderkey", text.region_cell(cell).alias("v")).select("o_orderkey", "v.*")


@query(f"SELECT o_orderkey, lpad((y % 100)::VARCHAR, 2, '0') || '-' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') AS previous, lpad(((y + 1) % 100)::VARCHAR, 2, '0') || '-' || lpad(((y + 2) % 100)::VARCHAR, 2, '0') AS current FROM ({_ORDER})")
def header_labels(spark, sf_dir):
    pair = lambda k: F.concat_ws("/", (F.col("y") + k).cast("string"), (F.col("y") + k + 1).cast("string"))
    cells = F.array(F.lit("Período"), pair(0), F.lit(None).cast("string"), F.concat(pair(1), F.lit(" "), pair(0)))
    return _orders(spark, sf_dir).select("o_orderkey", text.header_seasons(cells).alias("v")).select("o_orderkey", "v.*")


@query("SELECT * FROM (SELECT 'doc_id' AS \"column\", count(*) FILTER (d.doc_id IS NULL) AS missing FROM documents d UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")
def null_profile(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return contracts.missing_counts(both)


@query(f"""SELECT count(*) AS rows, 3 AS columns, count(*) - count(DISTINCT (s, q, d)) AS duplicate_rows, min(d) AS first_date, max(d) AS last_date,
  count(*) FILTER (s IS NULL) AS missing_s, count(*) FILTER (q IS NULL) AS missing_q, count(*) FILTER (d IS NULL) AS missing_d
FROM (SELECT nullif(s, 'P') AS s, q, CASE WHEN month(d) = 5 THEN NULL ELSE d END AS d FROM ({_ORDER}))""")
def summary_profile(spark, sf_dir):
    """The summary of orders, whose status P and days in May are missing."""
    orders = _orders(spark, sf_dir).select(F.nullif("s", F.lit("P")).alias("s"), "q", F.when(F.month("d") != 5, F.col("d")).alias("d"))
    return sinks.summary(orders, "d").select("*", *(F.col("missing")[c].alias(f"missing_{c}") for c in ("s", "q", "d"))).drop("missing")


@query("SELECT n_name AS municipality, 'SP' AS state, n_nationkey::BIGINT AS ibge_code, n_nationkey * 1.5::DOUBLE AS latitude, n_nationkey * -2.5::DOUBLE AS longitude FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def metadata_left_join(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    production = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("municipality"))
    places = nations.select(F.lit(35).alias("codigo_uf"), F.col("n_name").alias("nome"), F.col("n_nationkey").alias("codigo_ibge"), (F.col("n_nationkey") * 1.5).cast("double").alias("latitude"), (F.col("n_nationkey") * -2.5).cast("double").alias("longitude"))
    return tables.station_metadata(production, places)


@query(f"SELECT n_nationkey AS ibge_code, strptime(day, '%Y%m%d')::DATE AS Date, t AS T2M, r AS PRECTOTCORR FROM (SELECT n_nationkey, '20240101' AS day, n_nationkey + 0.5 AS t, n_nationkey * 2.0 AS r FROM nation UNION ALL SELECT n_nationkey, '20240102', n_nationkey + 1.5, NULL FROM nation)".replace("n_nationkey + 0.5", "(n_nationkey + 0.5)::DOUBLE").replace("n_nationkey * 2.0", "(n_nationkey * 2.0)::DOUBLE").replace("n_nationkey + 1.5", "(n_nationkey + 1.5)::DOUBLE"))
def json_map_align(spark, sf_dir):
    """A parameter that lacks a date is null on it."""
    key = F.col("n_nationkey")
    body = F.format_string('{"properties":{"parameter":{"T2M":{"20240101":%s,"20240102":%s},"PRECTOTCORR":{"20240101":%s}}}}', (key + 0.5).cast("string"), (key + 1.5).cast("string"), (key * 2.0).cast("string"))
    answers = table(spark, sf_dir, "nation").select(key.alias("ibge_code"), body.alias("body"))
    return weather.daily_rows(answers, ["T2M", "PRECTOTCORR"])


@query("SELECT * FROM (SELECT doc, row_idx, cells[1] AS c0, cells[2] AS c1, cells[3] AS c2, cells[4] AS c3 FROM (SELECT item_id AS doc, 0 AS row_idx, ['', 'CANA-DE-AÇÚCAR (toneladas)', NULL, NULL] AS cells FROM benchmark UNION ALL SELECT item_id, 1, ['Quinzena', 'São Paulo', 'Centro-Sul', 'Demais Estados'] FROM benchmark UNION ALL SELECT item_id, 2, [NULL, '2025/2026 2026/2027', '2025/2026 2026/2027', '2025/2026 2026/2027'] FROM benchmark UNION ALL SELECT item_id, 3, ['16/04', (item_id + 8000) || '.000', '11.000.000', '3.000.000'] FROM benchmark UNION ALL SELECT item_id, 4, ['01/05', '10.000.000', '13.000.000', '3.000.000'] FROM benchmark))")
def table_rows_from_words(spark, sf_dir):
    """One page for each benchmark item, its first number from the item."""
    header = [("Quinzena", 10, 30, 10), ("São", 100, 115, 10), ("Paulo", 118, 140, 10), ("Centro-Sul", 220, 270, 10), ("Demais", 340, 370, 10), ("Estados", 374, 410, 10)]
    seasons = [(f"{y}/{y + 1}", a, b, top) for y, top in ((2025, 30), (2026, 31)) for a, b in ((95, 145), (215, 275), (340, 410))]
    data = [("16/04", 10, 35, 50), ("?", 100, 150, 50), ("11.000.000", 220, 280, 50), ("3.000.000", 345, 400, 50), ("01/05", 10, 35, 70), ("10.000.000", 100, 155, 70), ("13.000.000", 220, 280, 70), ("3.000.000", 345, 400, 70)]
    rows = F.array(*(F.struct(F.lit(k).alias("word_idx"), F.lit(t).alias("text"), *(F.lit(float(v)).alias(n) for n, v in zip(("x0", "x1", "top"), at, strict=True))) for k, (t, *at) in enumerate(header + seasons + data)))
    placed = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"), F.lit(0).alias("page"), F.explode(rows).alias("w")).select("doc", "page", "w.*")
    placed = placed.withColumn("text", F.when(F.col("text") == "?", F.concat((F.col("doc") + 8000).cast("string"), F.lit(".000"))).otherwise(F.col("text")))
    return words.tables(placed).select("doc", "row_idx", *(F.get("cells", F.lit(k)).alias(f"c{k}") for k in range(4)))


@query(f"SELECT y AS _year, o_orderkey, p::DOUBLE AS price, d AS day FROM ({_ORDER})")
def year_union_scan(spark, sf_dir):
    """All orders written as one file for each year, and read again as one table."""
    every = _orders(spark, sf_dir).select("y", "o_orderkey", F.col("p").cast("double").alias("price"), F.col("d").alias("day"))
    with shared.scratch(spark) as folder:
        years = [int(y) for y in sinks.save_by(every, folder, "y")]
        return shared.keep(files.read_years(spark, folder, years, "o_orderkey bigint, price double, day date"))


@query("SELECT nation.*, s AS number_text FROM nation, (SELECT 1) LEFT JOIN (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 100 BETWEEN 10 AND 20 THEN n_nationkey || 'th' WHEN n_nationkey % 10 = 1 THEN n_nationkey || 'st' WHEN n_nationkey % 10 = 2 THEN n_nationkey || 'nd' WHEN n_nationkey % 10 = 3 THEN n_nationkey || 'rd' ELSE n_nationkey || 'th' END AS s FROM nation) ON k = n_nationkey")
def ordinals(spark, sf_dir):
    return table(spark, sf_dir, "nation").withColumn("number_text", formats.ordinal(F.col("n_nationkey")))


@query(f"WITH h AS ({HISTORY_SQL}) SELECT season, region, count(*) AS periods FROM h GROUP BY 1, 2")
def checked_report(spark, sf_dir):
    """The whole contract of a report, then its size by season and region."""
    report = harvest(spark, sf_dir).withColumn("variation_percent", F.lit(0.0))
    return contracts.check_report(report).groupBy("season", "region").agg(F.count(F.lit(1)).alias("periods"))


@query("SELECT c_custkey, c_mktsegment AS region, c_name AS season FROM customer")
def translated_headers(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), F.col("c_mktsegment")).alias("REGIÃO"), F.col("c_name").alias("Safra"))
    return tables.translate(raw)


from . import intake, passes, seasons, violations  # noqa: E402, F401 - register their queries
