"""Queries of agronomic features."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import agronomy
from ..sources import shared
from . import stages
from .catalog import _STATES, _WEATHER, _rounded, query
from .panel import DAILY_SQL, HISTORY_SQL, daily, table
from .panel import history as harvest

_FRAME = "(PARTITION BY ibge_code ORDER BY date RANGE BETWEEN INTERVAL {} DAYS PRECEDING AND INTERVAL {} DAYS {})"


def _rolling_sql(last: int) -> str:
    parts = []
    for f in agronomy.ROLLING:
        frame = _FRAME.format(f.days - 1 + last, last, "PRECEDING")
        own = {"sum": f"sum({f.column}::DECIMAL(18,4)) OVER {frame}::DOUBLE", "mean": f"sum({f.column}::DECIMAL(18,4)) OVER {frame}::DOUBLE / count(*) OVER {frame}", "dry_days": f"count(*) FILTER ({f.column} <= 1.0) OVER {frame}"}[f.kind]
        parts += [f"{own} AS {f.name}", f"count(*) OVER {frame} AS observed_{f.days}d"]
    return f"WITH d AS ({DAILY_SQL}) SELECT ibge_code, date, {', '.join(parts)} FROM d"


@query(_rolling_sql(0))
def rolling_weather(spark, sf_dir):
    """Windows of 30 to 150 days up to each day of every station, with gaps."""
    return agronomy.rolling(daily(spark, sf_dir))


@query(f"SELECT * REPLACE (CASE WHEN observed_90d > 0 THEN temperature_previous_90d END AS temperature_previous_90d, CASE WHEN observed_150d > 0 THEN temperature_maturation_150d END AS temperature_maturation_150d) FROM ({_rolling_sql(1)})")
def rolling_weather_before(spark, sf_dir):
    """The same, up to the day before."""
    return agronomy.rolling(daily(spark, sf_dir), today=False)


#: Stages of a region: start and end, later by its number of months.
_STAGES = (("establishment", 9, 1, 11, 15), ("grand growth", 11, 16, 3, 31), ("maturation", 3, 20, 7, 31), ("preharvest", 7, 2, 7, 31))


def _calendar(spark, sf_dir):
    stages = F.array(*(F.struct(F.lit(n).alias("stage"), *(F.lit(v).alias(c) for c, v in zip(("sm", "start_day", "em", "end_day"), at, strict=True))) for n, *at in _STAGES))
    rows = table(spark, sf_dir, "region").select(F.col("r_name").alias("state"), "r_regionkey", F.explode(stages).alias("s"))
    later = lambda c: ((F.col(f"s.{c}") + F.col("r_regionkey") - 1) % 12 + 1).cast("int")
    return rows.select("state", "s.stage", later("sm").alias("start_month"), F.col("s.start_day").alias("start_day"), later("em").alias("end_month"), F.col("s.end_day").alias("end_day"))


_DAY = "least(make_date({y}, {m}, 1) + ({d} - 1), last_day(make_date({y}, {m}, 1)))"


@query(f"""WITH d AS ({DAILY_SQL}), c AS (SELECT r_name AS state, stage, (sm + r_regionkey - 1) % 12 + 1 AS sm, sd, (em + r_regionkey - 1) % 12 + 1 AS em, ed
  FROM region, (VALUES {", ".join(f"('{n}', {', '.join(map(str, at))})" for n, *at in _STAGES)}) AS s(stage, sm, sd, em, ed)),
w AS (SELECT state, stage, y AS stage_year, {_DAY.format(y="y::INT", m="sm::INT", d="sd")} AS first, {_DAY.format(y="(y + CASE WHEN em < sm OR (em = sm AND ed < sd) THEN 1 ELSE 0 END)::INT", m="em::INT", d="ed")} AS last FROM c, range(2000, 2012) AS g(y)),
m AS (SELECT d.*, stage, stage_year FROM d JOIN w ON d.state = w.state AND d.date BETWEEN w.first AND w.last),
r AS (SELECT ibge_code, stage, stage_year, max(n) AS dry_spell FROM (SELECT ibge_code, stage, stage_year, count(*) AS n FROM (SELECT ibge_code, stage, stage_year, date - (row_number() OVER (PARTITION BY ibge_code, stage, stage_year ORDER BY date))::INT AS run FROM m WHERE PRECTOTCORR < 1.0) GROUP BY ibge_code, stage, stage_year, run) GROUP BY ALL)
SELECT m.ibge_code, m.state, m.stage, m.stage_year::INT AS stage_year, sum(PRECTOTCORR::DECIMAL(18,4))::DOUBLE AS rainfall, sum(T2M::DECIMAL(18,4))::DOUBLE / count(*) AS temperature, count(*) FILTER (PRECTOTCORR <= 1.0) AS dry_days, count(*) AS days, coalesce(max(dry_spell), 0)::BIGINT AS dry_spell
FROM m LEFT JOIN r ON r.ibge_code = m.ibge_code AND r.stage = m.stage AND r.stage_year = m.stage_year GROUP BY 1, 2, 3, 4""")
def stage_weather(spark, sf_dir):
    """Crop-stage windows of every station by its region's calendar, across the turn of the year."""
    return agronomy.stage_features(daily(spark, sf_dir), _calendar(spark, sf_dir))


@query(f"""WITH d AS ({DAILY_SQL}) SELECT ibge_code, year, month, sum(greatest(T2M::DECIMAL(18,4) - 30, 0))::DOUBLE AS growing_degree_days, count(*) FILTER (T2M > 45) AS hot_days, count(*) FILTER (T2M < 20) AS cool_days, max(T2M) AS max_temperature, min(T2M) AS min_temperature,
  count(*) FILTER (PRECTOTCORR > 1.5) AS heavy_rain_days, CASE WHEN count(*) FILTER (PRECTOTCORR > 1.0) > 0 THEN sum(PRECTOTCORR::DECIMAL(18,4))::DOUBLE / count(*) FILTER (PRECTOTCORR > 1.0) END AS rainfall_intensity,
  round(stddev_samp(PRECTOTCORR), 9) AS rainfall_variability, round(stddev_samp(RH2M), 9) AS humidity_std, count(*) FILTER (RH2M > 60) AS high_humidity_days, count(*) FILTER (RH2M < 20) AS low_humidity_days,
  count(*) FILTER (PRECTOTCORR IS NULL) AS rainfall_missing_days, count(*) FILTER (T2M IS NULL) AS temperature_missing_days, count(*) FILTER (RH2M IS NULL) AS humidity_missing_days FROM d GROUP BY 1, 2, 3""")
def weather_extremes(spark, sf_dir):
    """Degree-days, extremes and spread of every station and month."""
    made = agronomy.extremes(daily(spark, sf_dir), ["ibge_code", "year", "month"], base=30, hot=45, cool=20, heavy=1.5, humid=60, arid=20)
    return made.withColumns({c: F.round(c, 9) for c in ("rainfall_variability", "humidity_std")})


_VALUES = ("rainfall", "temperature", "dry_days", "maturation_temperature")
_PERIODS = f"""WITH d AS ({DAILY_SQL}), h AS (SELECT *, CASE region WHEN 'sao_paulo' THEN 'AMERICA' WHEN 'other_states' THEN 'EUROPE' END AS state,
  coalesce(lag(period_end_date) OVER (PARTITION BY season, region ORDER BY period_end_date) + 1, date_trunc('month', period_end_date)::DATE) AS first FROM ({HISTORY_SQL})),
s AS (SELECT state, date, sum(PRECTOTCORR::DECIMAL(18,4)) AS rain, count(*) FILTER (PRECTOTCORR <= 1.0) AS dry, sum(T2M::DECIMAL(18,4)) AS heat, count(*) AS n FROM d GROUP BY 1, 2),
p AS (SELECT h.season, h.period_end_date, h.region, h.state, crush_tonnes, sum(rain) FILTER (date >= h.first)::DOUBLE / sum(n) FILTER (date >= h.first) AS rainfall, sum(heat) FILTER (date >= h.first)::DOUBLE / sum(n) FILTER (date >= h.first) AS temperature,
  sum(dry) FILTER (date >= h.first)::DOUBLE / sum(n) FILTER (date >= h.first) AS dry_days, sum(heat) FILTER (date > h.period_end_date - 150)::DOUBLE / sum(n) FILTER (date > h.period_end_date - 150) AS maturation_temperature
  FROM h JOIN s ON s.state = h.state AND s.date <= h.period_end_date AND s.date >= least(h.first, h.period_end_date - 149) GROUP BY ALL)"""


@query(f"{_PERIODS} SELECT * REPLACE ({', '.join(f'round({v}, 9) AS {v}' for v in _VALUES)}) FROM p")
def harvest_period_weather(spark, sf_dir):
    """Weather of every harvest period, and of the 150 days before its end."""
    return _rounded(agronomy.harvest_periods(daily(spark, sf_dir), harvest(spark, sf_dir), _STATES))


_WEIGHTED = ", ".join(f"round(sum(crush_tonnes::DECIMAL(14,0) * {v}::DECIMAL(22,12))::DOUBLE / sum(crush_tonnes) FILTER ({v} IS NOT NULL)::DOUBLE, 6) AS harvest_weighted_{v}" for v in _VALUES)


@query(f"{_PERIODS} SELECT state, season, {_WEIGHTED} FROM p GROUP BY 1, 2 UNION ALL SELECT NULL, season, {_WEIGHTED} FROM p GROUP BY 2 UNION ALL SELECT NULL, NULL, {_WEIGHTED} FROM p")
def harvest_weighted_weather(spark, sf_dir):
    """Weather weighted by harvest: of states and seasons, of seasons, and of all, each from the parts of the level before."""
    periods = agronomy.harvest_periods(daily(spark, sf_dir), harvest(spark, sf_dir), _STATES)
    low = agronomy.weighted_sums(periods, ["state", "season"], "crush_tonnes", _VALUES)
    middle = agronomy.summed_up(low, ["season"], _VALUES)
    top = agronomy.summed_up(middle, [], _VALUES)
    levels = (low, middle.withColumn("state", F.lit(None).cast("string")), top.withColumns({c: F.lit(None).cast("string") for c in ("state", "season")}))
    made = [agronomy.weighted_means(s, _VALUES) for s in levels]
    return _rounded(made[0].unionByName(made[1]).unionByName(made[2]), 6)


_RUN_DAYS = f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ibge_code, year, month) AS n FROM ({DAILY_SQL})) WHERE n > 1"
_RUN = f"""{_WEATHER.replace(DAILY_SQL, _RUN_DAYS)}, h AS (SELECT *, 2000 + substr(season, 1, 2)::INT AS y FROM ({HISTORY_SQL}) WHERE region = 'sao_paulo'),
k AS (SELECT h.*, (SELECT period_end_date FROM h ORDER BY y DESC, period_end_date DESC LIMIT 1) AS r FROM h),
o AS (SELECT DISTINCT season FROM k WHERE period_end_date <= make_date(y, month(r), day(r))),
j AS (SELECT harvest_season, has_complete_growing_season AS whole FROM ws JOIN o ON season = harvest_season WHERE state = 'AMERICA'),
f AS (SELECT DISTINCT ibge_code, CASE WHEN month >= 9 THEN year + 1 ELSE year END AS y FROM d WHERE month >= 9 OR month <= 4)"""


@query(f"""{_RUN} SELECT 1 AS place, 'monthly weather' AS stage, 'done' AS state, 1 AS runs, NULL AS error, 'monthly' AS output, (SELECT count(*) FROM m) AS rows
UNION ALL SELECT 2, 'growing-season features', 'done', 1, NULL, 'season_features', (SELECT count(*) FROM f)
UNION ALL SELECT 3, 'weather and harvest', 'done', 2, NULL, 'weather_harvest', (SELECT count(*) FROM j)
UNION ALL SELECT 4, 'season panel', 'done', 1, NULL, 'panel', 8
UNION ALL SELECT 5, 'season comparison', 'done', 1, NULL, 'comparison/table', (SELECT count(*) FROM j WHERE whole)
UNION ALL SELECT 5, 'season comparison', 'done', 1, NULL, 'comparison/ranks', CASE WHEN (SELECT count(*) FROM j WHERE whole) > 0 THEN 4 ELSE 0 END
UNION ALL SELECT 5, 'season comparison', 'done', 1, NULL, 'comparison/trend', 4 * (SELECT count(*) FROM j WHERE whole)""")
def resumed_run(spark, sf_dir):
    """The five stages over the whole panel: a run whose third stage fails, then one that goes on from there; what the manifests say."""
    days = daily(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ibge_code", "year", "month"))).where("n > 1").drop("n", "year", "month")
    state = F.when(F.col("state") == "AMERICA", "SP").otherwise(F.col("state"))

    def broken(session, root):
        raise RuntimeError("The third stage fails.")

    third = stages.STAGES[2]
    with shared.scratch(spark) as root:
        days.withColumn("state", state).withColumnRenamed("date", "Date").write.parquet(f"{root}/daily")
        harvest(spark, sf_dir).where("region = 'sao_paulo'").write.parquet(f"{root}/history")
        said: list[str] = []
        try:
            stages.run(spark, root, (*stages.STAGES[:2], replace(third, function=broken), *stages.STAGES[3:]), said.append)
        except RuntimeError:
            assert stages.manifest(root, third)["state"] == "failed" and len(said) == 3
        stages.run(spark, root, say=said.append)
        assert [line.endswith("unchanged") for line in said[3:8]] == [True, True, False, False, False]
        return stages.manifests(spark, root)
