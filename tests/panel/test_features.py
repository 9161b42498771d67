import datetime
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import contracts, features, rollup


def day(text):
    return datetime.date.fromisoformat(text)


def daily(spark, rows):
    """rows: (code, date, rain, temperature)"""
    made = [(day(d), float(p) if p is not None else None, float(t), 70.0, f"M{c}", c, "SP", 1.0, 2.0) for c, d, p, t in rows]
    return spark.createDataFrame(made, "Date date, PRECTOTCORR double, T2M double, RH2M double, municipality string, ibge_code bigint, state string, latitude double, longitude double")


@pytest.mark.parametrize(
    "rain, dates, longest",
    [
        ((0.0, 0.5, 0.8, 3.0), ("2020-01-01", "2020-01-02", "2020-01-03", "2020-01-04"), 3),
        ((0.0, 0.5, 0.8, 0.2), ("2020-01-01", "2020-01-02", "2020-01-03", "2020-02-01"), 3),
        ((0.0, 1.0, 0.0), ("2020-01-01", "2020-01-02", "2020-01-03"), 1),
        ((2.0, 3.0, 5.0), ("2020-01-01", "2020-01-02", "2020-01-03"), None),
        ((), (), None),
    ],
)
def test_dry_spells(spark, rain, dates, longest):
    rows = [(1, d, p, 20) for p, d in zip(rain, dates, strict=True)]
    random.Random(1).shuffle(rows)
    found = features.longest_dry_spell(features.with_calendar(daily(spark, rows)).repartition(3), ["ibge_code"]).collect()
    assert [r.max_consecutive_dry_days for r in found] == ([longest] if longest else [])


def test_season_features(spark):
    dates = [f"2019-09-0{k}" for k in range(1, 6)] + [f"2020-01-0{k}" for k in range(1, 6)]
    rain = (0.0, 0.2, 0.5, 3.0, 0.0, 0.0, 0.4, 0.8, 2.0, 0.0)
    rows = [(3500105, d, p, 20 + k) for k, (d, p) in enumerate(zip(dates, rain, strict=True))] + [(3500105, "2020-06-01", 0.0, 9)]
    found = features.growing_season_features(features.with_calendar(daily(spark, rows))).collect()
    assert len(found) == 1
    r = found[0]
    assert (r.harvest_year, r.growing_season_total_rainfall, r.growing_season_average_temperature, r.growing_season_observation_days, r.growing_season_max_consecutive_dry_days) == (2020, 6.9, 24.5, 10, 3)
    assert (str(r.growing_season_start_date), str(r.growing_season_end_date)) == ("2019-09-01", "2020-01-05")


def test_months_keep_both_thresholds(spark):
    rows = [(1, "2020-01-30", 0.0, 20), (1, "2020-01-31", 0.5, 22), (1, "2020-02-01", 1.0, 20), (1, "2020-02-02", 0.0, 21), (1, "2020-02-03", 4.0, 23)]
    found = {r.month: r for r in features.build_monthly(daily(spark, rows)).collect()}
    # A day of exactly 1.0 is dry and yet ends a spell; spells end with the month.
    assert (found[1].dry_days, found[1].max_consecutive_dry_days, found[1].rainy_days) == (2, 2, 0)
    assert (found[2].dry_days, found[2].max_consecutive_dry_days, found[2].rainy_days, found[2].missing_weather_days) == (2, 1, 1, 26)
    assert found[2].weather_coverage_ratio == 0.1034 and not found[2].has_complete_weather_period


def test_wet_month_has_no_spell(spark):
    found = features.monthly_features(features.with_calendar(daily(spark, [(1, "2020-01-01", 9, 20), (1, "2020-01-02", 9, 21)]))).first()
    assert found.max_consecutive_dry_days == 0 and found.dry_days == 0


@pytest.mark.parametrize("rows, message", [([(1, "2020-01-01", None, 20)], "Missing"), ([(1, "2020-01-01", -1.0, 20)], "Negative"), ([(1, "2020-01-01", 1.0, 20)] * 2, "Duplicate")])
def test_daily_contract(spark, rows, message):
    with pytest.raises(ValueError, match=message):
        features.prepare_daily(daily(spark, rows))


def test_average_needs_every_value(spark):
    average = lambda values: spark.createDataFrame([(v,) for v in values], "t double").agg(features.strict_average(F.col("t"))).first()[0]
    assert [average(v) for v in ([20.0, 22.0, 24.0], [25.0], [20.0, 21.0], [])] == [22.0, 25.0, 20.5, None]
    with pytest.raises(Exception, match="missing values"):
        average([20.0, None, 24.0])


def test_merge_and_months(spark):
    one = features.build_monthly(daily(spark, [(1, "2020-01-01", 0, 20), (1, "2020-01-02", 0, 21)]))
    two = features.build_monthly(daily(spark, [(1, "2020-02-01", 0, 20), (1, "2020-02-02", 0, 21)]))
    assert features.merge_monthly([one, two]).count() == 2
    with pytest.raises(ValueError, match="At least one"):
        features.merge_monthly([])
    with pytest.raises(ValueError, match="Duplicate"):
        features.merge_monthly([one, one])
    with pytest.raises(ValueError, match="Month values"):
        features.annotate_growing_season(spark.createDataFrame([(2020, 13)], "year int, month int"))
    assert features.select_growing_season(spark.createDataFrame([(2019, m) for m in range(1, 13)], "year int, month int")).count() == 8


def history(spark, rows):
    return spark.createDataFrame([(s, day(d), r, n) for s, d, r, n in rows], "season string, period_end_date date, region string, crush_tonnes bigint")


def test_matched_cutoff(spark):
    rows = [("25-26", f"2025-{m}", "sao_paulo", n) for m, n in (("04-16", 1), ("05-01", 2), ("06-01", 4), ("06-16", 8))]
    rows += [("2026/27", "2026-04-16", "sao_paulo", 16), ("26-27", "2026-06-01", "sao_paulo", 32), ("26-27", "2026-07-01", "other_states", 64)]
    found = {r.harvest_season: r for r in rollup.harvest_summary(history(spark, rows)).collect()}
    assert {s: (r.cumulative_crush_tonnes, r.harvest_period_count, str(r.matched_cutoff_date)) for s, r in found.items()} == {"25-26": (7, 3, "2025-06-01"), "26-27": (48, 2, "2026-06-01")}


def test_join_contract(spark):
    weather = spark.createDataFrame([("SP", "25-26", 1), ("SP", "25-26", 2)], "state string, harvest_season string, x int")
    harvest = spark.createDataFrame([("SP", "25-26", 1)], "state string, harvest_season string, y int")
    with pytest.raises(ValueError, match="not unique in the left"):
        contracts.checked_join(weather, harvest, ["state", "harvest_season"])
    assert contracts.checked_join(weather, harvest, ["state", "harvest_season"], validate="many_to_one").count() == 2


def test_spell_plan_has_no_python_and_one_key(spark):
    rows = features.longest_dry_spell(features.with_calendar(daily(spark, [(1, "2020-01-01", 0, 20)])), ["ibge_code"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_dry_runs_with_the_other_sums(spark):
    """The same longest runs as by islands, in a plan that reads and deals out the days once."""
    r = random.Random(6)
    days = [(s, datetime.date(2023, 8, 1) + datetime.timedelta(days=k), r.choice((0.0, 0.2, 0.9, 1.0, 3.0, None)) if s else 0.5) for s in range(4) for k in range(280) if r.random() < 0.8]
    made = spark.createDataFrame(days, "ibge_code bigint, date date, PRECTOTCORR double").repartition(3)
    panel = made.select("*", F.year("date").alias("year"), F.month("date").alias("month"), F.lit("m").alias("municipality"), F.lit("SP").alias("state"), F.lit(1.0).alias("latitude"), F.lit(1.0).alias("longitude"), F.lit(20.0).alias("T2M"), F.lit(50.0).alias("RH2M"))
    for found, keys, name, rows in (
        (features.monthly_features(panel), ["ibge_code", "year", "month"], "max_consecutive_dry_days", panel),
        (features.growing_season_features(panel), ["ibge_code", "harvest_year"], "growing_season_max_consecutive_dry_days", features.select_growing_season(panel)),
    ):
        want = {tuple(x)[:-1]: tuple(x)[-1] for x in features.longest_dry_spell(rows, keys).collect()}
        got = {tuple(x)[:-1]: tuple(x)[-1] for x in found.select(*keys, name).collect()}
        assert {k: n for k, n in got.items() if n} == want and len(got) > len(want) * 0.9
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning") == 1 and "Join" not in plan
