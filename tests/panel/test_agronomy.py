import datetime
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import agronomy


def day(text):
    return datetime.date.fromisoformat(text)


def panel(spark, rows):
    """Rows (station, date, rain, heat, humidity)."""
    made = [(s, "SP" if s < 5 else "MG", day(d) if isinstance(d, str) else d, r, t, h) for s, d, r, t, h in rows]
    return spark.createDataFrame(made, "ibge_code bigint, state string, date date, PRECTOTCORR double, T2M double, RH2M double").repartition(3)


def random_days(seed=1, stations=(1, 2, 7), first="2019-11-01", count=500, missing=0.2):
    r = random.Random(seed)
    return [(s, day(first) + datetime.timedelta(days=k), r.choice((0.0, 0.9, 1.0, 1.1, 7.3)), round(r.uniform(5, 40), 1), None) for s in stations for k in range(count) if r.random() > missing]


@pytest.mark.parametrize("today", [True, False])
def test_rolling_windows_against_every_day(spark, today):
    rows = random_days(missing=0.4, count=220)
    features = (agronomy.Rolling("rain3", 3, "sum"), agronomy.Rolling("heat40", 40, "mean", "T2M"), agronomy.Rolling("dry40", 40, "dry_days"))
    got = {(r.ibge_code, r.date): (r.rain3, r.heat40, r.dry40, r.observed_3d, r.observed_40d) for r in agronomy.rolling(panel(spark, rows), features, today=today).collect()}
    for s, d, *_ in rows:
        last = d if today else d - datetime.timedelta(days=1)
        near = {n: [x for x in rows if x[0] == s and last - datetime.timedelta(days=n - 1) <= x[1] <= last] for n in (3, 40)}
        rain = float(sum(Fraction(str(x[2])) for x in near[3])) if near[3] else None
        heat = float(sum(Fraction(str(x[3])) for x in near[40])) / len(near[40]) if near[40] else None
        assert got[s, d] == (rain, heat, sum(x[2] <= 1.0 for x in near[40]), len(near[3]), len(near[40]))


def test_rolling_windows_share_one_exchange(spark):
    plan = agronomy.rolling(panel(spark, random_days(count=5)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(ibge_code") == 1
    with pytest.raises(ValueError, match="sum, a mean or dry_days"):
        agronomy.rolling(panel(spark, random_days(count=5)), [agronomy.Rolling("x", 3, "median")])
    with pytest.raises(ValueError, match="missing required"):
        agronomy.rolling(panel(spark, random_days(count=5)).drop("T2M"))


CALENDAR = [("SP", "early", 9, 1, 11, 30), ("SP", "cross", 12, 16, 2, 29), ("SP", "same month", 3, 20, 3, 10), ("MG", "early", 2, 30, 4, 31)]


def test_stages_against_every_day(spark):
    calendar = spark.createDataFrame(CALENDAR, "state string, stage string, start_month int, start_day int, end_month int, end_day int")
    rows = random_days(3)
    made = agronomy.stage_features(panel(spark, rows), calendar)
    got = {(r.ibge_code, r.stage, r.stage_year): (r.rainfall, r.temperature, r.dry_days, r.days, r.dry_spell) for r in made.collect()}

    def clipped(y, m, d):
        last = (datetime.date(y + m // 12, m % 12 + 1, 1) - datetime.timedelta(days=1)).day
        return datetime.date(y, m, min(d, last))

    want = {}
    for state, stage, sm, sd, em, ed in CALENDAR:
        for year in range(2018, 2023):
            first, last = clipped(year, sm, sd), clipped(year + ((em, ed) < (sm, sd)), em, ed)
            for s in (1, 2, 7):
                own = sorted(x[1:4] for x in rows if x[0] == s and ("SP" if s < 5 else "MG") == state and first <= x[1] <= last)
                if own:
                    run = best = 0
                    for k, (d, rain, _) in enumerate(own):
                        follows = k and (d - own[k - 1][0]).days == 1
                        run = 0 if rain >= 1.0 else run + 1 if follows else 1
                        best = max(best, run)
                    heat = float(sum(Fraction(str(x[2])) for x in own)) / len(own)
                    want[s, stage, year] = (float(sum(Fraction(str(x[1])) for x in own)), heat, sum(x[1] <= 1.0 for x in own), len(own), best)
    assert got == want and len(want) > 12
    plan = agronomy.in_stages(panel(spark, rows), calendar)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_extremes(spark):
    rows = [(1, "2024-01-01", 0.0, 8.0, 90.0), (1, "2024-01-02", 25.0, 36.5, 30.0), (1, "2024-01-03", None, float("nan"), None), (1, "2024-01-04", 5.0, 20.0, 80.0)]
    r = agronomy.extremes(panel(spark, rows[:2] + rows[3:]), ["ibge_code"]).first()
    assert (r.growing_degree_days, r.hot_days, r.cool_days, r.max_temperature, r.min_temperature) == (36.5, 1, 1, 36.5, 8.0)
    assert (r.heavy_rain_days, r.rainfall_intensity, r.high_humidity_days, r.low_humidity_days) == (1, 15.0, 1, 1)
    from fieldloom.operators.contracts import without_nan

    missing = agronomy.extremes(without_nan(panel(spark, rows)), ["ibge_code"]).first()
    assert (missing.rainfall_missing_days, missing.temperature_missing_days, missing.humidity_missing_days, missing.growing_degree_days) == (1, 1, 1, 36.5)
    assert agronomy.extremes(panel(spark, rows[:1]), ["ibge_code"]).first().rainfall_intensity is None


def test_weighted_means_of_two_levels(spark):
    rows = [("a", 1, 10, 1.0), ("a", 2, 30, 2.0), ("b", 1, 1, 9.0), ("b", 2, 0, 5.0), ("b", 3, 7, None), ("c", 1, 0, 4.0)]
    low = agronomy.weighted_sums(spark.createDataFrame(rows, "state string, k int, w bigint, x double"), ["state"], "w", ["x"])
    means = {r.state: r.harvest_weighted_x for r in agronomy.weighted_means(low, ["x"]).collect()}
    assert means == {"a": 1.75, "b": 9.0, "c": None}
    # The mean of the two means would be 5.375.
    assert agronomy.weighted_means(agronomy.summed_up(low, [], ["x"]), ["x"]).first()[0] == pytest.approx(79 / 41, abs=1e-15)


def test_harvest_periods(spark):
    rows = [(1, day("2024-01-01") + datetime.timedelta(days=k), 1.0 + k % 2, float(k), 50.0) for k in range(200)]
    history = spark.createDataFrame([("24-25", day(d), r, n) for d, r, n in (("2024-04-16", "sao_paulo", 5), ("2024-05-01", "sao_paulo", 6), ("2024-05-01", "centre_south", 9))], "season string, period_end_date date, region string, crush_tonnes bigint")
    made = agronomy.harvest_periods(panel(spark, rows), history, {"sao_paulo": "SP"}, maturation=10).orderBy("period_end_date").collect()
    assert [(str(r.period_end_date), r.crush_tonnes, r.temperature, r.maturation_temperature) for r in made] == [("2024-04-16", 5, sum(range(91, 107)) / 16, sum(range(97, 107)) / 10), ("2024-05-01", 6, sum(range(107, 122)) / 15, sum(range(112, 122)) / 10)]
    assert made[0].rainfall == 1.5 and made[0].dry_days == 0.5


def test_empty_panel(spark):
    none = panel(spark, random_days(count=1, missing=0)).where("false")
    calendar = spark.createDataFrame(CALENDAR, "state string, stage string, start_month int, start_day int, end_month int, end_day int")
    assert agronomy.rolling(none).count() == agronomy.stage_features(none, calendar).count() == agronomy.extremes(none, ["ibge_code"]).count() == 0
    assert none.agg(F.count(F.lit(1))).first()[0] == 0
