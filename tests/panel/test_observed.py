import datetime

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import contracts, observed
from fieldloom.sources import versions

HISTORY = "season string, period_end_date date, region string, crush_tonnes bigint"


def frame(spark, *rows):
    return spark.createDataFrame([(s, datetime.date.fromisoformat(d) if d else None, r, n) for s, d, r, n in rows], HISTORY)


A, B, C = ("25-26", "2025-04-16", "sao_paulo", 5), ("25-26", "2025-05-01", "sao_paulo", 6), ("25-26", "2025-05-01", "other_states", 7)


def run_out(df):
    df.write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize(
    "left,right,validate,message",
    [
        ([(1, "a"), (2, "b")], [(1, "x"), (1, "y")], "one_to_many", None),
        ([(1, "a"), (2, "b")], [(1, "x"), (1, "y")], "one_to_one", r"not unique in the right dataset: 1 \(2 rows\)"),
        ([(3, "a"), (3, "b"), (1, "c")], [(1, "x")], "one_to_one", r"not unique in the left dataset: 3 \(2 rows\)"),  # keys that meet nothing count
        ([(3, "a"), (3, "b"), (1, "c")], [(1, "x")], "many_to_one", None),
        ([(None, "a"), (None, "b")], [(1, "x")], "one_to_one", r"left dataset"),
        ([], [], "one_to_one", None),
    ],
)
def test_joins(spark, left, right, validate, message):
    make = lambda rows, c: spark.createDataFrame(rows, f"k int, {c} string").repartition(2)
    run = observed.Pass()
    joined = run.join(make(left, "v"), make(right, "w"), ["k"], validate=validate)
    run_out(joined)
    assert joined.columns == ["k", "v", "w"]
    if message:
        with pytest.raises(ValueError, match=message):
            run.check()
    else:
        run.check()


def test_inputs_are_read_once(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id") % 7).write.parquet(f"{tmp_path}/a")
    spark.range(50).withColumn("w", F.col("id") % 5).write.parquet(f"{tmp_path}/b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = observed.Pass()
        joined = run.join(spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b"), ["id"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 2 and plan.count("CollectMetrics") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joined.count() == 50 and run.check()["repeated left"] == 0


FAULTS = [
    ([], "dataset is empty"),
    ([A, ("25-26", None, "sao_paulo", 5)], r"missing values:\nperiod_end_date \(1 rows\)"),
    ([A, B, ("25-26", "2025-04-16", "sao_paulo", 9)], r"duplicate season-date-region records. 25-26, 2025-04-16, sao_paulo \(2 rows\)"),
    ([A, ("25-26", "2025-05-01", "sao_paulo", -1)], r"cannot contain negative values. \(1 rows\)"),
    ([("25-27", "2025-04-16", "sao_paulo", 5), B], r"Invalid season labels:  \(1 rows\)"),
    ([("25-26", "2025-04-16", "mars", 5), B], r"Unexpected regions:  \(1 rows\)"),
]


@pytest.mark.parametrize("rows,message", [*FAULTS, ([A, B, C], None)])
def test_reports_as_the_eager_contract(spark, rows, message):
    df = frame(spark, *rows).withColumn("variation_percent", F.lit(0.0))
    run = observed.Pass()
    run_out(observed.report_pass(df, run))
    if message is None:
        assert run.check()["rows"] == 3 and contracts.check_report(df).count() == 3
        return
    with pytest.raises(ValueError, match=message):
        run.check()
    with pytest.raises(ValueError, match=message.split(r" \(")[0].split(" 25-26")[0]):
        contracts.check_report(df)


def test_absent_columns(spark):
    with pytest.raises(ValueError, match="missing required columns"):
        observed.report_pass(frame(spark, A), observed.Pass())


@pytest.mark.parametrize(
    "report,message",
    [
        ([A, (*B[:3], 99)], r"Conflicting observations detected.*25-26, 2025-05-01, sao_paulo \(1 rows\)"),
        ([C, C], r"Duplicate keys found in normalized report:\n25-26, 2025-05-01, other_states \(2 rows\)"),
        ([(*C[:3], None)], r"Missing crush_tonnes values found in normalized report"),
        ([(*C[:3], -3)], r"Negative crush_tonnes values"),
        ([("25-26", "2025-05-01", "mars", 1)], r"Normalized report contains unsupported regions"),
        ([("25-26", "2025-05-01", "centre_south", 1)], r"no rows for the historical database regions"),
        ([(None, "2025-05-01", "sao_paulo", 1)], r"Missing key values found in normalized report:\nseason"),
    ],
)
def test_refused_reports_change_nothing(spark, tmp_path, report, message):
    store = versions.Versions(spark, str(tmp_path / "t"))
    store.write(frame(spark, A, B), name="one")
    before = sorted(str(p) for p in tmp_path.rglob("*"))
    with pytest.raises(ValueError, match=f"(?s){message}"):
        observed.append_report(store, frame(spark, *report))
    assert sorted(str(p) for p in tmp_path.rglob("*")) == before and store.read().count() == 2


def test_appended_reports(spark, tmp_path):
    store = versions.Versions(spark, str(tmp_path / "t"))
    store.write(frame(spark, A), name="one")
    total = ("25-26", "2025-05-01", "centre_south", 13)
    found = observed.append_report(store, frame(spark, (" 25-26 ", *A[1:]), B, C, total), name="two")
    assert (found["history"], found["reported"], found["overlap"], found["added"]) == (1, 3, 1, 2)
    assert sorted((r.season, str(r.period_end_date), r.region, r.crush_tonnes) for r in store.read().collect()) == sorted([A, B, C])
    assert store.current() == "two" and {p["path"].split("/")[0] for p in store.manifest()["parts"]} == {"one", "two"}
    assert observed.append_report(store, frame(spark, B))["added"] == 0 and store.current() == "two" and store.names() == ["one", "two"]
    with pytest.raises(ValueError, match="in use"):
        store.discard("one")


def test_keys_that_raise_as_rows_are_made(spark):
    df = frame(spark, A, B, C)
    assert sorted(r.crush_tonnes for r in contracts.unique_when_read(df, ["season", "period_end_date", "region"]).collect()) == [5, 6, 7]
    with pytest.raises(Exception, match="twice: 25-26, 2025-05-01"):
        contracts.unique_when_read(df, ["season", "period_end_date"], "twice: ").collect()
    assert contracts.unique_when_read(df.where("false"), ["season"]).count() == 0
    masks = contracts.repeat_masks(df, ["season", "period_end_date"], ["crush_tonnes"]).collect()
    assert sorted((r.crush_tonnes, r.repeated, r.again) for r in masks) == [(5, False, False), (6, True, False), (7, True, True)]
