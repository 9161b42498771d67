import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from fieldloom.plans import catalog, stages


def test_run_end_to_end(spark, tmp_path):
    root = str(tmp_path)
    days = spark.range(3 * 365).select(F.date_add(F.lit(datetime.date(2019, 9, 1)), F.col("id").cast("int")).alias("Date"), (F.col("id") % 5).cast("double").alias("PRECTOTCORR"), (F.col("id") % 7 + 20).cast("double").alias("T2M"), F.lit(60.0).alias("RH2M"))
    days.select("*", F.lit("A").alias("municipality"), F.lit(1).cast("bigint").alias("ibge_code"), F.lit("SP").alias("state"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude")).write.parquet(f"{root}/daily")
    rows = [(f"{y}-{y + 1}", datetime.date(2000 + y, 4, 16), "sao_paulo", 1000 * y) for y in (20, 21, 22)]
    spark.createDataFrame(rows, "season string, period_end_date date, region string, crush_tonnes bigint").write.parquet(f"{root}/history")
    said = []
    times = stages.run(spark, root, say=said.append)
    assert list(times) == [s.name for s in stages.STAGES] and len(said) == 6
    assert spark.read.parquet(f"{root}/weather_harvest").count() == 3 and spark.read.parquet(f"{root}/comparison/ranks").count() == 4
    crush = spark.read.parquet(f"{root}/comparison/ranks").where("metric = 'Matched-Cutoff Crush'").first()
    assert (crush.rank, crush.total, crush.harvest_season) == (1, 3, "22-23")
    assert spark.read.parquet(f"{root}/panel").count() == 8


def test_failure_is_said_and_raised(spark, tmp_path):
    said = []
    with pytest.raises(Exception):
        stages.run(spark, str(tmp_path / "none"), say=said.append)
    assert len(said) == 1 and "failed" in said[0]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_duckdb(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "lineitem", "orders", "documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, folder)
    other = con.sql(catalog.ORACLE[name])
    order = [other.columns.index(c) for c in df.columns]
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(df.collect()) == text(tuple(r[k] for k in order) for r in other.fetchall())


def small_stages(log, fail=()):
    """Two inputs to two tables to one."""

    def step(name, sources, to):
        def work(spark, root):
            log.append(name)
            if name in fail:
                raise RuntimeError(f"{name} is broken\nmore of it")
            rows = sum(spark.read.parquet(f"{root}/{s}").count() for s in sources)
            spark.range(rows).write.mode("overwrite").parquet(f"{root}/{to}")

        return stages.Stage(name, work, tuple(sources), (to,))

    return (step("one", ["x"], "a"), step("two", ["y"], "b"), step("three", ["a", "b"], "c"))


def test_runs_go_on_where_they_stopped(spark, tmp_path):
    root, said = str(tmp_path), []
    for name, n in (("x", 3), ("y", 4)):
        spark.range(n).write.parquet(f"{root}/{name}")
    log = []
    with pytest.raises(RuntimeError):
        stages.run(spark, root, small_stages(log, fail=["two"]), said.append)
    assert log == ["one", "two"]
    left = {r.stage: r for r in stages.manifests(spark, root, small_stages(log)).collect()}
    assert set(left) == {"one", "two"} and (left["two"].state, left["two"].error, left["two"].output) == ("failed", "two is broken", None)
    stages.run(spark, root, small_stages(log), said.append)
    assert log == ["one", "two", "two", "three"]
    left = {r.stage: (r.state, r.runs, r.rows) for r in stages.manifests(spark, root, small_stages(log)).collect()}
    assert left == {"one": ("done", 1, 3), "two": ("done", 2, 4), "three": ("done", 1, 7)}

    log.clear()
    assert stages.run(spark, root, small_stages(log), said.append) == {"one": 0.0, "two": 0.0, "three": 0.0} and log == []
    spark.range(9).write.mode("overwrite").parquet(f"{root}/y")  # an input changes
    stages.run(spark, root, small_stages(log), said.append)
    assert log == ["two", "three"]
    log.clear()
    next((tmp_path / "c").glob("part-*")).unlink()  # an output is damaged
    stages.run(spark, root, small_stages(log), said.append)
    assert log == ["three"]
    log.clear()
    (tmp_path / "_runs" / "one.json").write_text((tmp_path / "_runs" / "one.json").read_text().replace('"done"', '"running"'))  # a run that was killed
    stages.run(spark, root, small_stages(log), said.append)
    assert log[0] == "one"
    log.clear()
    stages.run(spark, root, small_stages(log), said.append, resume=False)
    assert log == ["one", "two", "three"]
