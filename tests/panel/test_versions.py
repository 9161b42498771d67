import pytest
from pyspark.sql import functions as F

from fieldloom.operators.history import keep_last
from fieldloom.sources import files, shared, sinks, versions


def frame(spark, *values):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").repartition(3, "k")


def values(df):
    return sorted(str(r.v) for r in df.collect())


def test_write_append_and_restore(spark, tmp_path):
    store = versions.Versions(spark, str(tmp_path / "t"))
    assert store.names() == [] and store.current() is None
    store.write(frame(spark, "a", "b"), rows=2, name="one")
    parts = {p["path"] for p in store.manifest()["parts"]}
    store.append(frame(spark, "c"), name="two")
    assert parts < {p["path"] for p in store.manifest()["parts"]} and not any(p.startswith("two/") for p in parts)
    assert values(store.read()) == ["a", "b", "c"] and values(store.read("one")) == ["a", "b"]
    store.point_to("one")
    assert values(store.read()) == ["a", "b"]
    store.append(frame(spark, None), name="three")
    assert values(store.read()) == ["None", "a", "b"]
    assert sorted((r.version, r.previous, r.rows) for r in store.history().collect()) == [("one", None, 2), ("three", "one", 3), ("two", "one", 3)]
    # Columns and filters reach the scan.
    plan = store.read().where("k = 1").select("v")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,1)]" in plan and "ReadSchema: struct<k:int,v:string>" in plan


def test_no_rows(spark, tmp_path):
    store = versions.Versions(spark, f"file://{tmp_path}/t")
    store.write(frame(spark).limit(0), rows=0)
    assert store.read().count() == 0 and store.read().columns == ["k", "v"]
    store.append(frame(spark, "x"))
    assert values(store.read()) == ["x"]


def test_failures_leave_no_trace(spark, tmp_path):
    store = versions.Versions(spark, str(tmp_path / "t"))
    store.write(frame(spark, "a"), name="one")
    before = sorted(str(p) for p in tmp_path.rglob("*"))
    with pytest.raises(Exception, match="no such row"):
        store.append(frame(spark, *"bcdefgh").withColumn("v", F.when(F.col("k") == 5, F.raise_error(F.lit("no such row")).cast("string")).otherwise(F.col("v"))), name="two")
    with pytest.raises(RuntimeError, match="verification failed: 1 rows in"):
        store.write(frame(spark, "b"), rows=2, name="two")
    with pytest.raises(FileExistsError):
        store.write(frame(spark, "b"), name="one")
    with pytest.raises(FileNotFoundError):
        store.point_to("two")
    assert sorted(str(p) for p in tmp_path.rglob("*")) == before and values(store.read()) == ["a"] and store.names() == ["one"]


def test_overlapping_writers(spark, tmp_path):
    """A writer that began on an older version is told so."""
    store = versions.Versions(spark, str(tmp_path / "t"))
    store.write(frame(spark, "a"), name="one")
    source = versions.VersionedSource({"path": str(tmp_path / "t"), "name": "late"})
    late = source.writer(frame(spark).schema, overwrite=False)
    store.append(frame(spark, "b"), name="two")
    with pytest.raises(RuntimeError, match="Another version was published meanwhile"):
        late.commit([])
    assert store.current() == "two"


def test_damage_is_found(spark, tmp_path):
    store = versions.Versions(spark, str(tmp_path / "t"))
    name = store.write(frame(spark, "a", "b", "c", "d"))
    assert store.damaged().isEmpty()
    part = next((tmp_path / "t" / name).glob("part-*"))
    part.write_bytes(part.read_bytes()[:-1] + b"\0")
    assert [r.path for r in store.damaged().collect()] == [f"{name}/{part.name}"]


@pytest.mark.parametrize("listed", [["a", "b", "c"], ["c", "a", "b"]])
def test_order_of_files(spark, tmp_path, listed):
    """Files of unequal size in blocks of some hundred bytes: Spark packs large ones first."""
    sizes = {"a": 3, "b": 400, "c": 60}
    for name, n in sizes.items():
        (tmp_path / f"{name}.csv").write_text("k,v\n" + "".join(f"{i % 7},{name}{i:05d}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "10b")
    try:
        df = files.read_csv(spark, [f"{tmp_path}/{n}.csv" for n in listed], "k int, v string", sequence="at")
        assert df.rdd.getNumPartitions() > 4
        rows = [r.v for r in df.orderBy("at").collect()]
        assert rows == [f"{n}{i:05d}" for n in listed for i in range(sizes[n])]
        last = {r.k: r.v for r in keep_last(df.repartition(5), ["k"], "at").collect()}
        assert last == {int(i) % 7: f"{n}{i:05d}" for n in listed for i in range(sizes[n])}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_history_of_several_files(spark, tmp_path):
    for name, rows in (("2024", ["24-25,2024-04-16,sao_paulo,5", "24-25,2024-04-16,sao_paulo,6"]), ("2025", ["25-26,2025-04-16,sao_paulo,1", "24-25,2024-04-16,sao_paulo,7"] + [f"25-26,2025-05-{d:02d},sao_paulo,{d}" for d in range(1, 29)])):
        (tmp_path / f"{name}.csv").write_text("season,period_end_date,region,crush_tonnes\n" + "\n".join(rows) + "\n")
    found = {str(r.period_end_date): r.crush_tonnes for r in files.harvest_history(spark, str(tmp_path)).collect()}
    assert found["2024-04-16"] == 7 and len(found) == 30


def test_files_by_value(spark, tmp_path):
    rows = spark.createDataFrame([(2021, 3), (2020, 2), (2020, 1), (2021, 1)], "y int, v int")
    assert sinks.save_by(rows, str(tmp_path / "f"), "y", "v") == ["2020", "2021"]
    read = files.read_years(spark, str(tmp_path / "f"), [2021, 2020], "v int")
    assert sorted((r._year, r.v) for r in read.collect()) == [(2020, 1), (2020, 2), (2021, 1), (2021, 3)]
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == ["2020.csv", "2021.csv"]


def test_scratch_goes_and_results_stay(spark):
    with shared.scratch(spark) as folder:
        spark.range(5).write.parquet(folder)
        kept = shared.keep(spark.read.parquet(folder))
    assert kept.count() == 5 and not files.exists(spark, folder)
