import datetime
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import contracts, history, reports, tables, words
from fieldloom.sources.versions import Versions
from fieldloom.streaming.append import append_reports


def day(text):
    return datetime.date.fromisoformat(text)


def frame(spark, rows, more=""):
    return spark.createDataFrame([(s, day(d), r, *v) for s, d, r, *v in rows], "season string, period_end_date date, region string, crush_tonnes bigint" + more)


OLD = [("25-26", "2025-04-16", "other_states", 2000000), ("25-26", "2025-04-16", "sao_paulo", 8000000), ("25-26", "2025-05-01", "other_states", 3000000), ("25-26", "2025-05-01", "sao_paulo", 10000000)]
NEW = [*OLD[2:], ("25-26", "2025-05-01", "centre_south", 13000000), ("25-26", "2025-05-16", "other_states", 4000000), ("25-26", "2025-05-16", "sao_paulo", 12000000), ("25-26", "2025-05-16", "centre_south", 16000000)]


def test_append(spark):
    rows = NEW.copy()
    random.Random(2).shuffle(rows)
    found = history.update(frame(spark, OLD), frame(spark, rows).repartition(3))
    assert (found.history_rows, found.new_rows, found.overlap_rows) == (4, 2, 2)
    assert found.combined.count() == 6 and found.combined.where("region = 'centre_south'").isEmpty()


def test_pure_overlap_adds_nothing(spark):
    found = history.update(frame(spark, OLD), frame(spark, OLD[2:]))
    assert found.new_rows == 0 and found.combined.count() == 4


@pytest.mark.parametrize(
    "old, new, message",
    [
        (OLD, [(*OLD[3][:3], 999)], "Conflicting"),
        (OLD, [("25-26", "2025-05-16", "north", 1)], "Normalized report contains unsupported"),
        ([("25-26", "2025-05-16", "north", 1)], OLD, "Historical database contains unsupported"),
        (OLD, [NEW[2]], "no rows"),
        (OLD + OLD[:1], NEW, "Duplicate keys"),
        (OLD, [("25-26", "2025-05-16", "sao_paulo", -1)], "Negative"),
        (OLD, [("25-26", "2025-05-16", "sao_paulo", None)], "Missing crush_tonnes"),
    ],
)
def test_refusals(spark, old, new, message):
    with pytest.raises(ValueError, match=message):
        history.update(frame(spark, old), frame(spark, new))


def test_versions(spark, tmp_path, monkeypatch):
    store = Versions(spark, str(tmp_path / "store"))
    with pytest.raises(FileNotFoundError):
        store.read()
    first = store.write(frame(spark, OLD))
    second = store.write(frame(spark, NEW[3:]))
    assert store.names() == [first, second] and store.current() == second and store.read().count() == 3
    with pytest.raises(RuntimeError, match="verification"):
        store.write(frame(spark, OLD), rows=99)
    assert store.names() == [first, second] and store.current() == second
    store.point_to(first)
    assert store.read().count() == 4


def test_streamed_reports(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "store"))
    store.write(frame(spark, OLD))
    frame(spark, NEW).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(spark, NEW).schema).parquet(str(tmp_path / "in"))
    append_reports(stream, store, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert store.read().count() == 6 and len(store.names()) == 2


def cumulative(spark, rows):
    return spark.createDataFrame([("25-26", day(f"2025-{d}"), r, n) for d, r, n in rows], "season string, period_end_date date, region string, cumulative_crush_tonnes bigint")


def test_periods_from_totals(spark):
    rows = [("04-16", "sao_paulo", 100), ("05-01", "sao_paulo", 250), ("05-16", "sao_paulo", 400), ("06-01", "sao_paulo", 650), ("04-16", "other_states", 40), ("05-01", "other_states", 90)]
    random.Random(3).shuffle(rows)
    found = reports.per_period(cumulative(spark, rows)).orderBy("region", "period_end_date").collect()
    assert [r.crush_tonnes for r in found] == [40, 50, 100, 150, 150, 250]
    for bad, message in (([("05-01", "sao_paulo", 100)], "16 April"), ([("04-16", "sao_paulo", 250), ("05-01", "sao_paulo", 230)], "decreasing")):
        with pytest.raises(ValueError, match=message):
            reports.per_period(cumulative(spark, bad))
    with pytest.raises(ValueError, match="missing required columns"):
        reports.per_period(cumulative(spark, rows).drop("region"))


PAGE = [
    ("Quinzena", 10, 30, 10), ("São", 100, 115, 10), ("Paulo", 118, 140, 10), ("Centro-Sul", 220, 270, 10), ("Demais", 340, 370, 10), ("Estados", 374, 410, 10),
    *((f"{y}/{y + 1}", a, b, top) for y, top in ((2025, 30), (2026, 31)) for a, b in ((95, 145), (215, 275), (340, 410))),
    ("16/04", 10, 35, 50), ("8.000.000", 100, 150, 50), ("11.000.000", 220, 280, 50), ("3.000.000", 345, 400, 50),
    ("01/05", 10, 35, 70), ("10.000.000", 100, 155, 70), ("13.000.000", 220, 280, 70), ("3.000.000", 345, 400, 70),
]


def page(spark, rows=PAGE):
    return spark.createDataFrame([("d", 0, k, t, float(a), float(b), float(c)) for k, (t, a, b, c) in enumerate(rows)], "doc string, page int, word_idx int, text string, x0 double, x1 double, top double")


def test_lines(spark):
    count = lambda tops, tolerance: words.lines(page(spark, [("w", k, k + 1, t) for k, t in enumerate(tops)]), tolerance).agg(F.max("line") + 1).first()[0]
    assert count((10, 11, 30), 2.0) == 2 and count((10, 15), 4.0) == 2
    assert count((10, 10, 30, 31, 50, 70), 4.0) == 4
    # The mean moves: 10 and 14 make 12, so 16 still joins and 17 after that (13.3) does.
    assert count((10, 14, 16, 17), 4.0) == 1 and count((10, 13, 16), 4.0) == 2


def test_columns_and_rows(spark):
    found = words.boundaries(page(spark)).first()
    assert (found.b1, found.b2, found.b3) == (70.0, 182.5, 310.0)
    rows = [r.cells for r in words.tables(page(spark)).orderBy("row_idx").collect()]
    assert len(rows) == 5 and rows[1] == ["Quinzena", "São Paulo", "Centro-Sul", "Demais Estados"]
    assert rows[3:] == [["16/04", "8.000.000", "11.000.000", "3.000.000"], ["01/05", "10.000.000", "13.000.000", "3.000.000"]]
    with pytest.raises(Exception, match="Could not locate header phrase"):
        words.boundaries(page(spark, PAGE[1:])).collect()


def test_report_from_table(spark):
    cells = [("", "x", None, None), ("Quinzena", "a", "b", "c"), (None, "2024/2025", "2025/2026", None), ("16/04", "1.000 2.000 33%", "4.000 6.000 50,5%", "3.000 4.000 9%"), ("01/05", "3.000 5.000 1%", None, "5.000 9.000 1%"), ("note", "x", "y", "z")]
    table = spark.createDataFrame([(k, list(c)) for k, c in enumerate(cells)], "row_idx int, cells array<string>")
    found = {(r.season, str(r.period_end_date), r.region): (r.crush_tonnes, r.variation_percent) for r in reports.normalized_report(table).collect()}
    assert len(found) == 10
    assert found["24-25", "2024-04-16", "sao_paulo"] == (1000, 33.0) and found["25-26", "2025-05-01", "sao_paulo"] == (3000, 1.0)
    assert found["25-26", "2025-04-16", "centre_south"] == (6000, 50.5) and found["25-26", "2025-05-01", "other_states"] == (5000, 1.0)


def test_first_page_with_text(spark):
    pages = spark.createDataFrame([("d", 0, None), ("d", 1, "Moagem ACUMULADA"), ("d", 2, "moagem acumulada"), ("e", 0, "x")], "doc string, page int, text string")
    assert [tuple(r) for r in words.page_with_text(pages, "Acumulada").collect()] == [("d", 1)]


REPORT = [("25-26", "2025-04-16", "sao_paulo", 8253154, 30.0), ("25-26", "2025-04-16", "other_states", 2754092, 20.0), ("25-26", "2025-04-16", "centre_south", 11007246, 27.0)]


def test_report_contract(spark):
    good = frame(spark, REPORT, ", variation_percent double")
    assert contracts.check_report(good).count() == 3
    bad = [
        (good.limit(0), "empty"),
        (good.drop("region"), "Missing columns"),
        (good.withColumn("season", F.lit(None).cast("string")), "missing values"),
        (good.unionByName(good), "duplicate"),
        (good.withColumn("crush_tonnes", F.lit("1")), "must be numeric"),
        (good.withColumn("crush_tonnes", F.lit(-1)), "negative"),
        (good.withColumn("period_end_date", F.col("period_end_date").cast("string")), "date type"),
        (good.withColumn("season", F.lit("25-27")), "season labels"),
        (good.withColumn("region", F.concat(F.lit("x_"), "region")), "Unexpected regions"),
    ]
    for df, message in bad:
        with pytest.raises(ValueError, match=message):
            contracts.check_report(df)


def test_generic_contracts(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("b", None)], "k string, v double")
    with pytest.raises(ValueError, match="Unexpected columns"):
        contracts.require_exact_columns(df, ["v", "k"])
    with pytest.raises(ValueError, match="Missing values"):
        contracts.require_present(df)
    assert {r.column: r.missing for r in contracts.missing_counts(df).collect()} == {"k": 0, "v": 2}
    with pytest.raises(ValueError, match="Duplicate"):
        contracts.require_unique(df, ["k"])
    with pytest.raises(ValueError, match="not numeric"):
        contracts.require_non_negative(df, "k")
    with pytest.raises(ValueError, match="Column not found"):
        contracts.require_numeric(df, "zz")
    with pytest.raises(ValueError, match="Unexpected values"):
        contracts.require_values(df, "k", ["a"])
    assert contracts.require_values(df, "k", ["a", "b"]) is df and contracts.without_nan(df).where("v is null").count() == 2


def test_translation_and_production(spark):
    raw = spark.createDataFrame([(" SÃO PAULO", "CENTRO-SUL", "Milho", 1)], "Estado string, `REGIÃO` string, `MATÉRIA-PRIMA` string, other int")
    assert tables.translate(raw).columns == ["state", "region", "feedstock", "other"] and tuple(tables.translate(raw).first()) == ("SP", "centre_south", "corn", 1)
    with pytest.raises(ValueError, match="Several columns"):
        tables.translate(spark.createDataFrame([(1, 2)], "SAFRA int, Safra int"))
    wide = spark.createDataFrame([("São Paulo", 1.0, None), (None, 2.0, 3.0), ("Other", 4.0, 5.0)], "`Estado/Safra` string, `19/20` double, `20/21` double")
    assert [tuple(r) for r in tables.state_production(wide, ["São Paulo"]).collect()] == [("São Paulo", "19/20", 1.0)]
    crush = spark.createDataFrame([("25-26 ", "2025-04-16", "SÃO PAULO", "12"), ("25-26", "bad", "X", "bad")], "SAFRA string, QUINZENA string, `REGIÃO` string, MOAGEM string")
    made = tables.period_table(crush, tables.CRUSH_COLUMNS)
    assert [tuple(r) for r in made.collect()] == [("25-26", day("2025-04-16"), "sao_paulo", 12.0), ("25-26", None, "X", None)]
    with pytest.raises(ValueError, match="Missing"):
        tables.check_period_table(made, "crush_tonnes")


def test_metadata(spark):
    production = spark.createDataFrame([("Adolfo",), ("Adolfo",), ("Agudos",)], "municipality string")
    places = spark.createDataFrame([(35, "Adolfo", 1, 1.0, 2.0), (35, "Agudos", 2, 3.0, 4.0), (31, "Agudos", 3, 5.0, 6.0)], "codigo_uf int, nome string, codigo_ibge int, latitude double, longitude double")
    assert [r.ibge_code for r in tables.station_metadata(production, places).orderBy("municipality").collect()] == [1, 2]
    with pytest.raises(ValueError, match="could not be found"):
        tables.station_metadata(production.union(spark.createDataFrame([("Nowhere",)], "m string")), places)
