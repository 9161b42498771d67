import datetime
import io

import pytest
from pyspark.sql import functions as F

from fieldloom.plans import sheets
from fieldloom.plans.sheets import workbook as book
from fieldloom.sources import files, pages, sinks, weather, workbook

def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("rainfall,municipality\n10.0,Adamantina\n20.0,Adolfo\n")
    df = files.read_csv(spark, str(path), "municipality string, rainfall double")
    assert [tuple(r) for r in df.orderBy("rainfall").collect()] == [("Adamantina", 10.0), ("Adolfo", 20.0)]
    assert files.read_csv(spark, str(path)).schema["rainfall"].dataType.typeName() == "double"
    with pytest.raises(FileNotFoundError, match="CSV file not found"):
        files.read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="missing required columns"):
        files.read_csv(spark, str(path), "state string")


def test_years(spark, tmp_path):
    for year, values in ((2020, (10, 20)), (2021, (30, 40))):
        (tmp_path / f"{year}.csv").write_text("v\n" + "\n".join(map(str, values)) + "\n")
    rows = files.read_years(spark, str(tmp_path), [2020, 2021], "v int").collect()
    assert sorted((r._year, r.v) for r in rows) == [(2020, 10), (2020, 20), (2021, 30), (2021, 40)]
    for years, error in (([], ValueError), ([2022], FileNotFoundError)):
        with pytest.raises(error):
            files.read_years(spark, str(tmp_path), years)
    with pytest.raises(FileNotFoundError, match="folder"):
        files.read_years(spark, str(tmp_path / "none"), [2020])


def test_history_keeps_the_last_of_a_key(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("season,period_end_date,region,crush_tonnes\n25-26,2025-04-16,sao_paulo,1\n25-26,2025-04-16,sao_paulo,2\n")
    assert [r.crush_tonnes for r in files.harvest_history(spark, str(path)).collect()] == [2]
    path.write_text("season,period_end_date,region,crush_tonnes\n25-26,2025-04-16,sao_paulo,-1\n")
    with pytest.raises(ValueError, match="Negative"):
        files.harvest_history(spark, str(path))


def test_matrix(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('title\nsource\nunit\nplace,"2019","2020"\nCana,x,y\nAdolfo (SP),1,2\nBelo (MG),3,4\n')
    from fieldloom.operators.tables import municipal_production

    df, years = files.municipal_matrix(spark, str(path))
    assert years == ["2019", "2020"]
    assert [tuple(r) for r in municipal_production(df, years).collect()] == [("Adolfo", "1", "2")]


BOOK = {"x": [["no"]], "TB_02": [[], ["SAFRA", " QUINZENA ", None, "MOAGEM"], ["25-26", datetime.date(2025, 4, 16), True, 12.5], [None, None, None, None], ["25-26", None, None, 7, "beyond"], [], ["a & <b>", None, None, None]]}


@pytest.mark.parametrize("rows", [1, 2, 100])
@pytest.mark.parametrize("dimension", [True, False])
def test_workbook(spark, tmp_path, rows, dimension):
    path = tmp_path / "b.xlsx"
    path.write_bytes(book(BOOK, dimension))
    df = workbook.read_sheet(spark, str(path), "TB_02", header_row=1, rows_per_partition=rows)
    assert df.columns == ["SAFRA", "QUINZENA", "_2", "MOAGEM", "_file", "_sheet"]
    want = [("25-26", "2025-04-16", "true", "12.5"), ("25-26", None, None, "7"), ("a & <b>", None, None, None)]
    assert sorted((tuple(r)[:4] for r in df.collect()), key=str) == sorted(want, key=str)
    assert df.rdd.getNumPartitions() == (1 if rows == 100 or not dimension else -(-5 // rows))
    few = workbook.read_sheet(spark, str(path), "TB_02", header_row=1, columns=["MOAGEM"], rows_per_partition=rows)
    assert few.columns == ["MOAGEM", "_file", "_sheet"] and sorted(r.MOAGEM for r in few.collect()) == ["12.5", "7"]
    assert workbook.sheet_names(str(path)) == ["x", "TB_02"]


def test_workbooks_of_a_folder(spark, tmp_path):
    for name, rows in (("b", [["k", "v"], ["x", 1]]), ("a", [["k", "v"], ["y", 2], ["z", None]])):
        (tmp_path / f"{name}.xlsx").write_bytes(book({"one": rows, "two": [["k", "v"], [f"{name}2", 3]]}))
    (tmp_path / "~a.xlsx").write_bytes(b"lock")
    found = sorted((r._file.rsplit("/", 1)[1], r._sheet, r.k, r.v) for r in workbook.read_sheet(spark, f"file://{tmp_path}", "*").collect())
    assert found == [("a.xlsx", "one", "y", "2"), ("a.xlsx", "one", "z", None), ("a.xlsx", "two", "a2", "3"), ("b.xlsx", "one", "x", "1"), ("b.xlsx", "two", "b2", "3")]
    (tmp_path / "c.xlsx").write_bytes(book({"one": [["k", "other"], ["x", 1]]}))
    with pytest.raises(Exception, match="c.xlsx has other columns"):
        workbook.read_sheet(spark, str(tmp_path)).collect()


def test_large_workbooks_are_streamed(spark, tmp_path, monkeypatch):
    """A workbook's rows go to its file batch by batch, and the ranges of a sheet don't grow with it."""
    monkeypatch.setattr(sheets, "SHARED", 2)
    out = io.BytesIO()
    made = sheets.Book(out)
    made.sheet("s", ([k, f"text {k} <&>"] for k in range(-1, 4)), 5)
    made.close()
    assert [row for _, row in workbook.Workbook(out).rows("s")] == [[str(k), f"text {k} <&>"] for k in range(-1, 4)]

    for first in (0, 1, 3, 4):  # what is skipped unread, by blocks of any size
        for block in (1, 7, 40, 200, 1000):
            monkeypatch.setattr(workbook, "BLOCK", block)
            assert [row for _, row in workbook.Workbook(out).rows("s", first)] == [[str(k), f"text {k} <&>"] for k in range(first - 1, 4)]
    monkeypatch.undo()

    rows = spark.range(60_000).select((F.col("id") % 2).alias("name"), "id", F.concat(F.lit("t"), F.col("id")).alias("t"))
    assert sheets.write_workbooks(rows, "name", ["id"], "s", f"file://{tmp_path}", preamble=3) == 2
    read = workbook.read_sheet(spark, f"file://{tmp_path}", "s", header_row=3, rows_per_partition=10)
    assert read.rdd.getNumPartitions() == 2 * workbook.RANGES
    got = read.agg(F.count("*"), F.sum("id"), F.sum((F.concat(F.lit("t"), "id") == F.col("t")).cast("int")), F.sum((F.col("_file").endswith(F.concat(F.col("id") % 2, F.lit(".xlsx")))).cast("int"))).first()
    assert tuple(got) == (60_000, 60_000 * 59_999 / 2, 60_000, 60_000)


def test_workbook_errors(spark, tmp_path):
    path = tmp_path / "b.xlsx"
    path.write_bytes(book(BOOK))
    with pytest.raises(ValueError, match="was not found"):
        workbook.read_sheet(spark, str(path), "TB_09")
    with pytest.raises(ValueError, match="no header row"):
        workbook.read_sheet(spark, str(path), "x", header_row=5)
    with pytest.raises(ValueError, match="Columns not found"):
        workbook.read_sheet(spark, str(path), columns=["none"])
    for missing in (tmp_path / "none.xlsx", tmp_path / "empty"):
        (tmp_path / "empty").mkdir(exist_ok=True)
        with pytest.raises(FileNotFoundError, match="Excel workbook"):
            workbook.read_sheet(spark, str(missing))


STATIONS = [("A", 1, "SP", 1.0, 2.0), ("B", 2, "SP", 3.0, 4.0)]


def stations(spark, rows=STATIONS):
    return spark.createDataFrame(rows, "municipality string, ibge_code bigint, state string, latitude double, longitude double")


def answers():
    """A transport that travels to tasks by value."""

    def answer(params):
        import json

        if params["latitude"] == 3.0:
            return 404, ""
        body = {"T2M": {"20240101": 20.5, "20240102": 21.5}, "PRECTOTCORR": {"20240101": 0.5}, "RH2M": {"20240101": 70.0}}
        return 200, json.dumps({"properties": {"parameter": body}})

    return answer


def test_download(spark):
    answer = answers()
    days, failed = weather.download(stations(spark), [("20240101", "20240131")], answer, wait=0)
    assert sorted((str(r.Date), r.T2M, r.PRECTOTCORR, r.municipality) for r in days.collect()) == [("2024-01-01", 20.5, 0.5, "A"), ("2024-01-02", 21.5, None, "A")]
    assert [(r.municipality, "404" in r.error) for r in failed.collect()] == [("B", True)]
    with pytest.raises(RuntimeError, match="All downloads failed"):
        weather.download(stations(spark, STATIONS[1:]), [("20240101", "20240131")], answer, wait=0)
    with pytest.raises(ValueError, match="same calendar year"):
        weather.download(stations(spark), [("20231231", "20240131")], answer)
    with pytest.raises(ValueError, match="Duplicate"):
        weather.download(stations(spark, STATIONS + STATIONS), [("20240101", "20240131")], answer)


def echo():
    """A transport with one day for each end of the period that is asked for."""

    def answer(params):
        import json

        days = {params["start"]: 1, params["end"]: None}
        return 200, json.dumps({"properties": {"parameter": {p: days for p in params["parameters"].split(",")}}})

    return answer


def test_dates_are_pushed_to_the_service(spark):
    periods = [("20230101", "20231231"), ("20240101", "20241231"), ("20250101", "20250630")]
    rows = weather.read(stations(spark), periods, echo(), wait=0, requestsPerPartition=2)
    asked = lambda df: sorted({(r.start, r.end) for r in df.collect()})
    assert asked(rows) == periods and rows.rdd.getNumPartitions() == 3
    assert asked(rows.where("Date > DATE '2023-12-30' AND Date <= DATE '2024-03-31'")) == [("20231231", "20231231"), ("20240101", "20240331")]
    assert asked(rows.where("Date = DATE '2024-02-29' AND municipality = 'A'")) == [("20240229", "20240229")]
    assert rows.where("Date < DATE '2020-01-01'").count() == 0
    # A condition that isn't pushed is applied to the rows.
    assert asked(rows.where("month(Date) = 6")) == [("20250101", "20250630")]


def test_failed_requests_survive_pushed_dates(spark):
    rows = weather.read(stations(spark), [("20240101", "20240131")], answers(), wait=0, tries=2).where("Date >= DATE '2024-01-02'").collect()
    assert sorted((r.municipality, r.error is None) for r in rows) == [("A", True), ("B", False)]
    assert {str(r.Date) for r in rows if r.error is None} == {"2024-01-02"}  # though this service gives more than it is asked for


@pytest.mark.parametrize("body", ["", "[]", "{}", '{"properties":{}}', '{"properties":{"parameter":{"T2M":{"2024-01-01":1},"PRECTOTCORR":{},"RH2M":{}}}}', '{"properties":{"parameter":{"T2M":{}}}}', '{"properties":{"parameter":{"T2M":{"20240101":"x"},"PRECTOTCORR":{},"RH2M":{}}}}'])
def test_answers_that_are_none(spark, body):
    rows = weather.read(stations(spark, STATIONS[:1]), [("20240101", "20240131")], lambda _: (200, body), wait=0).collect()
    assert len(rows) == 1 and rows[0].Date is None and rows[0].error


def test_many_stations_stay_a_dataframe(spark, monkeypatch):
    monkeypatch.setattr(weather, "MOST_STATIONS", 1)
    days, failed = weather.download(stations(spark), [("20240101", "20240131")], answers(), wait=0)
    assert days.count() == 2 and [r.municipality for r in failed.collect()] == ["B"]
    with pytest.raises(ValueError, match="More than 1 stations"):
        weather.read(stations(spark), [("20240101", "20240131")], echo())


def test_retries():
    waits, states = [], iter([(429, ""), (429, ""), (200, "ok")])
    assert weather.fetch(lambda _: next(states), {}, sleep=waits.append) == "ok" and waits == [10, 20]

    def broken(_):
        raise OSError("no network")

    waits.clear()
    with pytest.raises(RuntimeError, match="5 attempts"):
        weather.fetch(broken, {}, sleep=waits.append)
    assert waits == [10, 20, 40, 80]


def test_documents(spark, tmp_path):
    def extractor(content):
        for line in content.split(b"\n")[1:]:
            yield [(w, 9.0 * k, 9.0 * k + 1, 5.0) for k, w in enumerate(line.decode().split())]

    (tmp_path / "a.pdf").write_bytes(b"%PDF\nOne two\n\nthree")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    docs = pages.documents(spark, str(tmp_path))
    assert [r.text for r in pages.page_texts(docs, extractor).orderBy("page").collect()] == ["One two", "", "three"]
    assert [(r.page, r.word_idx, r.text) for r in pages.page_words(docs, extractor).orderBy("page", "word_idx").collect()] == [(0, 0, "One"), (0, 1, "two"), (2, 0, "three")]
    with pytest.raises(FileNotFoundError):
        pages.documents(spark, str(tmp_path / "none.pdf"))
    for content, kind in ((b"", ""), (b"x", "text/html"), (b"x", "")):
        with pytest.raises(ValueError):
            pages.check_download(content, kind, pages.MAGIC)
    assert pages.check_download(b"%PDF-1", "", pages.MAGIC) == b"%PDF-1"


def test_sinks_and_summary(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", None)], "k string, v double")
    sinks.save_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    sinks.save_parquet(df, str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(str(tmp_path / "p")).where("k = 'a'").count() == 2
    r = sinks.summary(df).first()
    assert (r.rows, r["columns"], r.duplicate_rows, r.missing) == (3, 2, 1, {"k": 0, "v": 1})
    with pytest.raises(ValueError, match="Column not found"):
        sinks.summary(df, "date")


def test_remote_paths_are_asked_of_hadoop(spark, tmp_path):
    (tmp_path / "x.csv").write_text("v\n1\n")
    assert files.exists(spark, f"file://{tmp_path}/x.csv") and not files.exists(spark, f"file://{tmp_path}/y.csv")
    assert files.read_csv(spark, f"file://{tmp_path}/x.csv").agg(F.sum("v")).first()[0] == 1
