import datetime

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import calendar, formats, text


def one(spark, *columns, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for n, v in values.items())) if names else spark.range(1)
    return tuple(df.select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


@pytest.mark.parametrize("year, month, inside, harvest", [(2019, 8, False, None), (2019, 9, True, 2020), (2019, 12, True, 2020), (2020, 1, True, 2020), (2020, 4, True, 2020), (2020, 5, False, None)])
def test_seasons(spark, year, month, inside, harvest):
    assert one(spark, calendar.in_growing_season(F.col("m")), calendar.harvest_year(F.col("y"), F.col("m")), y=year, m=month) == (inside, harvest)


def test_season_bounds():
    for start, end in ((0, 4), (9, 13), (4, 9)):
        with pytest.raises(ValueError):
            calendar.check_season(start, end)


@pytest.mark.parametrize("spelt, label", [("25-26", "25-26"), ("2025/2026", "25-26"), ("2025/26", "25-26"), (" 2025/26\t", "25-26"), ("99-00", "99-00"), ("25-27", None), ("2025/2027", None), ("2025", None), ("5-26", None), ("20255-26", None)])
def test_season_labels(spark, spelt, label):
    assert one(spark, text.try_harvest_season(F.col("s")), s=spelt) == (label,)
    if label is None:
        with pytest.raises(Exception, match="Invalid harvest season"):
            one(spark, text.harvest_season(F.col("s")), s=spelt)


@pytest.mark.parametrize("season, ok", [("10-11", True), ("24-25", True), ("98-99", True), ("99-00", True), ("2025/26", False), ("25/26", False), ("5-26", False), ("025-26", False), ("25-27", False), ("99-01", False), ("season 25-26", False), ("", False)])
def test_label_check(spark, season, ok):
    assert one(spark, text.is_season_label(F.col("s")), s=season) == (ok,)


@pytest.mark.parametrize("period, date", [("16/04", "2025-04-16"), ("01/08", "2025-08-01"), ("16/12", "2025-12-16"), ("01/01", "2026-01-01"), ("16/03", "2026-03-16"), ("01/04", "2025-04-01")])
def test_period_dates(spark, period, date):
    assert str(one(spark, calendar.period_end_date(F.lit("25-26"), F.col("p")), p=period)[0]) == date


def test_closing_period_belongs_to_the_next_year(spark):
    assert one(spark, calendar.period_end_date(F.lit("25-26"), F.lit("01/04"), season_end_inclusive=True)) == (datetime.date(2026, 4, 1),)


def test_cutoff_rollover(spark):
    reference = F.lit("2027-02-16").cast("date")
    assert one(spark, calendar.matched_cutoff(F.lit(2025), reference), calendar.matched_cutoff(F.lit(2025), reference, rollover=True)) == (datetime.date(2025, 2, 16), datetime.date(2026, 2, 16))


def test_assigned_season(spark):
    assert one(spark, calendar.assigned_season(F.lit(2025), F.lit(9)), calendar.assigned_season(F.lit(2026), F.lit(4))) == ("26-27", "26-27")
    with pytest.raises(Exception, match="outside"):
        one(spark, calendar.assigned_season(F.col("y"), F.col("m")), y=2025, m=6)


def test_numbers(spark):
    assert one(spark, text.brazilian_integer(F.lit(" 8.253.154 "))) == (8253154,)
    for bad in ("", "8,253,154", "8.253.154 tonnes", "abc"):
        with pytest.raises(Exception, match="Invalid Brazilian integer"):
            one(spark, text.brazilian_integer(F.col("s")), s=bad)
    cell = one(spark, text.region_cell(F.lit("8.253.154 11.007.246 33,4%")))[0]
    assert tuple(cell) == (8253154, 11007246, 33.4)
    with pytest.raises(Exception, match="three values"):
        one(spark, text.region_cell(F.col("s")), s="8.253.154 33%")


def test_headers(spark):
    cells = F.array(F.lit("Período"), F.lit("2024/2025"), F.lit(None).cast("string"), F.lit("2025/2026 2024/2025"))
    assert tuple(one(spark, text.header_seasons(cells))[0]) == ("24-25", "25-26")
    with pytest.raises(Exception, match="Two harvest seasons"):
        one(spark, text.header_seasons(F.array(F.col("s"))), s="2024/2025")


def test_small_texts(spark):
    assert one(spark, text.strip(F.lit("\t a b \n")), text.without_state(F.lit("Adolfo (SP)")), text.mapped(F.lit("x"), {"a": "b"}), text.mapped(F.lit("x"), {"a": "b"}, keep=False)) == ("a b", "Adolfo", "x", None)
    assert one(spark, text.boolean_text(F.lit("True")), text.boolean_text(F.lit("false"))) == (True, False)
    with pytest.raises(Exception, match="Invalid boolean"):
        one(spark, text.boolean_text(F.col("s")), s="yes")
    assert one(spark, text.combined_words(F.array(F.lit(" a"), F.lit(""), F.lit("b"))), text.combined_words(F.array().cast("array<string>"))) == ("a b", None)


def test_formats(spark):
    ordinals = [one(spark, formats.ordinal(F.col("n")), n=n)[0] for n in (1, 2, 3, 4, 11, 12, 13, 21, 112)]
    assert ordinals == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th"]
    colors = [one(spark, formats.rank_color(F.col("n"), F.lit(7)), n=n)[0] for n in (1, 2, 3, 5, 6, 7)]
    assert colors == [formats.TOP] * 2 + [formats.MIDDLE] * 2 + [formats.BOTTOM] * 2
    assert one(spark, formats.rank_color(F.lit(2), F.lit(3))) == (formats.TOP,)
    assert one(spark, formats.number_text(F.lit(81126838), 2, 1e6, "Mt"), formats.number_text(F.lit(1234.5), 0)) == ("81.13 Mt", "1,234")
    assert formats.elapsed(3723) == "1h 02m 03s" and formats.elapsed(75) == "1m 15s" and formats.elapsed(1.5) == "1.50s"
