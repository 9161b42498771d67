"""Parsing of report texts. Strict functions raise when evaluated, ``try_`` ones give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ``DD/MM`` and ``YYYY/YYYY``.
PERIOD = r"^[0-9]{2}/[0-9]{2}$"
SEASON_PAIR = r"[0-9]{4}/[0-9]{4}"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _fail(message: str, c: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), F.coalesce(c.cast("string"), F.lit("NULL"))))


def brazilian_integer(c: Column) -> Column:
    """``8.253.154`` as a long."""
    digits = F.regexp_replace(strip(c), r"\.", "")
    return F.when(digits.rlike("^[0-9]+$"), digits.try_cast("bigint")).otherwise(_fail("Invalid Brazilian integer: ", c).cast("bigint"))


def region_cell(c: Column) -> Column:
    """``previous current percent%`` as a struct of two longs and a double."""
    parts = F.split(strip(c), r"\s+")
    ok = F.when(F.size(parts) == 3, parts).otherwise(F.split(_fail("Region cell must have three values: ", c).cast("string"), " "))
    return F.struct(
        brazilian_integer(F.get(ok, F.lit(0))).alias("previous"),
        brazilian_integer(F.get(ok, F.lit(1))).alias("current"),
        F.regexp_replace(F.regexp_replace(F.get(ok, F.lit(2)), "%", ""), ",", ".").cast("double").alias("variation_percent"),
    )


def try_harvest_season(c: Column) -> Column:
    """``YY-YY`` of ``YY-YY``, ``YYYY/YYYY`` or ``YYYY/YY``; null unless the years follow each other."""
    text = strip(c)
    form = text.rlike(r"^(?:[0-9]{2}|[0-9]{4})[-/](?:[0-9]{2}|[0-9]{4})$")
    first, second = F.right(F.split(text, "[-/]")[0], F.lit(2)), F.right(F.get(F.split(text, "[-/]"), F.lit(1)), F.lit(2))
    follow = F.pmod(first.try_cast("int") + 1, F.lit(100)) == second.try_cast("int")
    return F.when(form & follow, F.concat_ws("-", first, second))


def harvest_season(c: Column) -> Column:
    return F.coalesce(try_harvest_season(c), _fail("Invalid harvest season: ", c).cast("string"))


def header_seasons(cells: Column) -> Column:
    """The first two distinct seasons that a header row names, in order."""
    found = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", cells), F.lit(SEASON_PAIR), F.lit(0)))
    enough = F.when(F.size(found) >= 2, found).otherwise(F.array(_fail("Two harvest seasons expected in the header: ", F.concat_ws(" ", cells)).cast("string")))
    return F.struct(harvest_season(F.get(enough, F.lit(0))).alias("previous"), harvest_season(F.get(enough, F.lit(1))).alias("current"))


def is_season_label(c: Column) -> Column:
    """``YY-YY`` of years that follow each other."""
    return F.coalesce(c.rlike("^[0-9]{2}-[0-9]{2}$") & (F.pmod(F.substring(c, 1, 2).try_cast("int") + 1, F.lit(100)) == F.substring(c, 4, 2).try_cast("int")), F.lit(False))


def boolean_text(c: Column) -> Column:
    """``true`` or ``false`` in any case, and nothing else."""
    text = F.lower(strip(c.cast("string")))
    return F.when(text == "true", True).when(text == "false", False).otherwise(_fail("Invalid boolean: ", c).cast("boolean"))


def without_state(c: Column, suffix: str = " (SP)") -> Column:
    return strip(F.replace(c, F.lit(suffix), F.lit("")))


def combined_words(words: Column) -> Column:
    """Words of a cell, joined by one blank; null for no words at all."""
    return F.when(F.size(words) > 0, F.array_join(F.filter(F.transform(words, strip), lambda w: w != ""), " "))


def mapped(c: Column, table: dict[str, str], keep: bool = True) -> Column:
    """Values replaced by a fixed table; those it lacks stay, or become null."""
    found = F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), c)
    return F.coalesce(found, c) if keep else found
