"""Tables rebuilt from positioned words.

Words are rows ``(doc, page, word_idx, text, x0, x1, top)``. Lines are found by a fold
over the words of one page in order of (top, x0): a word joins the first line
whose mean top is within the tolerance. The fold is a SQL aggregate over an array
of one page, so pages are independent and any number of them runs in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

PAGE = ("doc", "page")
# The words of the four header phrases, in order of the columns.
HEADERS = (("quinzena",), ("são", "paulo"), ("centro-sul",), ("demais", "estados"))
TITLE_ROWS = (("", "CANA-DE-AÇÚCAR (toneladas)", None, None), ("Quinzena", "São Paulo", "Centro-Sul", "Demais Estados"))


def _line_of(sums: Column, counts: Column, top: Column, tolerance: float) -> Column:
    """Index of the first line whose mean is near, or the number of lines."""
    near = F.transform(F.zip_with(sums, counts, lambda s, n: F.abs(s / n - top) <= tolerance), lambda hit: hit)
    at = F.array_position(near, True)
    return F.when(at > 0, at - 1).otherwise(F.size(sums)).cast("int")


def lines(words: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """``words`` with ``line``, numbered from 0 in order of first words."""
    item = F.struct("top", "x0", "word_idx", "text", "x1")
    pages = words.groupBy(*PAGE).agg(F.sort_array(F.collect_list(item)).alias("items"))
    empty = F.struct(F.array().cast("array<double>").alias("sums"), F.array().cast("array<bigint>").alias("counts"), F.array().cast("array<int>").alias("place"))

    def step(acc: Column, w: Column) -> Column:
        at = _line_of(acc["sums"], acc["counts"], w["top"], tolerance)
        new = at == F.size(acc["sums"])
        grown = lambda values, by: F.when(new, F.concat(values, F.array(by))).otherwise(F.transform(values, lambda v, i: F.when(i == at, v + by).otherwise(v)))
        return F.struct(grown(acc["sums"], w["top"]).alias("sums"), grown(acc["counts"], F.lit(1).cast("bigint")).alias("counts"), F.concat(acc["place"], F.array(at)).alias("place"))

    folded = pages.withColumn("place", F.aggregate("items", empty, step)["place"])
    both = folded.select(*PAGE, F.explode(F.arrays_zip("items", "place")).alias("z"))
    return both.select(*PAGE, "z.items.word_idx", "z.items.text", "z.items.x0", "z.items.x1", "z.items.top", F.col("z.place").alias("line"))


def boundaries(words: DataFrame) -> DataFrame:
    """``b1, b2, b3`` of every page: midpoints between the centres of the four headers."""
    name = F.lower(text.strip(F.col("text")))
    first = F.min_by(F.struct("x0", "x1"), F.when(name == HEADERS[0][0], F.col("word_idx")))
    spans = [first.alias("c0")]
    for k, phrase in enumerate(HEADERS[1:], 1):
        hit = name.isin(list(phrase))
        spans.append(F.struct(F.min(F.when(hit, F.col("x0"))).alias("x0"), F.max(F.when(hit, F.col("x1"))).alias("x1")).alias(f"c{k}"))
    found = words.groupBy(*PAGE).agg(*spans)
    center = lambda k: F.coalesce((F.col(f"c{k}.x0") + F.col(f"c{k}.x1")) / 2, F.raise_error(F.lit(f"Could not locate header phrase containing: {HEADERS[k]}")).cast("double"))
    return found.select(*PAGE, *((center(k) + center(k + 1)).__truediv__(2).alias(f"b{k + 1}") for k in range(3)))


def cells(words: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """``(doc, page, line, cells)``: the four cells of every line; an empty cell is null."""
    middle = (F.col("x0") + F.col("x1")) / 2
    placed = lines(words, tolerance).join(boundaries(words), list(PAGE))
    column = F.when(middle < F.col("b1"), 0).when(middle < F.col("b2"), 1).when(middle < F.col("b3"), 2).otherwise(3)
    each = placed.withColumn("column", column).groupBy(*PAGE, "line")
    own = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col("column") == k, F.struct("x0", "top", "word_idx", "text")))), lambda w: w["text"])
    return each.agg(F.array(*(text.combined_words(own(k)) for k in range(4))).alias("cells"))


def tables(words: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """``(doc, page, row_idx, cells)``: two title rows, the season row, then the rows of ``DD/MM`` periods."""
    rows = cells(words, tolerance)
    named = F.size(F.regexp_extract_all(F.concat_ws(" ", "cells"), F.lit(r"\b[0-9]{4}/[0-9]{4}\b"), F.lit(0))) >= 2
    season = rows.where(named).groupBy(*PAGE).agg(F.min_by("cells", "line").alias("cells")).withColumn("row_idx", F.lit(2))
    period = F.get(F.filter(F.split(F.coalesce(F.get("cells", F.lit(0)), F.lit("")), r"\s+"), lambda w: w.rlike(text.PERIOD)), F.lit(0))
    data = rows.withColumn("period", period).where(F.col("period").isNotNull())
    data = data.withColumn("cells", F.concat(F.array("period"), F.slice("cells", 2, 3)))
    # Lines are few by page; the number of a row is its place on the page.
    ordered = data.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("line", "cells"))).alias("rows"))
    data = ordered.select(*PAGE, F.posexplode("rows").alias("n", "r")).select(*PAGE, (F.col("n") + 3).alias("row_idx"), F.col("r.cells").alias("cells"))
    titles = season.select(*PAGE, F.posexplode(F.array(*(F.array(*(F.lit(c).cast("string") for c in row)) for row in TITLE_ROWS))).alias("row_idx", "cells"))
    return titles.unionByName(season.select(*PAGE, "row_idx", "cells")).unionByName(data)


def page_with_text(pages: DataFrame, wanted: str) -> DataFrame:
    """``(doc, page)`` of the first page of each document that holds the text in any case."""
    return pages.where(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(wanted.lower()))).groupBy("doc").agg(F.min("page").alias("page"))


def titled_tables(words: DataFrame, title: str, tolerance: float = 4.0) -> DataFrame:
    """Tables of the first page of each document whose text holds the title, from ``words`` with ``line``."""
    spoken = F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "text"))), lambda w: w["text"])
    texts = words.groupBy(*PAGE, "line").agg(F.array_join(spoken, " ").alias("text"))
    pages = page_with_text(texts, title)
    return tables(words.join(pages, list(PAGE), "left_semi").drop("line"), tolerance)
