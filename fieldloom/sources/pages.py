"""Portable documents as pages of text and of positioned words.

Tasks turn documents into characters with places (``pdf``, or another ``extractor`` that
gives ``text, x0, x1, top`` of a page's pieces). Lines and words are windows over the
characters of a page: a character starts a line if it lies lower than the one above it
by more than the tolerance, and a word if a blank or more than the tolerance separates it from the one before.
All windows share one exchange by document and page.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import pdf
from .files import exists

#: First bytes of a document, and what a workbook download must not be.
MAGIC = b"%PDF"
Piece = tuple[str, float, float, float]
#: Bytes of a document to the pieces of its pages, in order.
Extractor = Callable[[bytes], Iterator[Iterable[Piece]]]
PAGE = ("doc", "page")
_BROKEN = (ValueError, KeyError, IndexError, TypeError, AttributeError, ArithmeticError, RecursionError, zlib.error)


def pdf_characters(content: bytes) -> Iterator[Iterable[Piece]]:
    document = pdf.Document(content)
    for page in document.pages():
        yield pdf.characters(document, page)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc, content)`` of the files that are documents."""
    if not exists(spark, path):
        raise FileNotFoundError(f"Document not found: {path}")
    return spark.read.format("binaryFile").load(path).where(F.substring("content", 1, 4) == F.lit(MAGIC)).select(F.col("path").alias("doc"), "content")


def characters(docs: DataFrame, extractor: Extractor = pdf_characters, strict: bool = True) -> DataFrame:
    """``(doc, page, char_idx, text, x0, x1, top, error)``, and a row of index -1 without text for each page.

    A document that can't be read is an error, or (``strict=False``) a row with ``error`` after what was read of it.
    """
    names = ("doc", "page", "char_idx", "text", "x0", "x1", "top", "error")
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.string())

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=list(names))

    def run(batches):
        for each in batches:
            for doc, content in zip(each.column("doc").to_pylist(), each.column("content"), strict=True):
                page = -1
                try:
                    for page, pieces in enumerate(extractor(content.as_py() or b"")):
                        rows = [(doc, page, -1, None, None, None, None, None)]
                        rows += [(doc, page, k, text, float(x0), float(x1), float(top), None) for k, (text, x0, x1, top) in enumerate(pieces)]
                        yield batch(rows)
                except _BROKEN as failed:
                    if strict:
                        raise ValueError(f"{doc}, after page {page}: {failed}") from failed
                    yield batch([(doc, page + 1, -1, None, None, None, None, str(failed))])

    return docs.select("doc", "content").mapInArrow(run, "doc string, page int, char_idx int, text string, x0 double, x1 double, top double, error string")


def words_of(chars: DataFrame, x_tolerance: float = 2.0, y_tolerance: float = 2.0) -> DataFrame:
    """``(doc, page, line, word_idx, text, x0, x1, top)``: words by line and place, numbered by page from 0."""
    seen = chars.where("text is not null").withColumn("blank", F.col("text").rlike(r"^\s*$"))
    down = Window.partitionBy(*PAGE).orderBy("top", "char_idx")
    seen = seen.withColumn("lower", F.coalesce((F.col("top") - F.lag("top").over(down) > y_tolerance).cast("int"), F.lit(0)))
    seen = seen.withColumn("line", F.sum("lower").over(down))
    along = Window.partitionBy(*PAGE, "line").orderBy("x0", "char_idx")
    before = F.lag(F.struct("blank", "x0", "x1")).over(along)
    starts = before.isNull() | before["blank"] | (F.col("x0") > before["x1"] + x_tolerance) | (F.col("x0") < before["x0"])
    seen = seen.withColumn("starts", (~F.col("blank") & starts).cast("int")).withColumn("n", F.sum("starts").over(along)).where("not blank")
    item = F.struct("x0", "char_idx", "text")
    made = seen.groupBy(*PAGE, "line", "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda c: c["text"]), "").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"))
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("line", "n")) - 1
    return made.select(*PAGE, "line", number.alias("word_idx"), "text", "x0", "x1", "top")


def page_words(docs: DataFrame, extractor: Extractor = pdf_characters, x_tolerance: float = 2.0, y_tolerance: float = 2.0, strict: bool = True) -> DataFrame:
    """``(doc, page, word_idx, text, x0, x1, top)``."""
    return words_of(characters(docs, extractor, strict), x_tolerance, y_tolerance).drop("line")


def page_texts(docs: DataFrame, extractor: Extractor = pdf_characters, strict: bool = True) -> DataFrame:
    """``(doc, page, text)``: words joined by blanks, lines by line ends; a page without text is empty."""
    chars = characters(docs, extractor, strict)
    words = words_of(chars)
    lines = words.groupBy(*PAGE, "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "text"))), lambda w: w["text"]), " ").alias("text"))
    texts = lines.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda w: w["text"]), "\n").alias("text"))
    # A page's mark joins without another exchange.
    pages = chars.where("char_idx = -1 and error is null").select(*PAGE)
    return pages.join(texts, list(PAGE), "left").select(*PAGE, F.coalesce("text", F.lit("")).alias("text"))


def check_download(content: bytes, kind: str = "", magic: bytes = b"") -> bytes:
    """A download's bytes, if there are any, they aren't a web page and begin as they should."""
    if not content:
        raise ValueError("The downloaded file is empty.")
    if "html" in kind.lower():
        raise ValueError(f"The server returned a web page: {kind}")
    if magic and not content.startswith(magic):
        raise ValueError("The downloaded file is not of the expected type.")
    return content
