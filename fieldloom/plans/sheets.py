"""Workbooks of the bench tables: input of the queries that read workbooks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from datetime import date
from itertools import chain, groupby, islice
from typing import BinaryIO
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared

_MAIN, _REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: Texts that a workbook shares at most; later ones stand in their cells.
SHARED = 100_000


class Book:
    """A workbook that is written row by row; none of its sheets is held."""

    def __init__(self, out: BinaryIO, dimension: bool = True):
        self.zip, self.dimension = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), dimension
        self.names: list[str] = []
        self.strings: dict[str, int] = {}

    def _cell(self, value, at: str) -> str:
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, date):
            return f'<c r="{at}" s="1"><v>{(value - date(1899, 12, 30)).days}</v></c>'
        if isinstance(value, str):
            if value not in self.strings and len(self.strings) >= SHARED:
                return f'<c r="{at}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'
            return f'<c r="{at}" t="s"><v>{self.strings.setdefault(value, len(self.strings))}</v></c>'
        return f'<c r="{at}"><v>{value}</v></c>'

    def sheet(self, name: str, rows: Iterable[list], count: int) -> None:
        """Adds a sheet of ``count`` rows of values: texts, dates, numbers, booleans, None for no cell."""
        self.names.append(name)
        with self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True) as out:
            ref = f'<dimension ref="A1:Z{count}"/>' if self.dimension else ""
            out.write(f'<worksheet xmlns="{_MAIN}">{ref}<sheetData>'.encode())
            lines = (f'<row r="{r}">' + "".join(self._cell(v, f"{chr(65 + c)}{r}") for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1) if row)
            while some := "".join(islice(lines, 1000)):
                out.write(some.encode())
            out.write(b"</sheetData></worksheet>")

    def close(self) -> None:
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(self.names, 1))
        self.zip.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        self.zip.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(self.names) + 1)) + "</Relationships>")
        self.zip.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}">' + "".join(f"<si><t>{escape(s)}</t></si>" for s in self.strings) + "</sst>")
        self.zip.writestr("xl/styles.xml", f'<styleSheet xmlns="{_MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        self.zip.close()


def workbook(sheets: dict[str, list[list]], dimension: bool = True) -> bytes:
    """A workbook of rows of values: texts (shared), dates, numbers, booleans, None for no cell."""
    out = io.BytesIO()
    book = Book(out, dimension)
    for name, rows in sheets.items():
        book.sheet(name, rows, len(rows))
    book.close()
    return out.getvalue()


def write_workbooks(rows: DataFrame, name: str, order: list[str], sheet: str, uri: str, preamble: int = 0, others: dict[str, list[list]] | None = None) -> int:
    """A workbook under a folder for each value of ``name``, with the other columns as a sheet below a preamble, in order. Returns their number.

    A workbook's rows come sorted to the task that writes it, which holds one batch of them at a time.
    """
    columns = [c for c in rows.columns if c != name]
    sizes = rows.groupBy(F.col(name).alias("_name")).agg(F.count(F.lit(1)).alias("_rows"))
    each = rows.join(sizes, F.col(name).eqNullSafe(F.col("_name"))).select(F.coalesce(F.col(name).cast("string"), F.lit("None")).alias("_name"), "_rows", *(F.col(f"`{c}`") for c in columns))
    each = each.repartition("_name").sortWithinPartitions("_name", *(F.col(f"`{c}`") for c in [*order, *(c for c in columns if c not in order)]))
    head = [["Relatório"]] * min(preamble, 1) + [[]] * (preamble - 1) + [columns]

    def write(batches):
        system, path = shared.located(uri)
        system.create_dir(path, recursive=True)
        lines = (line for batch in batches for line in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for each_name, own in groupby(lines, lambda line: line[0]):
            first = next(own)
            with system.open_output_stream(f"{path}/{each_name}.xlsx") as out:
                book = Book(out)
                for other, body in (others or {}).items():
                    book.sheet(other, body, len(body))
                book.sheet(sheet, chain(head, (line[2:] for line in chain([first], own))), len(head) + first[1])
                book.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{each_name}.xlsx"])], names=["name"])

    return each.mapInArrow(write, "name string").count()
