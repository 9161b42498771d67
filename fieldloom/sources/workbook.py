"""Workbooks (Office Open XML) as a data source, by the standard library alone.

``spark.read.format("workbook")`` reads one sheet, or all, of every workbook under a path. A
partition is a file, a sheet and a range of its rows, as planned by the sheet's stated
dimension (a range reads past the rows before it, so a sheet has at most ``RANGES``, longer than asked for if need be); it streams the sheet's XML and holds one batch of rows at a time, besides
the workbook's table of shared strings. Values are texts, dates ``YYYY-MM-DD``; ``_file`` and ``_sheet`` tell where a row comes from.

Options: ``sheet`` (a name, ``#0`` for a place, ``*`` for all; default the first), ``headerRow`` (from
0), ``columns`` (names, by commas: others aren't decoded), ``rowsPerPartition``.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date, timedelta
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import shared

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats that show dates, besides those with day, month or year letters.
_DATE_FORMATS = frozenset((14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47))
ROWS, BATCH = 50_000, 4096
#: Ranges of a sheet at most: with more, what they read past would grow with the square of the rows.
RANGES = 8
#: Bytes of a sheet that are looked at at a time for the row at which a range begins.
BLOCK = 1 << 20
PLACES = ("_file", "_sheet")


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


class _Later:
    """A sheet's stream without rows before ``first``, as far as their numbers tell them without parsing."""

    def __init__(self, stream: BinaryIO, first: int):
        self.stream, self.first = stream, first

    def read(self, size: int) -> bytes:
        if not self.first:
            return self.stream.read(size)
        first, self.first = self.first, 0
        held = self.stream.read(BLOCK)
        start = held.find(b"<row ")
        head, held = (held[:start], held[start:]) if start >= 0 else (b"", held)
        while block := self.stream.read(BLOCK):
            # The last whole row, which states its number as those after it may not; comments and the like could hold anything.
            last = held.rfind(b"<row ", 0, max(held.rfind(b"</row>"), 0))
            stated = re.match(rb'<row r="(\d+)"', held[last : last + 32]) if last >= 0 and b"<!" not in held else None
            if not stated or int(stated[1]) > first:
                return head + held + block
            held = held[last:] + block
        return head + held


class Workbook:
    """A workbook in an open file."""

    def __init__(self, file: BinaryIO):
        self.zip = zipfile.ZipFile(file)
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in self._xml("xl/_rels/workbook.xml.rels")}
        self.sheets = {s.get("name"): targets[s.get(_REL)] for s in self._xml("xl/workbook.xml").iter(f"{_NS}sheet")}
        self._strings: list[str] | None = None
        self._dates: set[int] | None = None

    def _xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def chosen(self, sheet: str) -> list[str]:
        names = list(self.sheets)
        if sheet == "*":
            return names
        if sheet.startswith("#") and sheet not in self.sheets:
            return [names[int(sheet[1:])]]
        if sheet not in self.sheets:
            raise ValueError(f"Expected sheet '{sheet}' was not found. Available sheets: {names}")
        return [sheet]

    def _elements(self, sheet: str, tags: tuple[str, ...], first: int = 0) -> Iterator[ElementTree.Element]:
        target = self.sheets[sheet]
        with self.zip.open(target if target.startswith("xl/") else f"xl/{target}") as stream:
            above = []
            for event, element in ElementTree.iterparse(_Later(stream, first), ("start", "end")):
                if event == "start":
                    above.append(element)
                    continue
                above.pop()
                if element.tag in tags:
                    yield element
                    element.clear()
                    above[-1].remove(element)

    def last_row(self, sheet: str) -> int | None:
        """The number of the last row that the sheet states, if it does."""
        for element in self._elements(sheet, (f"{_NS}dimension", f"{_NS}row")):
            found = re.search(r"(\d+)$", element.get("ref", "")) if element.tag.endswith("dimension") else None
            return int(found[1]) if found else None
        return None

    def rows(self, sheet: str, first: int = 0, last: int | None = None, wanted: set[int] | None = None) -> Iterator[tuple[int, list[str | None]]]:
        """``(number, cells)`` of the rows from ``first`` to before ``last`` that the sheet has, from 0. Cells that aren't wanted are None."""
        number = -1
        for row in self._elements(sheet, (f"{_NS}row",), first):
            number = int(row.get("r", number + 2)) - 1
            if last is not None and number >= last:
                return
            if number >= first:
                cells: list[str | None] = []
                for cell in row.iter(f"{_NS}c"):
                    place = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (place + 1 - len(cells))
                    if wanted is None or place in wanted:
                        cells[place] = self._value(cell)
                yield number, cells

    def strings(self) -> list[str]:
        if self._strings is None:
            self._strings = []
            if "xl/sharedStrings.xml" in self.zip.namelist():
                with self.zip.open("xl/sharedStrings.xml") as stream:
                    for _, element in ElementTree.iterparse(stream):
                        if element.tag == f"{_NS}si":
                            self._strings.append("".join(t.text or "" for t in element.iter(f"{_NS}t")))
                            element.clear()
        return self._strings

    def dates(self) -> set[int]:
        """Numbers of the cell styles that show dates."""
        if self._dates is None:
            self._dates = set()
            if "xl/styles.xml" in self.zip.namelist():
                root = self._xml("xl/styles.xml")
                own = {int(f.get("numFmtId")) for f in root.iter(f"{_NS}numFmt") if re.search("[dmy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
                formats = root.find(f"{_NS}cellXfs")
                self._dates = {k for k, f in enumerate(formats if formats is not None else ()) if int(f.get("numFmtId", 0)) in own | _DATE_FORMATS}
        return self._dates

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind, value = cell.get("t"), cell.find(f"{_NS}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
        if value is None or value.text is None:
            return None
        if kind == "s":
            return self.strings()[int(value.text)]
        if kind == "b":
            return "true" if value.text == "1" else "false"
        if kind is None and int(cell.get("s", 0)) in self.dates():
            return str(date(1899, 12, 30) + timedelta(days=int(float(value.text))))
        return value.text

    def header(self, sheet: str, row: int) -> list[str]:
        """Names of the header row: stripped texts, ``_k`` for an empty cell."""
        for _, cells in self.rows(sheet, row, row + 1):
            return [(c or "").strip() or f"_{k}" for k, c in enumerate(cells)]
        raise ValueError("The worksheet has no header row.")


@contextmanager
def opened(path: str) -> Iterator[Workbook]:
    system, place = shared.located(path)
    with system.open_input_file(place) as file:
        yield Workbook(file)


class Range(InputPartition):
    def __init__(self, file: str, sheet: str, first: int, last: int | None):
        self.file, self.sheet, self.first, self.last = file, sheet, first, last


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def __init__(self, options):
        super().__init__(options)
        # Plain values: these go to every task.
        self.path, self.sheet = options.get("path", ""), options.get("sheet", "#0")
        self.header_row, self.rows = int(options.get("headerRow", 0)), int(options.get("rowsPerPartition", ROWS))
        self.columns = [c.strip() for c in options["columns"].split(",")] if options.get("columns") else None

    def _files(self) -> list[str]:
        files = shared.files_under(self.path, (".xlsx", ".xlsm"))
        if not files:
            raise FileNotFoundError(f"Excel workbook not found: {self.path}")
        system = self.path.split("://")[0] + "://" if "://" in self.path and not self.path.startswith("file:") else ""
        return [f"{system}{f}" for f in files]

    def schema(self) -> str:
        with opened(self._files()[0]) as book:
            names = book.header(book.chosen(self.sheet)[0], self.header_row)
        if absent := [c for c in self.columns or () if c not in names]:
            raise ValueError(f"Columns not found in the worksheet: {absent}")
        return ", ".join(f"`{n.replace('`', '``')}` string" for n in [*(self.columns or names), *PLACES])

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(self, [f.name for f in schema])


class WorkbookReader(DataSourceReader):
    def __init__(self, source: WorkbookSource, names: list[str]):
        self.source, self.names = source, names

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        start, step = self.source.header_row + 1, self.source.rows
        for file in self.source._files():
            with opened(file) as book:
                for sheet in book.chosen(self.source.sheet):
                    stop = max(book.last_row(sheet) or 0, start + 1)
                    edges = [*range(start, stop, max(step, -(-(stop - start) // RANGES)))]
                    # The last range takes whatever follows, as a stated dimension may be too small.
                    out += [Range(file, sheet, a, b) for a, b in zip(edges, [*edges[1:], None], strict=True)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        own = [n for n in self.names if n not in PLACES]
        with opened(partition.file) as book:
            header = book.header(partition.sheet, self.source.header_row)
            if (header != own) if self.source.columns is None else any(n not in header for n in own):
                raise ValueError(f"{partition.file} has other columns: {header}")
            places = [header.index(n) for n in own]
            held: list[list[str | None]] = []
            for _, cells in book.rows(partition.sheet, partition.first, partition.last, set(places)):
                cells += [None] * (len(header) - len(cells))
                if any(cells[k] is not None for k in places):
                    held.append([cells[k] for k in places])
                if len(held) >= BATCH:
                    yield self._batch(held, partition)
                    held = []
            if held:
                yield self._batch(held, partition)

    def _batch(self, rows: list, partition: Range) -> pa.RecordBatch:
        columns = [pa.array(values, pa.string()) for values in zip(*rows, strict=True)]
        where = [pa.array([v] * len(rows), pa.string()) for v in (partition.file, partition.sheet)]
        return pa.RecordBatch.from_arrays([*columns, *where], names=self.names)


def sheet_names(path: str) -> list[str]:
    with opened(path) as book:
        return list(book.sheets)


def read_sheet(spark: SparkSession, path: str, sheet: str | int = 0, header_row: int = 0, columns: list[str] | None = None, rows_per_partition: int = ROWS) -> DataFrame:
    """A sheet of every workbook under a path: one text column for each header cell, ``_file`` and ``_sheet``. All workbooks must have the first one's header."""
    options = {"path": path, "sheet": f"#{sheet}" if isinstance(sheet, int) else sheet, "headerRow": str(header_row), "rowsPerPartition": str(rows_per_partition)}
    options |= {"columns": ",".join(columns)} if columns else {}
    try:
        schema = WorkbookSource(options).schema()
    except FileNotFoundError as failed:
        raise FileNotFoundError(f"Excel workbook not found: {path}") from failed
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").schema(schema).options(**options).load()
