"""Workbooks (.xlsx): sheets read as rows of texts, and views written as workbooks.

A workbook is a zip archive of XML parts.  Reading takes the files through Spark, so any
file system that Spark knows will do, one task for a file, and streams the rows of a sheet;
a sheet holds 1,048,576 rows at most.  Writing is a Python data source: each task streams
its rows into a workbook in a staging folder, and the commit on the driver moves the files
into place, or removes them if there is nothing to export.
"""

from __future__ import annotations

import math
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from datetime import date
from decimal import Decimal
from io import BytesIO
from typing import IO
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# --- fixed values: the format's limits and names -------------------------------
MAX_ROWS = 1_048_576
MAX_COLUMNS = 16_384
MAX_TEXT = 32_767
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"

ROWS_PER_BATCH = 2_000
ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
UNSAFE = re.compile(r"[\x00-\x08\x0b-\x1f]|_(?=x[0-9A-Fa-f]{4}_)")


class EmptyViewError(ValueError):
    """There are no rows to export."""


# --- reading -------------------------------------------------------------------

def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(element) -> str:
    """The text of a string item: of itself or of its runs, without phonetic hints."""
    parts = []
    for child in element:
        name = _local(child.tag)
        if name == "t":
            parts.append(child.text or "")
        elif name == "r":
            parts += [t.text or "" for t in child if _local(t.tag) == "t"]
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


def _streamed(part: IO[bytes], container: str, item: str) -> Iterator:
    """The ``item`` elements of a part, each dropped after use."""
    holder = None
    for event, element in iterparse(part, events=("start", "end")):
        name = _local(element.tag)
        if event == "start" and name == container:
            holder = element
        elif event == "end" and name == item:
            yield element
            if holder is not None:
                holder.clear()


def _column(reference: str) -> int:
    """Column number, from 0, of a reference like ``AB12``."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _value(cell, shared: list[str]) -> str | None:
    kind, raw = cell.get("t", "n"), None
    for child in cell:
        name = _local(child.tag)
        if name == "is":
            return _text(child)
        if name == "v":
            raw = child.text
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "true" if raw == "1" else "false"
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)), raw) if kind == "str" else raw


def sheet_rows(content: bytes, sheet: str | int = 0) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 0, cells) of the rows of a sheet; blank cells are None, rows without cells are left out.

    Cells are texts: numbers as the file spells them, truth values as true and false,
    error values as None.  Dates are the numbers that the file holds.
    """
    with zipfile.ZipFile(BytesIO(content)) as book:
        names = set(book.namelist())
        with book.open("xl/_rels/workbook.xml.rels") as part:
            targets = {r.get("Id"): r.get("Target") for r in _streamed(part, "Relationships", "Relationship")}
        with book.open("xl/workbook.xml") as part:
            sheets = [(s.get("name"), targets[s.get(f"{{{LINKS}}}id")]) for s in _streamed(part, "sheets", "sheet")]
        found = [t for i, (n, t) in enumerate(sheets) if (i if isinstance(sheet, int) else n) == sheet]
        if not found:
            raise ValueError(f"no sheet {sheet!r} among {', '.join(n for n, _ in sheets)}")
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as part:
                shared = [_text(s) for s in _streamed(part, "sst", "si")]
        target = found[0]
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
            number = -1
            for row in _streamed(part, "sheetData", "row"):
                number = int(row.get("r", number + 2)) - 1
                cells: list[str | None] = []
                for cell in row:
                    at = _column(cell.get("r", "")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value = _value(cell, shared)
                    cells[at] = (value.strip() or None) if value else None
                if cells:
                    yield number, cells


def read_workbooks(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """Rows (file, row, cells) of one sheet, by name or number from 0, of the workbooks under ``path``.

    A file that is no workbook or lacks the sheet fails the read; the error names it.
    """
    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                out = []
                try:
                    for number, cells in sheet_rows(content, sheet):
                        out.append((file, number, cells))
                        if len(out) >= ROWS_PER_BATCH:
                            yield pd.DataFrame(out, columns=["file", "row", "cells"])
                            out = []
                except (ValueError, KeyError, IndexError, SyntaxError, zipfile.BadZipFile) as error:
                    raise ValueError(f"{file}: {error}") from error
                yield pd.DataFrame(out, columns=["file", "row", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInPandas(rows, "file string, row long, cells array<string>")


# --- writing -------------------------------------------------------------------

def _letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell_xml(value, reference: str) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, Decimal)) or (isinstance(value, float) and math.isfinite(value)):
        return f'<c r="{reference}"><v>{value!r}</v></c>' if isinstance(value, float) else f'<c r="{reference}"><v>{value}</v></c>'
    text = value.isoformat() if isinstance(value, date) else str(value)
    if len(text) > MAX_TEXT:
        raise ValueError(f"a cell holds {MAX_TEXT} characters at most, {reference} has {len(text)}")
    safe = escape(UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", text))
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{safe}</t></is></c>'


def write_workbook(stream: IO[bytes], header: Sequence[str] | None, rows: Iterable[Sequence], sheet: str = "Sheet1") -> int:
    """Stream a workbook; the number of rows.  Rows beyond a sheet's limit go to further sheets, each with the header."""
    letters = [_letters(i) for i in range(len(header or ()))]
    count, names = 0, []

    def row_xml(number: int, values: Sequence) -> bytes:
        if len(values) > MAX_COLUMNS:
            raise ValueError(f"a sheet holds {MAX_COLUMNS} columns at most")
        letters.extend(_letters(i) for i in range(len(letters), len(values)))
        cells = "".join(_cell_xml(v, f"{c}{number}") for v, c in zip(values, letters, strict=False))
        return f'<row r="{number}">{cells}</row>'.encode()

    pending = iter(rows)
    ahead = next(pending, None)
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=3) as book:
        while not names or ahead is not None:
            names.append(sheet if not names else f"{sheet} ({len(names) + 1})")
            with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as part:
                part.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
                number = 0
                if header is not None:
                    number = 1
                    part.write(row_xml(1, header))
                while ahead is not None and number < MAX_ROWS:
                    number, count = number + 1, count + 1
                    part.write(row_xml(number, ahead))
                    ahead = next(pending, None)
                part.write(b"</sheetData></worksheet>")
        spread, numbers = "application/vnd.openxmlformats-officedocument.spreadsheetml", range(1, len(names) + 1)
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" '
            'ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" '
            f'ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{spread}.sheet.main+xml"/>'
            + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{spread}.worksheet+xml"/>' for i in numbers)
            + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" '
            f'Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>'
            + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, names, strict=True))
            + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">'
            + "".join(f'<Relationship Id="rId{i}" Type="{LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
            + "</Relationships>",
        }
        for name, text in parts.items():
            book.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{text}')
    return count


class _Staged(WriterCommitMessage):
    def __init__(self, path: str | None, rows: int):
        self.path, self.rows = path, rows


class WorkbookWriter(DataSourceWriter):
    """Writes a workbook per task to a staging folder and moves them into place on commit."""

    def __init__(self, options, schema: StructType, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.sheet = options.get("sheet", "Sheet1")
        self.header = schema.names if options.get("header", "true").lower() == "true" else None
        self.refuse_empty = options.get("refuseempty", "false").lower() == "true"
        self.overwrite = overwrite
        self.run = uuid.uuid4().hex
        self.staging = f"{self.path}/_staging-{self.run}"

    def write(self, iterator: Iterator) -> _Staged:
        first = next(iterator, None)
        if first is None:
            return _Staged(None, 0)
        task = TaskContext.get()
        files, folder = located(self.staging)
        files.create_dir(folder, recursive=True)
        name = f"part-{task.partitionId():05d}-{self.run}.{task.taskAttemptId()}.xlsx"

        def rows() -> Iterator:
            yield first
            yield from iterator

        with files.open_output_stream(f"{folder}/{name}") as stream:
            return _Staged(name, write_workbook(stream, self.header, rows(), self.sheet))

    def commit(self, messages: list[_Staged | None]) -> None:
        done = [m for m in messages if m is not None and m.path]
        if self.refuse_empty and not done:
            raise EmptyViewError("no rows to export")
        files, folder = located(self.path)
        files.create_dir(folder, recursive=True)
        old = [f for f in listed(files, folder) if f.endswith(".xlsx")] if self.overwrite else []
        for m in done:
            files.move(f"{located(self.staging)[1]}/{m.path}", f"{folder}/{m.path}")
        for f in old:
            files.delete_file(f)
        self.abort(messages)
        with files.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        files, folder = located(self.staging)
        if exists(files, folder):
            files.delete_dir(folder)


class WorkbookSource(DataSource):
    """``df.write.format("workbook")``: options ``path``, ``sheet``, ``header``, ``refuseEmpty``."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options, schema, overwrite)


def located(path: str):
    """The file system of a path and the path within it; a path without a scheme is local."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def exists(files, path: str) -> bool:
    return files.get_file_info(path).type.name != "NotFound"


def listed(files, folder: str, recursive: bool = False) -> list[str]:
    from pyarrow import fs

    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=recursive))
    return [f.path for f in found if f.is_file]


def write_workbooks(df: DataFrame, path: str, mode: str = "errorifexists", sheet: str = "Sheet1",
                    header: bool = True, refuse_empty: bool = True) -> str:
    """Write ``df`` to the folder ``path``, a workbook for each partition with rows, in one job.

    ``coalesce`` before gives fewer files.  All executors must see ``path``.  An empty view
    raises ``EmptyViewError`` and leaves nothing behind, unless ``refuse_empty`` is False.
    """
    if mode not in ("errorifexists", "error", "append", "overwrite"):
        raise ValueError(f"mode must be errorifexists, append or overwrite, not {mode!r}")
    files, folder = located(path)
    there = exists(files, folder)
    if there and mode.startswith("error"):
        raise FileExistsError(f"{path} already exists")
    df.sparkSession.dataSource.register(WorkbookSource)
    writer = df.write.format("workbook").mode("overwrite" if mode == "overwrite" else "append")
    try:
        writer.options(sheet=sheet, header=header, refuseEmpty=refuse_empty).save(path)
    except Exception as error:
        if not there and exists(files, folder) and not listed(files, folder):
            files.delete_dir(folder)
        if "EmptyViewError" in str(error):
            raise EmptyViewError("no rows to export") from error
        raise
    return path
