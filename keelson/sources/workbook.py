"""Workbooks (.xlsx) as rows of cells.

Spark reads the files, so they may lie in any store that it reaches. A workbook
is an archive of one XML file a sheet: its directory is read once, and each sheet
goes to a task of its own, still packed. There it is unpacked and parsed piece by
piece, so a sheet's size is no matter; only the workbook's table of shared texts
is held whole.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: numbers of the built-in formats that show dates, and the days that dates count from.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
EPOCHS = {False: datetime(1899, 12, 30), True: datetime(1904, 1, 1)}
_PACKED = "file string, sheet string, position int, active boolean, epoch_1904 boolean, packed binary, method int, texts binary, texts_method int, styles binary"
_ROWS = "file string, sheet string, active boolean, row int, cells array<string>"
_BATCH = 2000


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _stored(content: bytes, archive: zipfile.ZipFile, name: str) -> tuple[bytes, int]:
    """A member as it lies in the archive, and how it is packed."""
    member = archive.getinfo(name)
    start = member.header_offset
    skipped = 30 + int.from_bytes(content[start + 26 : start + 28], "little") + int.from_bytes(content[start + 28 : start + 30], "little")
    return content[start + skipped : start + skipped + member.compress_size], member.compress_type


def _elements(packed: bytes, method: int, wanted: str) -> Iterator[ElementTree.Element]:
    """The elements of a name, each forgotten after it was used, of a packed XML file."""
    unpack = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
    parser, above = ElementTree.XMLPullParser(["start", "end"]), []
    for at in range(0, len(packed), 1 << 16):
        piece = packed[at : at + (1 << 16)]
        parser.feed(unpack.decompress(piece) if unpack else piece)
        for event, element in parser.read_events():
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if _tag(element) == wanted:
                yield element
                above[-1].remove(element)
    parser.close()


def _text(element: ElementTree.Element) -> str:
    """A rich text's runs joined, without its phonetic hints."""
    return "".join(t.text or "" for part in element if _tag(part) in ("t", "r") for t in ([part] if _tag(part) == "t" else [x for x in part if _tag(x) == "t"]))


def _sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a sheet of each workbook."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            content = content.as_py()
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                names = set(archive.namelist())
                book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
                links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
                view = next((e for e in book.iter() if _tag(e) == "workbookView"), None)
                active = int(view.get("activeTab", 0)) if view is not None else 0
                properties = next((e for e in book.iter() if _tag(e) == "workbookPr"), None)
                old = properties is not None and properties.get("date1904") in ("1", "true")
                texts, texts_method = _stored(content, archive, "xl/sharedStrings.xml") if "xl/sharedStrings.xml" in names else (None, 0)
                styles = archive.read("xl/styles.xml") if "xl/styles.xml" in names else None
                for i, sheet in enumerate(e for e in book.iter() if _tag(e) == "sheet"):
                    target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
                    member = target[1:] if target.startswith("/") else f"xl/{target}"
                    if member in names and "/worksheets/" in f"/{member}":
                        packed, method = _stored(content, archive, member)
                        yield pa.RecordBatch.from_pylist([{"file": path, "sheet": sheet.get("name"), "position": i, "active": i == active, "epoch_1904": old, "packed": packed, "method": method, "texts": texts, "texts_method": texts_method, "styles": styles}], schema=_arrow(_PACKED))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    return pa.schema([pa.field(name, kinds[kind]) for name, kind in (part.split(" ") for part in ddl.split(", "))])


def _date_styles(styles: bytes | None) -> set[int]:
    """Which of a workbook's cell styles show dates."""
    if styles is None:
        return set()
    root = ElementTree.fromstring(styles)
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or "").lower() for f in root.iter() if _tag(f) == "numFmt"}
    dates = DATE_FORMATS | {i for i, code in own.items() if re.search("[dmhysg]", code.replace("general", ""))}
    cells = next((e for e in root if _tag(e) == "cellXfs"), ())
    return {i for i, f in enumerate(cells) if int(f.get("numFmtId") or 0) in dates}


def _column(reference: str) -> int:
    n = 0
    for letter in reference:
        if not letter.isalpha():
            break
        n = 26 * n + ord(letter.upper()) - 64
    return n - 1


def _value(cell: ElementTree.Element, texts: list[str], dates: set[int], epoch: datetime) -> str | None:
    """A cell as text: dates by ISO, formulas by their stored results, and null where there is none."""
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return next((_text(e) for e in cell if _tag(e) == "is"), None)
    stored = next((e.text for e in cell if _tag(e) == "v"), None)
    if stored is None or kind == "str":
        return stored
    if kind == "s":
        return texts[int(stored)]
    if kind == "b":
        return "True" if stored == "1" else "False"
    if kind == "n" and int(cell.get("s") or 0) in dates:
        return (epoch + timedelta(days=float(stored))).date().isoformat()
    return stored


def _reader(columns: set[int] | None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sheet in batch.to_pylist():
                texts = [_text(e) for e in _elements(sheet["texts"], sheet["texts_method"], "si")] if sheet["texts"] else []
                dates, epoch = _date_styles(sheet["styles"]), EPOCHS[sheet["epoch_1904"]]
                held, number = [], 0
                for row in _elements(sheet["packed"], sheet["method"], "row"):
                    number = int(row.get("r") or number + 1)
                    cells: list[str | None] = []
                    for cell in row:
                        at = _column(cell.get("r") or "") if cell.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        if columns is None or at in columns:
                            cells[at] = _value(cell, texts, dates, epoch)
                    held.append({"file": sheet["file"], "sheet": sheet["sheet"], "active": sheet["active"], "row": number, "cells": cells})
                    if len(held) == _BATCH:
                        yield pa.RecordBatch.from_pylist(held, schema=_arrow(_ROWS))
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_arrow(_ROWS))

    return read


def read_workbooks(spark: SparkSession, path: str, columns: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """``file, sheet, active, row, cells`` of all workbooks at a path, in as many tasks as there are sheets.

    Rows without cells are left out; ``cells`` is as long as the row. Of
    ``columns`` (letters) the others are null and not converted. Charts have no rows.
    """
    wanted = None if columns is None else {_column(c) for c in columns}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInArrow(_sheets, _PACKED).repartition(tasks or spark.sparkContext.defaultParallelism, F.xxhash64("file", "sheet")).mapInArrow(_reader(wanted), _ROWS)


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """The RFIs of the registers at a path, each on its workbook's active sheet (see ``tables.register``)."""
    from .tables import register

    return register(read_workbooks(spark, path).where("active").select("file", "row", "cells"))
