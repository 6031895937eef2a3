"""Spreadsheets: .xlsx and .xls read as text cells, .xlsx written.

Reading goes through Spark's binary file source, so a path may be on any file system that Spark opens, and a folder of sheets
is read by as many tasks as it has files. Writing is a data source, ``df.write.format("xlsx")``: each partition streams its
rows into a file of its own, under a name that only the commit makes final; an aborted job leaves nothing.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_NS = {"m": _MAIN}
#: Fixed value: rows of a sheet, its heading included.
MOST_ROWS = 1_048_576


# .xlsx


def _plain(text: str) -> str:
    """Text of a cell: ``_xHHHH_`` stands for a character that XML cannot hold."""
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _coded(text: str) -> str:
    text = re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return re.sub("[\x00-\x08\x0b-\x1f\ufffe\uffff\ud800-\udfff]", lambda m: f"_x{ord(m[0]):04X}_", text)


def _text_of(item: ElementTree.Element) -> str:
    """The text of a string item, without readings that are only shown above it."""
    parts = item.findall("m:t", _NS) + item.findall("m:r/m:t", _NS)
    return _plain("".join(t.text or "" for t in parts))


def _first_sheet(z: zipfile.ZipFile) -> str:
    """The part of the workbook's first sheet."""
    names = set(z.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        first = ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets/m:sheet", _NS)
        for link in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            if first is not None and link.get("Id") == first.get(f"{{{_LINKS}}}id"):
                target = link.get("Target", "").lstrip("/")
                target = target if target.startswith("xl/") else f"xl/{target}"
                if target in names:
                    return target
    return sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rpartition("/")[2])[0]))[0]


def xlsx_rows(content: bytes) -> Iterator[list[str | None]]:
    """The rows of the first sheet as text cells, read as a stream."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as part:
                for _, item in ElementTree.iterparse(part):
                    if item.tag == f"{{{_MAIN}}}si":
                        strings.append(_text_of(item))
                        item.clear()
        with z.open(_first_sheet(z)) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{{{_MAIN}}}row":
                    continue
                cells: dict[int, str | None] = {}
                for at, c in enumerate(row.findall("m:c", _NS)):
                    letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                    k = sum((ord(x) - 64) * 26**p for p, x in enumerate(reversed(letters))) - 1 if letters else at
                    value, kind, own = c.find("m:v", _NS), c.get("t"), c.find("m:is", _NS)
                    if own is not None:
                        cells[k] = _text_of(own)
                    elif value is not None and value.text is not None:
                        cells[k] = strings[int(value.text)] if kind == "s" else _plain(value.text) if kind == "str" else value.text
                yield [cells.get(k) for k in range(max(cells, default=-1) + 1)]
                row.clear()


# .xls: a compound file whose workbook stream is a list of records


class _Compound:
    """Streams of a compound file by name."""

    def __init__(self, content: bytes):
        if content[:8] != bytes.fromhex("D0CF11E0A1B11AE1"):
            raise ValueError("not a compound file")
        self.content = content
        self.size, self.small = 1 << struct.unpack_from("<H", content, 30)[0], 1 << struct.unpack_from("<H", content, 32)[0]
        directory, self.least, small_start, _, extra, _ = struct.unpack_from("<I4xI4I", content, 48)
        sectors = [s for s in struct.unpack_from("<109I", content, 76) if s < 0xFFFFFFFA]
        seen = set()
        while extra < 0xFFFFFFFA and extra not in seen:  # more sectors of the table than the header names
            seen.add(extra)
            *more, extra = struct.unpack_from(f"<{self.size // 4}I", content, (extra + 1) * self.size)
            sectors += [s for s in more if s < 0xFFFFFFFA]
        self.next = [x for s in sectors for x in struct.unpack_from(f"<{self.size // 4}I", content, (s + 1) * self.size)]
        self.small_next = [x for (x,) in struct.iter_unpack("<I", self._chain(small_start))]
        entries = self._chain(directory)
        self.entries = {}
        for at in range(0, len(entries) - 127, 128):
            length, kind, start, size = *struct.unpack_from("<HB", entries, at + 64), *struct.unpack_from("<II", entries, at + 116)
            if kind:
                self.entries[entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace")] = (kind, start, size)
        self.ministream = next((self._chain(start) for kind, start, _ in self.entries.values() if kind == 5), b"")

    def _chain(self, sector: int) -> bytes:
        out, left = [], len(self.content) // self.size + 1
        while sector < 0xFFFFFFFA and left:
            out.append(self.content[(sector + 1) * self.size : (sector + 2) * self.size])
            sector, left = self.next[sector], left - 1
        return b"".join(out)

    def stream(self, *names: str) -> bytes:
        name = next((n for n in names if n in self.entries), None)
        if name is None:
            raise ValueError(f"no stream {' or '.join(names)}")
        _, start, size = self.entries[name]
        if size >= self.least:
            return self._chain(start)[:size]
        out, left = [], len(self.small_next) + 1
        while start < 0xFFFFFFFA and left:
            out.append(self.ministream[start * self.small : (start + 1) * self.small])
            start, left = self.small_next[start], left - 1
        return b"".join(out)[:size]


class _Pieces:
    """The data of a record and of those that continue it; text that is cut goes on behind a new flag of its width."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.k, self.at = pieces, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            while self.at >= len(self.pieces[self.k]):
                self.k, self.at = self.k + 1, 0
            part = self.pieces[self.k][self.at : self.at + n]
            out, self.at, n = out + part, self.at + len(part), n - len(part)
        return out

    def text(self, n: int) -> str:
        """A string of n characters with its flags."""
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while n:
            if self.at >= len(self.pieces[self.k]):
                self.k, self.at = self.k + 1, 1
                wide = self.pieces[self.k][0] & 1
            some = min(n, (len(self.pieces[self.k]) - self.at) >> wide)
            raw = self.pieces[self.k][self.at : self.at + (some << wide)]
            out.append(raw.decode("utf-16-le", "replace") if wide else raw.decode("latin-1"))
            self.at, n = self.at + len(raw), n - some
        self.take(4 * runs + extra)
        return "".join(out)


def _number(value: float) -> str:
    """As .xlsx files write it: whole numbers without a point."""
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def _short_number(raw: int) -> float:
    """A number in 30 bits: an integer or the upper bits of a double, either in hundredths."""
    value = float(raw >> 2 if raw < 1 << 31 else (raw >> 2) - (1 << 30)) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


def xls_rows(content: bytes) -> Iterator[list[str | None]]:
    """The rows of the first sheet of a workbook of 1997 or later as text cells."""
    book = _Compound(content).stream("Workbook", "Book")

    def records(at: int) -> Iterator[tuple[int, bytes, int]]:
        while at + 4 <= len(book):
            kind, size = struct.unpack_from("<HH", book, at)
            yield kind, book[at + 4 : at + 4 + size], at + 4 + size
            at += 4 + size

    strings: list[str] = []
    start, pieces = None, None
    for kind, data, _ in records(0):
        if kind == 0x2F:
            raise ValueError("the workbook is encrypted")
        if kind == 0x0809 and struct.unpack_from("<H", data)[0] != 0x0600:
            raise ValueError("workbooks before 1997 are not read")
        if kind == 0x85 and start is None and data[5] == 0:  # the first sheet with cells
            start = struct.unpack_from("<I", data)[0]
        if kind == 0xFC:
            pieces = [data]
        elif kind == 0x3C and pieces:
            pieces.append(data)
        elif pieces is not None and not strings:
            own = _Pieces([pieces[0][8:], *pieces[1:]])
            strings = [own.text(struct.unpack("<H", own.take(2))[0]) for _ in range(struct.unpack_from("<I", pieces[0], 4)[0])]
            pieces = None
        if kind == 0x0A:
            break
    cells: dict[int, dict[int, str]] = {}
    put = lambda row, column, value: cells.setdefault(row, {}).__setitem__(column, value)
    formula = None
    for kind, data, _ in records(start if start is not None else len(book)):
        if kind == 0x0A:
            break
        if kind in (0xFD, 0x0203, 0x027E, 0x06, 0x0204, 0x0205):
            row, column = struct.unpack_from("<HH", data)
        if kind == 0xFD:
            put(row, column, strings[struct.unpack_from("<I", data, 6)[0]])
        elif kind == 0x0203:
            put(row, column, _number(struct.unpack_from("<d", data, 6)[0]))
        elif kind == 0x027E:
            put(row, column, _number(_short_number(struct.unpack_from("<I", data, 6)[0])))
        elif kind == 0xBD:
            row, first = struct.unpack_from("<HH", data)
            for k in range((len(data) - 6) // 6):
                put(row, first + k, _number(_short_number(struct.unpack_from("<I", data, 6 + 6 * k)[0])))
        elif kind == 0x0204:
            put(row, column, _Pieces([data[8:]]).text(struct.unpack_from("<H", data, 6)[0]))
        elif kind == 0x0205 and not data[7]:
            put(row, column, str(data[6]))
        elif kind == 0x06:
            formula = (row, column) if data[12:14] == b"\xff\xff" and data[6] == 0 else None
            if data[12:14] != b"\xff\xff":
                put(row, column, _number(struct.unpack_from("<d", data, 6)[0]))
            elif data[6] == 1:
                put(row, column, str(data[8]))
        elif kind == 0x0207 and formula:
            put(*formula, _Pieces([data[2:]]).text(struct.unpack_from("<H", data)[0]))
    for row in range(max(cells, default=-1) + 1):
        own = cells.get(row, {})
        yield [own.get(k) for k in range(max(own, default=-1) + 1)]


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    return xls_rows(content) if content[:4] == b"\xd0\xcf\x11\xe0" else xlsx_rows(content)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a file, or of each file of a folder or pattern, as text columns named by the first row, and ``row_no``.

    Sheets of a folder have the same heading; their rows follow each other in order of the files' names.
    """
    files = spark.read.format("binaryFile").load(path).filter(F.lower("path").rlike(r"\.xlsx?$"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, next(sheet_rows(c), [])) for p, c in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([h for _, h in found], pa.list_(pa.string()))], names=["path", "head"])

    first = files.select("path", "content").mapInArrow(heads, "path string, head array<string>").agg(F.min(F.struct("path", "head"))).first()[0]
    names = [(h or "").strip() or f"_{k}" for k, h in enumerate(first["head"])] if first else []

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                rows = sheet_rows(content)
                next(rows, None)
                held: list[list[str | None]] = []
                at = 0
                for row in rows:
                    held.append((row + [None] * len(names))[: len(names)])
                    if len(held) == 10_000:
                        yield _batch(p, at, held, len(names))
                        at, held = at + len(held), []
                yield _batch(p, at, held, len(names))

    schema = "path string, at long" + "".join(f", c{k} string" for k in range(len(names)))
    rows = files.select("path", "content").mapInArrow(body, schema)
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))  # a row for each file
    starts = counts.select("path", F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"))
    return rows.join(starts, "path").select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)], (F.col("before") + F.col("at")).alias("row_no"))


def _batch(path: str, at: int, rows: list[list[str | None]], width: int) -> pa.RecordBatch:
    columns = [pa.array([path] * len(rows), pa.string()), pa.array(range(at, at + len(rows)), pa.int64())]
    columns += [pa.array([r[k] for r in rows], pa.string()) for k in range(width)]
    return pa.RecordBatch.from_arrays(columns, names=["path", "at", *[f"c{k}" for k in range(width)]])


# Writing

_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_LINKS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _letters(k: int) -> str:
    return ("" if k < 26 else _letters(k // 26 - 1)) + chr(65 + k % 26)


def _cell(row: int, column: int, value: Any) -> str:
    at = quoteattr(f"{_letters(column)}{row}")
    if isinstance(value, bool):
        return f'<c r={at} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float | Decimal) and value == value and abs(value) != float("inf"):
        return f"<c r={at}><v>{value!r}</v></c>" if isinstance(value, float) else f"<c r={at}><v>{value}</v></c>"
    return f'<c r={at} t="inlineStr"><is><t xml:space="preserve">{escape(_coded(str(value)))}</t></is></c>'


def write_rows(out: Any, names: list[str], rows: Iterator[Any]) -> int:
    """Streams a heading and rows into a file; the number of rows."""
    n = 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _PARTS.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            line = lambda k, cells: sheet.write(f'<row r="{k}">{"".join(_cell(k, c, v) for c, v in enumerate(cells) if v is not None)}</row>'.encode())
            sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode())
            line(1, names)
            for row in rows:
                n += 1
                if n >= MOST_ROWS:
                    raise ValueError(f"a sheet holds {MOST_ROWS - 1} rows; write more partitions")
                line(n + 1, row)
            sheet.write(b"</sheetData></worksheet>")
    return n


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class SheetTarget(DataSource):
    """``df.write.format("xlsx").mode("overwrite").save(folder)``: a file for each partition, in order of the partitions."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _SheetWriter(self.options["path"], schema.names, overwrite)


class _SheetWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite, self.run = path, names, overwrite, uuid.uuid4().hex[:12]

    def _at(self) -> tuple[fs.FileSystem, str, str]:
        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return system, path, f"{path}/_temporary-{self.run}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, _, temporary = self._at()
        context = TaskContext.get()
        name = f"{context.partitionId()}-{context.taskAttemptId()}.xlsx"  # attempts do not share a file
        system.create_dir(temporary, recursive=True)
        with system.open_output_stream(f"{temporary}/{name}") as out:
            rows = write_rows(out, self.names, iterator)
        return _Written(context.partitionId(), name, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, path, temporary = self._at()
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(path)):
                if re.fullmatch(r"part-\d+-\w+\.xlsx|_SUCCESS", old.base_name):
                    system.delete_file(old.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        kept = [m for m in done if m.rows] or done[:1]  # of empty partitions one, for the heading
        for k, m in enumerate(kept):
            system.move(f"{temporary}/{m.name}", f"{path}/part-{k:05d}-{self.run}.xlsx")
        if done:
            system.delete_dir(temporary)
        system.open_output_stream(f"{path}/_SUCCESS").close()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _, temporary = self._at()
        if system.get_file_info(temporary).type != fs.FileType.NotFound:
            system.delete_dir(temporary)


def write_sheets(df: DataFrame, path: str, order: list[str], files: int | None = None) -> None:
    """``df`` as sheets in a folder, rows in ``order`` over all files; their number is Spark's choice unless given."""
    df.sparkSession.dataSource.register(SheetTarget)
    df.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order).write.format("xlsx").mode("overwrite").save(path)
