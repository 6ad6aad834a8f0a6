"""Excel workbooks as a Spark data source, and written by parallel tasks; neither needs a library for workbooks.

A workbook is a zip archive of XML.  Writing turns partitions into parts of a sheet's XML on the executors, each deflated on its own;
the driver only copies their bytes into the archive, a few megabytes at a time, and notes in the comment of the archive's entry
where ranges of rows begin.  Reading such a sheet, a task starts at its own range.  Of a sheet made elsewhere each task
streams the XML, passes over the rows before its range and stops after it; no process holds a sheet.

Texts may hold any character: those XML cannot carry are written as _xHHHH_, as spreadsheets do.
"""

from __future__ import annotations

import datetime
import itertools
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .places import place

# fixed values: name spaces of the format, its limit of rows, and the day from which dates are counted
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MOST_ROWS = 1_048_576
DAY_ZERO = datetime.datetime(1899, 12, 30)

#: Rows of a sheet that a task reads, rows by which types are told, bytes read at a time, how hard is deflated.
RANGE, SAMPLE, CHUNK, LEVEL = 50_000, 1000, 1 << 20, 3
#: What the comment of a sheet with noted ranges begins with; types of columns that are handed over as Arrow arrays.
NOTED = b"ranges "
ARROW = {T.StringType(): pa.string(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}
_CODED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_ODD = re.compile(r"[\x00-\x08\x0b-\x1f￾￿]")
# texts with none of these are written as they are
_LOOKED_AT = r"[&<>\x00-\x08\x0b-\x1f\x{FFFE}\x{FFFF}]|_x[0-9A-Fa-f]{4}_"


def _decoded(value: str) -> str:
    return _CODED.sub(lambda m: chr(int(m[1], 16)), value) if "_x" in value else value


def _encoded(value: str) -> str:
    marked = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", value)
    return escape(_ODD.sub(lambda m: f"_x{ord(m[0]):04X}_", marked))


def _column(reference: str) -> int:
    found = 0
    for c in reference:
        if not c.isalpha():
            break
        found = found * 26 + ord(c.upper()) - 64
    return found - 1


class Archive:
    """The parts of a workbook: its sheets by name, its shared texts, and a sheet's rows one after the other."""

    def __init__(self, path: str):
        files, at = place(path)
        self.file = files.open_input_file(at)
        self.zip = zipfile.ZipFile(self.file)
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        self.sheets = {s.get("name"): self._path(links[s.get(f"{LINK}id")]) for s in book.iter(f"{MAIN}sheet")}

    @staticmethod
    def _path(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def shared(self) -> list[str]:
        """Texts that cells name by number; workbooks made elsewhere keep theirs in one list."""
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        found = []
        with self.zip.open("xl/sharedStrings.xml") as held:
            for _, item in ElementTree.iterparse(held):
                if item.tag == f"{MAIN}si":
                    found.append(_decoded("".join(t.text or "" for t in item.iter(f"{MAIN}t"))))
                    item.clear()
        return found

    def extent(self, sheet: str) -> int | None:
        """The last row by the sheet's own statement, which stands before its rows."""
        with self.zip.open(self.sheets[sheet]) as held:
            for _, item in ElementTree.iterparse(held, events=("start",)):
                if item.tag == f"{MAIN}dimension":
                    last = re.search(r"(\d+)$", item.get("ref", ""))
                    return int(last[1]) if last else None
                if item.tag == f"{MAIN}sheetData":
                    return None
        return None

    def ranges(self, sheet: str) -> list[tuple[int, int, int, int]]:
        """First row, number of rows, place and bytes of each range that the writer noted; none of sheets made elsewhere."""
        noted = self.zip.getinfo(self.sheets[sheet]).comment
        return [tuple(map(int, r.split(b":"))) for r in noted.removeprefix(NOTED).split()] if noted.startswith(NOTED) else []

    def range(self, sheet: str, at: int, size: int) -> Iterator[bytes]:
        """The rows of a noted range as XML, some at a time."""
        info, held = self.zip.getinfo(self.sheets[sheet]), self.file
        held.seek(info.header_offset + 26)
        held.seek(info.header_offset + 30 + sum(struct.unpack("<HH", held.read(4))) + at)
        unpacked, rest, kept = zlib.decompressobj(-15), size, b""
        while rest or unpacked.unconsumed_tail:
            packed = unpacked.unconsumed_tail or held.read(min(rest, CHUNK))
            rest -= 0 if unpacked.unconsumed_tail else len(packed)
            kept += unpacked.decompress(packed, CHUNK)
            end = max(kept.rfind(b"</row>"), kept.rfind(b"<row/>")) + 6
            if end > 5:
                yield kept[:end]
                kept = kept[end:]

    def rows(self, sheet: str, first: int = 1, last: int | None = None) -> Iterator[tuple[int, list[Any]]]:
        """Number and values of the rows from first to last; missing cells are None, texts, numbers and truth values are themselves."""
        texts, number, root = None, 0, None
        with self.zip.open(self.sheets[sheet]) as held:
            for event, item in ElementTree.iterparse(held, events=("start", "end")):
                if event == "start":
                    root = item if item.tag == f"{MAIN}sheetData" else root
                    continue
                if item.tag != f"{MAIN}row":
                    continue
                number = int(item.get("r") or number + 1)
                if last is not None and number > last:
                    return
                if number >= first:
                    if texts is None and any(c.get("t") == "s" for c in item):
                        texts = self.shared()
                    values: list[Any] = []
                    for c in item.iter(f"{MAIN}c"):
                        at = _column(c.get("r")) if c.get("r") else len(values)
                        values += [None] * (at + 1 - len(values))
                        values[at] = _value(c, texts)
                    yield number, values
                root.clear()  # rows that were read are let go


def _value(cell: ElementTree.Element, texts: list[str] | None) -> Any:
    kind, held = cell.get("t", "n"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        return _decoded("".join(t.text or "" for t in cell.iter(f"{MAIN}t")))
    if held is None or held.text is None or kind == "e":
        return None
    if kind == "s":
        return texts[int(held.text)]
    if kind == "b":
        return held.text.strip() == "1"
    return _decoded(held.text) if kind == "str" else float(held.text)


def _as(value: Any, kind: T.DataType) -> Any:
    """A cell's value as a column's type; what cannot be one is null."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.StringType):
            return value if isinstance(value, str) else ("true" if value else "false") if isinstance(value, bool) else repr(int(value)) if value == int(value) else repr(value)
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else {"true": True, "false": False, "1": True, "0": False}.get(str(value).strip().lower()) if isinstance(value, str) else bool(value)
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            moment = datetime.datetime.fromisoformat(value) if isinstance(value, str) else DAY_ZERO + datetime.timedelta(days=value)
            return moment.date() if isinstance(kind, T.DateType) else moment
        number = float(value)
        return int(number) if isinstance(kind, T.IntegralType) and number == int(number) else None if isinstance(kind, T.IntegralType) else number
    except (ValueError, OverflowError):
        return None


class RowRange(InputPartition):
    """Rows first to last of a sheet; where its ranges are noted, in the one that starts with row `start` at a place of some bytes."""

    def __init__(self, sheet: str, first: int, last: int | None, start: int = 0, at: int = 0, size: int = 0):
        self.sheet, self.first, self.last, self.start, self.at, self.size = sheet, first, last, start, at, size


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheets: list[str], schema: T.StructType, rows: int):
        self.path, self.sheets, self.schema, self.size = path, sheets, schema, rows

    def partitions(self) -> list[RowRange]:
        archive = Archive(self.path)
        return [part for sheet in self.sheets for part in self._parts(archive, sheet)]

    def _parts(self, archive: Archive, sheet: str) -> list[RowRange]:
        last = archive.extent(sheet)
        if last is None:
            return [RowRange(sheet, 2, None)]
        noted = archive.ranges(sheet)
        if noted:
            return [RowRange(sheet, lo, min(lo + self.size, first + n) - 1, first, at, size) for first, n, at, size in noted for lo in range(first, first + n, self.size)]
        starts = list(range(2, max(last, 2) + 1, self.size))
        # the last range is open, should the sheet have more rows than it states
        return [RowRange(sheet, lo, None if lo == starts[-1] else lo + self.size - 1) for lo in starts]

    def read(self, partition: RowRange) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        archive = Archive(self.path)
        header = {str(name): k for k, name in enumerate(next(archive.rows(partition.sheet, 1, 1), (1, []))[1]) if name is not None}
        wanted = [(header.get(f.name), f.dataType) for f in self.schema.fields]
        if not partition.start:
            for _, values in archive.rows(partition.sheet, partition.first, partition.last):
                yield tuple(_as(values[k], kind) if k is not None and k < len(values) else None for k, kind in wanted)
            return
        number = partition.start
        whole = wanted and all(k is not None and kind in ARROW for k, kind in wanted)
        for held in archive.range(partition.sheet, partition.at, partition.size):
            made = _arrays(held, len(header), wanted) if whole else None
            if made is None:
                rows = ElementTree.fromstring(b'<s xmlns="%s">%s</s>' % (MAIN[1:-1].encode(), held))
                # the writer leaves no cell out, so a cell's place is its column's
                made = [[None if k is None else _as(_value(row[k], None), kind) for row in rows] for k, kind in wanted]
                n = len(rows)
            else:
                n = len(made[0])
            lo, hi = max(0, partition.first - number), max(0, min(n, partition.last + 1 - number))
            number += n
            if whole and lo < hi:
                yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c, ARROW[kind])).slice(lo, hi - lo) for c, (_, kind) in zip(made, wanted, strict=True)], self.schema.names)
            elif not whole:
                yield from zip(*[c[lo:hi] for c in made], strict=True) if made else ((),) * (hi - lo)
            if number > partition.last:
                return


def _arrays(rows: bytes, width: int, wanted: list[tuple[int, T.DataType]]) -> list[pa.Array] | None:
    """The wanted columns of rows as the writer makes them, of `width` cells each; None if a cell needs a look of its own."""
    each = pc.split_pattern(pa.array([rows.removesuffix(b"</row>").decode()], pa.large_string()), "</row>").flatten()
    # texts hold no <, so marks are marks
    cells = pc.split_pattern(pc.replace_substring(pc.replace_substring(each, "<row>", ""), "<c/>", "<c></c>"), "</c>")
    if pc.any(pc.not_equal(pc.list_value_length(cells), width + 1)).as_py():
        return None
    found = []
    for k, kind in wanted:
        cell = pc.list_element(cells, k)
        before, after = ('<c t="inlineStr"><is><t xml:space="preserve">', "</t></is>") if kind == T.StringType() else ('<c t="b"><v>', "</v>") if kind == T.BooleanType() else ("<c><v>", "</v>")
        none = pc.equal(cell, "<c>")
        if not pc.all(pc.or_(none, pc.and_(pc.starts_with(cell, before), pc.ends_with(cell, after)))).as_py():
            return None
        text = pc.binary_replace_slice(pc.binary_replace_slice(cell.cast(pa.large_binary()), 0, len(before), b""), -len(after), 1 << 30, b"").cast(pa.large_string())
        text = pc.if_else(none, pa.scalar(None, pa.large_string()), text)
        if pc.any(pc.match_substring_regex(text, "&|_x|\r")).as_py():
            return None
        if kind in (T.LongType(), T.IntegerType()):
            number = text.cast(pa.float64())
            if not pc.all(pc.and_(pc.equal(number, pc.floor(number)), pc.less(pc.abs(number), 2.0**31))).as_py():
                return None
            found.append(number.cast(ARROW[kind]))
        else:
            found.append(pc.equal(text, "1") if kind == T.BooleanType() else text.cast(ARROW[kind]))
    return [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in found]


class WorkbookSource(DataSource):
    """format("workbook"): options path, sheet (the first by default) or sheets (a JSON list of those one table goes on in, told by the first) and rows (of a task).

    The first row names the columns, which a schema picks by name.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _sheets(self) -> list[str]:
        sheets = list(Archive(self.options["path"]).sheets)
        wanted = json.loads(self.options["sheets"]) if "sheets" in self.options else [self.options["sheet"]] if "sheet" in self.options else sheets[:1] or [None]
        for name in wanted:
            if name not in sheets:
                raise ValueError(f"no sheet {name} among {sheets}")
        return wanted

    def schema(self) -> T.StructType:
        rows = [values for _, values in itertools.islice(Archive(self.options["path"]).rows(self._sheets()[0]), SAMPLE + 1)]
        fields = []
        for k, name in enumerate(rows[0] if rows else []):
            kinds = {type(values[k]) for values in rows[1:] if k < len(values) and values[k] is not None}
            if name is not None:
                fields.append(T.StructField(str(name), T.DoubleType() if kinds == {float} else T.BooleanType() if kinds == {bool} else T.StringType()))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(self.options["path"], self._sheets(), schema, int(self.options.get("rows", RANGE)))


def read_workbook(spark: SparkSession, path: str, sheet: str | list[str] | None = None, schema: T.StructType | str | None = None, rows: int = RANGE) -> DataFrame:
    """A sheet, or those that one table goes on in, as a table. Without a schema, columns of numbers are doubles and those of truth values booleans, by the first SAMPLE rows."""
    spark.dataSource.register(WorkbookSource)
    source = spark.read.format("workbook").option("path", path).option("rows", rows)
    if sheet is not None:
        source = source.option("sheet", sheet) if isinstance(sheet, str) else source.option("sheets", json.dumps(sheet))
    return (source.schema(schema) if schema is not None else source).load()


def sheet_names(path: str) -> list[str]:
    return list(Archive(path).sheets)


def _cell(value: Any) -> str:
    if value is None or value != value:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>" if abs(value) != float("inf") else f'<c t="inlineStr"><is><t>{value}</t></is></c>'
    return f'<c t="inlineStr"><is><t xml:space="preserve">{_encoded(value)}</t></is></c>'


def _cells(column: pa.Array) -> pa.Array:
    """`_cell` of each value, by columns where nothing needs a look of its own."""
    kind, wide = column.type, pa.large_string()
    if pa.types.is_boolean(kind):
        before, text, after = '<c t="b"><v>', pc.if_else(column, "1", "0").cast(wide), "</v></c>"
    elif pa.types.is_integer(kind):
        before, text, after = "<c><v>", column.cast(wide), "</v></c>"
    elif pa.types.is_string(kind) and not pc.any(pc.match_substring_regex(column, _LOOKED_AT)).as_py():
        before, text, after = '<c t="inlineStr"><is><t xml:space="preserve">', column.cast(wide), "</t></is></c>"
    else:
        return pa.array([_cell(v) for v in column.to_pylist()], wide)
    return pc.fill_null(pc.binary_join_element_wise(pa.scalar(before, wide), text, pa.scalar(after, wide), pa.scalar("", wide)), "<c/>")


def _xml(batch: pa.RecordBatch, columns: list[int]) -> bytes | pa.Buffer:
    """The rows of a batch."""
    if not columns or not batch.num_rows:
        return b"<row/>" * batch.num_rows
    wide = pa.large_string()
    rows = pc.binary_join_element_wise(pa.scalar("<row>", wide), *[_cells(batch.column(c)) for c in columns], pa.scalar("</row>", wide), pa.scalar("", wide))
    ends = np.frombuffer(rows.buffers()[1], np.int64)
    return rows.buffers()[2].slice(int(ends[rows.offset]), int(ends[rows.offset + len(rows)] - ends[rows.offset]))


class Part(NamedTuple):
    """A file of deflated rows that ends at a whole byte and needs nothing before it: rows, bytes, bytes before deflating, and their CRC."""

    file: str
    n: int
    packed: int
    size: int
    crc: int


def _parts(df: DataFrame, folder: str) -> list[Part]:
    """Writes each partition's rows as deflated XML beside the others; a part for each file, in the partitions' order."""
    simple = (T.StringType, T.BooleanType, T.NumericType)
    held = df.select(F.spark_partition_id().alias("__part"), *[F.col(f"`{f.name}`").cast("double" if isinstance(f.dataType, T.DecimalType) else f.dataType) if isinstance(f.dataType, simple) else F.col(f"`{f.name}`").cast("string") for f in df.schema.fields])

    most = min(RANGE, MOST_ROWS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = place(folder)
        name, part, k, n, packed, size, crc, out, deflate = "", None, 0, 0, 0, 0, 0, None, None

        def closed() -> pa.RecordBatch:
            last = deflate.flush(zlib.Z_FULL_FLUSH)
            out.write(last)
            out.close()
            made = {"part": part, "k": k, "file": name, "n": n, "packed": packed + len(last), "size": size, "crc": crc}
            return pa.RecordBatch.from_pylist([made], pa.schema([("part", pa.int32()), ("k", pa.int32()), ("file", pa.string()), *[(c, pa.int64()) for c in ("n", "packed", "size", "crc")]]))

        for whole in batches:
            lo = 0
            while lo < whole.num_rows:
                if out is None:
                    name, deflate = uuid.uuid4().hex, zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
                    part, n, packed, size, crc, out = whole.column(0)[0].as_py(), 0, 0, 0, 0, files.open_output_stream(f"{at}/{name}")
                batch = whole.slice(lo, most - n)
                made = _xml(batch, list(range(1, batch.num_columns)))
                crc, size = zlib.crc32(made, crc), size + len(made)
                packed += out.write(deflate.compress(made))
                n, lo = n + batch.num_rows, lo + batch.num_rows
                if n == most:
                    yield closed()
                    k, out = k + 1, None
        if out is not None:
            yield closed()

    rows = held.mapInArrow(run, "part int, k int, file string, n long, packed long, size long, crc long").collect()  # a row per task and RANGE rows
    return [Part(*r[2:]) for r in sorted(rows)]


def _joined_crc(first: int, second: int, size: int) -> int:
    """The CRC of two texts one after the other, from both of theirs and the second's bytes: the first's goes through as many zeros."""

    def times(matrix: list[int], vector: int) -> int:
        found = 0
        for column in matrix:
            if vector & 1:
                found ^= column
            vector >>= 1
        return found

    matrix = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
    bits = size * 8
    while bits:
        if bits & 1:
            first = times(matrix, first)
        matrix = [times(matrix, column) for column in matrix]
        bits >>= 1
    return first ^ second


def _add_sheet(book: zipfile.ZipFile, entry: str, head: bytes, parts: list[Part], tail: bytes, read: Callable[[str], Iterator[bytes]]) -> None:
    """An entry of deflated parts, whose bytes are copied as they are, with a head and a tail; ranges of about RANGE rows are noted."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    first = deflate.compress(head) + deflate.flush(zlib.Z_FULL_FLUSH)
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    last = deflate.compress(tail) + deflate.flush()
    info = zipfile.ZipInfo(entry)
    info.compress_type, info.CRC = zipfile.ZIP_DEFLATED, zlib.crc32(head)
    row, at, ranges = 2, len(first), []
    for part in parts:
        if ranges and ranges[-1][1] + part.n <= RANGE:
            ranges[-1][1] += part.n
            ranges[-1][3] += part.packed
        else:
            ranges.append([row, part.n, at, part.packed])
        row, at, info.CRC = row + part.n, at + part.packed, _joined_crc(info.CRC, part.crc, part.size)
    info.CRC = _joined_crc(info.CRC, zlib.crc32(tail), len(tail))
    info.compress_size, info.file_size = at + len(last), len(head) + sum(p.size for p in parts) + len(tail)
    noted = NOTED + " ".join(":".join(map(str, r)) for r in ranges).encode()
    info.comment = noted if len(noted) < 1 << 16 else b""
    # the archive's own writer would inflate and deflate everything on the driver
    info.header_offset = book.fp.tell()
    book.fp.write(info.FileHeader(zip64=True))
    book.fp.write(first)
    for part in parts:
        for chunk in read(part.file):
            book.fp.write(chunk)
    book.fp.write(last)
    book.start_dir = book.fp.tell()
    book.filelist.append(info)
    book.NameToInfo[entry] = info


def _sheets(name: str, parts: list[Part], split: bool) -> Iterator[tuple[str, list[Part]]]:
    """The sheet of a table, or with `split` as many as its rows need: further ones are named by their number."""
    if not split and sum(p.n for p in parts) + 1 > MOST_ROWS:
        raise ValueError(f"sheet {name} has more than {MOST_ROWS - 1} rows; write a table instead")
    k, own, rows = 1, [], 1
    for part in parts:
        if own and rows + part.n > MOST_ROWS:
            yield (name[:31] if k == 1 else numbered(name, k)), own
            k, own, rows = k + 1, [], 1
        own.append(part)
        rows += part.n
    yield (name[:31] if k == 1 else numbered(name, k)), own


def numbered(name: str, k: int) -> str:
    """The name of a table's sheet k."""
    return f"{name[: 31 - len(f' ({k})')]} ({k})"


def write_workbook(sheets: dict[str, DataFrame], path: str, split: bool = False) -> None:
    """One workbook with a sheet for each table, its columns' names in the first row; rows keep the order of their partitions.

    Dates, times and nested values are written as text. More rows than a sheet can have are an error, or with
    `split` go on in further sheets.
    """
    files, at = place(path)
    folder = f"{at}.parts-{uuid.uuid4().hex}"
    files.create_dir(folder, recursive=True)  # and with it the folder of the workbook

    def copied(name: str) -> Iterator[bytes]:
        with files.open_input_stream(f"{folder}/{name}") as held:
            while chunk := held.read(1 << 22):
                yield chunk

    try:
        written = {name: (df.columns, _parts(df, f"{path}.parts-{folder.rsplit('-', 1)[1]}")) for name, df in sheets.items()}
        listed = {sheet: (columns, own) for name, (columns, parts) in written.items() for sheet, own in _sheets(name, parts, split)}
        numbers = range(1, len(listed) + 1)
        spaces = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        package = "http://schemas.openxmlformats.org/package/2006"
        office = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        with files.open_output_stream(at) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as book:
            book.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{office}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{office}.worksheet+xml"/>' for k in numbers) + "</Types>")
            book.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            book.writestr("xl/workbook.xml", f"<workbook {spaces}><sheets>" + "".join(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="rId{k}"/>' for k, name in zip(numbers, listed, strict=True)) + "</sheets></workbook>")
            book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{relation}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers) + "</Relationships>")
            for k, (columns, parts) in zip(numbers, listed.values(), strict=True):
                head = f'<worksheet {spaces}><dimension ref="A1:A{1 + sum(p.n for p in parts)}"/><sheetData><row>{"".join(map(_cell, columns))}</row>'
                _add_sheet(book, f"xl/worksheets/sheet{k}.xml", head.encode(), parts, b"</sheetData></worksheet>", copied)
    finally:
        files.delete_dir(folder)
