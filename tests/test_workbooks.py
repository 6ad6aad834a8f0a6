"""Workbooks: round trips through the writer and the data source, ranges of rows, workbooks made elsewhere."""

import datetime
import os
import zipfile

import pytest

from aisleforge.sources import files
from aisleforge.sources import workbooks as W

TEXTS = ["plain", "", " two  spaces ", "a<b>&\"c'", "line\nbreak\r\nand tab\t", "\x00\x07\x1f bell", "_x0041_ not coded", "ไทย \U0001f600", "0012", "x" * 5000]


def test_round_trip_of_several_sheets(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    rows = [(k, TEXTS[k % len(TEXTS)] if k % 7 else None, k / 8 if k % 5 else None, k % 2 == 0, datetime.date(2024, 1, 1 + k % 28)) for k in range(500)]
    first = spark.createDataFrame(rows, "n long, text string, x double, flag boolean, day date").repartition(6, "n").sortWithinPartitions("n")
    empty = spark.createDataFrame([], "a string, `b c` double")
    W.write_workbook({"All Findings": first, "KPIs & <more>": spark.createDataFrame([(3, 0.5)], "images int, share double"), "Issues": empty}, path)
    assert W.sheet_names(path) == ["All Findings", "KPIs & <more>", "Issues"] and os.listdir(tmp_path) == ["book.xlsx"]
    for size in (37, 10_000):
        found = W.read_workbook(spark, path, "All Findings", first.schema, rows=size)
        assert sorted(tuple(r) for r in found.collect()) == sorted(rows, key=lambda r: r[0])
    told = W.read_workbook(spark, path)
    assert dict(told.dtypes) == {"n": "double", "text": "string", "x": "double", "flag": "boolean", "day": "string"} and told.count() == 500
    assert [tuple(r) for r in W.read_workbook(spark, path, "KPIs & <more>").collect()] == [(3.0, 0.5)]
    none = W.read_workbook(spark, path, "Issues")
    assert none.count() == 0 and none.columns == ["a", "b c"]
    with pytest.raises(Exception, match="no sheet"):
        W.read_workbook(spark, path, "Absent").count()


def test_a_workbook_made_elsewhere(spark, tmp_path):
    """Shared texts, gaps between cells and rows, errors, dates as numbers, formulas."""
    path, main = str(tmp_path / "other.xlsx"), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId9"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId9" Target="/xl/worksheets/one.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>brand</t></si><si><r><t>Oa</t></r><r><t>k</t></r></si><si><t>day</t></si><si><t>n</t></si></sst>")
        cells = ['<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>2</v></c><c r="AA1" t="s"><v>3</v></c></row>', '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>45292.5</v></c><c r="AA3"><v>7</v></c></row>', '<row r="9"><c r="A9" t="str"><f>x</f><v>Elm</v></c><c r="C9" t="e"><v>#N/A</v></c><c r="AA9"><v>2.5</v></c></row>']
        book.writestr("xl/worksheets/one.xml", f"<worksheet {main}><sheetData>{''.join(cells)}</sheetData></worksheet>")
    found = W.read_workbook(spark, path, schema="n long, brand string, day timestamp_ntz, missing string").collect()
    assert [tuple(r) for r in found] == [(7, "Oak", datetime.datetime(2024, 1, 1, 12), None), (None, "Elm", None, None)]


def test_more_rows_than_a_sheet_has_are_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "MOST_ROWS", 10)
    with pytest.raises(ValueError, match="more than 9 rows"):
        W.write_workbook({"s": spark.range(10)}, str(tmp_path / "long.xlsx"))
    W.write_workbook({"s": spark.range(9)}, str(tmp_path / "fits.xlsx"))
    assert W.read_workbook(spark, str(tmp_path / "fits.xlsx")).count() == 9


def test_a_long_table_goes_on_in_further_sheets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "MOST_ROWS", 10)
    path = str(tmp_path / "long.xlsx")
    W.write_workbook({"s": spark.range(100).repartition(3), "t": spark.range(3)}, path, split=True)
    assert len(W.sheet_names(path)) >= 13 and W.sheet_names(path)[:2] == ["s", "s (2)"]
    found = files.workbook(spark, path, joined=True)
    assert list(found) == ["s", "t"] and sorted(r.id for r in found["s"].collect()) == list(range(100)) and found["t"].count() == 3


def test_a_task_starts_at_its_own_range(spark, tmp_path, monkeypatch):
    """Every range of rows was reached by reading all rows before it, and the driver deflated all sheets alone."""
    monkeypatch.setattr(W, "RANGE", 40)
    path = str(tmp_path / "book.xlsx")
    rows = [(k, TEXTS[k % len(TEXTS)] if k % 7 else None, k / 8 if k % 5 else float("inf"), k % 2 == 0) for k in range(1000)]
    W.write_workbook({"s": spark.createDataFrame(rows, "n long, text string, x double, flag boolean").repartition(6, "n").sortWithinPartitions("n")}, path)
    with zipfile.ZipFile(path) as book:
        assert book.testzip() is None  # lengths and checksums of the joined parts
        assert book.getinfo("xl/worksheets/sheet1.xml").compress_type == zipfile.ZIP_DEFLATED
    archive = W.Archive(path)
    ranges = archive.ranges("s")
    assert sum(n for _, n, _, _ in ranges) == 1000 and max(n for _, n, _, _ in ranges) <= 40
    whole = [values for _, values in archive.rows("s", 2)]

    def passed_over(self, sheet, first=1, last=None, read=W.Archive.rows):
        assert last == 1, "rows before a range are read again"
        return read(self, sheet, first, last)

    schema = W.T._parse_datatype_string("n long, text string, x string, flag boolean")
    monkeypatch.setattr(W.Archive, "rows", passed_over)
    for size in (7, 40, 5000):
        reader = W.WorkbookReader(path, ["s"], schema, size)
        found = [[[*r.values()] for batch in reader.read(part) for r in batch.to_pylist()] for part in reader.partitions()]
        assert [r for part in found for r in part] == [[int(n), text, W._as(x, schema["x"].dataType), flag] for n, text, x, flag in whole] and max(map(len, found)) <= size
