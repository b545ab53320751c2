"""Workbooks written by hand: types, shared and inline strings, dates of both calendars, gaps, several files."""

import zipfile
from datetime import datetime

import pytest

from tamis import load_data
from tamis.sources.excel import read_excel, sheet_rows

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(path, sheets, shared=(), styles="", date1904=False):
    """sheets: name -> rows as XML."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {NS} {REL}><workbookPr date1904="{int(date1904)}"/><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Type="t" Target="{"/xl/" if i % 2 else ""}worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(f'<si>{s}</si>' for s in shared)}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")


STYLES = '<numFmts><numFmt numFmtId="165" formatCode="yyyy\\-mm"/><numFmt numFmtId="166" formatCode="0.0&quot;days&quot;[Red]"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="165"/><xf numFmtId="166"/></cellXfs>'
SHARED = ["<t>id</t>", "<r><t>na</t></r><r><t>me</t></r><rPh><t>no</t></rPh>", "<t>x &amp; y</t>"]
HEAD = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="C2" t="inlineStr"><is><t>day</t></is></c><c r="E2" t="str"><v>id</v></c></row>'
ROWS = (
    '<row r="3"><c r="A3"><v>1</v></c><c r="B3" t="s"><v>2</v></c><c r="C3" s="1"><v>45292</v></c><c r="D3" s="3"><v>1.5</v></c><c r="E3" t="b"><v>1</v></c></row><row r="4"/>'
    '<row r="6"><c r="A6"><v>-2</v></c><c r="B6" t="e"><v>#N/A</v></c><c r="C6" s="2"><v>45292.75</v></c><c r="E6" t="b"><v>0</v></c></row><row><c><v>3</v></c><c t="str"><v>7</v></c><c/><c><v>2</v></c></row>'
)


def test_types_and_gaps(spark, tmp_path):
    book(tmp_path / "a.xlsx", {"First": HEAD + ROWS, "Second": '<row><c><v>1</v></c></row><row><c><v>2.5</v></c></row>'}, SHARED, STYLES)
    df = load_data(spark, str(tmp_path / "a.xlsx"))
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("day", "timestamp"), ("column_4", "double"), ("id.1", "boolean")]
    rows = {r[0]: tuple(r)[1:] for r in df.collect()}
    assert rows == {1: ("x & y", datetime(2024, 1, 1), 1.5, True), -2: (None, datetime(2024, 1, 1, 18), None, False), 3: ("7", None, 2.0, None)}
    second = load_data(spark, str(tmp_path / "a.xlsx"), sheet="Second")
    assert second.dtypes == [("1", "double")] and second.collect()[0][0] == 2.5
    with pytest.raises(Exception, match="no sheet"):
        read_excel(spark, str(tmp_path / "a.xlsx"), 7).collect()


def test_calendar_of_1904_and_mixed_columns(tmp_path):
    book(tmp_path / "b.xlsx", {"S": '<row r="1"><c r="AA1" s="1"><v>0.5</v></c></row><row r="2"><c r="A2"><v>1e300</v></c><c r="B2" t="d"><v>2024-02-03T04:05:06</v></c></row>'}, styles=STYLES, date1904=True)
    first, second = sheet_rows((tmp_path / "b.xlsx").read_bytes())
    assert first == (1, [None] * 26 + [("date", "1904-01-01 12:00:00")]) and second == (2, [("number", "1e+300"), ("date", "2024-02-03 04:05:06")])


def test_several_workbooks(spark, tmp_path):
    for i in range(3):
        book(tmp_path / f"c{i}.xlsx", {"S": f'<row><c t="str"><v>n</v></c></row><row><c><v>{i}</v></c></row>' + "<row/>" * i})
    assert sorted(r["n"] for r in read_excel(spark, str(tmp_path / "c*.xlsx")).collect()) == [0, 1, 2]
    book(tmp_path / "c9.xlsx", {"S": '<row><c t="str"><v>m</v></c></row>'})
    with pytest.raises(ValueError, match="different first rows"):
        read_excel(spark, str(tmp_path / "c*.xlsx"))
    assert read_excel(spark, str(tmp_path / "c9.xlsx")).columns == ["m"]
    book(tmp_path / "e.xlsx", {"S": ""})
    assert read_excel(spark, str(tmp_path / "e.xlsx")).columns == []
    with pytest.raises(ValueError, match="unsupported"):
        load_data(spark, str(tmp_path / "old.xls"))
