"""Workbooks and schedule exports, read in parts."""

import zipfile

from keelson.schemas import RFI_FIELDS
from keelson.sources import workbook, xer

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def make_workbook(path, sheets, texts, active=0, packing=zipfile.ZIP_DEFLATED):
    """An .xlsx of sheets as XML rows."""
    rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml" Type="x"/>' for i in range(len(sheets)))
    names = "".join(f'<sheet name="{name}" sheetId="{i + 1}" r:id="rId{i}"/>' for i, name in enumerate(sheets))
    with zipfile.ZipFile(path, "w", packing) as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(f'<si>{t}</si>' for t in texts)}</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><dimension ref='A1'/><sheetData>{rows}</sheetData></worksheet>")


TEXTS = ["<t>RFI No.</t>", "<t>Subject</t>", "<t>Date Raised</t>", "<r><t>two </t></r><r><t>runs</t></r><rPh><t>hint</t></rPh>", "<t>RFI-0001</t>", "<t> </t>", "<t>Status</t>"]
DATA = (
    '<row r="1"><c r="B1" t="inlineStr"><is><t>Project register</t></is></c></row>'
    '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="C3" t="s"><v>2</v></c><c r="AA3" t="s"><v>6</v></c></row>'
    '<row r="4"><c r="A4" t="s"><v>4</v></c><c r="B4" t="s"><v>3</v></c><c r="C4" s="1"><v>46223</v></c><c r="AA4" t="str"><f>A1</f><v>Open</v></c></row>'
    '<row r="5"><c r="A5" t="s"><v>5</v></c><c r="B5"><v>1</v></c></row>'
    '<row r="6"><c r="A6" t="inlineStr"><is><t>RFI-0002</t></is></c><c r="B6"><f>SUM(B4)</f></c><c r="C6" s="2"><v>46223.75</v></c><c r="AA6" t="inlineStr"><is><t>=A1</t></is></c></row>'
)


def test_cells_of_a_workbook(spark, tmp_path):
    odd = '<row><c><v>5</v></c><c t="b"><v>1</v></c><c s="3"><v>2.5</v></c><c t="e"><v>#N/A</v></c><c/></row><row/>'
    for name, packing in (("a.xlsx", zipfile.ZIP_DEFLATED), ("b.xlsx", zipfile.ZIP_STORED)):
        make_workbook(tmp_path / name, {"notes": odd, "data": DATA, "empty": ""}, TEXTS, active=1, packing=packing)
    (tmp_path / "c.txt").write_text("no workbook")
    got = workbook.read_workbooks(spark, str(tmp_path), tasks=3)
    for name in ("a.xlsx", "b.xlsx"):
        rows = {(r.sheet, r.row): list(r.cells) for r in got.collect() if r.file.endswith(name)}
        assert rows["notes", 1] == ["5", "True", "2.5", "#N/A", None] and rows["notes", 2] == []
        assert rows["data", 4][:3] == ["RFI-0001", "two runs", "2026-07-20"] and len(rows["data", 4]) == 27
        assert rows["data", 6][1:3] == [None, "2026-07-20"] and rows["data", 1] == [None, "Project register"]
    pruned = workbook.read_workbooks(spark, str(tmp_path / "a.xlsx"), columns=["A", "AA"]).where("sheet = 'data' and row = 4").first().cells
    assert pruned == ["RFI-0001", *[None] * 25, "Open"]


def test_register_of_a_workbook(spark, tmp_path):
    make_workbook(tmp_path / "r.xlsx", {"notes": "<row r='1'><c r='A1'><v>1</v></c></row>", "data": DATA}, TEXTS, active=1)
    got = {r.rfi_id: r for r in workbook.read_register(spark, str(tmp_path / "r.xlsx")).collect()}
    assert set(got) == {"RFI-0001", "RFI-0002"} and set(RFI_FIELDS) <= set(got["RFI-0001"].asDict())
    assert (got["RFI-0001"].subject, got["RFI-0001"].date_raised, got["RFI-0001"].status) == ("two runs", "2026-07-20", "Open")
    assert (got["RFI-0002"].subject, got["RFI-0002"].date_raised, got["RFI-0002"].status) == (None, "2026-07-20", None)


def test_a_sheet_of_many_rows(spark, tmp_path):
    rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' for i in range(1, 30_001))
    make_workbook(tmp_path / "m.xlsx", {"data": rows}, [])
    got = workbook.read_workbooks(spark, str(tmp_path / "m.xlsx"))
    assert got.selectExpr("count(*)", "sum(row)", "sum(cast(cells[0] as long))").first() == (30_000, 450_015_000, 450_015_000)


def test_an_export_in_splits(spark, tmp_path):
    lines = ["ERMHDR\t1", "%T\tPROJECT", "%F\tproj_id\tproj_short_name\tlast_recalc_date", "%R\t7\tP\t2026-07-20 00:00", "%T\tOTHER", "%F\ta", "%R\tx", "%T\tTASK", "%F\ttask_id\tproj_id\ttask_code\ttask_name"]
    lines += [f"%R\t{i}\t7\tA{i}\tname {i}" for i in range(5000)]
    lines += ["%T\tTASKPRED", "%F\ttask_pred_id\ttask_id\tpred_task_id\tpred_type\tlag_hr_cnt"]
    lines += [f"%R\t{i}\t{i + 1}\t{i}\tPR_FS\t{8 * (i % 3)}" for i in range(4999)] + ["%E"]
    for name in ("one.xer", "two.xer"):
        (tmp_path / name).write_text("\r\n".join(lines) + "\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = xer.read_rows(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 10
        got = rows.where("file like '%one.xer'").orderBy("seq").collect()
        projects, activities, links = xer.read_schedule(spark, str(tmp_path))
        assert (projects.count(), activities.count(), links.count()) == (2, 10_000, 9998)
        assert links.where("file like '%two.xer'").orderBy("seq").select("predecessor", "lag_days").take(4)[3] == ("A3", 0.0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 1 + 5000 + 4999 and len({r.seq for r in got}) == len(got)
    assert [r.fields["task_code"] for r in got if r.table_name == "TASK"] == [f"A{i}" for i in range(5000)]
    assert [r.fields["task_pred_id"] for r in got if r.table_name == "TASKPRED"] == [str(i) for i in range(4999)]
    assert got[0].fields == {"proj_id": "7", "proj_short_name": "P", "last_recalc_date": "2026-07-20 00:00"}
