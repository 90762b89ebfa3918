"""Workbooks: a round trip of a given table, and sheets as other programs write them."""

import io
import zipfile

from pyspark.sql import functions as F

from palimpsest.sources import workbook as W

SF = "/root/testdata/sf0.001"


def test_round_trip(spark, tmp_path):
    part = spark.read.parquet(f"{SF}/part.parquet").withColumn("p_name", F.when(F.col("p_partkey") % 9 == 0, None).otherwise(F.concat("p_name", F.lit(" <&> \"é水\" ")))).withColumn("file", F.concat(F.lit("f"), (F.col("p_partkey") % 3).cast("string")))
    columns = ["p_partkey", "p_name", "p_size", "p_retailprice"]
    for r in W.workbooks(part, "file", "p_brand", "p_partkey", columns).collect():
        (tmp_path / f"{r.file}.xlsx").write_bytes(bytes(r.content))
    rows = W.read_workbooks(spark, f"{tmp_path}/*.xlsx")
    got = {(r.path.rsplit("/", 1)[1][:-5], r.sheet.replace("_", "#"), r.row): (r.cells + [None] * 4)[:4] for r in rows.collect()}
    want = {}
    for r in sorted(part.collect(), key=lambda r: r.p_partkey):
        sheet = (r.file, r.p_brand)
        want.setdefault((*sheet, 1), columns)
        want[(*sheet, 1 + sum(k[:2] == sheet for k in want))] = [None if r[c] is None else str(r[c]) for c in columns]
    assert got == want
    names = W.sheet_names(spark, f"{tmp_path}/*.xlsx").collect()
    assert {(r.path.rsplit("/", 1)[1][:-5], r.sheet.replace("_", "#")) for r in names} == {k[:2] for k in want}
    table = W.with_header(rows, {"size": ["nowhere", "p_size"], "none": ["nowhere"]}, ["path", "sheet"]).collect()
    assert len(table) == part.count() and all(r.none is None and r.size.isdigit() for r in table)


def test_as_other_programs_write(spark, tmp_path):
    """Shared strings with runs and readings, booleans, gaps, cells and rows without references, targets from the root, a skipped sheet."""
    main, office, package = W.MAIN[1:-1], W.RELATION[1:-1], "http://schemas.openxmlformats.org/package/2006"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="小学科学方案" sheetId="1" r:id="a"/><sheet name="水" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="b" Target="/xl/worksheets/two.xml"/><Relationship Id="a" Target="worksheets/one.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>节</t></si><si><r><t>1 水的</t></r><r><t>变化</t></r><rPh sb="0" eb="1"><t>shui</t></rPh></si><si><t>年级</t></si></sst>')
        z.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        cells = '<row r="1"><c r="B1" t="s"><v>0</v></c><c r="D1" t="s"><v>2</v></c></row><row r="3"><c r="B3" t="s"><v>1</v></c><c r="C3" t="b"><v>1</v></c><c r="D3"><v>3</v></c><c r="AA3" t="str"><v>x</v></c></row><row><c/><c t="inlineStr"><is><t>2、光</t></is></c><c/><c><v>9</v></c></row><row r="9"><c r="D9"><v>4</v></c></row>'
        z.writestr("xl/worksheets/two.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    (tmp_path / "x.xlsx").write_bytes(out.getvalue())
    rows = W.read_workbooks(spark, str(tmp_path)).orderBy("row")
    assert [(r.sheet, r.place, r.row, r.cells) for r in rows.collect()] == [
        ("水", 1, 1, [None, "节", None, "年级"]), ("水", 1, 3, [None, "1 水的变化", "TRUE", "3", *[None] * 22, "x"]), ("水", 1, 4, [None, "2、光", None, "9"]), ("水", 1, 9, [None, None, None, "4"]),
    ]
    assert [r.sheet for r in W.sheet_names(spark, str(tmp_path)).collect()] == ["水"]
    lessons = W.lesson_rows(rows, ["sheet"]).orderBy("row").collect()
    assert [(r.row, r.grade, r.lesson_no, r.lesson_name, r.unit_title, r.import_batch) for r in lessons] == [(3, 3, "1", "水的变化", "", None), (4, 9, "2", "光", "", None)]
