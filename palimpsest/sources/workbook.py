"""Workbooks (xlsx) as tables and tables as workbooks, on zip and XML of the standard library.

Files are read through Spark's own binary source, so any file system will do; a file is the unit of work, its sheets are
parsed as streams, row by row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Names of the format, sheets that hold no lessons, columns of a lesson sheet.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
HEADERS = {"version_label": ["版本"], "grade": ["年级"], "semester": ["学期"], "unit_title": ["单元"], "lesson_raw": ["节"], "old_course_id": ["课件id", "课件ID", "课件唯一ID"], "page_count": ["页数"], "import_batch": ["完成时间"]}
NO_LESSONS = ["小学科学方案", "初中科学内容生产"]
#: Rows that are sent on at once.
SENT = 2000


def _column(reference: str) -> int:
    """The place (from 0) of a cell by its reference, A1."""
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    """The text of a string, its runs put together, readings of characters left out."""
    return "".join(t.text or "" for x in node if x.tag != MAIN + "rPh" for t in ([x] if x.tag == MAIN + "t" else x.iter(MAIN + "t")))


def parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of the sheets in their order, and where each is in the archive."""
    where = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(MAIN + "sheet")
    return [(s.get("name"), t.lstrip("/") if (t := where[s.get(RELATION + "id")]).startswith("/") else "xl/" + t) for s in sheets]


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag == MAIN + "si":
                out.append(_text(node))
                node.clear()
    return out


def rows_of(book: zipfile.ZipFile, part: str, strings: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    """Row number and cells of a sheet; an empty cell is None, a boolean TRUE or FALSE, a number as it is written."""
    with book.open(part) as f:
        at = 0
        for _, node in ElementTree.iterparse(f):
            if node.tag != MAIN + "row":
                continue
            at = int(node.get("r") or at + 1)
            cells: list[str | None] = []
            for c in node.iter(MAIN + "c"):
                place = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (place + 1 - len(cells))
                kind, value, inline = c.get("t"), c.find(MAIN + "v"), c.find(MAIN + "is")
                if kind == "inlineStr":
                    cells[place] = _text(inline) if inline is not None else None
                elif value is not None:
                    cells[place] = strings[int(value.text)] if kind == "s" else ("TRUE" if value.text == "1" else "FALSE") if kind == "b" else value.text
            yield at, cells
            node.clear()


def _parsed(batches: Iterator[pa.RecordBatch], names_only: bool) -> Iterator[pa.RecordBatch]:
    names = ["path", "sheet", "place", "row", "cells"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string())]
    made = lambda held: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names=names)
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                strings = [] if names_only else shared_strings(book)
                held: list[tuple] = []
                for place, (sheet, part) in enumerate(parts(book)):
                    if names_only:
                        held.append((path, sheet, place, None, None))
                        continue
                    for at, cells in rows_of(book, part, strings):
                        held.append((path, sheet, place, at, cells))
                        if len(held) >= SENT:
                            yield made(held)
                            held = []
                if held:
                    yield made(held)


def _read(spark: SparkSession, path: str, names_only: bool) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda batches: _parsed(batches, names_only), "path string, sheet string, place int, row long, cells array<string>")


def sheet_names(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, place (from 0): the sheets of the workbooks under a path, without those that hold no lessons."""
    return _read(spark, path, True).filter(~F.col("sheet").isin(NO_LESSONS)).select("path", "sheet", "place")


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, place, row (from 1), cells: every row of every sheet of the workbooks under a path, cells as text, missing ones null."""
    return _read(spark, path, False)


def with_header(rows: DataFrame, columns: dict[str, list[str]], sheet: list[str]) -> DataFrame:
    """sheet columns, row and the columns, each by the first of its names that the sheet has: the first row of a sheet names its cells, of a name's repeats the last counts. A column that a sheet lacks is null."""
    first = rows.groupBy(*sheet).agg(F.min_by("cells", "row").alias("names"), F.min("row").alias("head"))
    both = rows.join(first, sheet).filter("row > head").withColumn("named", F.reverse(F.transform("names", T.cell_str)))
    place = lambda n: F.size("named") - F.nullif(F.array_position("named", n), F.lit(0)).cast("int")
    return both.select(*sheet, "row", *[F.get("cells", F.coalesce(*[place(n) for n in names])).alias(k) for k, names in columns.items()])


def lesson_rows(rows: DataFrame, sheet: list[str]) -> DataFrame:
    """sheet columns, row, version_label, grade, semester, unit_title, lesson_raw, lesson_no, lesson_name, old_course_id, page_count, import_batch: the lessons of sheets with a header (rows: sheet columns, row, cells).

    Rows without a lesson or without a grade that can be read are left out; empty texts of a batch are null.
    """
    r = with_header(rows, HEADERS, sheet)
    r = r.filter(F.col("lesson_raw") != "").withColumn("said", T.parse_grade(F.col("grade"))).filter("said IS NOT NULL")
    text = lambda c: T.cell_str(F.col(c))
    return r.select(
        *sheet, "row", text("version_label").alias("version_label"), F.col("said").alias("grade"), T.parse_semester(F.col("semester")).alias("semester"), text("unit_title").alias("unit_title"), text("lesson_raw").alias("lesson_raw"),
        T.parse_lesson_no(F.col("lesson_raw")).alias("lesson_no"), T.parse_lesson_name(F.col("lesson_raw")).alias("lesson_name"), text("old_course_id").alias("old_course_id"), T.parse_page_count(F.col("page_count")).alias("page_count"), F.nullif(text("import_batch"), F.lit("")).alias("import_batch"),
    )


# Writing ----------------------------------------------------------------------------------------------


def _letters(place: int) -> str:
    out = ""
    place += 1
    while place:
        place, rest = divmod(place - 1, 26)
        out = chr(65 + rest) + out
    return out


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of the given rows; None leaves a cell out, numbers are numbers, everything else is text."""

    def cell(at: str, v) -> str:
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))}</t></is></c>'

    main, office, package = MAIN[1:-1], RELATION[1:-1], "http://schemas.openxmlformats.org/package/2006"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    names = list(sheets)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{kinds}worksheet+xml"/>' for i in range(len(names))) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i + 1}" r:id="s{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="s{i + 1}" Type="{office}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, n in enumerate(names):
            rows = "".join(f'<row r="{r + 1}">' + "".join(cell(f"{_letters(c)}{r + 1}", v) for c, v in enumerate(values)) + "</row>" for r, values in enumerate(sheets[n]))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def workbooks(df: DataFrame, file: str, sheet: str, order: str, columns: list[str]) -> DataFrame:
    """file, content: one workbook per file with a sheet per value of `sheet` (31 characters at most), a header and the columns' rows by `order`.

    A workbook is written by one task and held there, as its format wants; files are spread over tasks.
    """
    row = F.struct(F.col(sheet).cast("string").alias("sheet"), F.col(order).alias("order"), F.array(*[F.col(c).cast("string") for c in columns]).alias("cells"))
    books = df.groupBy(file).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    kind = dict(df.dtypes)[file]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = []
            for rows in b.column(1).to_pylist():
                sheets: dict[str, list[list]] = {}
                for r in rows:
                    sheets.setdefault(re.sub(r"[\[\]:*?/\\]", "_", (r["sheet"] or "")[:31]) or "_", [list(columns)]).append(r["cells"])
                content.append(workbook_bytes(sheets))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.binary())], names=[file, "content"])

    return books.mapInArrow(write, f"`{file}` {kind}, content binary")
