"""Catalogues, contents entries and page ranges of volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lesson_lines as L
from ..functions import text as T

# Columns that recur in every unit, methods that mean no match, the place of units without a number.
RECURRING = ["语文园地", "口语交际", "习作", "快乐读书吧"]
NO_MATCH = ["none", "unmatched", "no_match"]
UNNUMBERED = 9000


def unit_place(unit: Column, pos: Column) -> Column:
    """Where a row's unit belongs: its number, or after all numbered ones in the order of the rows."""
    return F.coalesce(T.unit_no_from_title(unit), UNNUMBERED + pos)


def by_unit(catalog: DataFrame, volume: str, lessons_too: bool = False) -> DataFrame:
    """catalog (volume, pos, unit, lesson) with `place` from 1: units in their order and, within them, lessons by number or as they stand."""
    key = [T.lesson_no_sort_key(F.col("lesson"))] if lessons_too else []
    return catalog.withColumn("place", F.row_number().over(Window.partitionBy(volume).orderBy(unit_place(F.col("unit"), F.col("pos")), *key, "pos")))


def without_stray_intro(catalog: DataFrame, volume: str) -> DataFrame:
    """Rows of catalog (volume, pos, unit, lesson) without lessons that stand in the introduction and in a unit: those of unit 1 go if it has others, else the introduction's."""
    key = T.norm_text(T.strip_lesson_seq(F.col("lesson")))
    c = catalog.withColumns({"u": T.unit_no_from_title(F.col("unit")), "key": key})
    w = Window.partitionBy(volume)
    intro = F.collect_set(F.when((F.col("u") == 0) & (F.col("key") != ""), F.col("key"))).over(w)  # an introduction's lessons: a handful
    c = c.withColumn("intro", intro).withColumn("shared", (F.col("u") == 1) & F.array_contains("intro", F.col("key")))
    others = F.coalesce(F.max((F.col("u") == 1) & ~F.array_contains("intro", F.col("key"))).over(w), F.lit(False))
    numbered = F.coalesce(F.max(F.col("u") > 0).over(w), F.lit(False))
    c = c.withColumns({"others": others, "numbered": numbered})
    c = c.filter(~(F.coalesce("shared", F.lit(False)) & F.col("others")))
    left = F.max((F.col("u") > 0) & (F.col("key") != "")).over(Window.partitionBy(volume, "key"))
    drop = (F.col("u") == 0) & F.col("numbered") & ((F.col("key") == "") | F.coalesce(left, F.lit(False)))
    return c.withColumn("drop", F.coalesce(drop, F.lit(False))).filter("NOT drop").select(*catalog.columns)


def physical_pages(entries: DataFrame, offsets: DataFrame, volume: str, page: str) -> DataFrame:
    """entries with their printed page moved by the volume's offset (none: unmoved)."""
    o = offsets.select(volume, F.col("offset").alias("by"))
    return entries.join(o, volume, "left").withColumn(page, F.col(page) + F.coalesce("by", F.lit(0))).drop("by")


def unit_first_pages(entries: DataFrame, units: DataFrame, volume: str) -> DataFrame:
    """units (volume, unit) with the least page of a unit heading in entries (volume, title, page) that has its number."""
    head = F.col("title").rlike(r"^\s*第[一二三四五六七八九十百零\d]+(单元|章)") | F.trim("title").startswith("绪论")
    e = entries.filter(head).select(volume, T.unit_no_from_title(F.col("title")).alias("no"), "page").groupBy(volume, "no").agg(F.min("page").alias("first_page"))
    return units.withColumn("no", T.unit_no_from_title(F.col("unit"))).join(e, [volume, "no"], "left").drop("no")


def lesson_hits(pages: DataFrame, targets: DataFrame, volume: str) -> DataFrame:
    """pages (volume, page, text) with the number of lessons (volume, lesson, keys) of which a key of 3 characters or more stands on the page."""
    p = pages.select(volume, "page", T.norm_text(F.col("text"), normal=False).alias("t"))
    k = targets.select(volume, "lesson", F.explode("keys").alias("key")).filter(F.length("key") >= 3)
    hit = p.join(k, volume).filter(F.contains("t", "key")).groupBy(volume, "page").agg(F.count_distinct("lesson").alias("hits"))
    return pages.join(hit, [volume, "page"], "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))


def shifted_ranges(lessons: DataFrame, volume: str, delta: int) -> DataFrame:
    """lessons (volume, start, end) with their page ranges moved; a volume in which a range would begin before page 1 stays as it is (moved: false)."""
    ok = F.coalesce(F.min("start").over(Window.partitionBy(volume)) + delta >= 1, F.lit(False))
    moved = F.col("ok") & F.col("start").isNotNull() & F.lit(delta != 0)
    out = lessons.withColumn("ok", ok).withColumn("moved", moved)
    end = F.coalesce("end", "start")
    return out.withColumns({"end": F.when(F.col("moved"), end + delta).otherwise(F.col("end")), "start": F.when(F.col("moved"), F.col("start") + delta).otherwise(F.col("start"))}).drop("ok")


def is_matched(method: Column, old: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(method, F.lit("")))).isin(NO_MATCH) & old.isNotNull()


def chosen_items(items: DataFrame, method: str, old: str, matched: bool, unmatched: bool) -> DataFrame:
    """The matched items, the unmatched ones, both or none."""
    m = is_matched(F.col(method), F.col(old))
    return items.filter((m & F.lit(matched)) | (~m & F.lit(unmatched)))


def shelf_status(has_file: Column, lessons: Column, atoms: Column) -> Column:
    return F.when(~F.coalesce(has_file, F.lit(False)), "待入库").when((lessons > 0) & (atoms > 0), "已上架").otherwise("建设中")


def volume_code(code: Column) -> Column:
    """prefix, grade, term, book and version of a volume's code; null if it is none."""
    pattern = r"^(?i)([A-Z0-9]+)-(\d+)([SX])-(OLD|NEW)(?:-v(\d+))?$"
    c = F.trim(F.coalesce(code, F.lit("")))
    part = lambda i: F.regexp_extract(c, pattern, i)
    version = F.coalesce(part(5).try_cast("int"), F.lit(1))
    fields = F.struct(F.upper(part(1)).alias("prefix"), part(2).try_cast("int").alias("grade"), F.when(F.upper(part(3)) == "S", "上").otherwise("下").alias("term"), F.lower(part(4)).alias("book"), version.alias("version"))
    return F.when(c.rlike(pattern) & (version >= 1), fields)


def is_recurring(no: Column, name: Column) -> Column:
    return T.has_any(F.concat(F.coalesce(no, F.lit("")), F.coalesce(name, F.lit(""))), RECURRING)


def title_tokens(no: Column, name: Column) -> Column:
    """The main title and the parts in brackets, normalised, of two characters or more; for recurring columns their number too. Sorted."""
    n = F.coalesce(name, F.lit(""))
    inner = F.split(F.regexp_extract(n, "（([^）]+)）", 1), "[；;、,/]")
    parts = F.concat(inner, F.array(T.stripped(F.regexp_replace(n, "（[^）]*）", ""))), F.when(T.has_any(F.coalesce(no, F.lit("")), RECURRING), F.array(no)).otherwise(F.array().cast("array<string>")))
    keys = F.transform(parts, lambda x: T.norm_text(x, normal=False))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda x: F.length(x) >= 2)))


# Lines ----------------------------------------------------------------------------------------------

# Headings of contents pages as they are read, words of lines that are none of a catalogue, bounds of page numbers.
HEADINGS = ["目录", "誉目", "眷目", "脊目", "着目", "目次", "日录"]
NOT_LISTED = [
    "前言", "编者的话", "版权", "图书在版编目", "定价", "出版社", "附录", "后记", "索引", "词汇表", "义务教育", "教科书", "ISBN", "CIP", "科学探究", "问题情境", "拓展延伸", "拓展迁移", "拓展活动", "课堂练习", "课后练习", "活动手册",
    "指南车信箱", "安全警示", "思想与方法", "工程实践", "责任编辑",
]
LAST_PAGE, TITLE_CHARS, SCANNED, FEW_LESSONS, FEW_UNITS = 400, 48, 22, 12, 3
NUMERALS = "一二三四五六七八九十百千"
LEADER = r"\.{2,}|…{2,}|·{3,}"


def close_up(text: Column) -> Column:
    """Han characters set apart by blanks together; other blanks single."""
    t = F.coalesce(text, F.lit(""))
    spaced = t.rlike(rf"[{T.HAN}][{T.BLANK}]+[{T.HAN}]")
    return F.when(spaced, F.trim(F.regexp_replace(F.regexp_replace(t, rf"(?<=[{T.HAN}])[{T.BLANK}]+(?=[{T.HAN}])", ""), r"\s+", " "))).otherwise(t)


def clean_line(line: Column) -> Column:
    """A catalogue line without leaders and page number, its lesson number set apart."""
    t = F.regexp_replace(close_up(F.trim(F.coalesce(line, F.lit("")))), rf"^(\d{{1,2}})([{T.HAN}])", "$1 $2")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[·●…．._—\-]+", " "), r"\s+", " "), r"\s+\d{1,3}\s*$", ""))


def unit_title(line: Column) -> Column:
    """绪论, 第N单元 with its name, or N单元 with its name; null for other lines."""
    s = F.trim(F.regexp_replace(F.regexp_replace(close_up(F.trim(F.coalesce(line, F.lit("")))), r"[·●…．._—\-]+", " "), r"\s+\d{1,3}\s*$", ""))
    named = clean_line(F.regexp_extract(s, rf"(第[{NUMERALS}\d]+单元[^0-9]{{0,{TITLE_CHARS}}})", 1))
    arabic = F.trim(F.regexp_replace(clean_line(F.regexp_extract(s, rf"^(\d{{1,2}}\s*单元\s*[^\d]{{0,{TITLE_CHARS}}})", 1)), r"^(\d{1,2})\s*单元\s*", "$1单元 "))
    return F.when(s == "绪论", s).otherwise(F.coalesce(F.nullif(named, F.lit("")), F.nullif(arabic, F.lit(""))))


def is_unlisted(line: Column) -> Column:
    t = F.trim(F.coalesce(line, F.lit("")))
    return (t == "") | t.isin("目录", "单元小结", "誉目", "眷目", "目次") | T.has_any(t, NOT_LISTED) | t.rlike(r"^\d+$")


def title_and_page(line: Column) -> Column:
    """title (normalised) and page of a contents line with leaders, a lesson number, a gap or a unit's summary; null for other lines."""
    s = F.trim(F.coalesce(line, F.lit("")))

    def form(pattern: str, least_page: int = 1) -> Column:
        title, page = T.norm_text(F.regexp_extract(s, pattern, 1), normal=False), F.regexp_extract(s, pattern, 2).try_cast("int")
        return F.when((F.length(title) >= 3) & page.between(least_page, LAST_PAGE), F.struct(title.alias("title"), page.alias("page")))

    summary = F.regexp_extract(s, r"(\d{1,3})\s*$", 1).try_cast("int")
    found = F.coalesce(
        form(rf"^(.+?)\s*(?:{LEADER})\s*(\d{{1,3}})\s*$"), form(rf"^\s*(\d{{1,2}}\s*[{T.HAN}（][^\n]{{1,48}}?)\s+(\d{{1,3}})\s*$"), form(r"^(.{4,48}?)\s{2,}(\d{1,3})\s*$", 3), form(r"^(\d{1,2}\s+.+?)\s+(\d{1,3})\s*$"),
        F.when(s.contains("单元小结") & summary.between(1, LAST_PAGE), F.struct(F.lit("单元小结").alias("title"), summary.alias("page"))),
    )
    return F.when((F.length(s) >= 4) & s.rlike(f"[{T.HAN}]"), found)


def contents_entries(lines: DataFrame, volume: str) -> DataFrame:
    """volume, pos, unit, title, page, match_key out of lines (volume, pos, line): lessons with their page, under the last unit heading before them."""
    s = F.trim(F.coalesce("line", F.lit("")))
    head = s.rlike(rf"^第[{NUMERALS}\d]+(单元|章)")
    parsed = title_and_page(F.col("line"))
    heading = F.when(head, F.substring(F.coalesce(parsed["title"], T.norm_text(s, normal=False)), 1, TITLE_CHARS))
    carried = F.last("heading", ignorenulls=True).over(Window.partitionBy(volume).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    out = lines.withColumns({"heading": heading, "parsed": parsed}).withColumn("unit", F.coalesce(carried, F.lit("")))
    key = T.norm_text(T.strip_lesson_seq(F.col("parsed.title")), normal=False)
    key = F.when(F.length(key) >= 2, key).when(F.col("parsed.title").contains("小结"), "单元小结")
    entries = out.filter("heading IS NULL AND parsed IS NOT NULL").withColumn("match_key", key).filter("match_key IS NOT NULL")
    return entries.select(volume, "pos", "unit", F.col("parsed.title").alias("title"), F.col("parsed.page").alias("page"), "match_key")


def catalogue_lines(lines: DataFrame, volume: str) -> DataFrame:
    """volume, pos, part, unit, lesson: numbered lessons of a catalogue's lines, several to a line too, under the last unit before them."""
    cut = F.filter(F.split(F.coalesce("line", F.lit("")), rf"(?=第[{NUMERALS}\d]+单元)"), lambda x: F.trim(x) != "")
    parts = lines.select(volume, "pos", F.posexplode(cut).alias("part", "s")).withColumn("unit_here", unit_title(F.col("s")))
    w = Window.partitionBy(volume).orderBy("pos", "part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("unit", F.coalesce(F.last("unit_here", ignorenulls=True).over(w), F.lit(""))).filter("unit_here IS NULL")
    found = F.regexp_extract_all(close_up(F.col("s")), F.lit(rf"\d{{1,2}}\s*[{T.HAN}][^\d]{{1,36}}"), F.lit(0))
    lessons = parts.select(volume, "pos", "part", "unit", F.posexplode(found).alias("n", "x")).withColumn("lesson", clean_line(F.col("x")))
    return lessons.filter(~is_unlisted(F.col("lesson")) & ~F.col("lesson").contains("单元小结") & F.length("lesson").between(2, 120)).select(volume, "pos", "part", "n", "unit", "lesson")


def contents_span(pages: DataFrame, volume: str) -> DataFrame:
    """volume, first, last: the run of pages with a contents heading or a unit and three numbered lessons, among the first SCANNED; it ends at a page without lessons."""
    heading = T.has_any(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", ""), HEADINGS)
    numbered = F.filter(F.split(F.coalesce("text", F.lit("")), "[\r\n]"), lambda x: ~F.trim(x).rlike(r"^\d{1,2}[.．、]") & F.trim(x).rlike(rf"^\d{{1,2}}\s*[{T.HAN}]"))
    p = pages.filter(F.col("page") <= SCANNED).withColumns({"n": F.size(numbered), "heading": heading})
    strong = F.col("heading") | ((F.col("n") >= 3) & F.col("text").contains("单元"))
    p = p.withColumn("strong", F.coalesce(strong, F.lit(False)))
    w = Window.partitionBy(volume).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("begun", F.max("strong").over(w)).withColumn("ended", F.max(F.col("begun") & ~F.col("strong") & (F.col("n") == 0)).over(w))
    return p.filter("strong AND NOT ended").groupBy(volume).agg(F.min("page").alias("first"), F.max("page").alias("last"))


def is_suspect(units: Column, lessons: Column, last_number: Column) -> Column:
    """A catalogue with few lessons or units, or whose numbers don't reach the count of its lessons."""
    return (lessons < FEW_LESSONS) | (units < FEW_UNITS) | (last_number < lessons * 0.6)


# Rows -----------------------------------------------------------------------------------------------


def expanded(catalog: DataFrame) -> DataFrame:
    """Rows of catalog (volume, pos, unit, lesson, page), those with several lessons in a line as several rows without a page; part: the place in the line."""
    parts = L.split_glued(F.col("lesson"))
    out = catalog.withColumn("parts", F.when(F.size(parts) > 1, parts).otherwise(F.array(F.coalesce("lesson", F.lit(""))))).withColumn("glued", F.size("parts") > 1)
    out = out.select(*[c for c in catalog.columns if c not in ("lesson", "page")], "page", "glued", F.posexplode("parts").alias("part", "lesson"))
    return out.withColumn("page", F.when(~F.col("glued"), F.col("page"))).drop("glued")


def listed(catalog: DataFrame, subject: Column) -> DataFrame:
    """Rows that are entries of a catalogue, with `subtitle`: by subject as they are seen (without noise and unit summaries), or lessons and subtitles only."""
    x = F.col("lesson")
    strict = T.catalog_filter_mode(subject) == "yuwen"
    summary = T.is_unit_summary_label(x)
    lesson, under = L.is_lesson_line(x), L.is_subtitle(x)
    keep = F.when(strict, ~summary & ~L.is_exercise(x) & (lesson | under)).otherwise(~T.is_catalog_noise_line(x) & ~summary)
    return catalog.filter(keep).withColumn("subtitle", strict & ~lesson)


def merged(primary: DataFrame, more: DataFrame, volume: str) -> DataFrame:
    """One row per lesson (semantic key) of catalogues (volume, pos, unit, lesson), the second filling up the first: at the place where it first stood, with the longest unit name and the row most worth showing."""
    both = primary.withColumn("side", F.lit(0)).unionByName(more.withColumn("side", F.lit(1))).withColumn("key", L.semantic_key(F.col("unit"), F.col("lesson"))).filter("key <> ''")
    at = F.struct("side", "pos")
    best = F.max_by("lesson", F.struct(L.row_worth(F.col("unit"), F.col("lesson")).alias("w"), (-F.col("side")).alias("s"), (-F.col("pos")).alias("p")))
    unit = F.max_by("unit", F.struct(F.length(F.coalesce("unit", F.lit(""))).alias("w"), (-F.col("side")).alias("s"), (-F.col("pos")).alias("p")))
    out = both.groupBy(volume, "key").agg(F.min(at).alias("at"), unit.alias("unit"), best.alias("lesson"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(volume).orderBy("at"))).select(volume, "place", "unit", "lesson", "key")
