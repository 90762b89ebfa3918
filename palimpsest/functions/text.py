"""Normalisers and predicates of titles and texts: Column -> Column, null counts as empty."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HAN = r"\x{4e00}-\x{9fff}"
BLANK = r"\s\x{00a0}\x{3000}"
# Chinese numerals, front-matter words, keyword families.
NUMERALS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
FRONT_MATTER = ["前言", "编者的话", "编者说明", "版权", "CIP", "ISBN", "定价", "责任编辑", "义务教育教科书", "绿色印刷"]


def _filled(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _gone(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def let(value: Column, use) -> Column:
    """use(value) with the value made once, however often it is used: a lambda's argument isn't made again for each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(c: Column) -> Column:
    return _gone(_filled(c), rf"^[{BLANK}]+|[{BLANK}]+$")


def has_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def _udf(form: str):
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return F.pandas_udf(normal, StringType())


def nfkc(c: Column) -> Column:
    """No built-in does this."""
    return _udf("NFKC")(c)


def nfc(c: Column) -> Column:
    return _udf("NFC")(c)


def norm_text(c: Column, drop_latin: bool = True, normal: bool = True) -> Column:
    """NFC, lower case, without bracketed parts, blanks, dashes, middle dots, quotes and (unless told otherwise) Latin runs."""
    t = stripped(c)
    t = F.lower(nfc(t) if normal else t)
    t = _gone(t, r"[（(][^）)]*[）)]")
    t = _gone(t, rf"[{BLANK}\-\x{{2010}}-\x{{2015}}\x{{2212}}\x{{ff0d}}\x{{00b7}}\x{{2022}}]+")
    if drop_latin:
        t = _gone(t, r"[A-Za-z\x{00c0}-\x{00ff}\x{0100}-\x{017e}\x{01ce}\x{01d0}\x{01d2}\x{01d4}\x{01d6}\x{01d8}\x{01da}\x{01dc}\x{01f9}\x{1e3f}\x{0250}-\x{02af}]+")
    return _gone(t, r"[\x22'`「」『』【】《》〈〉\x{2018}\x{2019}\x{201c}\x{201d}\x{ff02}]+")


def norm_lesson_title(c: Column, normal: bool = True) -> Column:
    """norm_text without an 一 between two Han characters (a mistyped dash)."""
    return _gone(norm_text(c, normal=normal), rf"(?<=[{HAN}])一(?=[{HAN}])")


def strip_lesson_seq(c: Column) -> Column:
    return stripped(_gone(stripped(_gone(stripped(c), r"^课题\s*\d+\s*")), r"^\d+\s*"))


def lesson_seq_int(c: Column) -> Column:
    """1 of '1' and '课题1'; null unless positive."""
    n = F.regexp_extract(stripped(c), r"^(?:课题\s*)?(\d+)$", 1).try_cast("int")
    return F.when(n > 0, n)


def is_numbered_lesson_no(c: Column) -> Column:
    return lesson_seq_int(c).isNotNull()


def normalize_title(c: Column) -> Column:
    return stripped(_gone(stripped(c), rf"[{BLANK}]+", " "))


def lesson_match_key(c: Column, normal: bool = True) -> Column:
    t = normalize_title(c)
    t = nfkc(t) if normal else t
    return _gone(_gone(t, rf"^0*(\d{{1,2}})[{BLANK}.．、]+", "$1"), rf"[{BLANK}]+")


def lesson_reuse_body_key(c: Column, normal: bool = True) -> Column:
    return _gone(lesson_match_key(c, normal), rf"^\d{{1,3}}(?=[{HAN}（])")


def lesson_reuse_match_key(c: Column, normal: bool = True) -> Column:
    """The key of the exact match: without leading number, 第N课 and every 的."""
    return F.replace(_gone(lesson_reuse_body_key(c, normal), r"^第[一二三四五六七八九十百千零0-9]+课"), F.lit("的"), F.lit(""))


def unit_theme_match_key(c: Column, normal: bool = True) -> Column:
    t = normalize_title(c)
    t = nfkc(t) if normal else t
    return _gone(_gone(t, r"^第[一二三四五六七八九十百千0-9]+单元\s*"), "[ \\x{3000}、，,;；·的]")


def merge_unit_lesson(unit: Column, lesson: Column, normal: bool = True) -> Column:
    return merge_unit_key(unit, lesson_reuse_match_key(lesson, normal))


def merge_unit_key(unit: Column, k: Column) -> Column:
    """merge_unit_lesson of a lesson's lesson_reuse_match_key."""
    u = normalize_title(unit)
    return F.when(k == "", u).when(u == "", k).otherwise(F.concat_ws(" ", u, k))


def body_text_match_key(c: Column) -> Column:
    return _gone(_filled(c), rf"[^{HAN}]")


def format_old_lesson_hint(unit: Column, lesson: Column) -> Column:
    u, x = normalize_title(unit), normalize_title(lesson)
    return F.when((u != "") & (x != ""), F.concat(u, F.lit("｜"), x)).otherwise(F.concat(u, x))


def normalize_compare_text(c: Column) -> Column:
    return _gone(_gone(stripped(c), rf"[{BLANK}]+"), "[，。！？、；：\"'（）【】《》…·\\-—]")


def excerpt(c: Column, most: int = 40) -> Column:
    t = stripped(F.replace(_filled(c), F.lit("\n"), F.lit(" ")))
    return F.concat(F.substring(t, 1, most), F.when(F.length(t) > most, "…").otherwise(""))


def body_excerpt(c: Column, most: int = 1000) -> Column:
    return F.substring(stripped(_gone(_filled(c), rf"[{BLANK}]+", " ")), 1, most)


def lesson_display_text(no: Column, name: Column) -> Column:
    n, x = stripped(no), stripped(name)
    return F.when((n != "") & (n != "0"), stripped(F.concat_ws(" ", n, x))).otherwise(x)


def cell_str(c: Column) -> Column:
    t = stripped(c)
    return F.when(F.lower(t).isin("nan", "none"), "").otherwise(t)


def parse_lesson_no(c: Column) -> Column:
    return F.regexp_extract(cell_str(c), r"^(\d+)", 1)


def parse_lesson_name(c: Column) -> Column:
    t = cell_str(c)
    rest = _gone(stripped(_gone(t, r"^\d+\s*[.．、]?\s*")), r"^[.．、]+")
    return F.when(stripped(rest) != "", stripped(rest)).otherwise(t)


def parse_grade(c: Column) -> Column:
    t = _gone(cell_str(c), "年级| ")
    digits = F.when(t.rlike(r"^\d+$"), t.try_cast("int"))
    return F.coalesce(digits, *[F.when(t.startswith(k), v) for k, v in list(NUMERALS.items())[:6]])


def parse_semester(c: Column) -> Column:
    return F.when(cell_str(c).contains("下"), "下").otherwise("上")


def parse_page_count(c: Column) -> Column:
    return cell_str(c).try_cast("double").try_cast("int")


def cn_numeral(c: Column) -> Column:
    """Numerals to 99 in Han or digits; null for anything else."""
    t = stripped(c)
    digit = lambda x: F.coalesce(*[F.when(x == k, v) for k, v in NUMERALS.items()])
    tens, ones = F.regexp_extract(t, "^(.?)十(.?)$", 1), F.regexp_extract(t, "^(.?)十(.?)$", 2)
    compound = F.when(tens == "", 1).otherwise(digit(tens)) * 10 + F.when(ones == "", 0).otherwise(digit(ones))
    return F.when(t.rlike(r"^\d+$"), t.try_cast("int")).when(t.rlike("^.?十.?$"), compound).otherwise(digit(t))


def unit_no_from_title(c: Column) -> Column:
    t = stripped(c)
    prologue = t.startswith("绪论") & ~t.contains("单元") & ~t.contains("章")
    return F.when(prologue, 0).otherwise(cn_numeral(F.regexp_extract(t, r"第([一二三四五六七八九十百零\d]+)(?:单元|章)", 1)))


def is_unit_summary_label(c: Column) -> Column:
    return _filled(c).contains("单元小结")


def is_master_class_unit(c: Column) -> Column:
    return _filled(c).contains("大师课")


def is_subtitle_lesson_no(no: Column, subject: Column) -> Column:
    s = stripped(subject)
    return stripped(no).rlike(r"\.\d+$") & s.isin("", "语文", "Test")


def catalog_filter_mode(subject: Column) -> Column:
    return F.when(stripped(subject).isin("语文", "Test"), "yuwen").otherwise("as_seen")


def is_catalog_noise_line(c: Column) -> Column:
    t = _gone(_filled(c), rf"[{BLANK}]+")
    return (t == "") | has_any(t, FRONT_MATTER) | (t.startswith("出版") & (F.length(t) < 24))


def is_blank_page(c: Column) -> Column:
    return F.length(_gone(_filled(c), rf"[{BLANK}]+")) < 3


def is_unit_summary_page(c: Column) -> Column:
    """单元小结 near the beginning, or at the beginning of a line."""
    t = _filled(c)
    head = F.least(F.lit(200), F.greatest(F.lit(40), F.floor(F.length(t) / 3).cast("int")))
    return F.locate("单元小结", t).between(1, head) | t.rlike(r"(?m)^\s*单元小结")


def lesson_no_sort_key(c: Column) -> Column:
    s = cell_str(c)
    n = F.regexp_extract(s, r"^(\d+)", 1).try_cast("long")
    kind = F.when(s.contains("单元小结"), 1).when(n.isNotNull(), 0).otherwise(2)
    return F.struct(kind.alias("kind"), F.when(kind == 1, F.lit(9999)).when(kind == 0, n).otherwise(0).cast("long").alias("n"), s.alias("s"))


# Titles of catalogue lines without a number and their places, and kinds of numbered activities and theirs.
SPECIAL_PLACES = {"整理与提升": 10, "复习与提高": 20, "回顾与反思": 70, "复习题": 80}
ACTIVITY_PLACES = {"实验活动": 30, "跨学科实践活动": 40, "综合实践活动": 50, "微项目": 60}
READING = "读一读|数学活动|主题探究"


def catalog_sort_key(c: Column) -> Column:
    """A struct that sorts the lines of a unit: numbered lessons, then reviews, activities and the rest, then the summary."""
    s = cell_str(c)
    bare = _gone(_gone(s, r"(?:[·●…．._—-]+\s*|\s+)\d{1,3}\s*$"), rf"[{BLANK}]+")  # without the page number
    number = lambda pattern, group=1: F.regexp_extract(s, pattern, group).try_cast("long")
    key = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"), s.alias("s"))
    out = F.when(s.contains("单元小结"), key(3, F.lit(9999)))
    for title, place in SPECIAL_PLACES.items():
        out = out.when(bare == title, key(2, F.lit(place)))
    for name, place in ACTIVITY_PLACES.items():
        at = number(rf"^{name}\s*(\d+)")
        out = out.when(at.isNotNull(), key(2, at + place))
    out = out.when(s.rlike(f"^({READING})"), key(2, F.lit(65)))
    for at in (number(r"^课题\s*(\d+)"), number(r"^(\d{1,2})\.(\d{1,2})\b") * 100 + number(r"^(\d{1,2})\.(\d{1,2})\b", 2), number(r"^(\d+)")):
        out = out.when(at.isNotNull(), key(0, at))
    return out.otherwise(key(2, F.lit(0)))


def lesson_place(sort_order: Column, no: Column) -> Column:
    """The sort order, else ten times the number; a number that isn't one comes last."""
    t = stripped(no)
    return F.coalesce(sort_order.cast("long"), F.when(t.rlike(r"^\d+$"), t.try_cast("long") * 10), F.lit(99990).cast("long"))


def catalog_line_count(c: Column) -> Column:
    """Lines of 4 to 90 characters with a Han character and a page number at the end."""
    lines = F.transform(F.split(F.translate(_filled(c), "\r", "\n"), "\n"), stripped)
    return F.size(F.filter(lines, lambda x: F.length(x).between(4, 90) & x.rlike(r"[\u4e00-\u9fff]") & x.rlike(r"\p{Nd}$")))


def is_contents_page(c: Column, hits: Column, lines: Column) -> Column:
    """hits: lessons named on the page; lines: its catalog_line_count."""
    named = _filled(c).contains("目录") & ((hits >= 1) | (lines >= 2))
    return (F.length(stripped(c)) >= 6) & (named | (lines >= 3) | ((hits >= 1) & (lines >= 2)))


def _slug(c: Column) -> Column:
    t = stripped(c)
    return F.when(t == "", "unknown").otherwise(t)


def semester_letter(c: Column, first: str, second: str) -> Column:
    s = stripped(c)
    return F.when(s.isin("上", "上学期", "1"), first).when(s.isin("下", "下学期", "2"), second).otherwise(_slug(c))


def make_lesson_uid(edition: Column, grade: Column, semester: Column, book: Column, unit: Column, no: Column, version: Column) -> Column:
    n = _slug(_gone(stripped(no), "[*＊]", "x"))
    b = F.when(stripped(book) == "", "old").otherwise(stripped(book))
    b = F.when(F.coalesce(version, F.lit(1)) > 1, F.concat(b, F.lit("-v"), version.cast("string"))).otherwise(b)
    return F.concat(_slug(edition), F.lit("-"), grade.cast("string"), F.lit("-"), semester_letter(semester, "上", "下"), F.lit("-"), b, F.lit("-U"), unit.cast("string"), F.lit("-L"), n)


def make_volume_code(edition: Column, grade: Column, semester: Column, book: Column) -> Column:
    s = F.when(stripped(semester).isin("上", "上学期", "1"), "S").otherwise("X")
    return F.concat(F.upper(F.substring(_slug(edition), 1, 8)), F.lit("-"), grade.cast("string"), s, F.lit("-"), F.upper(book))


def format_cw_range(pages: Column) -> Column:
    """P3, P3-5 for consecutive pages, else P3/P7."""
    p = F.array_sort(F.coalesce(pages, F.array().cast("array<int>")))
    joined = F.concat(F.lit("P"), F.array_join(p.cast("array<string>"), "/P"))
    steps = F.forall(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(p) - 1)), lambda i: F.coalesce(F.get(p, i) == F.get(p, i - 1) + 1, F.lit(True)))
    return F.when(F.size(p) == 0, "").when(F.size(p) == 1, joined).when(steps, F.concat(F.lit("P"), F.array_min(p).cast("string"), F.lit("-"), F.array_max(p).cast("string"))).otherwise(joined)


def parse_slides_spec(c: Column) -> Column:
    """'3-5' -> [3, 4, 5]; '3' -> [3]; bounds in either order; anything else -> []."""
    a, b = F.regexp_extract(_filled(c), r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$", 1).try_cast("int"), F.regexp_extract(_filled(c), r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$", 2).try_cast("int")
    return F.when(a.isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.least(a, F.coalesce(b, a)), F.greatest(a, F.coalesce(b, a))))


def view_side(view: Column) -> tuple[Column, Column]:
    """The sheet (from 1) and side of a view of a spread, two views to a sheet."""
    return F.ceil(view / 2).cast("long"), F.when(view % 2 == 1, "left").otherwise("right")


def sheet_view(sheet: Column, side: Column) -> Column:
    return sheet * 2 - F.when(side == "left", 1).otherwise(0)
