"""Kinds of pages, volumes and boxes: Column -> Column, null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_any, norm_text

# Words that open front matter, headings of pages.
FRONT = ["亲爱的小朋友", "给小朋友的信", "给朋友的信", "给孩子的信", "编者大朋友", "致同学", "编者的话", "写给小朋友", "本书主要栏目", "主要栏目及说明", "栏目及说明", "使用说明", "图书在版编目"]
LETTERS, READERS = ["的信", "的话"], ["亲爱的", "小朋友", "同学们"]
TITLES = [r"^课题\s*\d", r"^(复习与提高|整理与提升|探究)$", r"^第[一二三四五六七八九十\d]+单元", r"^实验活动\s*\d", "^跨学科", "^绪论"]
SKIPPED = ["Time:", "pdf_", "CMYK", "人民教育", "出版社", "义务教育"]
LEADERS = r"\.{2,}|…{2,}|·{4,}"
SMALLEST = 0.02


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _lines(text: Column) -> Column:
    return F.transform(F.split(_filled(text), "[\r\n]"), lambda x: F.trim(x))


def is_front_matter(text: Column) -> Column:
    """A greeting or a note on the book's columns, not a lesson."""
    head = F.substring(_filled(text), 1, 480)
    return has_any(head, FRONT) | (has_any(F.substring(head, 1, 80), LETTERS) & has_any(head, READERS))


def _first_line(text: Column, contents: str) -> Column:
    """The first line that isn't empty, a contents line with leaders, or of the given form."""
    return F.get(F.filter(_lines(text), lambda x: (x != "") & ~x.rlike(LEADERS) & ~x.rlike(contents)), F.lit(0))


def is_appendix_start(text: Column) -> Column:
    first = norm_text(_first_line(text, r"^附录[一二三四五六七八九十\d].*\s+\d{1,3}\s*$"), normal=False)
    return (F.length(F.trim(_filled(text))) >= 2) & F.coalesce(first.startswith("附录"), F.lit(False))


def is_postscript_start(text: Column) -> Column:
    first = norm_text(_first_line(text, r"^(后记|编者的话|编后记)\s+\d{1,3}\s*$"), normal=False)
    return (F.length(F.trim(_filled(text))) >= 2) & F.coalesce(first.startswith("后记") | first.startswith("编者的话") | (first == "编后记"), F.lit(False))


def title_line(text: Column) -> Column:
    """The first line of 4 to 48 characters that heads a lesson, a unit or a column; null if there is none."""
    tidy = F.transform(_lines(text), lambda x: F.regexp_replace(x, r"\s+", " "))
    heading = lambda x: sum((x.rlike(p).cast("int") for p in TITLES), F.lit(0)) > 0
    return F.get(F.filter(tidy, lambda x: F.length(x).between(4, 48) & ~has_any(x, SKIPPED) & heading(x)), F.lit(0))


def is_test_volume(code: Column) -> Column:
    c = F.trim(_filled(code))
    return F.upper(c).startswith("OLD-SEED") | F.upper(c).startswith("NEW-SEED") | c.startswith("T-")


def normal_box(b: Column, width: Column, height: Column) -> Column:
    """A box (x0, y0, x1, y1) as shares of the page: pixels divided by its size, clamped, SMALLEST wide and high if it had no extent, 4 places."""
    span = lambda lo, hi, size: (F.when(F.greatest(b[lo], b[hi]) > 1.01, b[lo] / size).otherwise(b[lo]), F.when(F.greatest(b[lo], b[hi]) > 1.01, b[hi] / size).otherwise(b[hi]))
    fields = []
    for lo, hi, size in (("x0", "x1", width), ("y0", "y1", height)):
        first, last = (F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) for c in span(lo, hi, size))
        last = F.when(last <= first, F.least(first + SMALLEST, F.lit(1.0))).otherwise(last)
        fields += [F.round(first, 4).alias(lo), F.round(last, 4).alias(hi)]
    return F.struct(*fields)
