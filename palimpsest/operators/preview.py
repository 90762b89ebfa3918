"""Which old page a new page belongs to: footer, contents, content, position; summaries of the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compare as C
from .scans import settled as made_once

# Floors of the methods, tail of a footer line, names that stand with a page number.
BY_CONTENTS, BY_CONTENT, WEAK, FOOTER_LINES, FOCUS, FOCUS_ROWS = 0.18, 0.22, 0.03, 8, 0.75, 10
TAIL = r"\s*(?:CMYK|TLPC|SCGL|New.*)?$"
FOOTERS = [
    rf"^(\d{{1,3}})\s*第[一二三四五六七八九十\d]+单元", rf"课题\s*[\d一二三四五六七八九十]+[^\d\n]{{2,48}}?(\d{{1,3}}){TAIL}", rf"^(?:练习与应用|复习与提高|整理与提升|探究与实践)\s*(\d{{1,3}}){TAIL}",
    r"^(\d{1,3})\s*(?:绪论|课题)", rf"^(\d{{1,3}}){TAIL}",
]


def footer_page(text: Column) -> Column:
    """The printed page number that the last lines of a page tell, from the bottom; null if none does."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[\r\n]"), lambda x: F.trim(x)), lambda x: x != "")
    last = F.filter(F.reverse(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - (FOOTER_LINES - 1)), F.lit(FOOTER_LINES))), lambda x: x.rlike(r"^\d{1,3}$") | ~C.is_scan_noise(x))
    number = lambda x: F.coalesce(*[F.regexp_extract(x, "(?i)" + p, 1).try_cast("int") for p in FOOTERS])
    return F.get(F.filter(F.transform(last, number), lambda n: n.isNotNull()), F.lit(0))


def body_start(pages: DataFrame, book: str, scan: int = 25) -> DataFrame:
    """book, start: the first page of the text proper among the first `scan`, else page 15 or the last."""
    contents = F.substring("text", 1, 80).contains("目录") & F.col("text").rlike(r"课题\s*\d")
    opens = ~contents & F.col("text").rlike(r"(?m)^课题\s*\d|^第[一二三四五六七八九十\d]+单元")
    return pages.groupBy(book).agg(F.coalesce(F.min(F.when(F.coalesce(opens, F.lit(False)) & (F.col("page") <= scan), F.col("page"))), F.least(F.lit(15), F.max("page"))).alias("start"))


def resolved_pages(new: DataFrame, old: DataFrame, contents: DataFrame, offsets: DataFrame, book: str) -> DataFrame:
    """book, page, old_page, method, similarity: the footer's page, else that of the contents entry with the page's key, else the most similar old page, else by position.

    new: book, page, key, text; old: book, page, text; contents: book, key, page; offsets: book, offset. Texts of pages
    are compared within a book, and all of them only for pages that neither footer nor contents settle.
    """
    # what is compared is made once a page, before pages meet
    norm = C.page_norm(C.without_scan_noise(F.col("text")))
    o = made_once(old.select(book, F.col("page").alias("old_page"), "text"), old_norm=norm).drop("text")
    n = made_once(new.join(offsets, book), printed=footer_page(F.col("text")), norm=norm).drop("text")
    alike = C.fuzz_of_norms(F.col("norm"), F.col("old_norm"))
    footer = n.filter("printed IS NOT NULL").withColumn("old_page", F.col("printed") + F.col("offset")).join(o, [book, "old_page"]).select(book, "page", "old_page", F.lit("footer").alias("method"), alike.alias("similarity"))
    entry = contents.groupBy(book, "key").agg(F.min("page").alias("first"))
    toc = n.join(entry, [book, "key"]).withColumn("old_page", F.col("first") + F.col("offset")).join(o, [book, "old_page"]).select(book, "page", "old_page", F.lit("toc").alias("method"), alike.alias("similarity")).filter(F.col("similarity") >= BY_CONTENTS)
    first = Window.partitionBy(book, "page").orderBy(F.when(F.col("method") == "footer", 0).otherwise(1))
    settled = footer.unionByName(toc).withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")
    rest = n.join(settled.select(book, "page"), [book, "page"], "left_anti")
    met = rest.join(o, book).join(body_start(old, book), book).filter(F.col("old_page") >= F.col("start"))
    best = met.select(book, "page", "old_page", alike.alias("similarity")).withColumn("k", F.row_number().over(Window.partitionBy(book, "page").orderBy(F.desc("similarity"), "old_page"))).filter((F.col("k") == 1) & (F.col("similarity") > WEAK))
    content = best.select(book, "page", "old_page", F.when(F.col("similarity") >= BY_CONTENT, "content").otherwise("content_weak").alias("method"), "similarity")
    last = old.groupBy(book).agg(F.max("page").alias("last"))
    guess = F.when(F.col("page") <= 1, 1).otherwise(F.least(F.greatest(F.lit(1), F.col("page") + F.col("offset") - 1), F.col("last")))
    placed = rest.join(content.select(book, "page"), [book, "page"], "left_anti").join(last, book).withColumn("old_page", guess.cast(dict(o.dtypes)["old_page"]))
    position = placed.join(o, [book, "old_page"], "left").select(book, "page", "old_page", F.lit("position").alias("method"), F.coalesce(alike, F.lit(0.0)).alias("similarity"))
    return settled.unionByName(content).unionByName(position)


def pair_summary(pairs: DataFrame, volume: str) -> DataFrame:
    """Per volume: comparable and skipped pages, pages per level of change, and the pages to look at first. pairs: volume, page, comparable, change, similarity."""
    seen = F.when(F.col("comparable"), F.coalesce("change", F.lit("未知")))
    levels = pairs.filter("comparable").groupBy(volume, seen.alias("change")).agg(F.count("*").alias("n")).groupBy(volume).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("change", "n")))).alias("by_change"))
    ranked = pairs.filter(F.col("comparable") & (F.coalesce("similarity", F.lit(1.0)) < FOCUS)).withColumn("k", F.row_number().over(Window.partitionBy(volume).orderBy("similarity", "page"))).filter(F.col("k") <= FOCUS_ROWS)
    focus = ranked.groupBy(volume).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "page"))), lambda x: x["page"]).alias("focus"))
    counts = pairs.groupBy(volume).agg(F.count_if("comparable").alias("comparable"), F.count_if(~F.col("comparable")).alias("skipped"))
    return counts.join(levels, volume, "left").join(focus, volume, "left")
