"""Paragraphs that go on over the ends of pages: chains of continued boxes, and fragments at pages' edges that belong to a neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compare as C
from ..functions.text import let
from .containment import covers, may_cover
from .scans import settled

# Marks that end a paragraph, openers that begin a new one, bands at the edges of a page, lengths of fragments.
FINAL = "。！？!?…；;.”\"』」"
OPENERS = ["选一个", "选做", "读一读", "读下面", "写一写", "和同学", "体会"]
TOP, LEAD, BOTTOM, HOST_BOTTOM, HOST_TOP = 0.16, 0.22, 0.84, 0.70, 0.30
FRAGMENT = (2, 28)


def is_unfinished(c: Column) -> Column:
    """A text whose last character doesn't end a paragraph; an empty one doesn't count."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    return (t != "") & ~F.contains(F.lit(FINAL), F.right(t, F.lit(1)))


def may_go_on(c: Column) -> Column:
    """A text that may be the rest of a paragraph: no heading by number or mark, no task."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    head = F.substring(t, 1, 12)
    opener = F.lit(False)
    for w in OPENERS:
        opener = opener | head.startswith(w)
    return (t != "") & ~t.rlike(rf"^[\d(（第{C.BULLETS}①-⑳]") & ~opener


def continued(boxes: DataFrame, book: str) -> DataFrame:
    """book, chain, first_page, pages, parts, text: paragraphs put together over the ends of pages, those on one page included.

    boxes: book, page, id, y0, y1, x0, text. A page's last box goes on in the first box of the next page number if it is
    unfinished and that box begins within LEAD of the top, may go on, and isn't already in the end of the text. A box that
    is all of its page may be both, so a chain may run over many pages. chain: the number of the paragraph in the book, in
    reading order. Texts of a chain are joined without a gap, blanks at the seam aside. Boxes without text are left out.
    """
    b = boxes.withColumn("t", F.trim(F.coalesce("text", F.lit("")))).filter("t <> ''").withColumn("y", (F.col("y0") + F.col("y1")) / 2)
    on_page = Window.partitionBy(book, "page").orderBy("y", "x0", "id")
    b = b.withColumns({"k": F.row_number().over(on_page), "n": F.count("*").over(Window.partitionBy(book, "page"))})
    first = b.filter("k = 1").select(F.col(book).alias("of_book"), (F.col("page") - 1).alias("of_page"), F.col("t").alias("lead"), F.col("y0").alias("lead_y"))
    ends = b.filter("k = n").join(first, F.col(book).eqNullSafe(F.col("of_book")) & (F.col("page") == F.col("of_page")))
    lead, own = C.page_norm(F.col("lead")), C.page_norm(F.col("t"))
    again = F.contains(F.right(own, F.greatest(F.lit(24), F.length(lead))), F.substring(lead, 1, 8)) & (lead != "")
    goes = ends.filter(is_unfinished(F.col("t")) & (F.col("lead_y") <= LEAD) & may_go_on(F.col("lead")) & ~again).select(F.col(book).alias("of_book"), (F.col("page") + 1).alias("of_page"), F.lit(1).alias("joined"))
    marked = b.join(goes, F.col(book).eqNullSafe(F.col("of_book")) & (F.col("page") == F.col("of_page")) & (F.col("k") == 1), "left")
    order = Window.partitionBy(book).orderBy("page", "k")
    chain = F.sum(1 - F.coalesce("joined", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    told = F.sort_array(F.collect_list(F.struct("page", "k", "t")))
    out = marked.withColumn("chain", chain).groupBy(book, "chain").agg(told.alias("told"))
    return out.select(book, "chain", F.get("told", F.lit(0))["page"].alias("first_page"), F.size(F.array_distinct(F.transform("told", lambda x: x["page"]))).alias("pages"), F.size("told").alias("parts"), F.array_join(F.transform("told", lambda x: x["t"]), "").alias("text"))


def edge_fragment(text: Column, y0: Column, y1: Column) -> Column:
    """A short text at the top or bottom of a page: rather the rest or the begin of a paragraph than a paragraph."""
    return let(F.length(C.content_key(text)), lambda n: n.between(*FRAGMENT)) & ((y0 < TOP) | (y1 > BOTTOM))


def absorbed(loose: DataFrame, others: DataFrame, book: str) -> DataFrame:
    """book, page, id, host_page, host: boxes without a counterpart (loose) that are no change, since the other side (others) has their text at the near edge of a neighbouring page.

    loose, others: book, page, id, y0, y1, text, pages of the two sides numbered alike. A fragment at the top may belong to
    a box in the lower part of the page before, one at the bottom to a box in the upper part of the page behind. Of several hosts that
    cover it, the longest text takes it, of equals the first. A stretch of a host is told once: equal fragments of one page are as
    many as there are in the host at most.
    """
    text = F.coalesce("text", F.lit(""))
    f = loose.filter((F.col("y0") < TOP) | (F.col("y1") > BOTTOM)).filter(edge_fragment(text, F.col("y0"), F.col("y1")))
    # normal forms are made once a text, before fragments meet hosts
    f = settled(f.select(book, "page", "id", text.alias("t"), (F.col("y0") < TOP).alias("top")), needle=C.page_norm(F.col("t"))).drop("t")
    f = f.withColumn("host_page", F.when(F.col("top"), F.col("page") - 1).otherwise(F.col("page") + 1))
    h = others.filter((F.col("y1") >= HOST_BOTTOM) | (F.col("y0") <= HOST_TOP)).select(F.col(book).alias("of_book"), F.col("page").alias("of_page"), F.col("id").alias("host"), F.coalesce("text", F.lit("")).alias("h"), (F.col("y1") >= HOST_BOTTOM).alias("low"), (F.col("y0") <= HOST_TOP).alias("high"))
    h = settled(h, hay=C.page_norm(F.col("h")))
    near = (F.col(book) == F.col("of_book")) & (F.col("host_page") == F.col("of_page"))
    met = f.join(h, near).filter((F.col("top") & F.col("low")) | (~F.col("top") & F.col("high"))).filter(may_cover(F.col("hay"), F.col("needle"), True)).filter(covers(F.col("hay"), F.col("needle"), True))
    best = Window.partitionBy(book, "page", "id").orderBy(F.desc(F.length(C.content_key(F.col("h")))), "host")
    one = met.withColumn("k", F.row_number().over(best)).filter("k = 1")
    needle, hay = F.col("needle"), F.col("hay")
    times = F.greatest(F.lit(1), F.floor((F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))) / F.greatest(F.lit(1), F.length(needle))).cast("int"))
    again = Window.partitionBy(book, "host_page", "host", needle).orderBy("page", "id")
    return one.withColumn("again", F.row_number().over(again)).filter(F.col("again") <= times).select(book, "page", "id", "host_page", "host")
