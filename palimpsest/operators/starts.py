"""Where lessons begin in a book: ordered lessons on ordered pages, and plans of pages with missing starts filled in."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .matching import by_group

# Places of a title on a page and what they are worth, reach of a hint, pages between units, share of starts that must be known.
HEAD_LINES, FIRST_LINE, AMONG_FIRST, EARLY, EARLY_CHARS = 5, 8, 4, 2, 360
BEFORE, AFTER, HINTED = 2, 14, 16
UNIT_GAP, KNOWN, FEWEST = 2, 0.65, 3


def page_head(page: Column) -> Column:
    """What title_worth needs of a page, made once for all its titles: its first lines, normalised, and the beginning of its text."""
    lines = F.filter(F.transform(F.split(F.coalesce(page, F.lit("")), "[\r\n]"), lambda x: T.norm_text(x, normal=False)), lambda x: x != "")
    return F.struct(F.slice(lines, 1, HEAD_LINES).alias("lines"), T.norm_text(F.substring(F.coalesce(page, F.lit("")), 1, EARLY_CHARS), normal=False).alias("early"))


def head_worth(head: Column, key: Column) -> Column:
    """title_worth of a page_head and a normalised title."""
    first = F.coalesce(F.get(head["lines"], F.lit(0)) == key, F.lit(False))
    among = F.exists(head["lines"], lambda x: x.startswith(key))
    return F.when(F.length(key) < 2, 0).when(first, FIRST_LINE).when(among, AMONG_FIRST).when(F.contains(head["early"], key), EARLY).otherwise(0)


def title_worth(page: Column, title: Column) -> Column:
    """How much a page looks like the start of a lesson: its title is the first line, begins one of the first lines, or stands early in the text; 0 if none, or if there is no title."""
    return T.let(page_head(page), lambda h: T.let(T.norm_text(title, normal=False), lambda k: head_worth(h, k)))


def hint_worth(page: Column, hint: Column) -> Column:
    """HINTED on the hinted page and one less for each page away, within BEFORE pages before it and AFTER behind it; 0 without a hint."""
    near = page.between(hint - BEFORE, hint + AFTER)
    return F.coalesce(F.when(near, HINTED - F.abs(page - hint)), F.lit(0))


def best_chain(rows: list[tuple]) -> list[tuple]:
    """(book, lesson, page, worth), by lesson and page -> those rows, one lesson and one page each and both increasing, that are worth most together; of equals
    those of more lessons, then those found first.

    Dynamic programming over the rows: the best chain that ends before a page is kept in a list of growing pages and
    growing worths, so a row costs a binary search.
    """
    pages: list[int] = []
    tops: list[tuple] = []  # (worth, length) of the best chain that ends at that page or before, both rising
    last: list[int] = []
    before = [-1] * len(rows)
    i = 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][1] == rows[i][1]:
            j += 1
        made = []
        for r in range(i, j):  # all of one lesson look at chains of earlier lessons only
            at = bisect_left(pages, rows[r][2]) - 1
            worth, count = tops[at] if at >= 0 else (0, 0)
            before[r] = last[at] if at >= 0 else -1
            made.append((rows[r][2], (worth + rows[r][3], count + 1), r))
        for page, top, r in made:
            at = bisect_left(pages, page)
            if (at > 0 and tops[at - 1] >= top) or (at < len(pages) and pages[at] == page and tops[at] >= top):
                continue
            end = at
            while end < len(pages) and tops[end] <= top:
                end += 1
            pages[at:end], tops[at:end], last[at:end] = [page], [top], [r]
        i = j
    out = []
    r = last[-1] if last else -1
    while r >= 0:
        out.append(rows[r])
        r = before[r]
    return out[::-1]


def lesson_starts(scored: DataFrame, book: str) -> DataFrame:
    """book, lesson, page, worth of scored (the same columns, worth a positive whole number): lessons put on pages, both in order, so that they are worth most together. Lessons that fit nowhere have no row.

    Only pairs worth something are held, a book at a time.
    """
    rows = scored.filter("worth > 0").select(book, F.col("lesson").cast("long").alias("lesson"), F.col("page").cast("long").alias("page"), F.col("worth").cast("long").alias("worth"))
    return by_group(rows, book, ["lesson", "page"], best_chain)


def page_plan(lessons: DataFrame, volume: str) -> DataFrame:
    """lessons (volume, pos, unit, start, total, offset) with logical_start, physical_start, physical_end, filled: a plan of pages for every lesson of the volumes where enough starts are known.

    A missing start is one page behind the last known one, but not behind the next; or a page before the next (1 at least). At least
    FEWEST starts and KNOWN of all must be there, else the volume has no plan. A lesson ends a page before the next start in its
    unit, two before another unit's, the last with the book; never before it begins, nor behind the book's end. Physical
    pages are logical ones moved by the offset. pos is unique in a volume.
    """
    w = Window.partitionBy(volume).orderBy("pos")
    whole = Window.partitionBy(volume)
    known = F.last("start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # the first one behind is the last one before in the other order: frames that end with the group are made anew for each row
    following = F.last("start", ignorenulls=True).over(Window.partitionBy(volume).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1))
    guess = F.when(known.isNotNull() & following.isNotNull(), F.greatest(known, F.least(following, known + 1))).when(known.isNotNull(), known + 1).otherwise(F.greatest(F.lit(1), following - 1))
    n = F.count("*").over(whole)
    have = F.count("start").over(whole)
    out = lessons.withColumns({"logical_start": F.coalesce("start", guess), "filled": F.col("start").isNull(), "enough": (have == n) | ((have >= FEWEST) & (have >= F.floor(n * KNOWN)))}).filter("enough").drop("enough")
    nxt, other = F.lead("logical_start").over(w), ~F.lead("unit").over(w).eqNullSafe(F.col("unit"))
    end = F.coalesce(nxt - F.when(other, UNIT_GAP).otherwise(1), F.greatest(F.lit(1), F.col("total") - F.col("offset")))
    out = out.withColumn("logical_end", F.greatest(F.col("logical_start"), end))
    first = F.col("logical_start") + F.col("offset")
    return out.withColumns({"physical_start": first, "physical_end": F.least(F.greatest(first, F.col("logical_end") + F.col("offset")), F.col("total"))})
