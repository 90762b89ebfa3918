"""Operators over catalogue rows, page ranges and boxes. Joins are on a volume, page or row key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of the rules.
SPARSE_CHARS, SPARSE_SHARE, SPARSE_PAGES = 24, 0.45, 30
OFFSETS, LEAST_HITS = 30, 2
EXCLUDE_CONTAINED, EXCLUDE_IOU = 0.35, 0.2975
INSIDE_AREA, INSIDE_CONTAINED, INSIDE_SMALL, INSIDE_LEAST = 0.92, 0.55, 0.45, 2


def row_span(df: DataFrame, keys: list[str], row: str) -> DataFrame:
    """keys, first_row, last_row."""
    return df.groupBy(*keys).agg(F.min(row).alias("first_row"), F.max(row).alias("last_row"))


def add_misgraded(primary: DataFrame, candidates: DataFrame, key: str, unit: str, no: str, place: str) -> DataFrame:
    """primary and those candidates whose number is in the gaps of its key's numbers and whose unit it has; per number the first by place.

    Null numbers never come in; a key without a number takes none. The columns are those of primary.
    """
    spans = primary.groupBy(key).agg(F.min(no).alias("lo"), F.max(no).alias("hi"))
    units, have = primary.select(key, unit).distinct(), primary.select(key, no).distinct()
    fits = candidates.join(spans, key).filter(F.col(no).between(F.col("lo"), F.col("hi"))).join(units, [key, unit], "left_semi").join(have, [key, no], "left_anti")
    first = F.row_number().over(Window.partitionBy(key, no).orderBy(place))
    return primary.unionByName(fits.withColumn("rn", first).filter("rn = 1").select(*primary.columns))


def catalogue_score(df: DataFrame, key: str, unit: str, no: str, summary: Column) -> DataFrame:
    """key, units, numbered (without summaries), highest: compared in this order, the larger catalogue wins."""
    return df.groupBy(key).agg(F.count_distinct(unit).alias("units"), F.count_if(F.col(no).isNotNull() & ~summary).alias("numbered"), F.coalesce(F.max(no), F.lit(0)).cast("long").alias("highest"))


def sparse(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """key, is_sparse: whether enough of the first pages have next to no text (a null text has none)."""
    short = (F.length(F.trim(F.coalesce(text, F.lit("")))) < SPARSE_CHARS).cast("int")
    share = F.avg(F.when(F.col(page) <= SPARSE_PAGES, short))
    return pages.groupBy(key).agg(F.coalesce(share >= SPARSE_SHARE, F.lit(True)).alias("is_sparse"))


def trim_tail(ranges: DataFrame, pages: DataFrame, keys: list[str], volume: str, page: str, start: str, end: str, droppable: str) -> DataFrame:
    """keys, start, end without the droppable pages at its tail; the first page always stays. Pages that have no row are kept."""
    gone = pages.filter(droppable).select(F.col(volume), F.col(page).alias("p")).distinct()
    span = ranges.select(*keys, volume, start, end).withColumn("p", F.explode(F.sequence(start, end)))
    kept = span.join(gone, [volume, "p"], "left_anti").groupBy(*keys).agg(F.max("p").alias("last"))
    return ranges.join(kept, keys, "left").select(*keys, start, F.greatest(F.col(start), F.coalesce("last", start)).alias(end))


def trim_back_matter(df: DataFrame, start: str, end: str, back: str) -> DataFrame:
    """Ranges that begin before the back matter and end in it end before it."""
    return df.withColumn(end, F.when((F.col(start) < F.col(back)) & (F.col(end) >= F.col(back)), F.col(back) - 1).otherwise(F.col(end)))


def page_offset(printed: DataFrame, found: DataFrame, volume: str, logical: str, physical: str) -> DataFrame:
    """volume, page_offset, hits: the offset of 1 to OFFSETS by which most printed pages are found, of equals the smallest; LEAST_HITS at least."""
    tried = printed.select(volume, logical).distinct().withColumn("by", F.explode(F.sequence(F.lit(1), F.lit(OFFSETS)))).withColumn(physical, F.col(logical) + F.col("by"))
    hits = tried.join(found.select(volume, physical).distinct(), [volume, physical], "left_semi").groupBy(volume, "by").agg(F.count("*").alias("n"))
    best = hits.groupBy(volume).agg(F.max(F.struct("n", (-F.col("by")).alias("neg"))).alias("b")).filter(F.col("b.n") >= LEAST_HITS)
    return best.select(volume, (-F.col("b.neg")).alias("page_offset"), F.col("b.n").alias("hits"))


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and both versions of the columns, for rows that differ or that one side lacks; nulls are equal to nulls."""
    side = lambda df, name: df.select(*keys, F.struct(*columns).alias(name))
    both = side(old, "old").join(side(new, "new"), keys, "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(*keys, *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("old", "new") for c in columns])


def coverage(blocks: DataFrame, visible: DataFrame, lesson: str, block: str, atoms: str, atom: str) -> DataFrame:
    """lesson, n_visible, n_assigned (visible atoms in a block), n_twice (atoms in two or more blocks), n_empty (blocks without atoms)."""
    held = blocks.select(lesson, block, F.explode(F.array_distinct(atoms)).alias(atom)).groupBy(lesson, atom).agg(F.count("*").alias("n"))
    seen = visible.select(lesson, atom).distinct().withColumn("seen", F.lit(True))
    per_atom = seen.join(held, [lesson, atom], "full_outer").groupBy(lesson).agg(F.count("seen").alias("n_visible"), F.count_if(F.col("seen") & F.col("n").isNotNull()).alias("n_assigned"), F.count_if(F.col("n") > 1).alias("n_twice"))
    empty = blocks.groupBy(lesson).agg(F.count_if(F.coalesce(F.size(atoms), F.lit(0)) <= 0).alias("n_empty"))
    return per_atom.join(empty, lesson, "full_outer").select(lesson, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_visible", "n_assigned", "n_twice", "n_empty")])


def is_tiny(kind: Column, width: Column, height: Column, text: Column) -> Column:
    """Specks: small images, and small boxes with next to no text."""
    area, n = width * height, F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))
    image = (area < 0.0002) | (width < 0.012) | (height < 0.012)
    words = ((area < 0.00008) & (n <= 2)) | ((width < 0.01) & (height < 0.01) & (n <= 1))
    return F.when(kind == "image", image).when(kind.isin("text", "title"), words).otherwise(F.lit(False))


def is_edge_fragment(text: Column, top: Column, bottom: Column) -> Column:
    """A few characters at the upper or lower edge of the page."""
    return F.length(F.coalesce(text, F.lit(""))).between(2, 28) & ((top < 0.16) | (bottom > 0.84))


def _sizes(inner: str, outer: str) -> tuple[Column, Column, Column]:
    a, b = lambda c: F.col(f"{inner}.{c}"), lambda c: F.col(f"{outer}.{c}")
    size = lambda of: (of("x1") - of("x0")) * (of("y1") - of("y0"))
    w, h = F.least(a("x1"), b("x1")) - F.greatest(a("x0"), b("x0")), F.least(a("y1"), b("y1")) - F.greatest(a("y0"), b("y0"))
    return size(a), size(b), F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def _paired(boxes: DataFrame, others: DataFrame, page: str) -> DataFrame:
    box = lambda name: F.struct("id", "x0", "y0", "x1", "y1").alias(name)
    return boxes.select(page, box("a")).join(others.select(page, box("b")), page)


def outside_regions(boxes: DataFrame, regions: DataFrame, page: str) -> DataFrame:
    """Boxes (page, id, x0, y0, x1, y1) that no excluded region of their page covers too far."""
    own, other, both = _sizes("a", "b")
    bad = _paired(boxes, regions, page).filter((both >= own * EXCLUDE_CONTAINED) & (own > 0) | (both >= (own + other - both) * EXCLUDE_IOU) & (both > 0))
    return boxes.join(bad.select(page, F.col("a.id").alias("id")).distinct(), [page, "id"], "left_anti")


def pieces_inside(pieces: DataFrame, outers: DataFrame, page: str) -> DataFrame:
    """page, outer_id, piece_ids: the pieces that an outer box was made of; outers with fewer than INSIDE_LEAST are out."""
    own, other, both = _sizes("a", "b")
    x, y = (F.col("a.x0") + F.col("a.x1")) / 2, (F.col("a.y0") + F.col("a.y1")) / 2
    centre = x.between(F.col("b.x0"), F.col("b.x1")) & y.between(F.col("b.y0"), F.col("b.y1"))
    fits = (own <= other * INSIDE_AREA) & ((both >= own * INSIDE_CONTAINED) | (own <= other * INSIDE_SMALL))
    hit = _paired(pieces, outers, page).filter(centre & fits).groupBy(page, F.col("b.id").alias("outer_id")).agg(F.array_sort(F.collect_set("a.id")).alias("piece_ids"))
    return hit.filter(F.size("piece_ids") >= INSIDE_LEAST)


def theme_change(old: Column, new: Column, alike: Column, shared: Column) -> Column:
    """What became of a picture's theme, from both themes without white space and marks, their likeness and their share of equal characters."""
    none = (F.coalesce(old, F.lit("")) == "") | (F.coalesce(new, F.lit("")) == "")
    return F.when(none, "无法命名").when((old == new) | (alike >= 0.72) | old.contains(new) | new.contains(old) | (shared >= 0.55), "主题一致").otherwise("主题改写")


def caption_change(old: Column, new: Column, alike: Column) -> Column:
    """What became of a picture's caption."""
    no_old, no_new = F.coalesce(old, F.lit("")) == "", F.coalesce(new, F.lit("")) == ""
    return F.when(no_old & no_new, "无图注").when(no_old, "旧无图注").when(no_new, "新无图注").when((old == new) | (alike >= 0.85), "图注一致").otherwise("图注改写")
