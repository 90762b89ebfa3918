"""Boxes of a page met through a grid, and boxes gathered into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compare as C
from ..functions import similarity as S
from ..functions.text import HAN
from .matching import by_group

#: Cells of a page along either side.
CELLS = 16
#: Boxes of a page that meet each other directly.
FEW = 64
# Overlap from which two pictures are one, sizes that count as equal, centres of a row, gaps between its boxes.
SAME, MUTUAL, INSIDE, PARTLY, NESTED, LOOSE, BIGGER, TIMES = 0.52, 0.82, 0.65, 0.35, 0.68, 0.10, 1.03, 3.0
ACROSS, BELOW, LIFT, OVERHANG, SUNK, INDENT, HIGHER = 0.35, 0.09, 0.008, 0.012, 0.28, 0.20, 0.002
SLACK, HALF, GAP, LEAST_GAP, WIDE, STEP, SHOWN = 0.018, 0.55, 0.14, 0.10, 0.12, 1.15, 500


def _cells(low: Column, high: Column) -> Column:
    cell = lambda v: F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor(v * CELLS).cast("int")))
    return F.sequence(cell(low), F.greatest(cell(low), cell(high)))


def overlapping(boxes: DataFrame, page: str) -> DataFrame:
    """page, a_id, b_id, a, b (structs of corners), a_id < b_id: the pairs of boxes (page, id, x0, y0, x1, y1) that have a point in common, each once.

    Boxes of a page of FEW or less meet each other directly, as an array that their page's count bounds. On other pages a
    box is dealt to the cells of a grid that it touches; a pair is told in one cell alone, that of the first corner of
    what they share. So boxes far apart never meet, a page's pairs are as many as overlap, not all, and no box of a small page is copied to cells.
    Coordinates beyond 0 to 1 belong to the outer cells; a null coordinate meets nothing.
    """
    b = boxes.filter(F.col(page).isNotNull() & F.col("id").isNotNull()).select(page, "id", F.struct("x0", "y0", "x1", "y1").alias("b"))
    b = b.filter(F.col("b.x1") >= F.col("b.x0")).filter(F.col("b.y1") >= F.col("b.y0"))
    counted = b.withColumn("many", F.count("*").over(Window.partitionBy(page)))
    first = lambda k: F.greatest(F.col(f"a.{k}"), F.col(f"b.{k}"))
    last = lambda k: F.least(F.col(f"a.{k}"), F.col(f"b.{k}"))
    share = (first("x0") <= last("x1")) & (first("y0") <= last("y1"))
    told = [page, "a_id", "b_id", "a", "b"]

    few = counted.filter(F.col("many").between(2, FEW)).groupBy(page).agg(F.collect_list(F.struct("id", "b")).alias("all"))
    one = few.select(page, "all", F.explode("all").alias("one")).select(page, "all", F.col("one.id").alias("a_id"), F.col("one.b").alias("a"))
    near = one.select(page, "a_id", "a", F.explode("all").alias("other")).select(page, "a_id", F.col("other.id").alias("b_id"), "a", F.col("other.b").alias("b")).filter("a_id < b_id").filter(share)

    dealt = counted.filter(F.col("many") > FEW).drop("many").withColumn("cx", F.explode(_cells(F.col("b.x0"), F.col("b.x1")))).withColumn("cy", F.explode(_cells(F.col("b.y0"), F.col("b.y1"))))
    left = dealt.select(page, "cx", "cy", F.col("id").alias("a_id"), F.col("b").alias("a"))
    met = left.join(dealt.withColumnRenamed("id", "b_id"), [page, "cx", "cy"]).filter("a_id < b_id")
    here = (F.get(_cells(first("x0"), first("x0")), F.lit(0)) == F.col("cx")) & (F.get(_cells(first("y0"), first("y0")), F.lit(0)) == F.col("cy"))
    return near.select(*told).unionByName(met.filter(share & here).select(*told))


def same_picture(a: Column, b: Column) -> Column:
    """Two frames of one picture: much the same, each within the other, or one closely around the other."""
    iou, ab, ba = S.iou(a, b), S.containment(a, b), S.containment(b, a)
    larger = S.area(a) >= S.area(b)
    inner = F.when(larger, ba).otherwise(ab)
    ratio = F.greatest(S.area(a), S.area(b)) / F.greatest(F.least(S.area(a), S.area(b)), F.lit(1e-9))
    nested = (ratio > BIGGER) & (inner >= NESTED) & (ratio <= TIMES) & (iou >= LOOSE)
    return (iou >= SAME) | ((ab >= MUTUAL) & (ba >= MUTUAL)) | ((inner >= INSIDE) & (iou >= PARTLY)) | nested


def drops_first(a: Column, b: Column) -> Column:
    """Of two frames of one picture, whether the first goes: the outer one, else the later number."""
    outer = lambda x, y, by, least: (S.area(x) > S.area(y) * by) & (S.containment(y, x) >= least)
    return (
        F.when(outer(a, b, BIGGER, INSIDE), True).when(outer(b, a, BIGGER, INSIDE), False).when(outer(a, b, 1.02, 0.75), True).when(outer(b, a, 1.02, 0.75), False).otherwise(False)
    )


def distinct_pictures(boxes: DataFrame, page: str) -> DataFrame:
    """The boxes that stay when of any two frames of one picture, taken by their ids, one goes; a frame that has gone drops no later ones, but those that it met first."""
    pairs = overlapping(boxes, page).filter(same_picture(F.col("a"), F.col("b"))).select(page, "a_id", "b_id", drops_first(F.col("a"), F.col("b")).alias("first"))

    def choose(rows: list[tuple]) -> list[tuple]:
        gone: set = set()
        out, last = [], None
        for row in rows:
            _, a, b, first = row
            if a != last:
                last, skip = a, a in gone
            if skip or b in gone:
                continue
            gone.add(a if first else b)
            out.append(row)
        return out

    taken = by_group(pairs, page, ["a_id", "b_id"], choose)
    gone = taken.select(page, F.when(F.col("first"), F.col("a_id")).otherwise(F.col("b_id")).alias("id")).distinct()
    return boxes.join(gone, [page, "id"], "left_anti")


def rows_of(boxes: DataFrame, page: str, gap: float | None = None) -> DataFrame:
    """page, row, part, ids, x0, y0, x1, y1, text, kind: boxes (page, id, x0, y0, x1, y1, text, kind) in one line of sight made one.

    By centre from above, a box joins the first row whose first box has its centre within SLACK, or HALF the smaller height;
    else it begins a row. A row, from the left, is cut at gaps wider than `gap`, or than the row's own limit: a little more
    than its widest gap, or than the second widest where one stands out. Texts are put together from the left, up to SHOWN
    characters; a part with a title in it is a title. Null texts are empty; a null coordinate keeps a box out.
    """
    corners = ["x0", "y0", "x1", "y1"]
    b = boxes.filter(" AND ".join(f"{c} IS NOT NULL" for c in corners))
    item = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("y"), *[F.col(c) for c in ("x0", "id", "y0", "x1", "y1")], F.trim(F.coalesce("text", F.lit(""))).alias("text"), F.col("kind"))
    gathered = b.groupBy(page).agg(F.sort_array(F.collect_list(item)).alias("all"))  # a page's boxes
    height = lambda x: x["y1"] - x["y0"]
    head = "array<struct<y:double,h:double>>"

    def place(acc: Column, x: Column) -> Column:
        near = F.transform(acc["heads"], lambda h: F.abs(h["y"] - x["y"]) <= F.greatest(F.lit(SLACK), HALF * F.least(h["h"], height(x))))
        at = F.coalesce(F.array_position(near, True), F.lit(0)).cast("int")
        mine = F.struct(x["y"].alias("y"), height(x).alias("h"))
        heads = F.when(at > 0, acc["heads"]).otherwise(F.array_append(acc["heads"], mine))
        return F.struct(heads.alias("heads"), F.array_append(acc["rows"], F.when(at > 0, at).otherwise(F.size(heads))).alias("rows"))

    start = F.struct(F.array().cast(head).alias("heads"), F.array().cast("array<int>").alias("rows"))
    put = gathered.withColumn("rows", F.aggregate("all", start, place, lambda acc: acc["rows"]))
    flat = put.select(page, F.explode(F.arrays_zip(F.col("all").alias("x"), F.col("rows").alias("row"))).alias("z")).select(page, F.col("z.row").alias("row"), "z.x.*")
    w = Window.partitionBy(page, "row").orderBy("x0", "y", "id")
    steps = flat.withColumn("step", F.col("x0") - F.lag("x1").over(w))
    if gap is None:
        gaps = F.reverse(F.array_sort(F.collect_list(F.when(F.col("step") > 0, F.col("step"))).over(Window.partitionBy(page, "row"))))
        first, second = F.get(gaps, F.lit(0)), F.get(gaps, F.lit(1))
        limit = F.when(first.isNull(), GAP).when(first > second * 2.2, F.greatest(F.lit(LEAST_GAP), F.least(F.lit(GAP), second * STEP))).otherwise(F.greatest(F.lit(WIDE), F.least(F.lit(GAP), first * STEP)))
        steps = steps.withColumn("limit", limit)
    else:
        steps = steps.withColumn("limit", F.lit(gap))
    parted = steps.withColumn("part", F.sum(F.coalesce(F.col("step") > F.col("limit"), F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    told = F.sort_array(F.collect_list(F.struct("x0", "y", "id", "text")))
    out = parted.groupBy(page, "row", "part").agg(told.alias("told"), *[F.round(f(c), 4).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))], F.when(F.bool_or(F.col("kind") == "title"), "title").otherwise("text").alias("kind"))
    return out.select(page, "row", "part", F.transform("told", lambda x: x["id"]).alias("ids"), *corners, F.substring(F.array_join(F.transform("told", lambda x: x["text"]), ""), 1, SHOWN).alias("text"), "kind")


# Pinyin -----------------------------------------------------------------------------------------------


def is_pinyin(c: Column) -> Column:
    """A line of Latin letters with and without tones, no Han: three quarters of its characters at least."""
    t = F.trim(F.coalesce(c, F.lit("")))
    kept = F.length(F.regexp_replace(t, rf"[^{C.PINYIN}\s]+", ""))
    return (t != "") & ~t.rlike(f"[{HAN}]") & t.rlike("[a-zA-Z]") & (kept >= 0.75 * F.length(t))


def pinyin_pairs(boxes: DataFrame, page: str) -> DataFrame:
    """page, upper, lower, gap, share: boxes of pinyin (page, id, x0, y0, x1, y1, text) with the box of Han characters under each, one to one: the nearest first, of equals that with the larger share of width.

    A box is under another if it begins within BELOW of its lower edge (or a little above it), or lower than SUNK of its height where the frame of the pinyin
    is too high; they share ACROSS of the narrower width at least. Pairs are met through the grid, the pinyin's box being
    lengthened by its reach, so only neighbours meet.
    """
    reach = BELOW + OVERHANG
    latin = is_pinyin(F.col("text"))
    han = F.coalesce("text", F.lit("")).rlike(f"[{HAN}]")
    corners = ["x0", "y0", "x1", "y1"]
    own = lambda df, bit, y1: df.select(page, (F.col("id") * 2 + bit).alias("id"), "x0", "y0", "x1", y1.alias("y1"))
    met = overlapping(own(boxes.filter(latin), 0, F.col("y1") + reach).unionByName(own(boxes.filter(han), 1, F.col("y1"))), page).filter((F.col("a_id") % 2) != (F.col("b_id") % 2))
    first = F.col("a_id") % 2 == 0
    pick = lambda when, a, b: F.when(when, F.col(a)).otherwise(F.col(b))
    p = met.select(page, F.floor(pick(first, "a_id", "b_id") / 2).alias("upper"), F.floor(pick(first, "b_id", "a_id") / 2).alias("lower"), pick(first, "a", "b").alias("u"), pick(first, "b", "a").alias("l"))
    u = {c: F.col(f"u.{c}") for c in corners} | {"y1": F.col("u.y1") - reach}
    low = {c: F.col(f"l.{c}") for c in corners}
    share = F.greatest(F.lit(0.0), F.least(u["x1"], low["x1"]) - F.greatest(u["x0"], low["x0"])) / F.greatest(F.least(u["x1"] - u["x0"], low["x1"] - low["x0"]), F.lit(1e-9))
    centre = lambda x: (x["y0"] + x["y1"]) / 2
    gap = F.round(low["y0"] - u["y1"], 9)
    tolerance = F.greatest(F.lit(SLACK), HALF * F.least(u["y1"] - u["y0"], low["y1"] - low["y0"]))
    one_row = (F.abs(centre(u) - centre(low)) <= tolerance) & (centre(low) <= centre(u) + HIGHER)
    under = (centre(low) > centre(u)) & gap.between(-LIFT, BELOW)
    framed = (low["y0"] >= u["y0"] + (u["y1"] - u["y0"]) * SUNK) & (low["y0"] <= u["y1"] + reach) | ((low["y0"] >= u["y0"]) & (low["y1"] <= u["y1"] + reach))
    fit = p.filter((low["x0"] <= u["x0"] + INDENT) & (share >= ACROSS) & ~one_row & (under | framed)).select(page, "upper", "lower", gap.alias("gap"), F.round(share, 9).alias("share"))

    def choose(rows: list[tuple]) -> list[tuple]:
        uppers, lowers, out = set(), set(), []
        for row in rows:
            if row[1] not in uppers and row[2] not in lowers:
                uppers.add(row[1])
                lowers.add(row[2])
                out.append(row)
        return out

    return by_group(fit, page, ["gap", F.desc("share"), "upper", "lower"], choose)
