"""Lines scanned with carried state, in parts that are joined: long volumes are not held by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lesson_lines as L
from ..functions import text as T
from .contents import clean_line, close_up, is_unlisted, unit_title

#: Lines of a part; a volume has as many parts as it needs. Pieces of a line, at most, that have places of their own.
PART, WIDTH = 4096, 1 << 16
# Headings, ends and skipped lines of contents pages, names that begin a title, lines a title may go on for.
CONTENTS, INTRODUCTION = "目录", "绪论"
ENDS = ["课程标准中列出的", "供选择；文中图标", "针对每课题梳理", "建构主题大概念", "学业要求设计的习题"]
SKIPPED = ["编者", "版权", "定价", "出版社", "附录", "后记", "ISBN", "责任编辑", "义务教育", "教科书", "人民教育出版社", "课程教材研究所", "侵权必究", "网址", "邮编"]
OPENERS, JOINERS = r"^(?:课题|实验活动|跨学科|综合实践|整理与提升|复习与提高|\d+\s)", r"^[的与和并及、，,]"
PREFIX_ONLY = r"^(?:跨学科实践活动|实验活动)\s*\d+\s*$"
WATERMARKS = ["学而思", "科学专用", "传递追责", "仅供", "授权"]
NUMBERED_UNIT = r"第[一二三四五六七八九十百千\d]+"
AHEAD, LONGEST_NAME, LAST_PAGE = 3, 36, 500


def settled(df: DataFrame, **values: Column) -> DataFrame:
    """df with the values, made once: they go through a generator of one row, so what is built on them doesn't repeat how they were made."""
    out = df.select("*", F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("settled_"))
    return out.select("*", *[F.col(f"settled_.{k}").alias(k) for k in values]).drop("settled_")


def carried(df: DataFrame, group: str, pos: str, values: dict[str, Column], size: int = PART) -> DataFrame:
    """df with, for each name in values, the last value that isn't null at the row or before it in its group.

    The rows of a group are scanned in parts of `size` positions; what a part passes on is its last value, one row per part, and only
    those are scanned from end to end. So a group of any length is spread over tasks. pos (whole numbers) orders a group; of
    rows with the same pos any order may be taken.
    """
    names = list(values)
    rows = df.withColumns({**{f"v_{n}": c for n, c in values.items()}, "at_part": F.floor(F.col(pos) / size)})
    ends = rows.groupBy(group, "at_part").agg(*[F.max_by(f"v_{n}", F.when(F.col(f"v_{n}").isNotNull(), F.col(pos))).alias(f"e_{n}") for n in names])
    before = Window.partitionBy(group).orderBy("at_part").rowsBetween(Window.unboundedPreceding, -1)
    passed = ends.select(group, "at_part", *[F.last(f"e_{n}", ignorenulls=True).over(before).alias(f"p_{n}") for n in names])
    here = Window.partitionBy(group, "at_part").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("g_key", F.col(group)).join(passed.withColumnsRenamed({group: "q_key", "at_part": "q_part"}), F.col("g_key").eqNullSafe(F.col("q_key")) & (F.col("at_part") == F.col("q_part")))
    out = joined.withColumns({n: F.coalesce(F.last(f"v_{n}", ignorenulls=True).over(here), F.col(f"p_{n}")) for n in names})
    return out.select(*df.columns, *names)


#: Rows of a stretch in which rows are numbered, and stretches at most.
STRETCH, STRETCHES = 1 << 18, 4096


def numbered(df: DataFrame, group: str, order: list[str], name: str, size: int = STRETCH) -> DataFrame:
    """df with the row's number (from 1) in its group by the order, as row_number gives it; a group of any length is spread over tasks.

    Rows are dealt to stretches by quantiles of the first column of the order (a number, nulls first), numbered in each stretch of a group,
    and moved on by the rows of the group's earlier stretches. Rows alike in that column share a stretch.
    """
    first = F.col(order[0]).cast("double")
    rows = df.count()
    many = min(STRETCHES, -(-rows // size))
    bounds = df.agg(F.percentile_approx(first, [k / many for k in range(1, many)], 10 * STRETCHES)).first()[0] if many > 1 else None
    bounds = sorted(set(bounds or []))
    # how many bounds are not above the value, by bisection
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    stretch = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, k: F.when(F.get(F.lit(bounds), at + k - 1) <= first, at + k).otherwise(at)) if bounds else F.lit(0)
    dealt = df.withColumn("at_stretch", stretch)
    counts = dealt.groupBy(group, "at_stretch").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("at_stretch").rowsBetween(Window.unboundedPreceding, -1))
    moved = counts.select(F.col(group).alias("q_key"), F.col("at_stretch").alias("q_stretch"), F.coalesce(before, F.lit(0)).alias("moved"))
    here = F.row_number().over(Window.partitionBy(group, "at_stretch").orderBy(*order))
    out = dealt.withColumn("here", here).join(moved, F.col(group).eqNullSafe(F.col("q_key")) & (F.col("at_stretch") == F.col("q_stretch")))
    return out.select(*df.columns, (F.col("here") + F.col("moved")).cast("long").alias(name))


# Catalogues -------------------------------------------------------------------------------------------


def page_suffix(c: Column) -> Column:
    """The number from 1 to LAST_PAGE behind blanks at a line's end; null without one."""
    n = F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"\s(\d{1,3})$", 1).try_cast("int")
    return F.when(n.between(1, LAST_PAGE), n)


def columns_of(c: Column) -> Column:
    """The lessons of a line that runs through two columns: number and name each, names of 2 to LONGEST_NAME characters, no watermarks. A line with one lesson, or with a unit, is one piece."""
    s = close_up(F.trim(F.coalesce(c, F.lit(""))))
    found = F.regexp_extract_all(s, F.lit(rf"\d{{1,2}}\s*[{T.HAN}][^\d]{{1,36}}"), F.lit(0))
    name = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\d{1,2}\s*", ""), r"[·●…._—\-]+", " "), r"\s+", " "))
    pieces = F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^(\d{1,2})", 1).alias("no"), name(x).alias("name")))
    good = F.filter(pieces, lambda x: F.length(x["name"]).between(2, LONGEST_NAME) & ~T.has_any(x["name"], WATERMARKS))
    told = F.transform(good, lambda x: F.concat(x["no"], F.lit(" "), x["name"]))
    one = (F.size(found) < 2) | s.contains("单元") | (F.size(told) == 0)
    return F.when(s == "", F.array().cast("array<string>")).when(one, F.array(s)).otherwise(told)


def catalogue_rows(lines: DataFrame, volume: str, size: int = PART) -> DataFrame:
    """volume, pos, part, piece, unit, lesson, page: the lessons of a catalogue's lines (volume, pos, line), by a scan that carries the unit and the units of two columns.

    A line is cut where several units begin in it; a piece that is a unit's title is carried on to what follows, in the line
    and after it. A unit's summary is a row if there is a unit. A line with several lessons gives them to the two units
    that last stood in one line, from left to right, and no page; without such a line, to the unit carried. Lessons before any
    unit are left out; null and unlisted lines give nothing. pos is a whole number, unique in a volume.
    """
    p = settled(lines.select(volume, "pos", "line"), raw=close_up(F.trim(F.coalesce("line", F.lit("")))))
    p = settled(p, page=page_suffix(F.col("raw")))
    p = settled(p, s=clean_line(F.when(F.col("page").isNotNull(), F.regexp_replace("raw", r"\s+\d{1,3}\s*$", "")).otherwise(F.col("raw"))))
    p = settled(p, out=is_unlisted(F.col("s"))).filter("s <> '' AND NOT out")
    units = F.size(F.regexp_extract_all("s", F.lit(rf"(?:{NUMBERED_UNIT}|\d{{1,2}})\s*单元"), F.lit(0)))
    cut = F.split("s", rf"(?={NUMBERED_UNIT}\s*单元)|(?<![\d第])(?=\d{{1,2}}\s*单元)")
    q = p.select(volume, "pos", "page", F.posexplode(F.when(units >= 2, cut).otherwise(F.array("s"))).alias("part", "x0"))
    q = settled(q, x=clean_line(F.col("x0")))
    q = settled(q, out=is_unlisted(F.col("x")), own=unit_title(F.col("x"))).filter("x <> '' AND NOT out")
    # what a line passes on to the next: its last unit, and its first two if it has two
    told = F.transform(F.filter(F.sort_array(F.collect_list(F.struct("part", "own"))), lambda x: x["own"].isNotNull()), lambda x: x["own"])
    ends = q.groupBy(volume, "pos").agg(told.alias("titles")).filter(F.size("titles") > 0)
    ends = ends.select(volume, (F.col("pos") + 1).alias("pos"), F.element_at("titles", -1).alias("u"), F.when(F.size("titles") >= 2, F.slice("titles", 1, 2)).alias("t"))
    rows = q.withColumn("u", F.lit(None).cast("string")).withColumn("t", F.lit(None).cast("array<string>")).unionByName(ends, allowMissingColumns=True)
    # a line's marks and its parts share its position: the marks come first
    rows = rows.withColumn("key", F.col("pos") * WIDTH + F.coalesce(F.col("part") + 1, F.lit(0)))
    rows = carried(rows, volume, "key", {"unit_before": F.coalesce("own", "u"), "column_units": F.col("t")}, size * WIDTH)
    q = rows.filter("x IS NOT NULL AND own IS NULL").drop("u", "t", "key", "own", "out", "x0")
    pieces = F.when(F.col("x").contains("单元小结"), F.array(F.lit("单元小结"))).otherwise(columns_of(F.col("x")))
    q = q.select("*", F.posexplode(pieces).alias("piece", "y"))
    q = settled(q, lesson=F.when(F.col("y") == "单元小结", F.col("y")).otherwise(clean_line(F.col("y"))))
    q = q.withColumn("of_line", F.count("*").over(Window.partitionBy(volume, "pos", "part")))
    q = settled(q, listed=(F.col("lesson") == "单元小结") | (F.length("lesson").between(2, 120) & ~is_unlisted(F.col("lesson")) & ~F.col("lesson").rlike(r"^\d{1,2}\s*单元") & L.is_lesson_line(F.col("lesson"))))
    many = (F.col("of_line") >= 2) & (F.size("column_units") >= 2)
    unit = F.when(many, F.get("column_units", F.least(F.col("piece"), F.lit(1)))).otherwise(F.col("unit_before"))
    return q.filter("listed").withColumn("unit", unit).filter("unit IS NOT NULL").select(volume, "pos", "part", "piece", "unit", "lesson", F.when(F.col("of_line") == 1, F.col("page")).alias("page"))


def _compact(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\x{00a0}\x{3000}]+", " "))


def contents_header(c: Column) -> Column:
    """The unit that a line opens, 绪论 by itself or with its lesson behind it; null for other lines."""
    unit = F.regexp_extract(c, r"^(第[一二三四五六七八九十\d]+单元)\s*(.*)$", 1)
    return F.when(c.rlike(rf"^{INTRODUCTION}(?:\s+.*)?$"), INTRODUCTION).when(unit != "", F.trim(F.concat_ws(" ", unit, F.nullif(F.trim(F.regexp_extract(c, r"^(第[一二三四五六七八九十\d]+单元)\s*(.*)$", 2)), F.lit("")))))


def experiment_contents(lines: DataFrame, volume: str, size: int = PART) -> DataFrame:
    """volume, pos, unit, lesson: the lessons of contents pages with experiments and topics (lines: volume, pos, line), long titles put together.

    The scan is on from a contents heading or a unit's header to a line that ends the contents; such a line also ends
    the unit. A lesson's title goes on over the next lines, AHEAD of them at most, that are no entry of their own; empty lines
    among them are passed over. An activity whose number stands alone takes the line right behind it as its name and
    stands there. The introduction's own line may name its first lesson. pos counts up by one in a volume; null lines are empty.
    """
    s = settled(lines.select(volume, "pos", "line"), s=_compact(F.col("line"))).drop("line")
    s = settled(s, n=L.normal_line(F.col("s")), heading=F.regexp_replace("s", r"[\s\x{00a0}\x{3000}·…．.]+", "") == CONTENTS, skip=(F.col("s") == "") | F.col("s").rlike(r"^\d{1,3}$") | T.has_any(F.col("s"), SKIPPED))
    s = settled(s, ends=T.has_any(F.col("s"), ENDS) & ~F.col("heading"), is_lesson=L.is_lesson_line(F.col("n")), its_header=contents_header(F.col("s")))
    s = s.withColumn("header", F.when(~F.col("heading") & ~F.col("ends") & ~F.col("skip"), F.col("its_header")))
    plain = ~F.col("heading") & ~F.col("ends") & ~F.col("skip") & F.col("header").isNull()
    s = settled(s, plain=plain).drop("its_header")
    s = settled(s, lesson_line=F.col("plain") & F.col("is_lesson"), alone=F.col("plain") & F.col("n").rlike(PREFIX_ONLY)).drop("is_lesson")
    s = settled(s, goes_on=F.col("plain") & ~F.col("lesson_line") & F.length("n").between(1, 80) & (F.col("n").rlike(JOINERS) | ~F.col("n").rlike(OPENERS)))
    # on and off, and the unit: an end puts an empty string in the unit's place
    on = F.when(F.col("heading") | F.col("header").isNotNull(), True).when(F.col("ends"), False)
    s = carried(s, volume, "pos", {"active": on, "unit": F.when(F.col("ends"), "").otherwise(F.col("header"))}, size).filter("active AND unit <> ''")
    # the lines around a line: a part holds the first lines of the next one too, and the last of the one before
    own = F.floor(F.col("pos") / size)
    dealt = s.withColumn("block", F.explode(F.sequence(F.floor((F.col("pos") - AHEAD - 1) / size), F.floor((F.col("pos") + 1) / size))))
    w = Window.partitionBy(volume, "block").orderBy("pos")
    near = F.struct("pos", "s", "n", "goes_on", "plain", "alone")
    around = dealt.withColumns({f"r{k}": (F.lead(near, k) if k > 0 else F.lag(near, -k)).over(w) for k in (-1, *range(1, AHEAD + 2))}).filter(F.col("block") == own)
    there = lambda k: F.when(F.col(f"r{k}.pos") == F.col("pos") + k, F.col(f"r{k}"))

    def title(start: Column, first: int) -> Column:
        out, still = start, F.lit(True)
        for k in range(first, first + AHEAD):
            takes = F.coalesce(there(k)["goes_on"], F.lit(False))
            out = F.when(still & takes, F.concat(out, there(k)["n"])).otherwise(out)
            still = still & (takes | F.coalesce(there(k)["s"] == "", F.lit(False)))
        return L.normal_line(out)

    around = settled(around, with_next=L.normal_line(F.concat_ws(" ", "n", there(1)["s"])), with_last=L.normal_line(F.concat_ws(" ", there(-1)["n"], "s")))
    around = settled(around, takes_next=F.col("alone") & F.coalesce(there(1)["plain"], F.lit(False)) & L.is_lesson_line(F.col("with_next")), taken=F.coalesce(there(-1)["alone"], F.lit(False)) & F.col("plain") & L.is_lesson_line(F.col("with_last")))
    around = around.withColumn("takes_next", F.col("takes_next") & ~F.col("taken"))
    first_lesson = F.trim(F.regexp_extract("s", rf"^{INTRODUCTION}\s+(.*)$", 1))
    inline = F.when((F.col("header") == INTRODUCTION) & (first_lesson != ""), L.normal_line(F.when(first_lesson.rlike(r"^(?:课题\s*)?\d+\s+"), first_lesson).otherwise(F.concat(F.lit("1 "), first_lesson))))
    special = (F.col("unit") == INTRODUCTION) & L.special_title(F.col("n")).isNotNull()
    around = settled(around, inline=inline, ordinary=F.when(F.col("lesson_line") & ~F.col("alone") & ~F.col("taken") & ~special, title(F.col("n"), 1)), joined=F.when(F.col("takes_next"), title(F.col("with_next"), 2)))
    out = around.withColumn("lesson", F.coalesce("inline", "joined", "ordinary")).withColumn("pos", F.when(F.col("takes_next"), F.col("pos") + 1).otherwise(F.col("pos")))
    return out.filter("lesson IS NOT NULL").select(volume, "pos", "unit", "lesson")
