"""Cases of contents with values worked out by hand."""

from pyspark.sql import functions as F

from palimpsest.functions import lesson_lines as L
from palimpsest.operators import contents as C
from palimpsest.registry import golden
from . import query

CATALOG = [
    ("v", 1, "第二单元 空气", "10 风", 7, 6), ("v", 2, "第一单元 水", "2 雨", 3, 4), ("v", 3, "附录", "元素表", 9, 9), ("v", 4, "第一单元 水", "1 云", 4, 3), ("v", 5, "绪论", "走进科学", 1, 1), ("v", 6, "第二单元 空气", "9 雾", 8, 5),
    ("v", 7, "第一单元 水", "单元小结", 5, 7), ("v", 8, "绪论", "雨", 2, 2),
]


@query(golden("pos, place", [(5, 1), (8, 2), (2, 3), (4, 4), (7, 5), (1, 6), (6, 7), (3, 8)]))
def catalogue_by_unit(spark, sf_dir):
    """Introduction, units by number, then units without one; within them as the rows stand."""
    c = spark.createDataFrame([x[:4] for x in CATALOG], "volume string, pos int, unit string, lesson string")
    return C.by_unit(c, "volume").select("pos", "place")


@query(golden("pos, place", [(5, 1), (8, 2), (2, 4), (4, 3), (7, 5), (1, 7), (6, 6), (3, 8)]))
def catalogue_by_unit_and_lesson(spark, sf_dir):
    """Within units lessons by number, then the summary, then others by name."""
    c = spark.createDataFrame([x[:4] for x in CATALOG], "volume string, pos int, unit string, lesson string")
    return C.by_unit(c, "volume", True).select("pos", "place")


STRAY = [
    ("v", 1, "绪论", "走进科学"), ("v", 2, "第一单元 水", "走进科学"), ("v", 3, "第一单元 水", "云"), ("v", 4, "绪论", ""), ("w", 1, "绪论", "走进科学"), ("w", 2, "第一单元 水", "走进科学"), ("x", 1, "绪论", "走进科学"), ("x", 2, "附录", "走进科学"), ("y", 1, "绪论", "光"), ("y", 2, "第二单元", "光"), ("y", 3, "第一单元", "云"),
]


@query(golden("volume, pos", [("v", 1), ("v", 3), ("w", 2), ("x", 1), ("x", 2), ("y", 2), ("y", 3)]))
def catalogue_stray_intro(spark, sf_dir):
    """v: unit 1 has other lessons, so its copy goes (and the nameless row); w: it has none, so the introduction's goes; x: no numbered unit; y: the copy is in unit 2."""
    return C.without_stray_intro(spark.createDataFrame(STRAY, "volume string, pos int, unit string, lesson string"), "volume").select("volume", "pos")


ENTRIES = [("v", "第一单元 水", 3), ("v", "第1单元", 2), ("v", "绪论 走进", 1), ("v", "课题1 第三单元里的水", 9), ("v", "第十二单元 光", 80), ("w", "第一单元", 5)]


UNITS = [("v", "第一单元", 2), ("v", "绪论", 1), ("v", "第三单元 x", None), ("v", "第十二单元 声", 80), ("w", "第一单元 水", 5), ("z", "第一单元", None)]


@query(golden("volume, unit, first_page", UNITS))
def contents_unit_pages(spark, sf_dir):
    u = spark.createDataFrame([x[:2] for x in UNITS], "volume string, unit string")
    return C.unit_first_pages(spark.createDataFrame(ENTRIES, "volume string, title string, page int"), u, "volume").select("volume", "unit", "first_page")


HIT_PAGES = [("v", 1, "光的传播与声音的产生", 2), ("v", 2, "光 的 传 播", 1), ("v", 3, None, 0), ("w", 1, "光的传播", 0)]


@query(golden("volume, page, hits", [(v, p, h) for v, p, _, h in HIT_PAGES]))
def contents_lesson_hits(spark, sf_dir):
    """Keys below three characters don't count, a lesson counts once, blanks don't matter."""
    t = spark.createDataFrame([("v", "a", ["光的传播", "的传播"]), ("v", "b", ["声音的产生"]), ("v", "c", ["光"])], "volume string, lesson string, keys array<string>")
    return C.lesson_hits(spark.createDataFrame([x[:3] for x in HIT_PAGES], "volume string, page int, text string"), t, "volume").select("volume", "page", "hits")


CODES = [("XK-3S-NEW", "XK", 3, "上", "new", 1), ("xk-12x-old-v3", "XK", 12, "下", "old", 3), ("XK-3S-NEW-v0", None, None, None, None, None), ("XK3S", None, None, None, None, None), (None, None, None, None, None, None), (" R2-1X-OLD ", "R2", 1, "下", "old", 1)]


@query(golden("code, prefix, grade, term, book, version", CODES))
def contents_volume_codes(spark, sf_dir):
    return spark.createDataFrame([(x[0],) for x in CODES], "code string").withColumn("p", C.volume_code(F.col("code"))).select("code", "p.prefix", "p.grade", "p.term", "p.book", "p.version")


TOKENS = [("1", "古诗三首（题西林壁；雪梅、卢沟）", False, "卢沟,古诗三首,雪梅,题西林壁"), ("语文园地", "", True, "语文园地"), ("", "习作：我的心儿", True, "习作：我的心儿"), (None, None, False, ""), ("2", "水", False, "")]


@query(golden("no, name, recurring, tokens", TOKENS))
def contents_title_tokens(spark, sf_dir):
    t = spark.createDataFrame([x[:2] for x in TOKENS], "no string, name string")
    return t.select("no", "name", C.is_recurring(F.col("no"), F.col("name")).alias("recurring"), F.array_join(C.title_tokens(F.col("no"), F.col("name")), ",").alias("tokens"))


LINES = ["目录", "第一单元 水……1", "1 水的变化……2", "2 云和雨 5", "单元小结 9", "第二单元 空气", "3 混合与分离   12", "没有页码的行", "课题1 氧气·····20", "第九课  900", None]


@query(golden("pos, unit, title, page, match_key", [(3, "第一单元水", "1水的变化", 2, "水的变化"), (4, "第一单元水", "2云和雨", 5, "云和雨"), (5, "第一单元水", "单元小结", 9, "单元小结"), (7, "第二单元空气", "3混合与分离", 12, "混合与分离"), (9, "第二单元空气", "课题1氧气", 20, "氧气")]))
def contents_entries(spark, sf_dir):
    """Lines with leaders, a number and a page, a summary, a gap; headings are carried on; the rest is none."""
    l = spark.createDataFrame([("v", i + 1, x) for i, x in enumerate(LINES)], "volume string, pos int, line string")
    return C.contents_entries(l, "volume").drop("volume")


CATALOGUE_LINES = ["目 录", "第一单元 光与色彩 1", "1光的传播 2 13弹 力 40", "2 光的反射……9", "绪论", "3 走进科学 1", "单元小结 12", "附录 99", "第二单元 声第三单元 力", "4 力的作用"]


@query(golden("pos, n, unit, lesson", [(3, 0, "第一单元光与色彩", "1 光的传播"), (3, 1, "第一单元光与色彩", "13 弹力"), (4, 0, "第一单元光与色彩", "2 光的反射"), (6, 0, "绪论", "3 走进科学"), (10, 0, "第三单元力", "4 力的作用")]))
def contents_catalogue_lines(spark, sf_dir):
    """Two columns on a line, blanks between Han characters, an introduction, two units on a line."""
    l = spark.createDataFrame([("v", i + 1, x) for i, x in enumerate(CATALOGUE_LINES)], "volume string, pos int, line string")
    return C.catalogue_lines(l, "volume").select("pos", "n", "unit", "lesson")


SPAN_PAGES = [("v", 1, "封面"), ("v", 2, "目 录\n1 水"), ("v", 3, "2 云\n3 雨"), ("v", 4, "第二单元\n4 风\n5 霜\n6 雪"), ("v", 5, "正文"), ("v", 6, "目录里说过"), ("w", 1, "正文"), ("x", 30, "目录")]


@query(golden("volume, first, last", [("v", 2, 4)]))
def contents_spans(spark, sf_dir):
    return C.contents_span(spark.createDataFrame(SPAN_PAGES, "volume string, page int, text string"), "volume")


LESSON_LINES = [
    ("课题1  水 ……12", "课题1 水", True, False, False, "1/N|1"), ("整 理 与 提 升 30", "整理与提升", True, False, False, "1/S|整理与提升"), ("实验活动2 制氧", "实验活动2 制氧", True, False, False, "1/E|2"), ("12.1 分式", "12.1 分式", True, False, False, "1/M|12|1"),
    ("下列说法正确的是（ ）", "下列说法正确的是（ ）", False, True, False, "1/R|下列说法正确的是（ ）"), ("语文园地", "语文园地", True, False, False, "1/Y|语文园地|"), ("例文 爬天都峰", "例文 爬天都峰", False, False, True, "1/R|例文 爬天都峰"), ("3* 现代诗二首", "3* 现代诗二首", True, False, False, "1/N|3"),
    ("读一读 圆", "读一读 圆", True, False, False, "1/MB|读一读|圆"), (None, "", False, False, False, ""), ("这是什么？", "这是什么？", False, True, False, "1/R|这是什么？"), ("写字表", "写字表", True, False, False, "1/R|写字表"),
]


@query(golden("line, normal, lesson, exercise, subtitle, key", LESSON_LINES))
def text_lesson_lines(spark, sf_dir):
    """Normal form, kind and semantic key of lines in a first unit."""
    t = spark.createDataFrame([(x[0],) for x in LESSON_LINES], "line string")
    c = F.col("line")
    return t.select("line", L.normal_line(c).alias("normal"), L.is_lesson_line(c).alias("lesson"), L.is_exercise(c).alias("exercise"), L.is_subtitle(c).alias("subtitle"), L.semantic_key(F.lit("第一单元 x"), c).alias("key"))


GLUED = [("1 观潮2 走月亮3 现代诗二首口语交际：我们与环境", "1 观潮|2 走月亮|3 现代诗二首|口语交际：我们与环境"), ("实验活动1 氧气的实验室制取与性质研究", "实验活动1 氧气的实验室制取与性质研究"), ("1 观潮", "1 观潮"), ("16.5 勾股定理在生活中的应用举隅文", "16.5 勾股定理在生活中的应用举隅文"), ("", "")]


@query(golden("line, parts", GLUED))
def text_glued_lines(spark, sf_dir):
    return spark.createDataFrame([(x[0],) for x in GLUED], "line string").select("line", F.array_join(L.split_glued(F.col("line")), "|").alias("parts"))


PLACES = [("单元小结", 3, 9999), ("复习题", 2, 80), ("实验活动3", 2, 33), ("课题2 水", 0, 2), ("12.3 圆", 0, 1203), ("7 光", 0, 7), ("附录", 2, 0), ("微项目1", 2, 61), ("数学活动", 2, 65)]


@query(golden("line, kind, n", PLACES))
def text_lesson_places(spark, sf_dir):
    return spark.createDataFrame([(x[0],) for x in PLACES], "line string").withColumn("p", L.place_in_unit(F.col("line"))).select("line", "p.kind", "p.n")


@query(golden("volume, place, unit, lesson", [("v", 1, "第一单元 水的世界", "课题1 水"), ("v", 2, "第一单元", "复习与提高"), ("v", 3, "第二单元", "课题1 火"), ("v", 4, "第一单元", "实验活动1")]))
def catalogue_merged(spark, sf_dir):
    """The fuller unit name, the entry before the bare number, the second catalogue's row at the end, an empty row dropped."""
    a = [("v", 1, "第一单元", "1 水"), ("v", 2, "第一单元", "复习与提高 9"), ("v", 3, "第二单元", "课题1 火"), ("v", 4, "第一单元", "")]
    b = [("v", 1, "第一单元 水的世界", "课题1 水"), ("v", 2, "第一单元", "实验活动1"), ("v", 3, "第一单元", "复习与提高")]
    schema = "volume string, pos int, unit string, lesson string"
    out = C.merged(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "volume")
    return out.select("volume", "place", "unit", F.regexp_replace("lesson", " 9$", "").alias("lesson"))


@query(golden("pos, part, lesson, page", [(1, 0, "1 观潮", None), (1, 1, "2 走月亮", None), (1, 2, "3 现代诗二首", None), (1, 3, "口语交际：我们与环境", None), (2, 0, "4 蝴蝶", 9)]))
def catalogue_expanded(spark, sf_dir):
    c = spark.createDataFrame([("v", 1, "u", GLUED[0][0], 3), ("v", 2, "u", "4 蝴蝶", 9)], "volume string, pos int, unit string, lesson string, page int")
    return C.expanded(c).select("pos", "part", "lesson", "page")


LISTED = [("1 水", "科学", True, False), ("版权", "科学", False, None), ("第一单元小结 单元小结", "科学", False, None), ("随便一行", "科学", True, False), ("随便一行", "语文", True, True), ("1 水", "语文", True, False), ("下列正确的是", "语文", False, None), ("这一行有标点，不是副标题。", "语文", False, None)]


@query(golden("id, subtitle", [(i, s) for i, (_, _, kept, s) in enumerate(LISTED) if kept]))
def catalogue_listed(spark, sf_dir):
    c = spark.createDataFrame([(i, x[0], x[1]) for i, x in enumerate(LISTED)], "id int, lesson string, subject string")
    return C.listed(c, F.col("subject")).select("id", "subtitle")
