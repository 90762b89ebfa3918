"""Cases of pages with values worked out by hand."""

from pyspark.sql import functions as F

from palimpsest.functions import compare as C
from palimpsest.functions import pages as G
from palimpsest.operators import alignment as A
from palimpsest.operators import pictures as I
from palimpsest.operators import preview as V
from palimpsest.registry import golden
from . import query

PAIRS = [
    (1, "", "", "无文字", "", False, False, False),
    (2, "", "水", "新有旧无", "文字新增", False, False, False),
    (3, "水", "", "旧有新无", "文字删除", False, False, False),
    (4, "水是生命之源。", "水是生命之源。", "一致", "", False, False, False),
    (5, "水是生命之源。", "水是生命之源", "仅标点差异", "标点删除", False, False, False),
    (6, "水，火", "水,火", "一致", "", False, False, False),
    (7, "“好地方”推荐会", "好“地方”推荐会", "仅标点差异", "文字新增,文字删除", False, False, True),
    (8, "花牛歌①", "花牛歌", "一致", "", False, False, False),
    (9, "①观潮", "1观潮", "一致", "", False, False, False),
    (10, "红地(dì)", "红地(de)", "音标变动注意", "文字改写", False, True, False),
    (11, "氧气约占21%", "氧气约占20%", "文字有差异", "文字改写", True, False, False),
    (12, "a b", "ab", "一致", "", False, False, False),
    (13, "◇读一读", "读一读", "一致", "", False, False, False),
    (14, None, "水", "新有旧无", "文字新增", False, False, False),
]


@query(golden("id, verdict, kinds, percents, pinyin, quotes", [(i, *r) for i, _, _, *r in PAIRS]))
def diff_block_verdicts(spark, sf_dir):
    """Edits, their kinds and the verdict of each pair of blocks."""
    p = spark.createDataFrame([x[:3] for x in PAIRS], "id int, old string, new string")
    told = p.withColumn("told", C.edits(F.col("old"), F.col("new"))).withColumn("told", C.told_edits(F.col("told")))
    a, b = F.col("old"), F.col("new")
    kinds = F.array_join(F.transform("told", lambda e: e["kind"]), ",")
    return told.select("id", C.block_verdict(F.col("told"), a, b).alias("verdict"), kinds.alias("kinds"), C.percents_differ(a, b).alias("percents"), C.pinyin_differs(a, b).alias("pinyin"), C.quote_move(a, b).isNotNull().alias("quotes"))


CHANGES = [(1, "abcdefghij", "abcdefghij", "一致"), (2, "abcdefghij", "abcdefghxy", "轻微差异"), (3, "abcdefghij", "abcdxyzuvw", "改写"), (4, "占21%", "占20%", "数据变化"), (5, "CO Os", "COO5", "一致"), (6, "", "abc", "改写")]


@query(golden("id, change", [(i, c) for i, _, _, c in CHANGES]))
def diff_anchor_changes(spark, sf_dir):
    return spark.createDataFrame([x[:3] for x in CHANGES], "id int, old string, new string").select("id", C.anchor_change(F.col("old"), F.col("new")).alias("change"))


FORMS = [
    (1, "（水），火。", "(水),火.", "水火", "水 火 山 石 田 土 木 禾", "writing_grid"), (2, "◆ 读", "◇读", "读", "读这段话，我很开心", "side_note"), (3, "真珠³ 缘", "真珠³缘", "真珠缘", "今天天气很好。", "other"),
    (4, "3* 现代诗", "3*现代诗", "3现代诗", "水火 山石 田土 木禾 日月", "other"), (5, None, "", "", "", "other"), (6, "⑫课", "⑫课", "12课", None, "other"),
]


@query(golden("id, soft, content, role", [(i, s, c, r) for i, _, s, c, _, r in FORMS]))
def diff_text_forms(spark, sf_dir):
    """Punctuation made one, the content key, and the role of a block."""
    t = spark.createDataFrame([(i, a, b) for i, a, _, _, b, _ in FORMS], "id int, t string, b string")
    return t.select("id", C.soft_punct(F.col("t")).alias("soft"), C.content_key(F.col("t")).alias("content"), C.block_role(F.col("b")).alias("role"))


PAGE_TEXTS = [
    (1, "本书主要栏目\n导引", True, False, False, False), (2, "附录1 元素表", False, True, False, False), (3, "附录一 元素 128", False, False, False, False), (4, "后记", False, False, True, False), (5, "后记 120", False, False, False, False),
    (6, "给同学们的信\n亲爱的同学们", True, False, False, False), (7, "正文从这里开始。", False, False, False, False), (8, None, False, False, False, False), (9, "\n目录……1\n编者的话", True, False, True, False), (10, "课题1 水", False, False, False, True),
]


@query(golden("id, front, appendix, postscript, title", [(i, f, a, p, t) for i, _, f, a, p, t in PAGE_TEXTS]))
def page_kinds(spark, sf_dir):
    t = F.col("t")
    p = spark.createDataFrame([x[:2] for x in PAGE_TEXTS], "id int, t string")
    return p.select("id", G.is_front_matter(t).alias("front"), G.is_appendix_start(t).alias("appendix"), G.is_postscript_start(t).alias("postscript"), G.title_line(t).isNotNull().alias("title"))


VOLUMES = [("XK-3S-NEW", False), ("OLD-SEED1", True), (" new-seed-2", True), ("T-1", True), ("t-1", False), (None, False), ("", False)]


@query(golden("code, test", VOLUMES))
def volume_tests(spark, sf_dir):
    return spark.createDataFrame([(c,) for c, _ in VOLUMES], "code string").select("code", G.is_test_volume(F.col("code")).alias("test"))


ATOMS = [
    (1, "old", 1, 0.1, 0.2, 0.1, 0.9, "水是生命之源，人人都要节约用水"), (1, "old", 2, 0.3, 0.4, 0.1, 0.9, "小草在春天里发芽，花儿在春天里开放"), (1, "old", 3, 0.5, 0.6, 0.1, 0.9, "这一段在新书里没有了，所以没有去处"),
    (1, "new", 1, 0.3, 0.4, 0.1, 0.9, "水是生命之源，人人都要节约用水"), (1, "new", 2, 0.1, 0.2, 0.1, 0.9, "小草在春天里发芽，花儿在春天里开花"), (1, "new", 3, 0.8, 0.9, 0.1, 0.9, "abcdefghijklmnop"),
    (2, "old", 1, 0.1, 0.2, 0.1, 0.9, "图1 水的循环"), (2, "new", 1, 0.1, 0.2, 0.1, 0.9, "图1 水的循环"), (2, "new", 2, 0.5, 0.6, 0.1, 0.9, "新增的一句话，旧书里没有它"),
]


@query(golden("pair, old_id, new_id", [(1, 1, 1), (1, 2, 2), (1, 3, None), (1, None, 3), (2, 1, 1), (2, None, 2)]))
def align_atoms(spark, sf_dir):
    """Texts that changed places are still anchored to each other; what has no counterpart is told for both sides."""
    a = spark.createDataFrame(ATOMS, "pair int, side string, id int, y0 double, y1 double, x0 double, x1 double, text string")
    return A.align(a.filter("side = 'old'").drop("side"), a.filter("side = 'new'").drop("side"), "pair").select("pair", "old_id", "new_id")


@query(golden("id, score", [(1, 1.0), (2, 0.92), (3, 0.92), (4, 0.0), (5, 1.08)]))
def align_scores(spark, sf_dir):
    """Equal texts in place; moved beyond reach, short; the same, long enough for the floor under moved texts; nothing alike; equal captions."""
    rows = [
        (1, 0.1, 0.1, "水火山石田土木禾日月", "水火山石田土木禾日月"), (2, 0.1, 0.9, "水火山石田土木禾日月", "水火山石田土木禾日月"), (3, 0.1, 0.9, "水火山石田土木禾日月天地人", "水火山石田土木禾日月天地人"),
        (4, 0.1, 0.9, "水火山石田土木禾日月", "abcdefghij"), (5, 0.1, 0.1, "图1 水", "图1 水"),
    ]
    p = spark.createDataFrame([(i, (y, y + 0.1, 0.1, 0.9, t), (z, z + 0.1, 0.1, 0.9, u)) for i, y, z, t, u in rows], "id int, a struct<y0:double,y1:double,x0:double,x1:double,text:string>, b struct<y0:double,y1:double,x0:double,x1:double,text:string>")
    return p.select("id", F.round(A.anchor_score(F.col("a"), F.col("b")), 6).alias("score"))


BOXES = [(1, 0.52, 0.56, 0.2, 0.6, 1.15), (2, 0.2, 0.28, 0.2, 0.6, 1.272857), (3, 0.36, 0.44, 0.65, 0.9, 0.55), (4, 0.52, 0.56, 0.9, 1.0, 0.05), (5, 0.9, 0.95, 0.2, 0.6, 0.091), (6, 0.9, 0.95, 0.7, 0.9, 0.0)]


@query(golden("id, near", [(x[0], x[-1]) for x in BOXES]))
def pictures_proximity(spark, sf_dir):
    """Below, above, at the side, below but apart, far below, far away, of a picture from 0.3 to 0.5 and 0.2 to 0.6."""
    t = spark.createDataFrame([x[:5] for x in BOXES], "id int, y0 double, y1 double, x0 double, x1 double")
    image = F.struct(F.lit(0.3).alias("y0"), F.lit(0.5).alias("y1"), F.lit(0.2).alias("x0"), F.lit(0.6).alias("x1"))
    return t.select("id", F.round(I.proximity(image, F.struct("y0", "y1", "x0", "x1")), 6).alias("near"))


PICTURES = [(1, 1, 0.3, 0.5, 0.2, 0.6, "豌豆花"), (1, 2, 0.8, 0.9, 0.2, 0.6, None), (2, 1, 0.1, 0.2, 0.1, 0.9, None)]


TEXTS = [
    (1, 1, 0.52, 0.54, 0.2, 0.6, "窗台下的豌豆花", "text"), (1, 2, 0.1, 0.2, 0.2, 0.6, "春天来了。小草在田野里发芽。", "text"), (1, 3, 0.91, 0.93, 0.2, 0.6, "图2 豌豆", "caption"), (1, 4, 0.6, 0.62, 0.2, 0.6, "豌豆的花开在窗台下面，很好看。", "text"), (2, 1, 0.9, 0.95, 0.1, 0.9, "远处的一句话。", "text"),
]


def pictures_and_texts(spark):
    return spark.createDataFrame(PICTURES, "page int, image int, y0 double, y1 double, x0 double, x1 double, label string"), spark.createDataFrame(TEXTS, "page int, id int, y0 double, y1 double, x0 double, x1 double, text string, kind string")


@query(golden("page, image, caption, nearest, phrase, theme", [(1, 1, "窗台下的豌豆花", "窗台下的豌豆花", "窗台下的豌豆花", "豌豆花"), (1, 2, "图2 豌豆", "图2 豌豆", "图2豌豆", "图2豌豆"), (2, 1, None, None, None, None)]))
def pictures_captions(spark, sf_dir):
    """Captions, nearest texts and phrases of pictures; a picture far from all texts has none."""
    i, t = pictures_and_texts(spark)
    named = I.captions(i, t, "page").withColumnRenamed("text", "caption")
    near = I.nearest_texts(i, t, "page").withColumnRenamed("text", "nearest")
    phrase = I.matched_phrases(i, t, "page").drop("score")
    return I.picture_rows(i.select("page", "image"), named, near, ["page", "image"]).join(phrase, ["page", "image"], "left")


FOOTERS = [(1, "正文\n172 第七单元 能源的合理利用与开发", 172), (2, "课题1 我们周围的空气31", 31), (3, "正文\n复习与提高79", 79), (4, "6绪论 化学\n正文很长的一行", 6), (5, "正文\n128", 128), (6, "没有页码的一页", None), (7, None, None), (8, "12\nTLPC0001", 12)]


@query(golden("id, printed", [(i, n) for i, _, n in FOOTERS]))
def preview_footers(spark, sf_dir):
    return spark.createDataFrame([x[:2] for x in FOOTERS], "id int, t string").select("id", V.footer_page(F.col("t")).alias("printed"))


OLD_PAGES = [("b", 1, "封面"), ("b", 2, "目录\n课题1 水 3"), ("b", 3, "课题1 水\n水是生命之源人人都要节约用水"), ("b", 4, "小草在春天里发芽花儿在春天里开放"), ("b", 5, "abcdefghijklmnopqrstuvwxyz")]


NEW_PAGES = [("b", 1, None, "封面新"), ("b", 2, "k1", "课题1 水\n水是生命之源人人都要节约用水"), ("b", 3, None, "小草在春天里发芽花儿在春天里盛开"), ("b", 4, None, "abcdefghijklmnopqrstuvwxyz\n3"), ("b", 6, None, "日月星辰")]


@query(golden("page, old_page, method", [(1, 1, "position"), (2, 3, "toc"), (3, 4, "content"), (4, 4, "footer"), (6, 5, "position")]))
def preview_pages(spark, sf_dir):
    """A page with a footer, one with a contents entry, one by content, and two by position, within the book's pages."""
    new, old = spark.createDataFrame(NEW_PAGES, "book string, page int, key string, text string"), spark.createDataFrame(OLD_PAGES, "book string, page int, text string")
    toc, offset = spark.createDataFrame([("b", "k1", 2), ("b", "k1", 9)], "book string, key string, page int"), spark.createDataFrame([("b", 1)], "book string, offset int")
    return V.resolved_pages(new, old, toc, offset, "book").select("page", "old_page", "method")


@query(golden("id, y0, y1, text, split_from", [("a#p1", 0.1, 0.2, "◇读一读", "a"), ("a#p2", 0.2, 0.3, "◆写一写", "a"), ("b", 0.5, 0.6, "◇一条", None), ("c", 0.7, 0.8, None, None)]))
def layout_exploded_lists(spark, sf_dir):
    b = spark.createDataFrame([("a", 0.1, 0.3, "◇读一读 ◆写一写"), ("b", 0.5, 0.6, "◇一条"), ("c", 0.7, 0.8, None)], "id string, y0 double, y1 double, text string")
    return A.exploded_lists(b).select("id", F.round("y0", 6).alias("y0"), F.round("y1", 6).alias("y1"), "text", "split_from")


BANDS = [(1, 0.2, 0.6, 1, 4, None, 0.3, 0.4), (2, 0.2, 0.6, 1, 2, [1.0, 3.0], 0.3, 0.6), (3, 0.2, 0.6, 9, 2, [1.0], 0.4, 0.6), (4, 0.2, 0.2, 0, 2, None, 0.2, 0.25), (5, 0.0, 1.0, 0, 0, None, 0.0, 1.0)]


@query(golden("id, top, bottom", [(x[0], x[-2], x[-1]) for x in BANDS]))
def layout_bands(spark, sf_dir):
    """Equal bands, weighed ones, an index beyond the last and weights that don't fit, a box without height, no bands at all."""
    b = spark.createDataFrame([x[:6] for x in BANDS], "id int, y0 double, y1 double, i int, n int, w array<double>")
    top, bottom = A.band(*[F.col(c) for c in ("y0", "y1", "i", "n", "w")])
    return b.select("id", F.round(top, 6).alias("top"), F.round(bottom, 6).alias("bottom"))


@query(golden("page, text", [(1, "第一行左\n第一行右\n第二行"), (2, "")]))
def layout_reading_text(spark, sf_dir):
    b = [(1, 0.5, 0.6, 0.1, 0.9, "第二行"), (1, 0.1, 0.2, 0.4, 0.9, "第一行右"), (1, 0.1, 0.2, 0.1, 0.4, " 第一行左 "), (1, 0.3, 0.4, 0.1, 0.9, "图1 水"), (1, 0.7, 0.8, 0.1, 0.9, None), (2, 0.1, 0.2, 0.5, 0.6, "氧气21%")]
    return A.reading_text(spark.createDataFrame(b, "page int, y0 double, y1 double, x0 double, x1 double, text string"), "page")
