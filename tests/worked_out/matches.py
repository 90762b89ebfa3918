"""Cases of matches with values worked out by hand."""

from pyspark.sql import functions as F

from palimpsest.functions import decisions as D
from palimpsest.functions import text as T
from palimpsest.operators import editions as E
from palimpsest.registry import golden
from . import query

LESSON = "id string, pool string, grade int, semester string, unit string, no string, name string, body string"


NEW = [
    ("n1", "A", 3, "上", "第一单元 水", "1", "水的变化", None), ("n2", "A", 3, "上", "第一单元 水", "2", "单元小结", None), ("n3", "A", 6, "上", "月球", "", "月相的秘密", None), ("n4", "A", 3, "上", "电路", "", "电流与电压", None),
    ("n5", "B", 4, "上", "第二单元 声音", "", "声音的产生", None), ("n6", "B", 5, "上", "第二单元 声音", "", "声音的强弱", None), ("n7", "C", 4, "上", "第三单元 光", "", "光的传播路线", None), ("n8", "D", 1, "上", None, "", "无人", None), ("n9", "A", 1, None, "", "", "", None),
]


OLD = [
    ("o1", "A", 3, "上", "第一单元 水", "1", "水变化", None), ("o2", "A", 4, "上", "第二单元 水", "3", "水的变化", None), ("o3", "A", 5, "下", "宇宙", "", "在地球上看月球", None),
    ("o4", "B", 4, "上", "第二单元 声音", "", "声音的传播", None), ("o5", "C", 4, "下", "第三单元 光", "", "光的传播", None),
]


@query(
    golden(
        "id, old_id, tier, rank",
        [
            ("n1", "o1", "exact", 1), ("n1", "o2", "exact", 2), ("n3", "o3", "high_similarity", 1), ("n4", None, "none", 1), ("n5", None, "none", 1),
            ("n6", None, "none", 1), ("n6", "o4", "traceability", 2), ("n7", "o5", "high_similarity", 1), ("n8", None, "none", 1),
        ],
    )
)
def match_edition_tiers(spark, sf_dir):
    """Exact by grade and term, a shared theme, the trap of a half-alike lesson in the same unit, traceability to another grade, a part of a title."""
    out = E.match_edition(spark.createDataFrame(NEW, LESSON), spark.createDataFrame(OLD, LESSON))
    return out.select("id", "old_id", "tier", F.col("rank").cast("int").alias("rank"))


THEMES = [("月相的秘密", "在地球上看月球", "moon_phase", 0.34, False), ("地月系统", "月球——地球卫星", "earth_moon_system", 0.28, False), ("人类探月史", "探索月球秘密", "moon_explore", 0.34, False), ("水", "火", "", 0.0, False), ("自制潜望镜", "光源在哪里", "", 0.0, True), ("", "月相", "", 0.0, False)]


@query(golden("n, o, themes, boost, blocked", THEMES))
def match_themes(spark, sf_dir):
    t = spark.createDataFrame([x[:2] for x in THEMES], "n string, o string")
    a, b = T.lesson_reuse_match_key(F.col("n"), False), T.lesson_reuse_match_key(F.col("o"), False)
    return t.select("n", "o", F.array_join(E.shared_themes(a, b), ",").alias("themes"), E.theme_boost(a, b).alias("boost"), E.is_blocked(a, b, ["moon", "suji_5s"]).alias("blocked"))


HAN40 = "".join(chr(0x4E00 + i) for i in range(40))


BODIES = [(1, HAN40, HAN40, 1.0), (2, HAN40[:39], HAN40, None), (3, "abc" + HAN40, HAN40 + "12", 1.0), (4, None, HAN40, None), (5, HAN40, HAN40[:20] + "".join(chr(0x5000 + i) for i in range(20)), 0.5)]


@query(golden("id, score", [(i, s) for i, _, _, s in BODIES]))
def match_bodies(spark, sf_dir):
    b = spark.createDataFrame([x[:3] for x in BODIES], "id int, a string, b string")
    return b.select("id", F.round(E.body_score(F.col("a"), F.col("b")), 6).alias("score"))


SWAPS = [(1, "地月系", "探月", "探月", "地月系", True), (2, "水", "光", "水", "光", False), (3, "", "光", "光", "水", False)]


@query(golden("id, swapped", [(x[0], x[-1]) for x in SWAPS]))
def match_swapped_titles(spark, sf_dir):
    return spark.createDataFrame([x[:5] for x in SWAPS], "id int, a string, b string, c string, d string").select("id", E.titles_swapped(*[F.col(c) for c in "abcd"]).alias("swapped"))


LABELS = [
    ("12 走进科学", "走进科学", "1", "水", "1 水", "第一单元", "第一单元｜12 走进科学"), ("课题3 空气", "空气", "0", "空气", "空气", "", "课题3 空气"), ("水", "水", "", "水", "水", "单元  二", "单元 二｜水"), (None, "", None, None, "", "第三单元", "第三单元"),
]


@query(golden("lesson, bare, shown, hint", [(a, b, e, g) for a, b, _, _, e, _, g in LABELS]))
def text_labels(spark, sf_dir):
    t = spark.createDataFrame([(a, c, d, f) for a, _, c, d, _, f, _ in LABELS], "lesson string, no string, name string, unit string")
    return t.select("lesson", T.strip_lesson_seq(F.col("lesson")).alias("bare"), T.lesson_display_text(F.col("no"), F.col("name")).alias("shown"), T.format_old_lesson_hint(F.col("unit"), F.col("lesson")).alias("hint"))


EXPERIMENTS = [(1, "实验探究", None, None, True), (2, "导入", None, None, False), (3, "导入", "activity", None, True), (4, "演示水的沸腾", "explain", None, True), (5, "实验", None, False, False), (6, None, None, None, False), (7, "小结", None, True, True)]


@query(golden("id, experiment", [(x[0], x[-1]) for x in EXPERIMENTS]))
def decide_experiments(spark, sf_dir):
    return spark.createDataFrame([x[:4] for x in EXPERIMENTS], "id int, name string, kind string, flag boolean").select("id", D.is_experiment(F.col("name"), F.col("kind"), F.col("flag")).alias("experiment"))
