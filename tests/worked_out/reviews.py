"""Cases of reviews with values worked out by hand."""

from pyspark.sql import functions as F

from palimpsest.operators import review as R
from palimpsest.registry import golden
from . import query

PAIRS = [("p1", "v", "a", "auto", "suggested"), ("p2", "v", "a", "auto", "suggested"), ("p3", "v", None, "none", "suggested"), ("p4", "v", "a", "auto", "confirmed"), ("p5", "v", "a", "auto", "suggested"), ("p6", "v", "a", "auto", "suggested")]


EDITS = [("p1", True, None, None), ("p2", None, " b ", "confirmed"), ("p3", None, "z", "nonsense"), ("p4", None, None, "rejected"), ("p5", None, "", None)]


@query(golden("id, old_lesson, method, status", [("p1", None, "manual", "suggested"), ("p2", "b", "manual", "confirmed"), ("p3", None, "none", "suggested"), ("p4", "a", "auto", "rejected"), ("p5", None, "manual", "suggested"), ("p6", "a", "auto", "suggested")]))
def review_edits(spark, sf_dir):
    """Cleared, set and confirmed, a lesson of another volume and an unknown status, rejected, emptied, untouched."""
    p = spark.createDataFrame(PAIRS, "id string, old_volume string, old_lesson string, method string, status string")
    e = spark.createDataFrame(EDITS, "id string, clear boolean, lesson string, status string")
    return R.edited_pairs(p, e, spark.createDataFrame([("a", "v"), ("b", "v"), ("z", "w")], "lesson string, volume string"), "id").drop("old_volume")


BLOCKS = [
    (1, "导入", "观察后小结", 1, 1, None, True, False), (2, "水", "短", 1, 1, None, False, True), (3, "水", "这一段文字足够长，所以它不算碎片", 1, 1, None, False, False), (4, "实验", "短", 3, 3, None, True, False), (5, "水", "", 0, 0, None, False, True),
    (6, "水", "短", 5, 5, None, True, False), (7, "讲解", "短", 1, 1, None, False, False), (8, "水", "短", 2, 2, False, False, False), (9, "水", "短", 1, 1, True, True, False), (10, None, None, 0, 0, None, False, True),
]


@query(golden("id, complete, fragment", [(x[0], x[6], x[7]) for x in BLOCKS]))
def review_blocks(spark, sf_dir):
    """Opening, activity and close; next to nothing; enough text; an experiment; empty; large; a telling kind; two atoms; said to be whole; nameless."""
    b = spark.createDataFrame([x[:6] for x in BLOCKS], "id int, name string, texts string, atoms int, codes int, said boolean")
    none = F.lit(None).cast("string")
    c = R.is_complete(F.col("name"), F.col("texts"), F.col("atoms"), none, F.col("said"))
    return b.select("id", c.alias("complete"), R.is_fragment(F.col("name"), F.col("texts"), F.col("codes"), F.lit(0), none, c, F.lit(None).cast("boolean")).alias("fragment"))


NOTES = [
    (1, "水", "雨", "B2", [3, 4], [1], [2], "abcd", "abcd", "optimize", "旧课件P3-4；「水」→「雨」；→新区块 B2；教材页旧P1→新P2；核心内容基本一致；可参考旧课件，更新文字/排版/页码"),
    (2, None, "雨", "B2", None, None, None, "", "x", "new_build", "新教材新增「雨」（B2）；旧教材无对应块；旧侧无原子文本，以新教材为准；需全新制作"),
    (3, "课件例题1", None, None, [9], None, None, "x", "", "reuse_as_is", "旧课件P9；课件固定课件例题，无新教材对应块；旧课件该页可直接沿用；新侧无原子文本，需核对建块；旧课件可直接沿用"),
    (4, "水", None, None, None, None, None, "", "", "", "旧块「水」在新教材已删除"), (5, None, None, None, None, None, None, None, None, None, "请补充：旧课件哪页→新教材哪块→怎么改"),
]


@query(golden("id, note", [(x[0], x[-1]) for x in NOTES]))
def review_notes(spark, sf_dir):
    n = spark.createDataFrame([x[:-1] for x in NOTES], "id int, a string, b string, i string, p array<int>, op array<int>, np array<int>, x string, y string, act string")
    return n.select("id", R.teacher_note(*[F.col(c) for c in ("a", "b", "i", "p", "op", "np", "x", "y", "act")]).alias("note"))
