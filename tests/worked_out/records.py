"""Cases of records with values worked out by hand."""

from pyspark.sql import functions as F

from palimpsest.operators import records as R
from palimpsest.registry import golden
from . import query

LESSONS = [("v", "a1", 1, 1), ("v", "a2", 1, 2), ("v", "a3", 1, 3), ("v", "b4", 2, 4), ("v", "b9", 2, 9), ("w", "c1", 1, 1), ("w", "c9", None, None), ("w", "d1", None, 8)]


@query(golden("new, lesson", [("n1", "a1"), ("n1", "a2"), ("n1", "a3"), ("n2", "b4"), ("n2", "b9"), ("n2", "a2"), ("n2", "a3"), ("n3", "c9"), ("n3", "d1"), ("n3", "c1")]))
def records_prescan_neighbours(spark, sf_dir):
    """n1: a unit and two numbers; n2: another unit; n3: the fifth rank doesn't count, nulls are one unit and number 0."""
    m = [("n1", "a1", 1), ("n1", None, 2), ("n2", "b4", 1), ("n3", "c9", 1), ("n3", "zz", 2), ("n3", "zy", 3), ("n3", "zx", 4), ("n3", "a1", 5)]
    return R.prescan_neighbours(spark.createDataFrame(m, "new string, lesson string, rank int"), spark.createDataFrame(LESSONS, "volume string, lesson string, unit int, no int"))


CLAIMED = [(1, "L1", "B1", ["x", " y ", ""]), (2, "L1", "B2", ["y", "z"]), (3, "L2", "B1", ["x", "w"]), (4, "L2", "B2", None)]


@query(golden("ref, by_lesson, by_block", [("x", "L1", "B1"), ("y", "L1", "B1"), ("z", "L1", "B2"), ("w", "L2", "B1")]))
def records_claims(spark, sf_dir):
    return R.claims(spark.createDataFrame(CLAIMED, "place int, lesson string, block string, refs array<string>"))


ROWS = [("x", "o1", "实验探究"), ("w", "o1", "导入"), ("v", "o2", "水循环")]


@query(golden("ref, same_lesson, kind, locked, used, score", [("x", True, "activity", True, False, 0.0), ("w", True, "intro", False, True, 0.42), ("v", False, "other", False, False, 0.85)]))
def records_suggestions(spark, sf_dir):
    """x is another lesson's; w is the same lesson's, contained in the query and used: (0.85 + 0.35) * 0.35; v is contained."""
    c = R.claims(spark.createDataFrame(CLAIMED, "place int, lesson string, block string, refs array<string>"))
    rows = R.claimed_rows(spark.createDataFrame(ROWS, "ref string, lesson string, name string"), c, F.lit("o1"), F.lit("L2"))
    row = {"text": F.col("name"), "name": F.col("name"), "unit_no": F.lit(None).cast("int"), "same_lesson": F.col("same_lesson"), "locked": F.col("locked"), "used": F.col("used")}
    query_text = F.lit("导入水循环")
    return rows.select("ref", "same_lesson", "kind", "locked", "used", R.suggestion_score(query_text, F.lit(""), F.lit(None).cast("int"), row).alias("score"))


NAMES = [("实验探究", "实验观察", 1.0, 0.333333), ("导入", "导入", 1.0, 1.0), ("", "导入", 0.0, 0.0), ("水", "火", 0.0, 0.0), ("探究", "练习", 0.0, 0.0)]


@query(golden("a, b, kinds, names", [(a, b, k, round(0.7 * 1 / 3 + 0.3 * 2 / 6, 6) if a == "实验探究" else n) for a, b, k, n in NAMES]))
def records_name_similarity(spark, sf_dir):
    """实验探究 and 实验观察: one of three keywords, two of six characters."""
    n = spark.createDataFrame([x[:2] for x in NAMES], "a string, b string")
    return n.select("a", "b", R.kind_match(F.col("a"), F.col("b")).alias("kinds"), F.round(R.name_similarity(F.col("a"), F.col("b")), 6).alias("names"))


NUMBERED_NEW = [("n1", "1", 2, "第二单元"), ("n2", "1", None, "第一单元"), ("n3", " 1 ", 9, "第三单元 光"), ("n4", "1", 9, "补充"), ("n5", "", 1, "x"), ("n6", "7", 1, "x")]


NUMBERED_OLD = [("o1", 1, "1", 1, "第一单元"), ("o2", 2, "1", 2, "第二单元"), ("o3", 3, "1", 3, "第三单元光学"), ("o4", 4, "2", 1, "第一单元")]


@query(golden("id, old_id", [("n1", "o2"), ("n2", "o1"), ("n3", "o3"), ("n4", "o1")]))
def records_by_number(spark, sf_dir):
    return R.by_number(spark.createDataFrame(NUMBERED_NEW, "id string, no string, unit_no int, unit string"), spark.createDataFrame(NUMBERED_OLD, "old_id string, place int, no string, unit_no int, unit string"))


FILES = [("v", "abc123 水.zip"), ("v", "2-3 任意.zip"), ("v", "课件_光的传播.zip"), ("v", "其他的东西.zip"), ("v", "又一份 abc123.zip")]


FILE_LESSONS = [("v", "L1", "ABC123", 1, "第一单元", "1", "水的变化"), ("v", "L2", None, 2, "第二单元", "3", "声音"), ("v", "L3", None, 3, "第三单元", "1", "光的传播")]


@query(golden("file, lesson, score", [("abc123 水.zip", "L1", 1.0), ("2-3 任意.zip", "L2", 0.98), ("课件_光的传播.zip", "L3", 0.94)]))
def records_assigned_files(spark, sf_dir):
    """By id, by unit and number, by name; of two files with one id the first in order; what is below the threshold has none."""
    c = R.file_candidates(spark.createDataFrame(FILES, "pool string, file string"), spark.createDataFrame(FILE_LESSONS, "pool string, lesson string, course_id string, unit_no int, unit string, no string, name string"))
    return R.assigned_files(c).select("file", "lesson", "score")


@query(golden("file, lesson, rank", [("abc123 水.zip", "L1", 1), ("又一份 abc123.zip", "L1", 1), ("2-3 任意.zip", "L2", 1), ("课件_光的传播.zip", "L3", 1)]))
def records_ranked_files(spark, sf_dir):
    c = R.file_candidates(spark.createDataFrame(FILES, "pool string, file string"), spark.createDataFrame(FILE_LESSONS, "pool string, lesson string, course_id string, unit_no int, unit string, no string, name string"))
    return R.ranked_files(c.filter("score >= 0.9")).select("file", "lesson", F.col("rank").cast("int").alias("rank"))


BOOKS = [
    ("XK-3S-NEW 扫描版.pdf", 3, "上", 1.0, 1.0), ("湘科版三年级上册.pdf", 3, "上", 1.0, 0.96), ("科学3上.pdf", 3, "上", 0.55, 0.68), ("苏教版三年级上册.pdf", 3, "上", 0.0, 0.0), ("xiangke 四下.pdf", 4, "下", 0.9, 0.0), ("xk三 上.pdf", 3, "上", 0.9, 0.96),
    ("说明.pdf", None, None, 0.55, 0.0), ("SJ-3S-NEW.pdf", 3, "上", 0.0, 0.0),
]


@query(golden("file, grade, term, said, score", BOOKS))
def records_book_scores(spark, sf_dir):
    """Files against the first volume of grade three of one edition: by code, label, nothing said, another edition, another grade, a short name, none of it, another code."""
    f = spark.createDataFrame([(x[0],) for x in BOOKS], "file string").withColumn("gt", R.grade_and_term(F.col("file")))
    label, prefix = F.lit("湘科版"), F.lit("XK")
    return f.select("file", "gt.grade", "gt.term", R.edition_evidence(F.col("file"), label, prefix).alias("said"), R.book_score(F.col("file"), F.lit("XK-3S-NEW"), F.lit(3), F.lit("上"), label, prefix, F.lit("")).alias("score"))


@query(golden("file, code", [("XK-3S-NEW 扫描版.pdf", "XK-3S-NEW"), ("xiangke 四下.pdf", "XK-4X-NEW")]))
def records_assigned_books(spark, sf_dir):
    v = [("p", "XK-3S-NEW", 3, "上", "湘科版", "XK", ""), ("p", "XK-4X-NEW", 4, "下", "湘科版", "XK", "")]
    f = spark.createDataFrame([("p", x[0]) for x in BOOKS], "pool string, file string")
    return R.assigned_books(f, spark.createDataFrame(v, "pool string, code string, grade int, term string, label string, prefix string, title string")).select("file", "code")
