"""Cases of titles with values worked out by hand."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import decisions as D
from palimpsest.functions import similarity as S
from palimpsest.functions import text as T
from palimpsest.registry import golden
from . import query

TITLES = [
    (1, "第一单元 水", "1 水的变化"), (2, "第一单元 水", "水变化"), (3, "第二单元 空气", "课题2 空气的成分"), (4, "第十二单元 复习", "单元小结"), (5, "绪论", " 12. 走进　科学 "),
    (6, "大师课 一", "第3课 月相（yuè xiàng）"), (7, "第二十三章 光", "8.1"), (8, "固液气", "0"), (9, "", ""), (10, "第一单元 水", "前言"), (11, "x", "出版说明"), (12, "第三单元", "03、从垃圾说起一资源"),
]


VALUES = ", ".join(f"({i}, '{u}', '{t}')" for i, u, t in TITLES)


TITLE_SQL = f"(VALUES {VALUES}) AS t(id, unit, lesson)"


BL = r"[\s\x{00a0}\x{3000}]"


def titles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TITLES, "id int, unit string, lesson string")


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{BL}+|{BL}+$', '', 'g')"


KEY_SQL = f"regexp_replace(regexp_replace({trim_sql('lesson')}, '^0*(\\d{{1,2}})[\\s\\x{{00a0}}\\x{{3000}}.．、]+', '\\1'), '{BL}+', '', 'g')"


@query(
    f"SELECT id, CASE WHEN regexp_matches(b, '^第[一二三四五六七八九十百千零0-9]+课') THEN replace(regexp_replace(b, '^第[一二三四五六七八九十百千零0-9]+课', ''), '的', '') ELSE replace(b, '的', '') END AS reuse_key, k AS match_key "
    f"FROM (SELECT id, k, regexp_replace(k, '^\\d{{1,3}}([\\x{{4e00}}-\\x{{9fff}}（])', '\\1') AS b FROM (SELECT id, {KEY_SQL} AS k FROM {TITLE_SQL}))"
)
def text_lesson_keys(spark, sf_dir):
    return titles(spark).select("id", T.lesson_reuse_match_key(F.col("lesson"), False).alias("reuse_key"), T.lesson_match_key(F.col("lesson"), False).alias("match_key"))


NORMS = [
    (1, "1水的变化", "1水的变化", "水", "第一单元 水 水变化"), (2, "水变化", "水变化", "水", "第一单元 水 水变化"), (3, "课题2空气的成分", "课题2空气的成分", "空气", "第二单元 空气 课题2空气成分"),
    (4, "单元小结", "单元小结", "复习", "第十二单元 复习 单元小结"), (5, "12.走进科学", "12.走进科学", "绪论", "绪论 走进科学"), (6, "第3课月相", "第3课月相", "大师课一", "大师课 一 月相(yuèxiàng)"),
    (7, "8.1", "8.1", "第二十三章光", "第二十三章 光 81"), (8, "0", "0", "固液气", "固液气 0"), (9, "", "", "", ""), (10, "前言", "前言", "水", "第一单元 水 前言"), (11, "出版说明", "出版说明", "x", "x 出版说明"),
    (12, "03、从垃圾说起一资源", "03、从垃圾说起资源", "", "第三单元 从垃圾说起一资源"),
]


@query(golden("id, norm, norm_title, unit_key, line", NORMS))
def text_norm_unicode(spark, sf_dir):
    t = titles(spark)
    return t.select("id", T.norm_text(F.col("lesson")).alias("norm"), T.norm_lesson_title(F.col("lesson")).alias("norm_title"), T.unit_theme_match_key(F.col("unit")).alias("unit_key"), T.merge_unit_lesson(F.col("unit"), F.col("lesson")).alias("line"))


@query(
    f"SELECT id, CASE WHEN {trim_sql('lesson')} LIKE '%单元小结%' THEN true ELSE false END AS is_summary, unit LIKE '%大师课%' AS is_master, "
    f"(n = '') OR regexp_matches(n, '前言|编者的话|编者说明|版权|CIP|ISBN|定价|责任编辑|义务教育教科书|绿色印刷') OR (n LIKE '出版%' AND length(n) < 24) AS is_noise, length(n) < 3 AS is_blank, "
    f"regexp_matches({trim_sql('lesson')}, '\\.\\d+$') AS is_subtitle, TRY_CAST(nullif(regexp_extract({trim_sql('lesson')}, '^(课题\\s*)?([1-9]\\d*)$', 2), '') AS INT) AS seq "
    f"FROM (SELECT *, regexp_replace(lesson, '{BL}+', '', 'g') AS n FROM {TITLE_SQL})"
)
def text_predicates(spark, sf_dir):
    c, u = F.col("lesson"), F.col("unit")
    return titles(spark).select(
        "id", T.is_unit_summary_label(c).alias("is_summary"), T.is_master_class_unit(u).alias("is_master"), T.is_catalog_noise_line(c).alias("is_noise"), T.is_blank_page(c).alias("is_blank"),
        T.is_subtitle_lesson_no(c, F.lit("")).alias("is_subtitle"), T.lesson_seq_int(c).alias("seq"),
    )


@query("SELECT * FROM (VALUES (1, 1), (2, 1), (3, 2), (4, 12), (5, 0), (6, NULL), (7, 23), (8, NULL), (9, NULL), (10, 1), (11, NULL), (12, 3)) AS t(id, unit_no)")
def text_unit_numbers(spark, sf_dir):
    return titles(spark).select("id", T.unit_no_from_title(F.col("unit")).cast("int").alias("unit_no"))


@query("SELECT * FROM (VALUES (1, '1', '水的变化'), (2, '', '水变化'), (3, '', '课题2 空气的成分'), (4, '', '单元小结'), (5, '12', '走进　科学'), (6, '', '第3课 月相（yuè xiàng）'), (7, '8', '1'), (8, '0', '0'), (9, '', ''), (10, '', '前言'), (11, '', '出版说明'), (12, '03', '从垃圾说起一资源')) AS t(id, no, name)")
def text_lesson_cells(spark, sf_dir):
    return titles(spark).select("id", T.parse_lesson_no(F.col("lesson")).alias("no"), T.parse_lesson_name(F.col("lesson")).alias("name"))


RATIOS = [("abcd", "abcf", 0.75, 0.857143, 0.75, 0.822857), ("", "a", 0.0, 0.0, 0.0, 0.0), ("水变化", "水变化", 1.0, 1.0, 1.0, 1.0), ("a b", "b a", 0.333333, 0.5, 1.0, 0.88)]


@query(golden("a, b, ratio, partial, token_set, raw", RATIOS))
def similarity_ratios(spark, sf_dir):
    """Values worked out by hand: common subsequence, best stretch, tokens, and the blend of them."""
    t = spark.createDataFrame([x[:2] for x in RATIOS], "a string, b string")
    a, b = F.col("a"), F.col("b")
    return t.select("a", "b", *[F.round(f(a, b), 6).alias(n) for n, f in (("ratio", S.ratio), ("partial", S.partial), ("token_set", S.token_set), ("raw", S.raw))])


@query()
def similarity_raw_titles(spark, sf_dir):
    """Each pair of catalogue titles: ratio, partial and token-set ratios, the raw score, paths and tier."""
    a, b = titles(spark).toDF("new_id", "new_unit", "new_lesson"), titles(spark).toDF("old_id", "old_unit", "old_lesson")
    p = a.join(F.broadcast(b), F.col("new_id") < F.col("old_id"))  # 12 rows of a fixture
    ka, kb = T.lesson_reuse_match_key(F.col("new_lesson")), T.lesson_reuse_match_key(F.col("old_lesson"))
    p = p.withColumns({"lesson_score": S.raw(ka, kb), "unit_score": S.raw(T.unit_theme_match_key(F.col("new_unit")), T.unit_theme_match_key(F.col("old_unit"))), "context_score": S.raw(T.merge_unit_lesson(F.col("new_unit"), F.col("new_lesson")), T.merge_unit_lesson(F.col("old_unit"), F.col("old_lesson")))})
    p = p.withColumn("title_score", S.paths(F.col("lesson_score"), F.col("unit_score"), F.col("context_score"), S.has_trilogy(F.col("new_unit")) & S.has_trilogy(F.col("old_unit"))))
    args = [F.col(c) for c in ("title_score", "lesson_score", "unit_score", "context_score")]
    return p.select("new_id", "old_id", "lesson_score", "unit_score", "context_score", "title_score", S.ratio(ka, kb).alias("ratio"), S.partial(ka, kb).alias("partial"), S.token_set(F.col("new_lesson"), F.col("old_lesson")).alias("token_set"), D.core_match(*args, F.lit(0)).alias("core"), D.traceable(*args, F.lit(1)).alias("trace"))


BLOCKS = [(1, "实验探究", "实验探究", "水 变化", "水 变化", 100, 100, True), (2, "导入", "情境", "a", "b", 0, 10, False), (3, "", "反思", "", "x", 0, 0, False), (4, "课件尾页", "", "x", "", 0, 0, True), (5, "器材", "准备", "a b", "a c", 20, 66, False), (6, "插图", "插图", "a", "a", 90, 70, True), (7, "讲解", "讲解", "甲", "乙", 100, 50, True), (8, "", "新课", "", "y", 0, 0, False)]


@query("SELECT * FROM (VALUES (1, 'L002', 'reuse_as_is', 'activity'), (2, 'L009', 'new_build', 'intro'), (3, 'L001', 'new_build', 'other'), (4, 'L002', 'reuse_as_is', 'end'), (5, 'L005', 'reference', 'other'), (6, 'L006', 'optimize', 'other'), (7, 'L004', 'reference', 'explain'), (8, 'L008', 'new_build', 'other')) AS t(id, change_type, action, kind)")
def decide_change_types(spark, sf_dir):
    b = spark.createDataFrame(BLOCKS, "id int, o string, n string, x string, y string, nr int, tr int, cw boolean")
    has_old, has_new = F.col("o") != "", F.col("n") != ""
    kind = D.change_type(has_old, has_new, F.col("o"), F.col("n"), F.col("x"), F.col("y"), F.col("nr"), F.col("tr"), F.lit(False))
    return b.withColumn("change_type", kind).select("id", "change_type", D.reuse_action(F.col("change_type"), has_old, has_new, F.col("o"), F.col("tr"), F.col("cw")).alias("action"), D.block_kind(F.col("o"), F.lit("")).alias("kind"))


LINES = [
    ("3 水", 0, 3), ("课题 2 氧气", 0, 2), ("12.3 光", 0, 1203), ("整理与提升 45", 2, 10), ("复习题", 2, 80), ("实验活动 4 铁", 2, 34), ("跨学科实践活动2", 2, 42), ("综合实践活动 1", 2, 51), ("微项目3", 2, 63), ("读一读 山", 2, 65), ("单元小结", 3, 9999), ("其他", 2, 0),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', {k}, {n}::BIGINT)" for s, k, n in LINES) + ") AS t(line, kind, n)")
def text_catalog_sort_keys(spark, sf_dir):
    k = T.catalog_sort_key(F.col("line"))
    return spark.createDataFrame([(s,) for s, _, _ in LINES], "line string").select("line", k["kind"].alias("kind"), k["n"].alias("n"))
