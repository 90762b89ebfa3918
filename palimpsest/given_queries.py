"""Queries of functions of titles, lines, blocks and records over the given documents' lines, read as Chinese.

A line gives letters for names and, by its place, the form that it takes; each query states in SQL what its rule makes of every form.
Values worked out by hand for single cases are in the tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import compare as K
from .functions import decisions as D
from .functions import lesson_lines as L
from .functions import pages as G
from .functions import similarity as S
from .functions import text as T
from .operators import alignment as A
from .operators import contents as C
from .operators import editions as E
from .operators import pictures as I
from .operators import preview as V
from .operators import records as R
from .operators import review as W
from .operators.scans import settled
from .registry import query, table

# Characters that no rule knows, one for each letter.
LETTERS, NEUTRAL = "abcdefghijklmnopqrstuvwxyz", "山川云雨雪花草木竹松梅兰菊鸟鱼虫马牛羊江河湖海石田土"
HAN_ONLY = r"[^\x{4e00}-\x{9fff}]+"
GIVEN = (
    "(SELECT *, substr(h, 1, 4) AS a, substr(h, 5, 4) AS b, pos % 9 + 1 AS n, pos % 12 AS k FROM (SELECT doc_id, i AS pos, "
    f"'山' || regexp_replace(translate(lower(l[i + 1]), '{LETTERS}', '{NEUTRAL}'), '{HAN_ONLY}', '', 'g') || '川云雨雪花草木竹' AS h FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM "
    "(SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l FROM documents))))"
)


def given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, h and of it a, b (four characters each), n (1 to 9), k (0 to 11): every line of the documents that isn't blank."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    l = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("pos", "line"))
    h = F.concat(F.lit("山"), F.regexp_replace(F.translate(F.lower("line"), LETTERS, NEUTRAL), HAN_ONLY, ""), F.lit("川云雨雪花草木竹"))
    # made once a line: filters and cases on the forms of a line would repeat it for each use
    l = settled(l.select("doc_id", F.col("pos").cast("long").alias("pos"), "line"), h=h).select("doc_id", "pos", "h")
    return l.select("*", F.substring("h", 1, 4).alias("a"), F.substring("h", 5, 4).alias("b"), (F.col("pos") % 9 + 1).alias("n"), (F.col("pos") % 12).alias("k"))


def of(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) and p not in ("a", "b", "n") else F.col(p).cast("string") if isinstance(p, str) else p for p in parts])


def forms(*cases) -> Column:
    """The text of the form that a line takes."""
    out = None
    for i, parts in enumerate(cases):
        text = of(*parts) if isinstance(parts, tuple) else F.lit(parts)
        out = F.when(F.col("k") % len(cases) == i, text) if out is None else out.when(F.col("k") % len(cases) == i, text)
    return out


def formed(spark, sf_dir, *cases) -> DataFrame:
    return settled(given(spark, sf_dir), t=forms(*cases))


def told(*values: str) -> str:
    """SQL for what is said of each form."""
    return "CASE " + " ".join(f"WHEN k % {len(values)} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


def given_sql(*columns: str) -> str:
    return f"SELECT doc_id, pos, {', '.join(columns)} FROM {GIVEN}"


KEYS = ["doc_id", "pos"]
Q = lambda s: f"'{s}'"  # noqa: E731 - a string of SQL

# Titles -----------------------------------------------------------------------------------------------

LESSONS = [("n", " ", "a"), ("a",), ("课题", "n", " ", "a"), "单元小结", (" ", "n", ". ", "a", "　", "b", " "), ("第", "n", "课 ", "a", "（yuè）"), ("8.", "n"), "0", "", ("前言", "a"), ("出版", "a"), ("0", "n", "、", "a")]


@query(given_sql(f"{told('n || a', 'a', Q('课题') + ' || n || a', Q('单元小结'), 'n || a || b', Q('第') + ' || n || ' + Q('课') + ' || a || ' + Q('（yuè）'), Q('8') + ' || n', Q('0'), Q(''), Q('前言') + ' || a', Q('出版') + ' || a', 'n || a')} AS match_key",
                 f"{told('a', 'a', Q('课题') + ' || n || a', Q('单元小结'), 'a || b', 'a || ' + Q('（yuè）'), Q('8') + ' || n', Q('0'), Q(''), Q('前言') + ' || a', Q('出版') + ' || a', 'a')} AS reuse_key"))
def text_lesson_keys(spark, sf_dir):
    t = formed(spark, sf_dir, *LESSONS)
    return t.select(*KEYS, T.lesson_reuse_match_key(F.col("t"), False).alias("reuse_key"), T.lesson_match_key(F.col("t"), False).alias("match_key"))


# The same forms, the last with an 一 between Han characters; what becomes of them.
NORMED = [*LESSONS[:-1], ("0", "n", "、", "a", "一", "b")]
NORMS = ["n || a", "a", Q("课题") + " || n || a", Q("单元小结"), "n || " + Q(".") + " || a || b", Q("第") + " || n || " + Q("课") + " || a", Q("8.") + " || n", Q("0"), Q(""), Q("前言") + " || a", Q("出版") + " || a"]
MERGED = ["a", "a", Q("课题") + " || n || a", Q("单元小结"), "a || b", "a || " + Q("(yuè)"), Q("8") + " || n", Q("0"), None, Q("前言") + " || a", Q("出版") + " || a", "a || " + Q("一") + " || b"]


@query(given_sql(f"{told(*NORMS, Q('0') + ' || n || ' + Q('、') + ' || a || ' + Q('一') + ' || b')} AS norm", f"{told(*NORMS, Q('0') + ' || n || ' + Q('、') + ' || a || b')} AS norm_title", "CASE WHEN pos % 2 = 0 THEN a ELSE b END AS unit_key",
                 f"CASE WHEN pos % 2 = 0 THEN '第' || n || '单元 ' || a ELSE '第十二单元 ' || b END || {told(*[Q('') if x is None else Q(' ') + ' || ' + x for x in MERGED])} AS line"))
def text_norm_unicode(spark, sf_dir):
    """Normal forms of lessons, keys of unit titles, and both as one line."""
    t = formed(spark, sf_dir, *NORMED)
    unit = F.when(F.col("pos") % 2 == 0, of("第", "n", "单元 ", "a")).otherwise(of("第十二单元　", "b"))
    return t.select(*KEYS, T.norm_text(F.col("t")).alias("norm"), T.norm_lesson_title(F.col("t")).alias("norm_title"), T.unit_theme_match_key(unit).alias("unit_key"), T.merge_unit_lesson(unit, F.col("t")).alias("line"))


@query(given_sql(f"{told(*['false'] * 3, 'true', *['false'] * 8)} AS is_summary", "pos % 2 = 1 AS is_master", f"{told(*['false'] * 8, 'true', 'true', 'true', 'false')} AS is_noise", f"{told(*['false'] * 7, 'true', 'true', 'false', 'false', 'false')} AS is_blank",
                 f"{told(*['false'] * 6, 'true', *['false'] * 5)} AS is_subtitle", "CASE WHEN pos % 4 = 0 THEN n WHEN pos % 4 = 1 THEN n END::INTEGER AS seq"))
def text_predicates(spark, sf_dir):
    t = formed(spark, sf_dir, *LESSONS)
    unit = F.when(F.col("pos") % 2 == 1, of("大师课 ", "a")).otherwise(of("b"))
    number = F.when(F.col("pos") % 4 == 0, of("n")).when(F.col("pos") % 4 == 1, of("课题", "n")).when(F.col("pos") % 4 == 2, of("n", "a")).otherwise("0")
    c = F.col("t")
    return t.select(*KEYS, T.is_unit_summary_label(c).alias("is_summary"), T.is_master_class_unit(unit).alias("is_master"), T.is_catalog_noise_line(c).alias("is_noise"), T.is_blank_page(c).alias("is_blank"), T.is_subtitle_lesson_no(c, F.lit("")).alias("is_subtitle"), T.lesson_seq_int(number).alias("seq"))


CHINESE = ["一", "二", "三", "四", "五", "六", "七", "八", "九"]


@query(given_sql(f"{told('n', '10 + n', '20 + n', 'n * 10', '0', 'NULL')}::INTEGER AS unit_no"))
def text_unit_numbers(spark, sf_dir):
    """Units by Chinese and Arabic numerals, the introduction, and names without a number."""
    digit = F.element_at(F.array(*map(F.lit, CHINESE)), F.col("n").cast("int"))
    t = formed(spark, sf_dir, ("第", digit, "单元 ", "a"), ("第十", digit, "单元", "a"), ("第二十", digit, "章 ", "b"), ("第", F.when(F.col("n") == 1, "").otherwise(digit), "十单元"), "绪论", ("a", "b"))
    return t.select(*KEYS, T.unit_no_from_title(F.col("t")).cast("int").alias("unit_no"))


@query(given_sql(f"{told('n::VARCHAR', Q(''), Q(''), Q(''), 'n::VARCHAR', Q(''), Q('8'), Q('0'), Q(''), Q(''), Q(''), Q('0') + ' || n')} AS no", f"{told('a', 'a', Q('课题') + ' || n || ' + Q(' ') + ' || a', Q('单元小结'), 'a || ' + Q('　') + ' || b', Q('第') + ' || n || ' + Q('课 ') + ' || a || ' + Q('（yuè）'), 'n::VARCHAR', Q('0'), Q(''), Q('前言') + ' || a', Q('出版') + ' || a', 'a')} AS name"))
def text_lesson_cells(spark, sf_dir):
    t = formed(spark, sf_dir, *LESSONS)
    return t.select(*KEYS, T.parse_lesson_no(F.col("t")).alias("no"), T.parse_lesson_name(F.col("t")).alias("name"))


@query(given_sql(f"{told('a', 'a', 'a', Q('') )} AS bare", "CASE WHEN pos % 3 = 0 THEN n || ' ' || a ELSE a END AS shown", f"CASE WHEN pos % 2 = 0 THEN b || '｜' ELSE '' END || {told('n || ' + Q(' ') + ' || a', Q('课题') + ' || n || ' + Q(' ') + ' || a', 'a', 'n::VARCHAR')} AS hint"))
def text_labels(spark, sf_dir):
    """Lessons without their number, with it, and behind their unit."""
    t = formed(spark, sf_dir, ("n", " ", "a"), ("课题", "n", " ", "a"), ("a",), ("n",))
    no = F.when(F.col("pos") % 3 == 0, of("n")).when(F.col("pos") % 3 == 1, "0").otherwise(" ")
    unit = F.when(F.col("pos") % 2 == 0, of(" ", "b", " ")).otherwise(" ")
    return t.select(*KEYS, T.strip_lesson_seq(F.col("t")).alias("bare"), T.lesson_display_text(no, F.col("a")).alias("shown"), T.format_old_lesson_hint(unit, F.col("t")).alias("hint"))


@query(given_sql("pos % 3 = 0 AS summary_page", "substr(h || ' ' || h, 1, 20) AS excerpt", "CASE WHEN k < 4 THEN array_to_string(range(n, n + k + 1), ',') WHEN k < 8 THEN n::VARCHAR ELSE '' END AS slides", "CASE WHEN pos % 2 = 0 THEN 'yuwen' ELSE 'as_seen' END AS mode", "CASE WHEN pos % 4 = 0 THEN 1 WHEN pos % 4 = 1 THEN 0 ELSE 2 END AS kind", "CASE WHEN pos % 4 = 0 THEN 9999 WHEN pos % 4 = 1 THEN n ELSE 0 END AS place",
                 "CASE WHEN n >= 6 THEN 'matched' WHEN n >= 3 THEN 'partial' ELSE 'none' END AS status", "CASE WHEN pos % 2 = 0 THEN '下' ELSE '上' END AS semester", "CASE WHEN k < 6 THEN n END::INTEGER AS pages"))
def text_small_fields(spark, sf_dir):
    """Pages of summaries, excerpts, spans of slides, modes of catalogues, sort keys of lesson numbers, states of matches, terms and counts of pages."""
    t = given(spark, sf_dir)
    page = F.when(F.col("pos") % 3 == 0, of("a", "\n 单元小结\n", "b")).otherwise(F.concat(F.repeat(F.col("a"), 60), F.lit("单元小结")))
    slides = F.when(F.col("k") < 4, of(" ", (F.col("n") + F.col("k")).cast("string"), "-", "n")).when(F.col("k") < 8, of("n", " ")).otherwise(of("n", "-"))
    subject = F.when(F.col("pos") % 2 == 0, " 语文 ").otherwise("科学")
    number = F.when(F.col("pos") % 4 == 0, of("a", "单元小结")).when(F.col("pos") % 4 == 1, of("n", " ", "a")).otherwise(of("a"))
    pages = F.when(F.col("k") < 6, of("n", ".0")).otherwise(of("a"))
    key = T.lesson_no_sort_key(number)
    return t.select(
        *KEYS, T.is_unit_summary_page(page).alias("summary_page"), T.body_excerpt(F.concat(F.lit(" "), F.col("h"), F.lit(" \n\t"), F.col("h")), 20).alias("excerpt"), F.array_join(T.parse_slides_spec(slides), ",").alias("slides"), T.catalog_filter_mode(subject).alias("mode"),
        key["kind"].alias("kind"), key["n"].alias("place"), D.text_match_status(F.col("n") / 10, F.lit(0.6)).alias("status"), T.parse_semester(F.when(F.col("pos") % 2 == 0, "下册").otherwise("上册")).alias("semester"), T.parse_page_count(pages).alias("pages"),
    )


@query(
    "WITH l AS (SELECT l_suppkey, l_quantity AS s, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS pos, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem) "
    "SELECT l_suppkey, pos, round(avg(s) OVER (PARTITION BY l_suppkey ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * (total - pos) / 5, 6) AS eta FROM l"
)
def sequence_remaining_seconds(spark, sf_dir):
    """What the pages of a supplier's lines still take, by the mean of the last twenty and five workers."""
    from pyspark.sql import Window

    from .operators.sequence import remaining_seconds

    w = Window.partitionBy("l_suppkey")
    l = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(w.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")).cast("long")).withColumn("total", F.count("*").over(w))
    return remaining_seconds(l, "l_suppkey", "pos", "l_quantity", "total", 5).select("l_suppkey", "pos", F.round("eta", 6).alias("eta"))


# Lines ------------------------------------------------------------------------------------------------

LINES = [
    ("课题", "n", "  ", "a", " ……12"), "整 理 与 提 升 30", ("实验活动", "n", " ", "a"), ("12.", "n", " ", "a"), ("下列", "a", "（ ）"), "语文园地", ("例文 ", "a"), ("n", "* ", "a"), ("读一读 ", "a"), "", ("这是", "a", "？"), "写字表",
]
NORMAL = [Q("课题") + " || n || " + Q(" ") + " || a", Q("整理与提升"), Q("实验活动") + " || n || " + Q(" ") + " || a", Q("12.") + " || n || " + Q(" ") + " || a", Q("下列") + " || a || " + Q("（ ）"), Q("语文园地"), Q("例文 ") + " || a", "n || " + Q("* ") + " || a", Q("读一读 ") + " || a", Q(""), Q("这是") + " || a || " + Q("？"), Q("写字表")]
KEY = [Q("1/N|") + " || n", Q("1/S|整理与提升"), Q("1/E|") + " || n", Q("1/M|12|") + " || n", Q("1/R|下列") + " || a || " + Q("（ ）"), Q("1/Y|语文园地|"), Q("1/R|例文 ") + " || a", Q("1/N|") + " || n", Q("1/MB|读一读|") + " || a", Q(""), Q("1/R|这是") + " || a || " + Q("？"), Q("1/R|写字表")]


@query(given_sql(f"{told(*NORMAL)} AS normal", "k NOT IN (4, 6, 9, 10) AS lesson", "k IN (4, 10) AS exercise", "k = 6 AS subtitle", f"{told(*KEY)} AS key"))
def text_lesson_lines(spark, sf_dir):
    """Normal form, kind and semantic key of lines in a first unit."""
    t, c = formed(spark, sf_dir, *LINES), F.col("t")
    return t.select(*KEYS, L.normal_line(c).alias("normal"), L.is_lesson_line(c).alias("lesson"), L.is_exercise(c).alias("exercise"), L.is_subtitle(c).alias("subtitle"), L.semantic_key(F.lit("第一单元 x"), c).alias("key"))


@query(given_sql(f"{told(*['n || a || ' + Q('|') + ' || (n + 1) || ' + Q(' ') + ' || b || ' + Q('|口语交际：') + ' || a || b'], Q('实验活动') + ' || n || ' + Q(' ') + ' || a || b || a || b', 'n || ' + Q(' ') + ' || a', Q(''))} AS parts"))
def text_glued_lines(spark, sf_dir):
    """Lines of several lessons, of one column, of one lesson, of none."""
    t = formed(spark, sf_dir, ("n", "a", (F.col("n") + 1).cast("string"), " ", "b", "口语交际：", "a", "b"), ("实验活动", "n", " ", "a", "b", "a", "b"), ("n", " ", "a"), "")
    return t.select(*KEYS, F.array_join(L.split_glued(F.col("t")), "|").alias("parts"))


PLACED = ["单元小结", "复习题", ("实验活动", "n", " ", "a"), ("课题", "n", " ", "a"), ("12.", "n", " ", "a"), ("n", " ", "a"), ("a",), ("微项目", "n"), ("数学活动 ", "a"), "整理与提升", ("跨学科实践活动", "n", " ", "a"), ("综合实践活动", "n")]


@query(given_sql(f"{told('3', '2', '2', '0', '0', '0', '2', '2', '2', '2', '2', '2')} AS kind", f"{told('9999', '80', '30 + n', 'n', '1200 + n', 'n', '0', '60 + n', '65', '10', '40 + n', '50 + n')}::BIGINT AS place"))
def text_lesson_places(spark, sf_dir):
    """Where lines stand in a unit: numbers, other lines and columns, the summary."""
    return formed(spark, sf_dir, *PLACED).withColumn("p", L.place_in_unit(F.col("t"))).select(*KEYS, "p.kind", F.col("p.n").cast("long").alias("place"))


@query(given_sql(f"{told('0', '0', '0', '2', '2')} AS kind", f"{told('n', 'n', '1200 + n', '10', '30 + n')}::BIGINT AS place"))
def text_catalog_sort_keys(spark, sf_dir):
    """Sort keys of numbered lessons, sections, special titles and experiments."""
    t = formed(spark, sf_dir, ("n", " ", "a"), ("课题 ", "n", " ", "a"), ("12.", "n", " ", "a"), "整理与提升 45", ("实验活动 ", "n", " ", "a"))
    k = T.catalog_sort_key(F.col("t"))
    return t.select(*KEYS, k["kind"].alias("kind"), k["n"].cast("long").alias("place"))


@query(given_sql(f"{told(Q('XK') , Q('R') + ' || n', 'NULL', 'NULL')} AS prefix", f"{told('n', 'n + 3', 'NULL', 'NULL')}::INTEGER AS grade", f"{told(Q('上'), Q('下'), 'NULL', 'NULL')} AS term", f"{told(Q('new'), Q('old'), 'NULL', 'NULL')} AS book", f"{told('1', 'n', 'NULL', 'NULL')}::INTEGER AS version"))
def contents_volume_codes(spark, sf_dir):
    """Codes of volumes with and without a version, one with version 0, one that is none."""
    t = formed(spark, sf_dir, ("XK-", "n", "S-NEW"), (" r", "n", "-", (F.col("n") + 3).cast("string"), "x-old-v", "n"), ("XK-", "n", "S-NEW-v0"), ("XK", "n", "S"))
    return t.withColumn("p", C.volume_code(F.col("t"))).select(*KEYS, "p.prefix", F.col("p.grade").cast("int").alias("grade"), "p.term", "p.book", F.col("p.version").cast("int").alias("version"))


@query(given_sql(f"{told('false', 'true', 'true', 'false')} AS recurring", f"array_to_string(list_sort(list_distinct({told('[a || ' + Q('诗') + ', b, ' + Q('卢沟') + ']', '[' + Q('语文园地') + ']', '[' + Q('习作：') + ' || a]', '[]::VARCHAR[]')})), ',') AS tokens"))
def contents_title_tokens(spark, sf_dir):
    """The main title and those in brackets; recurring columns by their number; single characters are none."""
    no, name = forms(("n",), "语文园地", "", "2"), forms(("a", "诗（", "b", "；卢沟、水）"), "", ("习作：", "a"), "水")
    t = given(spark, sf_dir)
    return t.select(*KEYS, C.is_recurring(no, name).alias("recurring"), F.array_join(C.title_tokens(no, name), ",").alias("tokens"))


@query(given_sql(f"{told('n > 1', 'true', 'true', 'false', 'false', 'true', 'false', 'true')} AS test"))
def volume_tests(spark, sf_dir):
    """Codes of volumes that are for tests only: seeds, T with a number; but not a small t."""
    code = forms((F.when(F.col("n") > 1, "OLD-SEED").otherwise("OLD-"), "n"), "OLD-SEED1", (" new-seed-", "n"), ("XK-", "n", "S-NEW"), ("t-", "n"), ("T-", "n"), "", ("T-", "n"))
    return given(spark, sf_dir).withColumn("code", code).select(*KEYS, G.is_test_volume(F.col("code")).alias("test"))


@query(given_sql(f"{told('true', 'false', 'false', 'false', 'false', 'false')} AS front", f"{told('false', 'true', 'false', 'false', 'false', 'false')} AS appendix", f"{told('false', 'false', 'true', 'false', 'false', 'false')} AS postscript", f"{told('false', 'false', 'false', 'true', 'false', 'true')} AS title"))
def page_kinds(spark, sf_dir):
    """Front matter, appendices, postscripts and lessons by their first lines."""
    t = formed(spark, sf_dir, ("本书主要栏目\n", "a"), ("附录", "n", " ", "a", "\n", "b"), ("后记\n", "a", "b"), ("课题", "n", " ", "a"), ("a", "b", "。"), ("实验活动", "n", "\n", "b"))
    c = F.col("t")
    return t.select(*KEYS, G.is_front_matter(c).alias("front"), G.is_appendix_start(c).alias("appendix"), G.is_postscript_start(c).alias("postscript"), G.title_line(c).isNotNull().alias("title"))


@query(given_sql(f"{told('pos % 500 + 1', 'n', 'n + 70', 'n', 'n + 100', 'NULL')}::INTEGER AS printed"))
def preview_footers(spark, sf_dir):
    """Printed page numbers in footers of units, topics, columns and by themselves; none."""
    t = formed(spark, sf_dir, ("a", "\n", (F.col("pos") % 500 + 1).cast("string"), " 第七单元 ", "b"), ("课题1 ", "a", "b", "n"), ("a", "\n复习与提高", (F.col("n") + 70).cast("string")), ("n", "绪论 ", "a", "\n", "b", "a"), ("a", "\n", (F.col("n") + 100).cast("string")), ("a", "b"))
    return t.select(*KEYS, V.footer_page(F.col("t")).cast("int").alias("printed"))


# Blocks and boxes -------------------------------------------------------------------------------------


# Pairs of blocks, whether their texts are the same, the verdict, the kinds of their edits: other words, the same, a mark less, marks in another width, one side empty,
# quotes around other words, a number less, other pinyin, other percentages, blanks, a list's mark.
PAIRED = [
    (("a",), ("b",), "a = b", "CASE WHEN a = b THEN '一致' ELSE '文字有差异' END", "CASE WHEN a = b THEN '' ELSE '文字' END"), (("a", "b", "。"), ("a", "b", "。"), "true", "'一致'", "''"),
    (("a", "b", "。"), ("a", "b"), "false", "'仅标点差异'", "'标点删除'"), (("a", "，", "b"), ("a", ",", "b"), "true", "'一致'", "''"), ("", ("a",), "false", "'新有旧无'", "'文字新增'"), (("a",), "", "false", "'旧有新无'", "'文字删除'"),
    (("“好地方”推荐会", "a"), ("好“地方”推荐会", "a"), "false", "'仅标点差异'", "'文字新增,文字删除'"), (("a", "①"), ("a",), "false", "'一致'", "''"), (("a", "(dì)"), ("a", "(de)"), "false", "'音标变动注意'", "'文字改写'"),
    (("a", "占21%"), ("a", "占20%"), "false", "'文字有差异'", "'文字改写'"), (("a", " ", "b"), ("a", "b"), "true", "'一致'", "''"), (("◇", "a"), ("a",), "false", "'一致'", "''"),
]


@query(given_sql(f"{told(*[p[2] for p in PAIRED])} AS same_text", f"{told(*[p[3] for p in PAIRED])} AS verdict", f"{told(*[p[4] for p in PAIRED])} AS kinds", "k = 9 AS percents", "k = 8 AS pinyin", "k = 6 AS quotes"))
def diff_block_verdicts(spark, sf_dir):
    """Edits, their kinds (of whole words changed for others only that they are words) and the verdict of each pair of blocks."""
    old, new = forms(*[p[0] for p in PAIRED]), forms(*[p[1] for p in PAIRED])
    p = given(spark, sf_dir).withColumns({"old": old, "new": new})
    p = p.withColumn("told", K.told_edits(K.edits(F.col("old"), F.col("new")), None))
    a, b = F.col("old"), F.col("new")
    kinds = F.transform("told", lambda e: e["kind"])
    kinds = F.when(F.col("k") == 0, F.array_distinct(F.transform(kinds, lambda x: F.substring(x, 1, 2)))).otherwise(kinds)
    return p.select(*KEYS, (K.soft_punct(a) == K.soft_punct(b)).alias("same_text"), K.block_verdict(F.col("told"), a, b).alias("verdict"), F.array_join(kinds, ",").alias("kinds"), K.percents_differ(a, b).alias("percents"), K.pinyin_differs(a, b).alias("pinyin"), K.quote_move(a, b).isNotNull().alias("quotes"))


@query(given_sql(f"{told(Q('一致'), Q('数据变化'), Q('一致'), Q('改写'))} AS change"))
def diff_anchor_changes(spark, sf_dir):
    """What became of an anchored text: the same, other percentages, blanks only, nothing left of it."""
    old, new = forms(("a", "b"), ("a", "占21%"), ("a", " ", "b"), ("a", "b")), forms(("a", "b"), ("a", "占2", "n", "9%"), ("a", "b"), "abc")
    return given(spark, sf_dir).select(*KEYS, K.anchor_change(old, new).alias("change"))


@query(given_sql(f"{told(Q('(') + ' || a || ' + Q('),') + ' || b || ' + Q('.'), Q('◇') + ' || a', 'a || ' + Q('³'), 'n || ' + Q('*') + ' || a', Q(''), Q('⑫') + ' || a')} AS soft", f"{told('a || b', 'a', 'a', 'n || a', Q(''), Q('12') + ' || a')} AS content",
                 f"{told(Q('writing_grid'), Q('side_note'), *[Q('other')] * 4)} AS role"))
def diff_text_forms(spark, sf_dir):
    """Punctuation made one, the content key, and the role of a block."""
    none = F.lit(None).cast("string")
    t = formed(spark, sf_dir, ("（", "a", "），", "b", "。"), ("◆ ", "a"), ("a", "³ "), ("n", "* ", "a"), (none,), ("⑫", "a"))
    block = forms((F.regexp_replace(F.concat("a", "b"), "(.)", "$1 "),), ("读这段话", "a", "，我很开心"), ("a", "很好。"), ("a", " ", "b"), "", (none,))
    return t.select(*KEYS, K.soft_punct(F.col("t")).alias("soft"), K.content_key(F.col("t")).alias("content"), K.block_role(block).alias("role"))


@query(f"SELECT doc_id, pos, unnest({told('[' + Q('◇') + ' || a, ' + Q('◆') + ' || b]', '[' + Q('◇') + ' || a]', '[a || b]')}) AS text, round(unnest({told('[0.1, 0.1 + n / 20.0]', '[0.1::DOUBLE]', '[0.1::DOUBLE]')}), 6) AS y0 FROM {GIVEN}")
def layout_exploded_lists(spark, sf_dir):
    """Boxes of lists, a box for each item; other boxes as they are."""
    t = formed(spark, sf_dir, ("◇", "a", " ◆", "b"), ("◇", "a"), ("a", "b"))
    b = t.select(F.concat_ws("-", *KEYS).alias("id"), *KEYS, F.lit(0.1).alias("y0"), (F.lit(0.1) + F.col("n") / 10).alias("y1"), F.col("t").alias("text"))
    return A.exploded_lists(b).select(*KEYS, "text", F.round("y0", 6).alias("y0"))


@query(given_sql("round(0.1 + k / 12.0 * n / 10, 6) AS top", "round(0.1 + (k + 1) / 12.0 * n / 10, 6) AS bottom", "round(CASE WHEN pos % 2 = 0 THEN 0.1 ELSE 0.1 + n / 10.0 * n / (n + 3.0) END, 6) AS weighed"))
def layout_bands(spark, sf_dir):
    """Equal bands of a box, and bands by weights."""
    t, y0 = given(spark, sf_dir), F.lit(0.1)
    y1 = y0 + F.col("n") / 10
    top, bottom = A.band(y0, y1, F.col("k"), F.lit(12), F.lit(None).cast("array<double>"))
    weighed, _ = A.band(y0, y1, F.col("pos") % 2, F.lit(2), F.array(F.col("n").cast("double"), F.lit(3.0)))
    return t.select(*KEYS, F.round(top, 6).alias("top"), F.round(bottom, 6).alias("bottom"), F.round(weighed, 6).alias("weighed"))


@query(f"SELECT doc_id, coalesce(string_agg(a || b, chr(10) ORDER BY k, n, a || b) FILTER (k % 3 < 2), '') AS text FROM {GIVEN} GROUP BY 1")
def layout_reading_text(spark, sf_dir):
    """A document's lines as boxes here and there, read from top to bottom and left to right; captions are left out."""
    t = given(spark, sf_dir)
    y, x = F.col("k") / 12, F.col("n") / 40
    text = F.when(F.col("k") % 3 == 2, of("图", "n", " ", "a")).otherwise(of("a", "b"))
    b = t.select("doc_id", y.alias("y0"), (y + 0.05).alias("y1"), x.alias("x0"), (x + 0.2).alias("x1"), text.alias("text"))
    return A.reading_text(b, "doc_id")


@query(given_sql("CASE WHEN pos % 3 = 2 THEN false ELSE k % 3 < 2 END AS experiment"))
def decide_experiments(spark, sf_dir):
    """Blocks that are experiments by their flag, their kind or their name."""
    name, kind = forms(("实验", "a"), ("a",), ("a",)), forms("explain", "activity", "explain")
    flag = F.when(F.col("pos") % 3 == 2, F.lit(False))
    return given(spark, sf_dir).select(*KEYS, D.is_experiment(name, kind, flag).alias("experiment"))


# Catalogues: a document is a volume, its lines are rows -------------------------------------------------

UNIT_PLACE = "CASE WHEN k = 0 THEN 0 WHEN k = 11 THEN 9000 + pos ELSE n END"


def unit_of_line() -> Column:
    return F.when(F.col("k") == 0, "绪论").when(F.col("k") == 11, of("附录", "a")).otherwise(of("第", "n", "单元 ", "b"))


def catalogue(spark, sf_dir, lesson) -> DataFrame:
    return given(spark, sf_dir).select(F.col("doc_id").alias("volume"), "pos", unit_of_line().alias("unit"), lesson.alias("lesson"), "n", "k", "a", "b")


@query(f"SELECT doc_id AS volume, pos, row_number() OVER (PARTITION BY doc_id ORDER BY {UNIT_PLACE}, pos) AS place FROM {GIVEN}")
def catalogue_by_unit(spark, sf_dir):
    """Introduction, units by number, then units without one; within them as the rows stand."""
    return C.by_unit(catalogue(spark, sf_dir, of("a")), "volume").select("volume", "pos", "place")


@query(f"SELECT doc_id AS volume, pos, row_number() OVER (PARTITION BY doc_id ORDER BY {UNIT_PLACE}, pos % 7, a, pos) AS place FROM {GIVEN}")
def catalogue_by_unit_and_lesson(spark, sf_dir):
    """Within units lessons by number, then by name."""
    return C.by_unit(catalogue(spark, sf_dir, of((F.col("pos") % 7).cast("string"), " ", "a")), "volume", True).select("volume", "pos", "place")


@query(f"SELECT doc_id AS volume, pos, part, CASE WHEN k % 2 = 1 THEN n || ' ' || a WHEN part = 0 THEN n || a || b ELSE (n + 1) || b || a END AS lesson, CASE WHEN k % 2 = 1 THEN pos END AS page FROM (SELECT *, unnest(CASE WHEN k % 2 = 1 THEN [0] ELSE [0, 1] END) AS part FROM {GIVEN})")
def catalogue_expanded(spark, sf_dir):
    """Rows with two lessons become two without a page."""
    lesson = F.when(F.col("k") % 2 == 1, of("n", " ", "a")).otherwise(of("n", "a", "b", (F.col("n") + 1).cast("string"), "b", "a"))
    c = catalogue(spark, sf_dir, lesson).select("volume", "pos", "unit", "lesson", F.col("pos").alias("page"))
    return C.expanded(c).select("volume", "pos", "part", "lesson", "page")


@query(f"SELECT doc_id AS volume, pos, k % 6 > 0 AS subtitle FROM {GIVEN} WHERE k % 6 IN (0, 1, 3)")
def catalogue_listed(spark, sf_dir):
    """Numbered lessons, front matter, summaries and lines of names, for subjects that show what is seen and those that show lessons and subtitles only."""
    lesson = forms(("n", " ", "a"), ("版权", "a"), "单元小结", ("a", "b"), ("版权", "b"), "单元小结")
    c = catalogue(spark, sf_dir, lesson).withColumn("subject", F.when(F.col("pos") % 2 == 1, "语文").otherwise("科学"))
    return C.listed(c, F.col("subject")).select("volume", "pos", "subtitle")


@query(
    f"WITH r AS (SELECT doc_id AS volume, pos % 2 AS side, pos, n, CASE WHEN pos % 2 = 0 THEN n || ' ' || a ELSE '课题' || n || ' ' || a END AS lesson, '第' || (k % 3 + 1) || '单元 ' || substr(h, 1, n) AS unit, k % 3 + 1 AS u FROM {GIVEN}), "
    "w AS (SELECT *, CASE WHEN side = 1 THEN 200 ELSE 0 END + least(length(unit), 40) - greatest(0, length(lesson) - 32) AS worth FROM r), "
    "f AS (SELECT volume, u, n, min(side * 1000000 + pos) AS spot, first(unit ORDER BY length(unit) DESC, side, pos) AS unit, first(lesson ORDER BY worth DESC, side, pos) AS lesson FROM w GROUP BY 1, 2, 3) "
    "SELECT volume, row_number() OVER (PARTITION BY volume ORDER BY spot) AS place, unit, lesson FROM f"
)
def catalogue_merged(spark, sf_dir):
    """Two catalogues of a volume, even and odd lines, made one: a lesson by unit and number once, with the fuller unit name and the entry most worth showing."""
    t = given(spark, sf_dir)
    lesson = F.when(F.col("pos") % 2 == 0, of("n", " ", "a")).otherwise(of("课题", "n", " ", "a"))
    c = t.select(F.col("doc_id").alias("volume"), "pos", of("第", (F.col("k") % 3 + 1).cast("string"), "单元 ", F.expr("substring(h, 1, int(n))")).alias("unit"), lesson.alias("lesson"))
    return C.merged(c.filter("pos % 2 = 0"), c.filter("pos % 2 = 1"), "volume").select("volume", "place", "unit", "lesson")


STRAY = "SELECT doc_id AS volume, pos, CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS u, substr(h, 2, 1) || '课' AS key FROM " + GIVEN


@query(
    f"WITH c AS ({STRAY}), i AS (SELECT volume, list(DISTINCT key) FILTER (u = 0) AS intro FROM c GROUP BY 1), m AS (SELECT c.*, u = 1 AND list_contains(coalesce(intro, []), key) AS shared, max(coalesce(u = 1 AND NOT list_contains(coalesce(intro, []), key), false)) OVER (PARTITION BY c.volume) AS others, max(coalesce(u > 0, false)) OVER (PARTITION BY c.volume) AS numbered FROM c JOIN i USING (volume)), "
    "s AS (SELECT * FROM m WHERE NOT (coalesce(shared, false) AND others)), t AS (SELECT *, max(coalesce(u > 0, false)) OVER (PARTITION BY volume, key) AS there FROM s) SELECT volume, pos FROM t WHERE NOT coalesce(u = 0 AND numbered AND there, false)"
)
def catalogue_stray_intro(spark, sf_dir):
    """Lessons that stand in the introduction and in a unit lose one of their rows."""
    t = given(spark, sf_dir)
    unit = F.when(F.col("k") % 4 == 0, "绪论").when(F.col("k") % 4 == 1, "第一单元").when(F.col("k") % 4 == 2, "第二单元").otherwise("附录")
    c = t.select(F.col("doc_id").alias("volume"), "pos", unit.alias("unit"), F.concat(F.substring("h", 2, 1), F.lit("课")).alias("lesson"))
    return C.without_stray_intro(c, "volume").select("volume", "pos")


@query(
    f"WITH l AS (SELECT doc_id AS volume, pos, k, CASE WHEN k = 0 THEN '第' || n || '单元' || a END AS head, n, a FROM {GIVEN}), "
    "c AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY volume ORDER BY pos), '') AS unit FROM l) SELECT volume, pos, unit, CASE WHEN k = 5 THEN '单元小结' ELSE n || a END AS title, (n + k)::INTEGER AS page, CASE WHEN k = 5 THEN '单元小结' ELSE a END AS match_key FROM c WHERE k IN (1, 2, 3, 5)"
)
def contents_entries(spark, sf_dir):
    """Lines with leaders, a gap, a number and a page, a summary; headings are carried on; names without a page are none."""
    page = (F.col("n") + F.col("k")).cast("string")
    line = F.when(F.col("k") == 0, of("第", "n", "单元 ", "a")).when(F.col("k") == 1, of("n", " ", "a", "……", page)).when(F.col("k") == 2, of("n", " ", "a", "   ", page)).when(F.col("k") == 3, of("n", " ", "a", " ", page)).when(F.col("k") == 5, of("单元小结 ", page)).otherwise(of("a", "b"))
    return C.contents_entries(given(spark, sf_dir).select(F.col("doc_id").alias("volume"), "pos", line.alias("line")), "volume").withColumn("page", F.col("page").cast("int"))


@query(
    f"WITH l AS (SELECT doc_id AS volume, pos, k, CASE WHEN k = 0 THEN '第' || n || '单元' || a WHEN k = 6 THEN '绪论' END AS head, n, a, b FROM {GIVEN}), c AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY volume ORDER BY pos), '') AS unit FROM l) "
    "SELECT volume, pos, m AS n, unit, CASE WHEN m = 0 THEN n || ' ' || a ELSE (n + 9) || ' ' || b END AS lesson FROM (SELECT *, unnest(CASE WHEN k % 3 = 2 THEN [0, 1] ELSE [0] END) AS m FROM c WHERE head IS NULL AND k <> 9)"
)
def contents_catalogue_lines(spark, sf_dir):
    """Lessons of catalogues' lines, two to some, under the units before them; lines of an appendix are none."""
    line = F.when(F.col("k") == 0, of("第", "n", "单元 ", "a", " 1")).when(F.col("k") == 6, "绪论").when(F.col("k") == 9, of("附录 ", "b", " 99")).when(F.col("k") % 3 == 2, of("n", "a", " 2 ", (F.col("n") + 9).cast("string"), "b", " 40")).otherwise(of("n", " ", "a", "……9"))
    return C.catalogue_lines(given(spark, sf_dir).select(F.col("doc_id").alias("volume"), "pos", line.alias("line")), "volume").select("volume", "pos", F.col("n").alias("n"), "unit", "lesson")


@query(
    f"WITH p AS (SELECT doc_id % 10 AS volume, doc_id // 10 AS page, string_agg(a, '' ORDER BY pos) AS t FROM {GIVEN} GROUP BY 1, 2), k AS (SELECT DISTINCT doc_id % 10 AS volume, substr(a, 1, 3) AS key FROM {GIVEN}) "
    "SELECT p.volume, p.page, count(key) AS hits FROM p LEFT JOIN k ON k.volume = p.volume AND contains(p.t, key) GROUP BY 1, 2"
)
def contents_lesson_hits(spark, sf_dir):
    """How many lessons of a volume stand on each of its pages."""
    t = given(spark, sf_dir).withColumn("volume", F.col("doc_id") % 10)
    pages = t.groupBy("volume", F.floor(F.col("doc_id") / 10).alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "a"))), lambda x: x["a"]), " ").alias("text"))
    targets = t.select("volume", F.substring("a", 1, 3).alias("lesson")).distinct().withColumn("keys", F.array("lesson", F.substring("lesson", 1, 2)))
    return C.lesson_hits(pages, targets, "volume").select("volume", "page", "hits")


@query(
    f"WITH e AS (SELECT doc_id AS volume, CASE WHEN k = 0 THEN 0 WHEN k = 11 THEN NULL ELSE n END AS no, min(pos) AS first_page FROM {GIVEN} WHERE k <> 11 AND pos % 5 > 0 GROUP BY 1, 2) "
    f"SELECT g.doc_id AS volume, g.pos, e.first_page FROM (SELECT *, CASE WHEN k = 0 THEN 0 WHEN k = 11 THEN NULL ELSE n END AS no FROM {GIVEN}) g LEFT JOIN e ON e.volume = g.doc_id AND e.no = g.no"
)
def contents_unit_pages(spark, sf_dir):
    """The first page of each row's unit, out of the entries that head one."""
    c = catalogue(spark, sf_dir, of("a"))
    entries = c.filter("pos % 5 > 0").select("volume", F.col("unit").alias("title"), F.col("pos").alias("page"))
    return C.unit_first_pages(entries, c.select("volume", "pos", "unit"), "volume").select("volume", "pos", "first_page")


@query(
    f"WITH p AS (SELECT doc_id AS volume, pos + 1 AS page, n % 3 = 0 AS heading, k < 7 AS lessons FROM {GIVEN} WHERE pos < 22), b AS (SELECT *, max(heading) OVER (PARTITION BY volume ORDER BY page) AS begun FROM p), "
    "e AS (SELECT *, max(begun AND NOT heading AND NOT lessons) OVER (PARTITION BY volume ORDER BY page) AS ended FROM b) SELECT volume, min(page) AS first, max(page) AS last FROM e WHERE heading AND NOT ended GROUP BY 1"
)
def contents_spans(spark, sf_dir):
    """Runs of contents pages of documents: a line is a page, with a heading, with two lessons or with neither."""
    text = of(F.when(F.col("n") % 3 == 0, "目 录\n").otherwise(""), F.when(F.col("k") < 7, of("n", " ", "a", "\n", "n", "b")).otherwise(of("a")))
    return C.contents_span(given(spark, sf_dir).select(F.col("doc_id").alias("volume"), (F.col("pos") + 1).alias("page"), text.alias("text")), "volume")


# Matches ----------------------------------------------------------------------------------------------


@query(given_sql(f"{told(Q('moon_phase'), Q('earth_moon_system'), Q('moon_explore'), Q(''))} AS themes", f"{told('0.34', '0.28', '0.34', '0.0')}::DOUBLE AS boost"))
def match_themes(spark, sf_dir):
    """Titles that share a theme of the moon, and titles that share none."""
    new, old = forms(("a", "月相的秘密"), ("地月系", "a"), ("人类探月史", "b"), ("a",)), forms(("在地球上看月球", "b"), ("月球——地球卫星", "a"), ("探索月球秘密", "a"), ("b",))
    a, b = T.lesson_reuse_match_key(new, False), T.lesson_reuse_match_key(old, False)
    return given(spark, sf_dir).select(*KEYS, F.array_join(E.shared_themes(a, b), ",").alias("themes"), E.theme_boost(a, b).alias("boost"))


@query(
    "WITH d AS (SELECT doc_id, regexp_replace(translate(lower(coalesce(text, '')), 'abcdefghijklmnopqrstuvwxyz', '" + NEUTRAL + "'), '[^\\x{4e00}-\\x{9fff}]+', '', 'g') AS h FROM documents) SELECT doc_id, CASE WHEN length(h) >= 40 THEN 1.0::DOUBLE END AS score FROM d"
)
def match_bodies(spark, sf_dir):
    """Whole bodies against themselves with other marks: 1 where there are enough characters, else nothing is said."""
    h = F.translate(F.lower(F.coalesce("text", F.lit(""))), LETTERS, NEUTRAL)
    d = table(spark, sf_dir, "documents").select("doc_id", h.alias("x"), F.concat(F.lit("abc。"), F.replace(h, F.lit(" "), F.lit("，"))).alias("y"))
    return d.select("doc_id", F.round(E.body_score(F.col("x"), F.col("y")), 6).alias("score"))


@query(given_sql("k % 3 = 0 AS swapped"))
def match_swapped_titles(spark, sf_dir):
    """Units and lessons that changed places, that stayed, and where one is missing."""
    first, second = of("a"), of("abcdefg", "n")
    x = F.when(F.col("k") % 3 == 2, "").otherwise(first)
    p, q = F.when(F.col("k") % 3 == 0, second).otherwise(first), F.when(F.col("k") % 3 == 0, first).otherwise(second)
    return given(spark, sf_dir).select(*KEYS, E.titles_swapped(x, second, p, q).alias("swapped"))


def lessons_of_documents(spark, sf_dir) -> DataFrame:
    """id, pool, grade, semester, unit, no, name, body: a document is a lesson, named by its letters; PAGES of them in a row are a pool."""
    t = given(spark, sf_dir).groupBy("doc_id").agg(F.min_by("a", "pos").alias("a"), F.min_by("b", "pos").alias("b"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]), "").alias("body"))
    n = F.col("doc_id")
    return t.select(n.cast("string").alias("id"), F.floor(n / 40).cast("string").alias("pool"), (n % 6 + 1).cast("int").alias("grade"), F.when(n % 3 == 0, "下").otherwise("上").alias("semester"), F.concat(F.lit("第一单元 "), "b").alias("unit"), F.when(n % 4 == 0, (n % 9).cast("string")).otherwise("").alias("no"), F.col("a").alias("name"), "body")


@query()
def match_edition_tiers(spark, sf_dir):
    """Odd documents as new lessons against even ones as old lessons of their pool: tiers and ranks. Held against values worked out by hand in tests."""
    l = lessons_of_documents(spark, sf_dir)
    out = E.match_edition(l.filter("int(id) % 2 = 1"), l.filter("int(id) % 2 = 0"))
    return out.select("id", "old_id", "tier", F.col("rank").cast("int").alias("rank"))


# Records ----------------------------------------------------------------------------------------------


@query(
    f"WITH r AS (SELECT doc_id, pos, unnest([a, b]) AS ref, unnest([1, 2]) AS spot FROM {GIVEN} WHERE k < 9) SELECT ref, first(doc_id::VARCHAR ORDER BY doc_id * 1000000 + pos, spot) AS by_lesson, first(pos::VARCHAR ORDER BY doc_id * 1000000 + pos, spot) AS by_block FROM r GROUP BY 1"
)
def records_claims(spark, sf_dir):
    """Who first claimed each name: blocks are lines, some without claims."""
    refs = F.when(F.col("k") < 9, F.array(F.concat(F.lit(" "), F.col("a")), F.col("b"), F.lit(" ")))
    t = given(spark, sf_dir).select((F.col("doc_id") * 1000000 + F.col("pos")).alias("place"), F.col("doc_id").cast("string").alias("lesson"), F.col("pos").cast("string").alias("block"), refs.alias("refs"))
    return R.claims(t)


@query(
    f"WITH o AS (SELECT doc_id, pos, n, k % 4 AS u, a FROM {GIVEN} WHERE doc_id % 2 = 0), x AS (SELECT doc_id, pos, n, k % 3 AS u, b FROM {GIVEN} WHERE doc_id % 2 = 1 AND k < 10) "
    "SELECT id, old_id FROM (SELECT x.doc_id || '-' || x.pos AS id, o.doc_id || '-' || o.pos AS old_id, row_number() OVER (PARTITION BY x.doc_id, x.pos ORDER BY CASE WHEN x.u = o.u THEN 0 WHEN x.b = o.a THEN 1 ELSE 3 END, o.doc_id * 1000000 + o.pos) AS r FROM x JOIN o ON x.n = o.n AND (x.doc_id // 2) = (o.doc_id // 2)) WHERE r = 1"
)
def records_by_number(spark, sf_dir):
    """Old lessons of the same number: of the same unit, of the same title, else the first; the lessons of odd documents against those of the documents before them."""
    t = given(spark, sf_dir).withColumns({"pair": F.floor(F.col("doc_id") / 2).cast("string"), "id": F.concat_ws("-", *KEYS), "no": F.concat_ws("/", F.floor(F.col("doc_id") / 2).cast("string"), F.col("n").cast("string"))})
    old = t.filter("doc_id % 2 = 0").select(F.col("id").alias("old_id"), (F.col("doc_id") * 1000000 + F.col("pos")).alias("place"), "no", (F.col("k") % 4).alias("unit_no"), F.col("a").alias("unit"))
    new = t.filter("doc_id % 2 = 1").select("id", F.when(F.col("k") < 10, F.concat(F.lit(" "), F.col("no"))).otherwise("").alias("no"), (F.col("k") % 3).alias("unit_no"), F.col("b").alias("unit"))
    return R.by_number(new, old)


NAMED = [(("实验探究", "a"), ("实验观察", "b")), (("导入", "a"), ("导入", "b")), (("a",), ("b",)), ("", ("导入", "a")), ("探究", "练习")]
NAMED_CHARS = [(f"string_split({x}, '')", f"string_split({y}, '')") for x, y in (("'实验探究' || a", "'实验观察' || b"), ("'导入' || a", "'导入' || b"), ("a", "b"))]
NAMED_SHARES = [f"len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y})))" for x, y in NAMED_CHARS]


@query(given_sql(f"{told('1.0', '1.0', '0.0', '0.0', '0.0')}::DOUBLE AS kinds", f"round({told('0.7 / 3 + 0.3 * ' + NAMED_SHARES[0], '0.7 + 0.3 * ' + NAMED_SHARES[1], '0.3 * ' + NAMED_SHARES[2], '0.0', '0.0')}::DOUBLE, 6) AS names"))
def records_name_similarity(spark, sf_dir):
    """Whether names of blocks are of one kind that counts, and how many keywords (one of three where experiments are explored and observed) and characters they share."""
    x, y = forms(*[n[0] for n in NAMED]), forms(*[n[1] for n in NAMED])
    return given(spark, sf_dir).select(*KEYS, R.kind_match(x, y).alias("kinds"), F.round(R.name_similarity(x, y), 6).alias("names"))


@query(
    f"SELECT doc_id, pos, CASE WHEN k % 6 IN (0, 4) THEN NULL WHEN k % 6 = 1 THEN b WHEN k % 6 = 2 THEN a ELSE a END AS old_lesson, CASE WHEN k % 6 IN (0, 1, 4) THEN 'manual' ELSE 'auto' END AS method, CASE WHEN k % 6 = 1 THEN 'confirmed' WHEN k % 6 = 3 THEN 'rejected' ELSE 'suggested' END AS status FROM {GIVEN}"
)
def review_edits(spark, sf_dir):
    """Pairs of lessons cleared, set and confirmed, given a lesson of another volume and an unknown status, rejected, emptied, left alone."""
    t = given(spark, sf_dir).withColumn("id", F.concat_ws("-", *KEYS)).withColumn("volume", F.col("doc_id").cast("string"))
    named = lambda c: F.concat_ws("/", "id", c)
    p = t.select("id", F.col("volume").alias("old_volume"), named("a").alias("old_lesson"), F.lit("auto").alias("method"), F.lit("suggested").alias("status"))
    six = F.col("k") % 6
    lesson = F.when(six == 1, F.concat(F.lit(" "), named("b"))).when(six == 2, F.concat_ws("/", F.lit("other"), "id")).when(six == 4, "")
    e = t.filter(six < 5).select("id", F.when(six == 0, True).alias("clear"), lesson.alias("lesson"), F.when(six == 1, "confirmed").when(six == 2, "nonsense").when(six == 3, "rejected").alias("status"))
    lessons = t.select(named("b").alias("lesson"), "volume").unionByName(t.select(F.concat_ws("/", F.lit("other"), "id").alias("lesson"), F.lit("x").alias("volume")))
    out = W.edited_pairs(p, e, lessons, "id")
    return out.join(t.select("id", *KEYS), "id").select(*KEYS, F.element_at(F.split("old_lesson", "/"), -1).alias("old_lesson"), "method", "status")


@query(given_sql(f"{told('true', 'false', 'false', 'false')} AS complete", f"{told('false', 'true', 'false', 'true')} AS fragment"))
def review_blocks(spark, sf_dir):
    """Blocks with opening, activity and close; with next to nothing; with enough text; empty ones."""
    name, texts = forms("导入", ("a",), ("b",), ("a",)), forms(("观察", "a", "后小结"), "短", ("a", "b", "a", "b", "a", "b"), "")
    many = forms("1", "1", "1", "0").cast("int")
    none = F.lit(None).cast("string")
    c = W.is_complete(name, texts, many, none, F.lit(None).cast("boolean"))
    return given(spark, sf_dir).select(*KEYS, c.alias("complete"), W.is_fragment(name, texts, many, F.lit(0), none, c, F.lit(None).cast("boolean")).alias("fragment"))


@query(given_sql(f"{told(Q('旧块「') + ' || a || ' + Q('」在新教材已删除'), Q('请补充：旧课件哪页→新教材哪块→怎么改'), Q('旧课件P3-4；') + ' || CASE WHEN a = b THEN ' + Q('') + ' ELSE ' + Q('「') + ' || a || ' + Q('」→「') + ' || b || ' + Q('」；') + ' END || ' + Q('→新区块 B2；教材页旧P1→新P2；核心内容基本一致；可参考旧课件，更新文字/排版/页码'), Q('新教材新增「') + ' || b || ' + Q('」（B2）；旧教材无对应块；旧侧无原子文本，以新教材为准；需全新制作'), Q('旧课件P9；课件固定课件例题，无新教材对应块；旧课件该页可直接沿用；新侧无原子文本，需核对建块；旧课件可直接沿用'))} AS note"))
def review_notes(spark, sf_dir):
    """Notes on blocks that are gone, on pairs of which nothing is known, on pairs with pages and like texts, on new blocks, on the courseware's own pages."""
    none = F.lit(None).cast("string")
    at = lambda case, *pages: F.when(F.col("k") % 5 == case, F.array(*map(F.lit, pages)))
    pages = F.coalesce(at(2, 3, 4), at(4, 9))
    old, new = forms(("a",), (none,), ("a",), (none,), "课件例题1"), forms((none,), (none,), ("b",), ("b",), (none,))
    was, now = forms("", "", ("a", "b"), "", ("a",)), forms("", "", ("a", "b"), ("a",), "")
    action = forms("", "", "optimize", "new_build", "reuse_as_is")
    return given(spark, sf_dir).select(*KEYS, W.teacher_note(old, new, forms((none,), (none,), "B2", "B2", (none,)), pages, at(2, 1), at(2, 2), was, now, action).alias("note"))


# Pairs of lines: scores that SQL can't state, held against brute force in tests -------------------------


def neighbours(spark, sf_dir) -> DataFrame:
    """Each line with the one behind it in its document: doc_id, pos, x, y (whole lines)."""
    from .book_queries import document_lines

    l = document_lines(spark, sf_dir)
    # dealt to all cores: scores take far longer than the bytes of the lines say
    parts = 4 * spark.sparkContext.defaultParallelism
    x, y = l.select("doc_id", "pos", F.col("line").alias("x")), l.select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("line").alias("y"))
    return x.repartition(parts, *KEYS).join(y.repartition(parts, *KEYS), KEYS)


@query()
def similarity_ratios(spark, sf_dir):
    """Ratio, best stretch, tokens of each line and the next, both whole. Held against plain dynamic programming in tests."""
    x, y = F.col("x"), F.col("y")
    return neighbours(spark, sf_dir).select(*KEYS, *[F.round(f(x, y), 6).alias(n) for n, f in (("ratio", S.ratio), ("partial", S.partial), ("token_set", S.token_set))])


@query()
def similarity_raw_titles(spark, sf_dir):
    """Each lesson against the next: raw scores of lesson, unit and both, the paths through them and the tier. Held against values worked out by hand in tests."""
    t = formed(spark, sf_dir, *LESSONS).select(*KEYS, "t", unit_of_line().alias("u"))
    # keys are made once a line, before lines meet
    t = settled(t, lesson=T.lesson_reuse_match_key(F.col("t")), unit=T.unit_theme_match_key(F.col("u")))
    t = t.withColumn("context", T.merge_unit_key(F.col("u"), F.col("lesson"))).select(*KEYS, "lesson", "unit", "context")
    nxt = t.select("doc_id", (F.col("pos") - 1).alias("pos"), *[F.col(c).alias(f"{c}2") for c in ("lesson", "unit", "context")])
    # dealt to all cores: titles are short, so that partitions made by bytes would hold very many pairs to score
    parts = 4 * spark.sparkContext.defaultParallelism
    p = t.repartition(parts, *KEYS).join(nxt.repartition(parts, *KEYS), KEYS).withColumns({f"{c}_score": S.raw(F.col(c), F.col(f"{c}2")) for c in ("lesson", "unit", "context")})
    p = p.withColumn("title_score", S.paths(F.col("lesson_score"), F.col("unit_score"), F.col("context_score"), F.lit(False)))
    return p.select(*KEYS, *[F.round(c, 6).alias(c) for c in ("lesson_score", "unit_score", "context_score", "title_score")], D.core_match(F.col("title_score"), F.col("lesson_score"), F.col("unit_score"), F.col("context_score"), F.lit(0)).alias("core"))


@query()
def align_atoms(spark, sf_dir):
    """Pages of document lines against another reading of them in which boxes have run together: anchors one to one, and boxes without. Held against brute force in tests."""
    from .book_queries import merged_boxes, page_boxes

    new = page_boxes(spark, sf_dir)
    return A.align(merged_boxes(new), new, "pair").select("pair", "old_id", "new_id")


@query(given_sql(f"{told('1.0', '0.92', '1.0')}::DOUBLE AS score"))
def align_scores(spark, sf_dir):
    """Equal texts in place; the same beyond reach, long enough for the floor under moved texts; equal captions near each other."""
    text = F.when(F.col("k") % 3 == 1, of("a", "b", "a")).otherwise(of("a", "b", "a"))
    box = lambda y: F.struct(y.alias("y0"), (y + 0.1).alias("y1"), F.lit(0.1).alias("x0"), F.lit(0.9).alias("x1"), text.alias("text"))
    a, b = box(F.lit(0.1)), box(F.when(F.col("k") % 3 == 1, F.lit(0.9)).otherwise(F.lit(0.1)))
    return given(spark, sf_dir).select(*KEYS, F.round(A.anchor_score(a, b), 6).alias("score"))


@query()
def preview_pages(spark, sf_dir):
    """Which page of a document each line of another reading belongs to, by footer, contents, content or position. Held against values worked out by hand in tests."""
    t = given(spark, sf_dir)
    book = F.floor(F.col("doc_id") / 20).cast("string")
    old = t.groupBy(book.alias("book"), (F.col("doc_id") % 20 + 1).cast("int").alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "a", "b"))), lambda x: F.concat(x["a"], x["b"])), "").alias("text"))
    old = old.persist()  # pages are far smaller than the lines they are read from, and all steps start from them
    footed = F.when(F.col("page") % 3 == 0, F.concat("text", F.lit("\n"), F.col("page").cast("string"))).otherwise(F.substring("text", 9, 1 << 20))
    new = old.select("book", F.col("page"), F.when(F.col("page") % 5 == 0, F.concat(F.lit("k"), F.col("page").cast("string"))).alias("key"), footed.alias("text"))
    toc = old.filter("page % 5 = 0").select("book", F.concat(F.lit("k"), F.col("page").cast("string")).alias("key"), "page")
    return V.resolved_pages(new, old, toc, old.select("book").distinct().withColumn("offset", F.lit(0)), "book").select("book", "page", "old_page", "method")


CHANGED = [("L002", "reuse_as_is", "activity"), ("L009", "new_build", "intro"), ("L001", "new_build", "other"), ("L002", "reuse_as_is", "end"), ("L005", "reference", "other"), ("L006", "optimize", "other"), ("L004", "reference", "explain"), ("L008", "new_build", "other")]


@query(given_sql(f"{told(*[Q(x[0]) for x in CHANGED])} AS change_type", f"{told(*[Q(x[1]) for x in CHANGED])} AS action", f"{told(*[Q(x[2]) for x in CHANGED])} AS kind"))
def decide_change_types(spark, sf_dir):
    """Blocks that stay, of an opening with another text, without an old one, a courseware's last page, other names, another picture, other explanations, a new lesson: type of change, action and kind."""
    old, new = forms("实验探究", "导入", "", "课件尾页", "器材", "插图", "讲解", ""), forms("实验探究", "情境", "反思", "", "准备", "插图", "讲解", "新课")
    x = forms(("a", " ", "b"), "a", "", ("a",), ("a", " 水"), ("a",), ("a", "甲"), "")
    y = forms(("a", " ", "b"), ("b", "n"), ("a",), "", ("a", " 火"), ("a",), ("b", "n"), ("a",))
    r, t = forms("100", "0", "0", "0", "20", "90", "100", "0").cast("int"), forms("100", "10", "0", "0", "66", "70", "50", "0").cast("int")
    p = settled(given(spark, sf_dir), old=old, new=new, x=x, y=y, r=r, t=t)  # made once: rules use them many times
    old, new, x, y, r, t = (F.col(c) for c in ("old", "new", "x", "y", "r", "t"))
    has_old, has_new = old != "", new != ""
    p = settled(p, change_type=D.change_type(has_old, has_new, old, new, x, y, r, t, F.lit(False)))
    return p.select(*KEYS, "change_type", D.reuse_action(F.col("change_type"), has_old, has_new, old, t, (F.col("k") % 8).isin(0, 3, 5, 6)).alias("action"), D.block_kind(old, F.lit("")).alias("kind"))


def pictures_and_texts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every fifth line of a document is a picture on its page of ten lines, the others are texts around it; every seventh a caption."""
    t = given(spark, sf_dir).select("doc_id", "pos", "a", "b", "n").persist()  # a few characters of each line, read many times
    page, at = F.concat_ws("-", "doc_id", F.floor(F.col("pos") / 10).cast("string")), F.col("pos") % 10
    x = F.col("n") / 20
    box = [page.alias("page"), F.col("pos").cast("int").alias("id"), (at / 10).alias("y0"), (at / 10 + 0.08).alias("y1"), x.alias("x0"), (x + 0.4).alias("x1")]
    pictures = t.filter("pos % 5 = 2").select(*box, F.col("a").alias("label")).withColumnRenamed("id", "image")
    texts = t.filter("pos % 5 <> 2").select(*box, F.when(F.col("pos") % 7 == 0, of("图", "n", " ", "a")).otherwise(of("a", "b")).alias("text"), F.when(F.col("pos") % 7 == 0, "caption").otherwise("text").alias("kind"))
    return pictures, texts


@query()
def pictures_captions(spark, sf_dir):
    """Captions, nearest texts and phrases of pictures on pages of lines. Held against values worked out by hand in tests."""
    i, t = pictures_and_texts(spark, sf_dir)
    named, near = I.captions(i, t, "page").withColumnRenamed("text", "caption"), I.nearest_texts(i, t, "page").withColumnRenamed("text", "nearest")
    phrase = I.matched_phrases(i, t, "page").drop("score")
    return I.picture_rows(i.select("page", "image"), named, near, ["page", "image"]).join(phrase, ["page", "image"], "left")


@query()
def pictures_proximity(spark, sf_dir):
    """How near each text is to each picture of its page. Held against values worked out by hand in tests."""
    i, t = pictures_and_texts(spark, sf_dir)
    box = F.struct("y0", "y1", "x0", "x1")
    return i.select("page", "image", box.alias("p")).join(t.select("page", "id", box.alias("q")), "page").select("page", "image", "id", F.round(I.proximity(F.col("p"), F.col("q")), 6).alias("near"))


def files_and_lessons(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents as lessons of volumes of twenty, and files named by their id, by their numbers, by their names, or by nothing."""
    t = given(spark, sf_dir).filter("pos = 0").withColumns({"pool": F.floor(F.col("doc_id") / 20).cast("string"), "n": F.col("doc_id") % 20 + 1})
    unit = F.floor((F.col("n") - 1) / 5).cast("int") + 1
    lessons = t.select("pool", F.col("doc_id").cast("string").alias("lesson"), F.concat(F.lit("ID9"), F.lpad("doc_id", 7, "0")).alias("course_id"), unit.alias("unit_no"), F.concat(F.lit("第"), unit.cast("string"), F.lit("单元")).alias("unit"), ((F.col("n") - 1) % 5 + 1).cast("string").alias("no"), F.concat("a", "b").alias("name"))
    name = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("id9"), F.lpad("doc_id", 7, "0"), F.lit(" "), "a")).when(F.col("doc_id") % 4 == 1, F.concat(unit.cast("string"), F.lit("-"), ((F.col("n") - 1) % 5 + 1).cast("string"), F.lit(" 任意"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("课件_"), "a", "b")).otherwise("其他的东西")
    return t.select("pool", F.concat(name, F.lit(".zip")).alias("file")), lessons


@query()
def records_assigned_files(spark, sf_dir):
    """Files of volumes put to lessons one to one: by id, by unit and number, by name. Held against values worked out by hand in tests."""
    return R.assigned_files(R.file_candidates(*files_and_lessons(spark, sf_dir))).select("file", "lesson", F.round("score", 6).alias("score"))


@query()
def records_ranked_files(spark, sf_dir):
    """Files by how well they fit each lesson. Held against values worked out by hand in tests."""
    c = R.file_candidates(*files_and_lessons(spark, sf_dir))
    return R.ranked_files(c.filter("score >= 0.9")).select("file", "lesson", F.col("rank").cast("int").alias("rank"))


BOOKS = [("XK-", "n", "S-NEW 扫描版.pdf"), ("湘科版三年级上册 ", "n", ".pdf"), ("苏教版三年级上册 ", "n", ".pdf"), ("说明 ", "a", ".pdf"), ("xiangke 四下 ", "n", ".pdf")]


@query()
def records_book_scores(spark, sf_dir):
    """Files against the first volume of grade three of one edition: grade, term, what they say of the edition, the score. Held against values worked out by hand in tests."""
    f = settled(formed(spark, sf_dir, *BOOKS), gt=R.grade_and_term(F.col("t")))
    label, prefix = F.lit("湘科版"), F.lit("XK")
    return f.select(*KEYS, "gt.grade", "gt.term", R.edition_evidence(F.col("t"), label, prefix).alias("said"), R.book_score(F.col("t"), F.lit("XK-3S-NEW"), F.lit(3), F.lit("上"), label, prefix, F.lit(""), F.col("gt")).alias("score"))


@query()
def records_assigned_books(spark, sf_dir):
    """Files of each document put to the volumes of an edition, one to one. Held against values worked out by hand in tests."""
    f = formed(spark, sf_dir, *BOOKS).select(F.col("doc_id").cast("string").alias("pool"), F.col("t").alias("file"))
    v = f.select("pool").distinct()
    volume = lambda g, term, letter: v.select("pool", F.lit(f"XK-{g}{letter}-NEW").alias("code"), F.lit(g).alias("grade"), F.lit(term).alias("term"), F.lit("湘科版").alias("label"), F.lit("XK").alias("prefix"), F.lit("").alias("title"))
    return R.assigned_books(f, volume(3, "上", "S").unionByName(volume(4, "下", "X"))).select("pool", "file", "code")


@query(
    "WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n FROM lineitem) "
    "SELECT DISTINCT a.l_orderkey::VARCHAR AS new, b.l_orderkey || '-' || b.n AS lesson FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey WHERE a.n = 1 AND (b.n = 1 OR b.l_linestatus = a.l_linestatus OR abs(b.n - a.n) <= 2)"
)
def records_prescan_neighbours(spark, sf_dir):
    """The neighbours of the lesson that each new one matches: an order is a volume, its first line the match."""
    from .queries import lines

    l = lines(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("volume"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("lesson"), F.col("l_linestatus").alias("unit"), F.col("l_linenumber").alias("no"))
    return R.prescan_neighbours(l.filter("no = 1").select(F.col("volume").alias("new"), "lesson", F.lit(1).alias("rank")), l)


@query()
def records_suggestions(spark, sf_dir):
    """What each document's lines are worth as sources for the line behind them, with what others have claimed. Held against values worked out by hand in tests."""
    t = given(spark, sf_dir)
    blocks = t.filter("pos % 4 = 0").select((F.col("doc_id") * 1000000 + F.col("pos")).alias("place"), F.col("doc_id").cast("string").alias("lesson"), F.col("pos").cast("string").alias("block"), F.array(F.concat_ws("-", "doc_id", (F.col("pos") + 1).cast("string"))).alias("refs"))
    rows = t.select(F.concat_ws("-", *KEYS).alias("ref"), F.col("doc_id").cast("string").alias("lesson"), F.concat("a", "b").alias("name"), "a")
    out = R.claimed_rows(rows, R.claims(blocks), F.lit("0"), F.lit("1"))
    row = {"text": F.col("name"), "name": F.col("name"), "unit_no": F.lit(None).cast("int"), "same_lesson": F.col("same_lesson"), "locked": F.col("locked"), "used": F.col("used")}
    return out.select("ref", "same_lesson", "kind", "locked", "used", F.round(R.suggestion_score(F.concat(F.lit("导入"), F.col("a")), F.lit(""), F.lit(None).cast("int"), row), 6).alias("score"))
