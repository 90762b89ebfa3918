"""Queries of books made of the given documents: a document's lines are boxes and pages, documents of one source a book."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import alignment as A
from .operators import containment as N
from .operators import continued as P
from .operators import grid as G
from .operators import located as O
from .operators import scans as S
from .operators import starts as B
from .queries import LINES_SQL, lines
from .registry import query, table

#: Lines of a page, documents of a book.
LINES, PAGES = 10, 40
# The character that stands for each letter where texts are read as Chinese; the first ones begin titles.
HAN_FOR = str.maketrans("abcdefghijklmnopqrstuvwxyz", "水的课题目录第一单元小结与实验活动整理提升复习高附言")
LETTERS, CHARACTERS = "".join(map(chr, HAN_FOR)), "".join(map(chr, HAN_FOR.values()))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos (from 0), line: the lines of all documents that aren't blank."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    # dealt to all cores, since a few large rows make a partition; queries that read the lines more than once do so from one exchange
    d = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")
    return d.select("doc_id", F.posexplode(lines).alias("pos", "line"))


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair, id, y0, y1, x0, x1, text: lines of documents as the boxes of pages of LINES lines each."""
    l = document_lines(spark, sf_dir)
    at = F.col("pos") % LINES
    pair = F.concat_ws("-", "doc_id", F.floor(F.col("pos") / LINES))
    return l.select(pair.alias("pair"), at.cast("long").alias("id"), (at / LINES).alias("y0"), ((at + 1) / LINES).alias("y1"), F.lit(0.1).alias("x0"), F.lit(0.9).alias("x1"), F.col("line").alias("text"))


def merged_boxes(boxes: DataFrame) -> DataFrame:
    """The boxes as another reading might give them: every third one, if its text says so, is part of the one above it."""
    joins = (F.col("id") % 3 == 2) & (F.crc32(F.col("text").cast("binary")) % 2 == 0)
    whole = boxes.withColumn("host", F.when(joins, F.col("id") - 1).otherwise(F.col("id")))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "")
    return whole.groupBy("pair", F.col("host").alias("id")).agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), texts.alias("text"))


@query()
def align_rebound(spark, sf_dir):
    """Pages aligned with another reading of them in which boxes have run together; boxes that cover several are cut. Held against brute force in tests."""
    new = page_boxes(spark, sf_dir)
    old = merged_boxes(new)
    anchors = A.align(old, new, "pair").filter("old_id IS NOT NULL AND new_id IS NOT NULL")
    out = N.rebind(old, new, anchors, "pair")
    return out.select("pair", "old_id", "new_id", "part", "parts", "cut", F.round("score", 6).alias("score"), F.md5(F.col("old_text")).alias("old_md5"), F.md5(F.col("new_text")).alias("new_md5"), F.round("y0", 6).alias("y0"), F.round("y1", 6).alias("y1"))


@query(
    "SELECT doc_id, item_id, i AS at, length(p) AS size FROM (SELECT d.doc_id, b.item_id, d.text AS t, b.text AS p, unnest(list_filter(range(0, length(d.text)), lambda i: substr(d.text, i + 1, length(b.text)) = b.text)) AS i FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND b.text <> '')"
)
def match_located_passages(spark, sf_dir):
    """Where benchmark passages stand word for word in documents."""
    return O.located(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


EDGES = "[\\s\\x{200b}\\x{200c}\\x{200d}\\x{feff}\\x{00a0}\\x{3000}·●…．._—\\-]+"


@query(
    "WITH n AS (SELECT doc_id, list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> ''), lambda x: trim(x)) AS l FROM documents) "
    f"SELECT doc_id, len(l) AS n_pieces, md5(array_to_string(list_transform(l, lambda x: coalesce(nullif(regexp_replace(x, '^{EDGES}|{EDGES}$', '', 'g'), ''), x)), chr(10))) AS pieces FROM n WHERE len(l) > 0"
)
def match_cut_texts(spark, sf_dir):
    """Texts put together of their lines are cut at the lines again, however the blanks between them are; dots at a piece's ends don't count."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    d = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(4 * spark.sparkContext.defaultParallelism)  # a few large rows make a partition
    d = S.settled(d, l=lines).drop("text").filter(F.size("l") > 0)
    pieces = O.cut_at(F.array_join("l", "  "), F.col("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("n_pieces"), F.md5(F.array_join(pieces, "\n")).alias("pieces"))


# Boxes ------------------------------------------------------------------------------------------------

BOX = f"SELECT l_orderkey AS page, l_linenumber AS id, l_discount * 5 AS x0, l_tax * 5 AS y0, l_discount * 5 + l_quantity / 100 AS x1, l_tax * 5 + l_quantity / 200 AS y1, l_linestatus || l_linenumber AS text, CASE WHEN l_returnflag = 'R' THEN 'title' ELSE 'text' END AS kind FROM {LINES_SQL} AS l"
SHARED = "greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, id, x0, y0, x1, y1, text, kind: lines of orders as boxes of pages."""
    q = F.col("l_quantity")
    kind = F.when(F.col("l_returnflag") == "R", "title").otherwise("text")
    corners = [(F.col("l_discount") * 5).alias("x0"), (F.col("l_tax") * 5).alias("y0"), (F.col("l_discount") * 5 + q / 100).alias("x1"), (F.col("l_tax") * 5 + q / 200).alias("y1")]
    return lines(spark, sf_dir).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), *corners, F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("text"), kind.alias("kind"))


@query(
    f"WITH b AS ({BOX}), p AS (SELECT a.page, a.id AS a_id, b.id AS b_id, {SHARED} AS o, (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb FROM b a JOIN b ON a.page = b.page AND a.id < b.id "
    "AND greatest(a.x0, b.x0) <= least(a.x1, b.x1) AND greatest(a.y0, b.y0) <= least(a.y1, b.y1)) SELECT page, a_id, b_id, round(CASE WHEN sa + sb - o > 0 THEN o / (sa + sb - o) ELSE 0 END, 6) AS iou FROM p"
)
def layout_grid_overlaps(spark, sf_dir):
    """Boxes that have a point in common, met through a grid."""
    from .functions import similarity as S_

    return G.overlapping(boxes(spark, sf_dir), "page").select("page", "a_id", "b_id", F.round(S_.iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query()
def layout_distinct_pictures(spark, sf_dir):
    """Frames that stay when of any two frames of one picture one goes. Held against brute force in tests."""
    return G.distinct_pictures(boxes(spark, sf_dir), "page").select("page", "id")


@query()
def layout_pinyin_pairs(spark, sf_dir):
    """Lines of orders as boxes of pinyin and of Han characters: which belongs over which. Held against brute force in tests."""
    b = boxes(spark, sf_dir).withColumn("text", F.when(F.col("kind") == "title", "shuǐ dī").otherwise("水滴"))
    return G.pinyin_pairs(b, "page")


ROWS = f"""
WITH RECURSIVE b AS ({BOX}), e AS (SELECT *, (y0 + y1) / 2 AS y, y1 - y0 AS h, row_number() OVER (PARTITION BY page ORDER BY (y0 + y1) / 2, x0, id) AS n FROM b),
g AS (
  SELECT page, id, n, 1 AS row, [{{'y': y, 'h': h}}] AS heads FROM e WHERE n = 1
  UNION ALL
  SELECT page, id, n, CASE WHEN hit IS NULL THEN len(heads) + 1 ELSE hit END, CASE WHEN hit IS NULL THEN list_append(heads, {{'y': y, 'h': h}}) ELSE heads END FROM (
    SELECT e.page, e.id, e.n, e.y, e.h, g.heads, nullif(list_position(list_transform(g.heads, lambda k: abs(k.y - e.y) <= greatest(0.018, 0.55 * least(k.h, e.h))), true), 0) AS hit FROM g JOIN e ON e.page = g.page AND e.n = g.n + 1)
), r AS (SELECT e.*, g.row FROM g JOIN e USING (page, id)),
s AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY page, row ORDER BY x0, y, id) AS step FROM r),
l AS (SELECT page, row, list_sort(list(step) FILTER (step > 0), 'DESC') AS gaps FROM s GROUP BY 1, 2),
p AS (SELECT s.*, sum(CASE WHEN step > CASE WHEN len(gaps) IS NULL OR len(gaps) = 0 THEN 0.14 WHEN len(gaps) > 1 AND gaps[1] > gaps[2] * 2.2 THEN greatest(0.10, least(0.14, gaps[2] * 1.15)) ELSE greatest(0.12, least(0.14, gaps[1] * 1.15)) END THEN 1 ELSE 0 END)
  OVER (PARTITION BY page, row ORDER BY x0, y, id) AS part FROM s JOIN l USING (page, row))
SELECT page, row, part::BIGINT AS part, string_agg(id, ',' ORDER BY x0, y, id) AS ids, round(min(x0), 4) AS x0, round(max(y1), 4) AS y1, string_agg(text, '' ORDER BY x0, y, id) AS text, CASE WHEN bool_or(kind = 'title') THEN 'title' ELSE 'text' END AS kind FROM p GROUP BY 1, 2, 3
"""


@query(ROWS)
def layout_text_rows(spark, sf_dir):
    """Boxes in one line of sight, cut at wide gaps, made one."""
    return G.rows_of(boxes(spark, sf_dir), "page").select("page", "row", "part", F.array_join("ids", ",").alias("ids"), "x0", "y1", "text", "kind")


# Books ------------------------------------------------------------------------------------------------


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, page, text: PAGES documents in a row are a book."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.floor(F.col("doc_id") / PAGES).alias("book"), (F.col("doc_id") % PAGES + 1).alias("page"), F.coalesce("text", F.lit("")).alias("text"))


@query()
def sequence_lesson_starts(spark, sf_dir):
    """Lessons named by the first lines of every third page put on pages, in order, by what their titles are worth there and by a hint that is some pages off. Held against brute force in tests."""
    p = book_pages(spark, sf_dir).withColumn("head", B.page_head(F.col("text")))
    titled = p.filter("page % 3 = 0").select("book", (F.col("page") / 3).cast("long").alias("lesson"), B.T.norm_text(F.substring_index("text", "\n", 1), normal=False).alias("title"), (F.col("page") - F.col("book") % 3).alias("hint"))
    met = titled.join(p.drop("text"), "book").withColumn("title_worth", B.head_worth(F.col("head"), F.col("title")))
    scored = met.filter("title_worth > 0").withColumn("worth", F.col("title_worth") * 100 + B.hint_worth(F.col("page"), F.col("hint")))
    return B.lesson_starts(scored, "book")


PLAN = """
WITH l AS (SELECT l_suppkey AS volume, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS pos, * FROM lineitem),
s AS (SELECT volume, pos, l_returnflag AS unit, CASE WHEN l_discount >= 0.02 THEN pos * 4 + (l_quantity % 3)::BIGINT END AS start FROM l),
k AS (SELECT *, last_value(start IGNORE NULLS) OVER (PARTITION BY volume ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known, first_value(start IGNORE NULLS) OVER (PARTITION BY volume ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
  count(*) OVER (PARTITION BY volume) AS n, count(start) OVER (PARTITION BY volume) AS have FROM s),
f AS (SELECT *, n * 4 + 9 AS total, 3 AS off, coalesce(start, CASE WHEN known IS NOT NULL AND nxt IS NOT NULL THEN greatest(known, least(nxt, known + 1)) WHEN known IS NOT NULL THEN known + 1 ELSE greatest(1, nxt - 1) END) AS s FROM k WHERE have = n OR (have >= 3 AND have >= floor(n * 0.65))),
e AS (SELECT *, greatest(s, coalesce(lead(s) OVER w - CASE WHEN lead(unit) OVER w IS DISTINCT FROM unit THEN 2 ELSE 1 END, greatest(1, total - off))) AS t FROM f WINDOW w AS (PARTITION BY volume ORDER BY pos))
SELECT volume, pos, s AS logical_start, s + off AS physical_start, least(greatest(s + off, t + off), total) AS physical_end, start IS NULL AS filled FROM e
"""


@query(PLAN)
def sequence_page_plan(spark, sf_dir):
    """A plan of pages for the volumes where enough starts are known; the others filled in between."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    l = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(w).cast("long"))
    start = F.when(F.col("l_discount") >= 0.02, F.col("pos") * 4 + (F.col("l_quantity") % 3).cast("long"))
    lessons = l.select(F.col("l_suppkey").alias("volume"), "pos", F.col("l_returnflag").alias("unit"), start.alias("start"), (F.count("*").over(Window.partitionBy("l_suppkey")) * 4 + 9).alias("total"), F.lit(3).alias("offset"))
    return B.page_plan(lessons, "volume").select("volume", "pos", "logical_start", "physical_start", "physical_end", "filled")


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, page, id, y0, y1, x0, text: lines of documents as boxes, pages of LINES lines, a document a book."""
    b = page_boxes(spark, sf_dir)
    return b.select(F.substring_index("pair", "-", 1).cast("long").alias("book"), F.substring_index("pair", "-", -1).cast("long").alias("page"), "id", "y0", "y1", "x0", "text")


STITCHED = r"""
WITH d AS (SELECT doc_id AS book, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
x AS (SELECT book, (i // 10)::BIGINT AS page, i % 10 AS k, len(l) AS n, trim(l[i + 1]) AS t, i, trim(l[i + 2]) AS lead FROM (SELECT *, unnest(range(0, len(l))) AS i FROM d)),
m AS (SELECT *, regexp_replace(t, '[ \t\n\x0b\f\r]+', '', 'g') AS bare, regexp_replace(lead, '[ \t\n\x0b\f\r]+', '', 'g') AS head, regexp_replace(t, 'EDGES', '', 'g') AS own, regexp_replace(lead, 'EDGES', '', 'g') AS ln FROM x),
g AS (SELECT *, k = 9 AND i + 1 < n AND bare <> '' AND NOT contains('。！？!?…；;.”"』」', right(bare, 1)) AND head <> '' AND NOT regexp_matches(head, '^[\d(（第◇◆◊♦●•○□■▪▫※①-⑳]')
  AND NOT regexp_matches(head, '^(选一个|选做|读一读|读下面|写一写|和同学|体会)') AND NOT (ln <> '' AND contains(right(own, greatest(24, length(ln))), left(ln, 8))) AS goes FROM m),
c AS (SELECT *, sum(CASE WHEN coalesce(before, false) THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY i) AS chain FROM (SELECT *, lag(goes) OVER (PARTITION BY book ORDER BY i) AS before FROM g))
SELECT book, chain::BIGINT AS chain, min(page) AS first_page, count(DISTINCT page) AS pages, count(*) AS parts, md5(string_agg(t, '' ORDER BY i)) AS text FROM c GROUP BY 1, 2
""".replace("EDGES", EDGES)


@query(STITCHED)
def sequence_continued_paragraphs(spark, sf_dir):
    """Lines of documents as paragraphs, those at the ends of pages put together with what goes on behind."""
    return P.continued(line_boxes(spark, sf_dir), "book").select("book", "chain", "first_page", "pages", "parts", F.md5("text").alias("text"))


@query()
def align_absorbed_fragments(spark, sf_dir):
    """Short lines at the edges of pages whose text stands at the near edge of the neighbouring page of another reading, where boxes have run together. Held against brute force in tests."""
    new = page_boxes(spark, sf_dir)
    book = lambda b: b.select(F.substring_index("pair", "-", 1).cast("long").alias("book"), F.substring_index("pair", "-", -1).cast("long").alias("page"), "id", "y0", "y1", "text")
    loose = book(new).withColumn("text", F.substring_index("text", " ", 3)).unionByName(book(new).withColumns({"id": F.col("id") + 100, "text": F.substring_index("text", " ", -3)}))
    shifted = book(merged_boxes(new)).withColumn("page", F.col("page") + 1)
    return P.absorbed(loose, shifted, "book")


# Catalogues -------------------------------------------------------------------------------------------


def han_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume, pos, h: lines of documents in Chinese characters, made once a line."""
    l = document_lines(spark, sf_dir).select(F.col("doc_id").alias("volume"), F.col("pos").cast("long").alias("pos"), "line")
    return S.settled(l, h=F.regexp_replace(F.translate(F.lower("line"), LETTERS, CHARACTERS), r"[^\x{4e00}-\x{9fff}]+", "")).select("volume", "pos", "h")


def catalogue_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume, pos, line: lines of documents read as lines of a catalogue in Chinese, a document a volume: units, two units in a line, lessons with and without page, two in a line, summaries."""
    l = han_lines(spark, sf_dir)
    n, k = F.col("pos"), F.col("pos") % 11
    name = lambda a: F.substring("h", a, 5)
    of = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    no, page = (n % 30 + 1).cast("string"), (n * 2 + 3).cast("string")
    line = (
        F.when(k == 0, of("第", (n % 9 + 1).cast("string"), "单元 ", name(1))).when(k == 4, of(no, name(1), " ", page, " ", (n % 30 + 2).cast("string"), name(6)))
        .when(k == 6, of("第一单元 ", name(1), " 第二单元 ", name(6))).when(k == 8, of(name(1), "单元小结 ", page)).when(k == 9, name(1)).otherwise(of(no, " ", name(1), "……", page))
    )
    return l.select("volume", "pos", line.alias("line"))


@query()
def contents_scanned_catalogue(spark, sf_dir):
    """Lessons of catalogues under their units, with two columns and summaries, scanned in parts. Held against a scan in one part, and lines worked out by hand, in tests."""
    return S.catalogue_rows(catalogue_text(spark, sf_dir), "volume")


def experiment_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume, pos, line: lines of documents read as lines of contents pages with topics, experiments, titles over several lines, and an end."""
    l = han_lines(spark, sf_dir)
    n, k = F.col("pos"), F.col("pos") % 13
    name, no = F.substring("h", 1, 6), (n % 9 + 1).cast("string")
    of = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    line = (
        F.when(k == 0, "目 录").when(k == 1, of("绪论 ", name)).when(k == 2, of("第", no, "单元 ", name)).when(k == 3, of("课题", no, " ", name)).when(k == 4, of("与", name)).when(k == 5, of("实验活动", no)).when(k == 7, of("课题", no, " ", name, " 12"))
        .when(k == 8, "").when(k == 10, "整理与提升").when((k == 12) & (n > 40), "针对每课题梳理").otherwise(name)
    )
    return l.select("volume", "pos", line.alias("line"))


@query()
def contents_experiments(spark, sf_dir):
    """Lessons, topics and experiments of contents pages with titles that go on over lines, scanned in parts. Held against a scan in one part, and lines worked out by hand, in tests."""
    return S.experiment_contents(experiment_text(spark, sf_dir), "volume")


@query("SELECT l_orderkey, pos, last_value(CASE WHEN l_discount > 0.05 THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_returnflag ORDER BY pos) AS part, last_value(CASE WHEN l_tax > 0.06 THEN l_suppkey END IGNORE NULLS) OVER (PARTITION BY l_returnflag ORDER BY pos) AS supplier "
       "FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos FROM lineitem)")
def sequence_carried_values(spark, sf_dir):
    """The last parts and suppliers that count, carried on over the lines of each return flag: three groups that are a third of all rows each, scanned in parts."""
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")
    l = S.numbered(l, "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], "pos").select("l_returnflag", "l_orderkey", "pos", "l_discount", "l_tax", "l_partkey", "l_suppkey")
    out = S.carried(l, "l_returnflag", "pos", {"part": F.when(F.col("l_discount") > 0.05, F.col("l_partkey")), "supplier": F.when(F.col("l_tax") > 0.06, F.col("l_suppkey"))}, 1000)
    return out.select("l_orderkey", "pos", "part", "supplier")


# Sheets -----------------------------------------------------------------------------------------------


@query(
    "SELECT p_brand AS sheet, row, n AS grade, CASE WHEN row % 2 = 0 THEN '下' ELSE '上' END AS semester, row::VARCHAR AS lesson_no, p_name AS lesson_name, p_type AS unit_title, p_size AS page_count, CASE WHEN p_partkey % 3 > 0 THEN 'C' || p_partkey ELSE '' END AS old_course_id "
    "FROM (SELECT *, p_partkey % 6 + 1 AS n, 1 + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS row FROM part) WHERE p_partkey % 5 > 0 AND p_partkey % 7 > 0"
)
def contents_lesson_rows(spark, sf_dir):
    """Parts as the rows of sheets, a brand a sheet, with a header each: lessons with grade, term, number, name and pages; rows without a lesson or a grade are left out."""
    from pyspark.sql import Window

    from .sources.workbook import lesson_rows

    p = table(spark, sf_dir, "part").withColumn("row", (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) + 1).cast("long"))
    k, text = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    grade = F.when(k % 7 == 0, "无").otherwise(F.concat((k % 6 + 1).cast("string"), F.lit(" 年级")))
    lesson = F.when(k % 5 == 0, "").otherwise(F.concat(text("row"), F.lit(". "), F.col("p_name")))
    term = F.when(F.col("row") % 2 == 0, "下册").otherwise("上册")
    cells = F.array(F.lit("v1"), grade, term, F.col("p_type"), lesson, F.when(k % 3 > 0, F.concat(F.lit("C"), text("p_partkey"))), text("p_size"))
    rows = p.select(F.col("p_brand").alias("sheet"), "row", cells.alias("cells"))
    head = p.select(F.col("p_brand").alias("sheet")).distinct().select("sheet", F.lit(1).cast("long").alias("row"), F.array(*map(F.lit, ["版本", "年级", "学期", " 单元 ", "节", "课件ID", "页数"])).alias("cells"))
    out = lesson_rows(rows.unionByName(head), ["sheet"])
    return out.select("sheet", "row", "grade", "semester", "lesson_no", "lesson_name", "unit_title", "page_count", "old_course_id")
