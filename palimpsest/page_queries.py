"""Queries of the page comparison: fixtures with values worked out by hand, and whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import compare as C
from .functions import pages as G
from .operators import alignment as A
from .operators import pictures as I
from .operators import preview as V
from .operators.scans import settled
from .registry import query, table


NOISE = (
    "(length(s) <= 1 OR (contains(s, '人民教育出版社') AND length(s) < 20) OR regexp_matches(s, '(?i)CMYK|Time\\s*:\\s*\\d{4}/\\d{2}/\\d{2}|TLPC\\d+|SCGL|New\\s+D\\b|pdf_p\\d+|p\\d{4}_p\\d{4}') "
    "OR regexp_matches(s, 'S\\d{3}\\b') OR regexp_matches(s, '^[_./:\\-\\d\\s]+$') OR regexp_matches(s, '^[\\sL]+$'))"
)


@query(
    "WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '\\s+', ' ', 'g')) AS s FROM documents) "
    f"SELECT doc_id, count(*) FILTER (s <> '') AS n_lines, count(*) FILTER (s <> '' AND {NOISE}) AS n_noise FROM l GROUP BY 1"
)
def diff_scan_noise(spark, sf_dir):
    """Lines of each document, and those that a scan's cleaning drops."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(lines, lambda x: x != "").alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.size(F.filter("l", C.is_scan_noise)).cast("long").alias("n_noise"))


BLOB = "regexp_replace(array_to_string(list_filter(list_transform(string_split(coalesce({0}, ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda s: s <> '' AND NOT " + NOISE + "), chr(10)), '[\\s\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{feff}}\\x{{00a0}}\\x{{3000}}·●…．._—\\-]+', '', 'g')"
CUT = "regexp_replace(b, '([①②③④⑤⑥⑦⑧⑨⑩]|课题\\d+|图\\d+)', '。\\1', 'g')"
for _label in C.CLAUSE_LABELS:
    CUT = f"replace({CUT}, '{_label}', '。{_label}')"


@query(
    f"WITH d AS (SELECT doc_id, {BLOB.replace('{{', '{').replace('}}', '}').replace('{0}', 'text')} AS b FROM documents), c AS (SELECT doc_id, b, list_filter(regexp_split_to_array({CUT}, '[。！？；：]'), lambda x: length(x) >= 12) AS c FROM d) "
    "SELECT n.doc_id, len(n.c) AS n_clauses, len(list_filter(n.c, lambda x: NOT contains(coalesce(o.b, ''), x))) AS n_missing FROM c n LEFT JOIN c o ON o.doc_id = n.doc_id - 1"
)
def diff_missing_clauses(spark, sf_dir):
    """Clauses of each whole document, and those that the document before it doesn't have."""
    # a few large rows make a partition: dealt out by rows, and each text is read once a side
    d = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(4 * spark.sparkContext.defaultParallelism)
    d = settled(d, blob=C.page_blob(F.col("text"))).drop("text")
    before = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("blob").alias("before"))
    p = settled(d.join(before, "doc_id", "left"), some=C.clauses_of(F.col("blob")))
    return p.select("doc_id", F.size("some").cast("long").alias("n_clauses"), F.size(C.missing_from(F.col("some"), F.coalesce("before", F.lit("")))).cast("long").alias("n_missing"))


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN 1 - l_tax * 8 >= 0.88 THEN '基本一致' WHEN 1 - l_tax * 8 >= 0.70 THEN '局部改写' WHEN 1 - l_tax * 8 >= 0.45 THEN '明显修改' ELSE '大幅重写' END AS level, "
    "CASE WHEN l_linenumber = 1 THEN '封面，不参与正文对比。' WHEN l_linenumber = 2 THEN '新课标目录页，页码体系与旧书不同。' ELSE coalesce(nullif(l_returnflag, 'N'), '不参与正文对比。') END AS skipped FROM lineitem"
)
def diff_levels(spark, sf_dir):
    """The level of change by similarity, and what is said of a page that isn't compared."""
    kind = C.draft_kind(F.col("l_linenumber"), F.lit("正文"), F.col("l_linenumber") == 2)
    note = F.nullif(F.col("l_returnflag"), F.lit("N"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.level_name(1 - F.col("l_tax") * 8).alias("level"), C.skip_summary(kind, note).alias("skipped"))


@query(
    "SELECT l_orderkey, l_linenumber, round(least(l_quantity / 100, 1), 4) AS x0, round(CASE WHEN least(l_quantity / 100 + l_tax, 1) <= least(l_quantity / 100, 1) THEN least(least(l_quantity / 100, 1) + 0.02, 1) ELSE least(l_quantity / 100 + l_tax, 1) END, 4) AS x1 FROM lineitem"
)
def layout_normal_boxes(spark, sf_dir):
    """Boxes in pixels of a page of 1000 by 2000, brought to shares of it."""
    l = table(spark, sf_dir, "lineitem")
    b = F.struct((F.col("l_quantity") * 10).alias("x0"), F.lit(500.0).alias("y0"), (F.col("l_quantity") * 10 + F.col("l_tax") * 1000).alias("x1"), F.lit(900.0).alias("y1"))
    return l.select("l_orderkey", "l_linenumber", G.normal_box(b, F.lit(1000.0), F.lit(2000.0)).alias("b")).select("l_orderkey", "l_linenumber", "b.x0", "b.x1")


@query(
    "WITH b AS (SELECT l_orderkey AS page, l_linenumber AS id, l_discount * 5 AS x0, l_tax * 5 AS y0, l_discount * 5 + l_quantity / 100 AS x1, l_tax * 5 + l_quantity / 100 AS y1 FROM "
    "(SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS l_linenumber) FROM lineitem)), "
    "p AS (SELECT a.page, a.id AS part, b.id AS figure, (a.x0 + a.x1) / 2 AS cx, (a.y0 + a.y1) / 2 AS cy, b.x0, b.x1, b.y0, b.y1, (b.x1 - b.x0) * (b.y1 - b.y0) AS area, "
    "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)) AS cov FROM b a JOIN b b ON a.page = b.page AND a.id % 2 = 1 AND b.id % 2 = 0), "
    "q AS (SELECT *, cx BETWEEN x0 - 0.01 AND x1 + 0.01 AND cy BETWEEN y0 - 0.01 AND y1 + 0.01 AS ins, pow(cx - (x0 + x1) / 2, 2) + pow(cy - (y0 + y1) / 2, 2) AS gap FROM p), "
    "h AS (SELECT *, row_number() OVER (PARTITION BY page, part ORDER BY ins DESC, CASE WHEN ins THEN round(area, 9) END, CASE WHEN ins THEN round(gap, 9) END, round(cov, 9) DESC, figure) AS k FROM q WHERE ins OR cov >= 0.45) SELECT page, part, figure FROM h WHERE k = 1"
)
def layout_figure_parts(spark, sf_dir):
    """Boxes of odd number bound to the smallest figure (even number) around their centre."""
    from .queries import boxes, lines

    l = lines(spark, sf_dir)
    q = F.col("l_quantity") / 100
    b = l.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), (F.col("l_discount") * 5).alias("x0"), (F.col("l_tax") * 5).alias("y0"), (F.col("l_discount") * 5 + q).alias("x1"), (F.col("l_tax") * 5 + q).alias("y1"))
    return A.figure_parts(b.filter("id % 2 = 1"), b.filter("id % 2 = 0"), "page", 0.01)


@query(
    "WITH b AS (SELECT l_orderkey AS page, l_linenumber AS id, l_discount * 5 AS x0, l_tax * 5 AS y0, l_discount * 5 + l_quantity / 100 AS x1, l_tax * 5 + l_quantity / 100 AS y1 FROM "
    "(SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS l_linenumber) FROM lineitem)), "
    "h AS (SELECT a.page, b.id AS outer_id, a.id, (a.x1 - a.x0) * (a.y1 - a.y0) / ((b.x1 - b.x0) * (b.y1 - b.y0)) AS share, "
    "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)) AS cov FROM b a JOIN b b ON a.page = b.page "
    "WHERE (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1) "
    "SELECT page, outer_id, array_to_string(list_sort(list(id)), ',') AS ids FROM h WHERE share <= 0.92 AND (cov >= 0.55 OR share <= 0.45) GROUP BY 1, 2 HAVING count(*) >= 2"
)
def layout_boxes_inside(spark, sf_dir):
    from .queries import lines

    q = F.col("l_quantity") / 100
    b = lines(spark, sf_dir).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), (F.col("l_discount") * 5).alias("x0"), (F.col("l_tax") * 5).alias("y0"), (F.col("l_discount") * 5 + q).alias("x1"), (F.col("l_tax") * 5 + q).alias("y1"))
    return A.boxes_inside(b, b, "page").select("page", F.col("outer").alias("outer_id"), F.array_join("ids", ",").alias("ids"))


@query(
    "WITH h AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings), p AS (SELECT x.vec_id, x.a, y.a AS b FROM h x LEFT JOIN h y ON y.vec_id = x.vec_id + 1), "
    "v AS (SELECT vec_id, unnest(a) AS s, unnest(b) AS t FROM p WHERE b IS NOT NULL) SELECT p.vec_id, coalesce(round((c + 1) / 2, 6), 0) AS score FROM p LEFT JOIN (SELECT vec_id, corr(s, t) AS c FROM v GROUP BY 1) USING (vec_id)"
)
def pictures_histograms(spark, sf_dir):
    """The correlation of histograms, over the vectors of the table and their followers."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(nxt, "vec_id", "left").select("vec_id", F.round(I.histogram_similarity(F.col("embedding"), F.col("b")), 6).alias("score"))


@query(
    "WITH p AS (SELECT l_suppkey, l_orderkey AS page, l_returnflag <> 'R' AS c, CASE WHEN l_discount < 0.03 THEN '基本一致' WHEN l_discount < 0.08 THEN '局部改写' END AS ch, CASE WHEN l_tax > 0 THEN 1 - l_tax * 5 END AS s FROM lineitem), "
    "n AS (SELECT l_suppkey, coalesce(ch, '未知') AS ch, count(*) AS n FROM p WHERE c GROUP BY 1, 2), b AS (SELECT l_suppkey, string_agg(ch || '=' || n, ',' ORDER BY ch) AS levels FROM n GROUP BY 1), "
    "r AS (SELECT l_suppkey, page, row_number() OVER (PARTITION BY l_suppkey ORDER BY s, page) AS k FROM p WHERE c AND coalesce(s, 1.0) < 0.75), f AS (SELECT l_suppkey, string_agg(page, ',' ORDER BY k) AS focus FROM r WHERE k <= 10 GROUP BY 1) "
    "SELECT l_suppkey, count(*) FILTER (c) AS comparable, count(*) FILTER (NOT c) AS skipped, any_value(levels) AS levels, any_value(focus) AS focus FROM p LEFT JOIN b USING (l_suppkey) LEFT JOIN f USING (l_suppkey) GROUP BY 1"
)
def preview_summary(spark, sf_dir):
    d = F.col("l_discount")
    p = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("page"), (F.col("l_returnflag") != "R").alias("comparable"), F.when(d < 0.03, "基本一致").when(d < 0.08, "局部改写").alias("change"), F.when(F.col("l_tax") > 0, 1 - F.col("l_tax") * 5).alias("similarity"))
    s = V.pair_summary(p, "l_suppkey")
    levels = F.array_join(F.transform(F.map_entries("by_change"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.select("l_suppkey", "comparable", "skipped", levels.alias("levels"), F.array_join("focus", ",").alias("focus"))


