"""Queries of the edition-alignment operators over the driver's tables and small inline catalogues, each with its SQL where SQL can state it.

Roles: lineitem is blocks (order = lesson, line = place, returnflag and linestatus = actions), orders are lessons, events
are dated steps, documents and benchmark are old and new texts, part and customer are catalogues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import decisions as D
from .functions import similarity as S
from .functions import text as T
from .operators import catalogue as C
from .operators import matching as M
from .operators import progress as P
from .operators import rollup as R
from .operators import sequence as Q
from .registry import QUERIES, SQL, query, table


@query(
    "SELECT p_partkey, upper(substr(p_brand, 1, 8)) || '-' || p_size || CASE WHEN p_partkey % 2 = 1 THEN 'S' ELSE 'X' END || '-NEW' AS volume_code, "
    "p_brand || '-' || p_size || '-' || CASE WHEN p_partkey % 2 = 1 THEN '上' ELSE '下' END || '-new' || CASE WHEN p_partkey % 3 + 1 > 1 THEN '-v' || (p_partkey % 3 + 1) ELSE '' END || '-U' || (p_partkey % 7) || '-L' || (p_partkey % 11) AS lesson_uid FROM part"
)
def text_codes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    sem = F.when(F.col("p_partkey") % 2 == 1, "上").otherwise("下")
    no = (F.col("p_partkey") % 11).cast("string")
    return p.select("p_partkey", T.make_volume_code(F.col("p_brand"), F.col("p_size"), sem, F.lit("new")).alias("volume_code"), T.make_lesson_uid(F.col("p_brand"), F.col("p_size"), sem, F.lit("new"), F.col("p_partkey") % 7, no, F.col("p_partkey") % 3 + 1).alias("lesson_uid"))


@query(
    "WITH l AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS p FROM lineitem WHERE l_quantity > 10 GROUP BY 1) "
    "SELECT l_orderkey, CASE WHEN len(p) = 1 THEN 'P' || p[1] WHEN p[-1] - p[1] = len(p) - 1 THEN 'P' || p[1] || '-' || p[-1] ELSE 'P' || array_to_string(p, '/P') END AS pages FROM l"
)
def text_page_ranges(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("p"))
    return l.select("l_orderkey", T.format_cw_range(F.col("p")).alias("pages"))


@query(
    "SELECT doc_id, left(t, 40) || CASE WHEN length(t) > 40 THEN '…' ELSE '' END AS excerpt, length(regexp_replace(n, '[，。！？、；：\"''（）【】《》…·\\-—]', '', 'g')) AS n_compare FROM "
    "(SELECT doc_id, trim(replace(text, chr(10), ' ')) AS t, regexp_replace(text, '\\s+', '', 'g') AS n FROM documents)"
)
def text_excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"), F.length(T.normalize_compare_text(F.col("text"))).cast("long").alias("n_compare"))


#: Tasks that the pairs of a brand are dealt out to.
SHARES = 16

JACCARD = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"


@query(
    "WITH p AS (SELECT p_partkey, p_brand, list_distinct(string_split(p_name, '')) AS c FROM part) SELECT a.p_partkey AS new_id, b.p_partkey AS old_id, round(" + JACCARD.format("a.c", "b.c") + ", 6) AS score "
    "FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey"
)
def similarity_char_jaccard(spark, sf_dir):
    # the pairs of a brand are dealt out to SHARES tasks: each new row is in one share, each old row in all; a number of partitions that is named isn't coalesced
    share, many = F.pmod(F.xxhash64("p_partkey"), F.lit(SHARES)), 4 * spark.sparkContext.defaultParallelism
    # rows of one name go together, as keys alone, and are scored once; their pairs are made behind the join
    p = table(spark, sf_dir, "part").groupBy("p_brand", share.alias("share"), "p_name").agg(F.sort_array(F.collect_list("p_partkey")).alias("ids"))
    p = p.select("p_brand", "share", "ids", S.char_sets(F.col("p_name")).alias("c"))
    a = p.select("p_brand", "share", F.col("ids").alias("news"), F.col("c").alias("x")).repartition(many, "p_brand", "share")
    b = p.select("p_brand", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("share"), F.col("ids").alias("olds"), F.col("c").alias("y")).repartition(many, "p_brand", "share")
    met = a.join(b, ["p_brand", "share"]).select("news", "olds", S.char_sets_jaccard(F.col("x"), F.col("y"), 6).alias("score"))
    met = met.select("olds", "score", F.explode("news").alias("new_id")).select("new_id", F.explode("olds").alias("old_id"), "score")
    return met.filter("new_id < old_id")


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <= 0.05 THEN 'direct_reuse' WHEN l_discount <= 0.30 THEN 'optimize' WHEN l_discount < 0.70 THEN 'reference' ELSE 'new_build' END AS bucket, "
    "CASE WHEN 1 - l_tax >= 0.88 THEN 'same' WHEN 1 - l_tax >= 0.70 THEN 'minor' WHEN 1 - l_tax >= 0.45 THEN 'moderate' ELSE 'major' END AS level FROM lineitem"
)
def similarity_buckets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.change_bucket(F.col("l_discount")).alias("bucket"), S.change_level(1 - F.col("l_tax")).alias("level"))


BOX_SQL = "SELECT l_orderkey AS page, l_linenumber AS id, l_discount * 5 AS x0, l_tax * 5 AS y0, l_discount * 5 + l_quantity / 100 AS x1, l_tax * 5 + l_quantity / 100 AS y1 FROM lineitem"
OVER_SQL = "greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity") / 100
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), (F.col("l_discount") * 5).alias("x0"), (F.col("l_tax") * 5).alias("y0"), (F.col("l_discount") * 5 + q).alias("x1"), (F.col("l_tax") * 5 + q).alias("y1"))


@query(
    f"WITH b AS ({BOX_SQL}), p AS (SELECT a.page, a.id AS a_id, b.id AS b_id, {OVER_SQL} AS o, (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb FROM b a JOIN b ON a.page = b.page AND a.id < b.id) "
    "SELECT page, a_id, b_id, round(CASE WHEN sa + sb - o > 0 THEN o / (sa + sb - o) ELSE 0 END, 6) AS iou, round(CASE WHEN sa > 0 THEN o / sa ELSE 0 END, 6) AS inside FROM p"
)
def layout_overlaps(spark, sf_dir):
    b = boxes(spark, sf_dir).select("page", "id", F.struct("x0", "y0", "x1", "y1").alias("box"))
    p = b.select("page", F.col("id").alias("a_id"), F.col("box").alias("a")).join(b.select("page", F.col("id").alias("b_id"), F.col("box").alias("b")), "page").filter("a_id < b_id")
    return p.select("page", "a_id", "b_id", F.round(S.iou(F.col("a"), F.col("b")), 6).alias("iou"), F.round(S.containment(F.col("a"), F.col("b")), 6).alias("inside"))


@query(
    f"WITH RECURSIVE b AS ({BOX_SQL}), e AS (SELECT *, greatest(0.0, x1 - x0) * greatest(0.0, y1 - y0) AS area, row_number() OVER (PARTITION BY page ORDER BY greatest(0.0, x1 - x0) * greatest(0.0, y1 - y0) DESC, id, x0, y0, x1, y1) AS n FROM b), "
    "g AS (SELECT page, id, x0, y0, x1, y1, n, true AS ok, [{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}] AS kept FROM e WHERE n = 1 UNION ALL SELECT page, id, x0, y0, x1, y1, n, ok, CASE WHEN ok THEN list_append(kept, {'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}) ELSE kept END FROM ("
    "SELECT e.page, e.id, e.x0, e.y0, e.x1, e.y1, e.n, g.kept, len(list_filter(list_transform(g.kept, lambda k: {'o': greatest(0.0, least(e.x1, k.x1) - greatest(e.x0, k.x0)) * greatest(0.0, least(e.y1, k.y1) - greatest(e.y0, k.y0)), 'a': greatest(0.0, k.x1 - k.x0) * greatest(0.0, k.y1 - k.y0)}), "
    "lambda v: (e.area + v.a - v.o > 0 AND v.o / (e.area + v.a - v.o) >= 0.38) OR (e.area > 0 AND v.o / e.area > 0.7))) = 0 AS ok FROM g JOIN e ON e.page = g.page AND e.n = g.n + 1)) SELECT page, id, x0, y0, x1, y1 FROM g WHERE ok"
)
def layout_drop_overlapping(spark, sf_dir):
    return M.drop_overlapping(boxes(spark, sf_dir), "page")


@query("SELECT l_orderkey, l_linenumber, ceil(l_linenumber / 2)::BIGINT AS sheet, CASE WHEN l_linenumber % 2 = 1 THEN 'left' ELSE 'right' END AS side, l_linenumber::BIGINT AS back FROM lineitem")
def layout_spreads(spark, sf_dir):
    sheet, side = T.view_side(F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sheet.alias("sheet"), side.alias("side")).withColumn("back", T.sheet_view(F.col("sheet"), F.col("side")).cast("long"))


ACTION_SQL = "CASE l_returnflag WHEN 'R' THEN 'remove' WHEN 'A' THEN 'reuse_as_is' ELSE CASE WHEN l_discount < 0.05 THEN 'optimize' WHEN l_discount < 0.08 THEN 'reference' ELSE '' END END"


def action() -> Column:
    rest = F.when(F.col("l_discount") < 0.05, "optimize").when(F.col("l_discount") < 0.08, "reference").otherwise("")
    return F.when(F.col("l_returnflag") == "R", "remove").when(F.col("l_returnflag") == "A", "reuse_as_is").otherwise(rest)


#: lineitem with the place in the order as line number: numbers there repeat.
LINES_SQL = "(SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS l_linenumber) FROM lineitem)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.row_number().over(w))


@query(
    f"WITH a AS (SELECT l_orderkey, l_linenumber, ({ACTION_SQL}) IN ('reuse_as_is', 'optimize') AS f FROM {LINES_SQL} AS lines), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM a), "
    f"i AS (SELECT *, rn - sum(f::INT) OVER (PARTITION BY l_orderkey ORDER BY rn) AS g FROM r), n AS (SELECT l_orderkey, g, count(*) AS n, min(rn) AS first FROM i WHERE f GROUP BY 1, 2), "
    f"b AS (SELECT l_orderkey, n, first, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, first) AS k FROM n) "
    f"SELECT o.l_orderkey, coalesce(n, 0) AS raw_length, CASE WHEN n >= 2 THEN n ELSE 0 END AS length, CASE WHEN n >= 2 THEN first END AS first_place FROM (SELECT DISTINCT l_orderkey FROM {LINES_SQL} AS lines) o LEFT JOIN b ON o.l_orderkey = b.l_orderkey AND k = 1"
)
def sequence_longest_run(spark, sf_dir):
    return Q.longest_run(lines(spark, sf_dir), "l_orderkey", ["l_linenumber"], action().isin("reuse_as_is", "optimize"))


@query(
    "SELECT l_orderkey, bool_and(ok) AS contiguous FROM (SELECT l_orderkey, coalesce(l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 1, true) AS ok FROM lineitem WHERE l_quantity > 10) GROUP BY 1"
)
def sequence_contiguous(spark, sf_dir):
    return Q.contiguous(table(spark, sf_dir, "lineitem").filter("l_quantity > 10").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query(
    f"SELECT l_orderkey, l_linenumber, l_suppkey AS low FROM (SELECT *, max(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {LINES_SQL} AS lines) WHERE l_suppkey < b"
)
def sequence_order_inversions(spark, sf_dir):
    l = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("low"))
    return Q.order_inversions(l, "l_orderkey", "l_linenumber", "low", "low")


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag, l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def sequence_primary_owners(spark, sf_dir):
    return Q.owners(table(spark, sf_dir, "lineitem"), "l_partkey", ["l_returnflag", F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"]).select("l_partkey", "l_orderkey", "l_linenumber")


@query(
    "WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag, l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' AND rn > 1 THEN 'primary_collision' WHEN l_returnflag = 'N' AND rn > 1 THEN 'traceability' END AS reason FROM o"
)
def sequence_build_hints(spark, sf_dir):
    order = ["l_returnflag", F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"]
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    claimed = Q.claimants(l, "l_partkey", order, "rank")
    later = F.col("rank") > 1
    return claimed.select("l_orderkey", "l_linenumber", F.when(later & (F.col("l_returnflag") != "N"), "primary_collision").when(later & (F.col("l_returnflag") == "N"), "traceability").alias("reason"))


@query(
    "SELECT l_orderkey, l_linenumber, (SELECT min(b.l_linenumber) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber > a.l_linenumber AND b.l_quantity > 10) AS nxt, "
    "coalesce((SELECT min(b.l_linenumber) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber > a.l_linenumber AND b.l_quantity > 10) - 1, 9) AS page_end FROM lineitem a WHERE l_quantity > 10"
)
def sequence_page_ends(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").select("l_orderkey", "l_linenumber", F.lit(9).alias("total"))
    out = Q.page_ends(l, "l_orderkey", "l_linenumber", "total")
    return out.select("l_orderkey", "l_linenumber", F.when(F.col("page_end") < 9, F.col("page_end") + 1).alias("nxt"), "page_end")


@query(
    f"WITH w AS (SELECT l_orderkey, l_linenumber, l_linenumber * 3 AS s, lead(l_linenumber * 3) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n, l_linestatus IS DISTINCT FROM lead(l_linestatus) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS d FROM {LINES_SQL} AS lines) "
    f"SELECT l_orderkey, l_linenumber, greatest(s, CASE WHEN n IS NULL THEN 40 ELSE n - CASE WHEN d THEN 2 ELSE 1 END END) AS page_end FROM w"
)
def sequence_unit_page_ends(spark, sf_dir):
    l = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_linestatus", (F.col("l_linenumber") * 3).alias("s"), F.lit(40).alias("total"))
    return Q.unit_page_ends(l, "l_orderkey", "l_linenumber", "l_linestatus", "s", "total").select("l_orderkey", "l_linenumber", "page_end")


@query(
    "SELECT user_id, event_id, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS unit_no FROM (SELECT user_id, event_id, ts, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
)
def sequence_unit_numbers(spark, sf_dir):
    return Q.unit_numbers(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", F.col("unit_no").cast("long").alias("unit_no"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN l_linenumber ELSE 10 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) END AS sort_order FROM {LINES_SQL} AS lines")
def sequence_sort_orders(spark, sf_dir):
    l = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 25, F.col("l_linenumber")).alias("sort_order"))
    return Q.default_sort_order(l, "l_orderkey", ["l_linenumber"], "sort_order")


@query(f"SELECT l_orderkey, l_suppkey, CASE WHEN l_linenumber = 2 THEN 1 WHEN l_linenumber = 1 AND max(l_linenumber) OVER (PARTITION BY l_orderkey) >= 2 THEN 2 ELSE l_linenumber END AS sort_order FROM {LINES_SQL} AS lines")
def sequence_swap_neighbours(spark, sf_dir):
    l = lines(spark, sf_dir).select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("sort_order"))
    return Q.swap_with_neighbour(l, ["l_orderkey"], "sort_order", F.col("sort_order") == 2, True)


@query(
    "SELECT user_id, event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN event_id END AS v FROM events)"
)
def sequence_fill_hints(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("event_id"))).withColumn("o", F.struct("ts", "event_id"))
    return Q.fill_hints(e, "user_id", "o", "v").select("user_id", "event_id", "filled")


@query(
    f"WITH b AS (SELECT page AS p, y0 / 4 AS a, y1 / 4 AS b FROM ({BOX_SQL}) UNION ALL SELECT DISTINCT l_orderkey, 1.0, 1.0 FROM lineitem), w AS (SELECT p, a, coalesce(max(b) OVER (PARTITION BY p ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS f FROM b) "
    "SELECT p AS page, round(f, 6) AS gap_start, round(a, 6) AS gap_end FROM w WHERE a - f >= 0.045"
)
def sequence_vertical_gaps(spark, sf_dir):
    b = boxes(spark, sf_dir).select("page", (F.col("y0") / 4).alias("a"), (F.col("y1") / 4).alias("b"))
    g = Q.vertical_gaps(b, "page", "a", "b")
    return g.select("page", F.round("gap_start", 6).alias("gap_start"), F.round("gap_end", 6).alias("gap_end"))


@query(
    f"WITH a AS (SELECT l_orderkey, CASE WHEN ({ACTION_SQL}) IN ('reuse_as_is', 'optimize', 'reference', 'new_build', 'remove') THEN {ACTION_SQL} ELSE 'pending' END AS code FROM lineitem) "
    "SELECT l_orderkey, code, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY l_orderkey), 3) AS share FROM a GROUP BY 1, 2"
)
def rollup_action_stats(spark, sf_dir):
    return R.action_stats(table(spark, sf_dir, "lineitem"), "l_orderkey", action())


@query(f"SELECT l_orderkey, round_even(sum(CASE {ACTION_SQL} WHEN 'remove' THEN 5 WHEN 'reuse_as_is' THEN 2 WHEN 'optimize' THEN 15 WHEN 'reference' THEN 50 ELSE 40 END)::DOUBLE / count(*), 0)::BIGINT AS pct FROM lineitem GROUP BY 1")
def rollup_modification_percent(spark, sf_dir):
    return R.modification_percent(table(spark, sf_dir, "lineitem"), "l_orderkey", action())


@query(
    f"WITH p AS (SELECT l_suppkey, unnest([l_linenumber, l_linenumber + 1]) AS page, (({ACTION_SQL}) IN ('reuse_as_is', 'optimize'))::DOUBLE AS r FROM lineitem), s AS (SELECT l_suppkey, page, count(*) AS block_count, round(avg(r), 3) AS share FROM p GROUP BY 1, 2) "
    "SELECT *, CASE WHEN share >= 0.8 THEN 'mostly_reuse' WHEN share >= 0.5 THEN 'partial_adjust' ELSE 'major_rebuild' END AS level FROM s"
)
def rollup_page_levels(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("pages", F.array("l_linenumber", F.col("l_linenumber") + 1))
    return R.page_levels(l, ["l_suppkey"], "pages", action().isin("reuse_as_is", "optimize"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 UNION ALL SELECT NULL, o_orderstatus, count(*) FROM orders GROUP BY 2")
def rollup_status_totals(spark, sf_dir):
    return R.status_totals(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query("SELECT d.place, d.o_orderstatus, count(o.o_orderkey) AS n FROM (VALUES (0, 'F'), (1, 'O'), (2, 'P'), (3, 'X')) d(place, o_orderstatus) LEFT JOIN orders o USING (o_orderstatus) GROUP BY 1, 2")
def rollup_histogram(spark, sf_dir):
    return R.histogram(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'P' WHEN bool_and(o_orderstatus = 'F') THEN 'F' WHEN bool_or(o_orderstatus = 'F') THEN 'P' ELSE 'O' END AS slot_status FROM orders GROUP BY 1")
def rollup_slot_status(spark, sf_dir):
    return R.slot_status(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "P", "F", "O")


@query(
    f"WITH s AS (SELECT l_orderkey, ({ACTION_SQL}) IN ('reuse_as_is', 'optimize') AS r, unnest([l_suppkey % 5, l_partkey % 5]) AS s FROM lineitem) SELECT l_orderkey, count(DISTINCT s) AS total, count(DISTINCT CASE WHEN r THEN s END) AS used, round(count(DISTINCT CASE WHEN r THEN s END)::DOUBLE / greatest(1, count(DISTINCT s)), 4) AS ratio FROM s GROUP BY 1"
)
def rollup_reuse_ratio(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("slides", F.array(F.col("l_suppkey") % 5, F.col("l_partkey") % 5))
    return R.reuse_ratio(l, "l_orderkey", "slides", action().isin("reuse_as_is", "optimize"))


@query(
    f"WITH a AS (SELECT l_orderkey, l_quantity > 30 AS x, coalesce(nullif({ACTION_SQL}, ''), 'pending') AS a FROM lineitem) SELECT l_orderkey, count(*) FILTER (x) AS n_experiments, CASE WHEN count(*) FILTER (x) > 0 AND NOT bool_or(x AND a = 'pending') THEN bool_and(NOT x OR a IN ('reuse_as_is', 'optimize')) END AS all_retained FROM a GROUP BY 1"
)
def rollup_experiment_status(spark, sf_dir):
    return R.experiment_status(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_quantity") > 30, action(), ["reuse_as_is", "optimize"])


@query("SELECT user_id, winner, votes FROM (SELECT user_id, event_type AS winner, count(*) AS votes, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1")
def rollup_majority_vote(spark, sf_dir):
    return R.most_frequent(table(spark, sf_dir, "events"), "user_id", "event_type")


@query(
    "WITH n AS (SELECT c_custkey AS id, c_nationkey AS block, substr(c_name, 1, 14) AS k, c_name AS name FROM customer), o AS (SELECT s_suppkey AS id, s_nationkey AS block, 'Customer#' || right('000000000' || s_suppkey, 5) AS k FROM supplier), "
    "e AS (SELECT n.id AS id, o.id AS old_id, 'exact' AS tier, 1.0 AS score, row_number() OVER (PARTITION BY n.id ORDER BY abs(n.block - o.block), o.id) AS rank FROM n JOIN o ON n.k = o.k), x AS (SELECT * FROM e WHERE rank <= 25), "
    "s AS (SELECT n.id, o.id AS old_id, 1.0 / (1 + abs(n.id - o.id)) AS score FROM n JOIN o ON n.block = o.block WHERE n.k NOT IN (SELECT k FROM o)), t AS (SELECT id, old_id, 'similar' AS tier, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, old_id) AS rank FROM s WHERE score >= 0.01), "
    "h AS (SELECT * FROM x UNION ALL SELECT * FROM t WHERE rank = 1) SELECT id, old_id, tier, round(score, 6) AS score, rank FROM h UNION ALL SELECT id, NULL, 'none', NULL, 1 FROM n WHERE id NOT IN (SELECT id FROM h)"
)
def match_tiers(spark, sf_dir):
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("block"), F.substring("c_name", 1, 14).alias("k"))
    o = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("old_id"), F.col("s_nationkey").alias("block"), F.concat(F.lit("Customer#"), F.substring(F.concat(F.lit("000000000"), F.col("s_suppkey").cast("string")), -5, 5)).alias("k"))
    score = 1.0 / (1 + F.abs(F.col("n_id") - F.col("o_old_id")))
    out = M.tiered_match(n, o, "k", "block", "id", "old_id", score, 0.01, [F.abs(F.col("n_block") - F.col("o_block"))])
    return out.select("id", "old_id", "tier", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def match_edition_titles(spark, sf_dir):
    """The flagship: new passages of the benchmark against documents' first lines, both whole: exact on the reuse key, else the best indel ratio among all lines."""
    new = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("t"))
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("old_id"), F.substring_index("text", "\n", 1).alias("t"))
    keyed = lambda d: d.withColumn("k", T.lesson_reuse_match_key(F.col("t"), False))
    return M.tiered_match(keyed(new), keyed(old), "k", None, "id", "old_id", None, 0.405, [F.col("o_t")])


@query(
    "WITH RECURSIVE e AS (SELECT l_orderkey, l_suppkey, l_partkey, round(l_discount * 10, 2) AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_discount * 10, 2) DESC, l_suppkey, l_partkey) AS n FROM lineitem WHERE round(l_discount * 10, 2) >= 0.38), "
    "g AS (SELECT l_orderkey, l_suppkey, l_partkey, score, n, true AS ok, [l_suppkey] AS used_l, [l_partkey] AS used_r FROM e WHERE n = 1 UNION ALL "
    "SELECT e.l_orderkey, e.l_suppkey, e.l_partkey, e.score, e.n, NOT list_contains(used_l, e.l_suppkey) AND NOT list_contains(used_r, e.l_partkey), "
    "CASE WHEN NOT list_contains(used_l, e.l_suppkey) AND NOT list_contains(used_r, e.l_partkey) THEN list_append(used_l, e.l_suppkey) ELSE used_l END, "
    "CASE WHEN NOT list_contains(used_l, e.l_suppkey) AND NOT list_contains(used_r, e.l_partkey) THEN list_append(used_r, e.l_partkey) ELSE used_r END FROM g JOIN e ON e.l_orderkey = g.l_orderkey AND e.n = g.n + 1) "
    "SELECT l_orderkey, l_suppkey, l_partkey, score FROM g WHERE ok"
)
def match_greedy_assignment(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", F.round(F.col("l_discount") * 10, 2).alias("score"))
    return M.greedy_assignment(l, "l_orderkey", "l_suppkey", "l_partkey", "score", 0.38)


@query(
    "SELECT o_custkey, d, o_orderkey FROM (SELECT a.o_custkey, a.o_orderdate AS d, b.o_orderkey, row_number() OVER (PARTITION BY a.o_custkey, a.o_orderdate ORDER BY b.o_orderkey) AS rn "
    "FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders) a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate BETWEEN b.o_orderdate AND b.o_orderdate + INTERVAL 30 DAY) WHERE rn = 1"
)
def match_interval_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    points = o.select("o_custkey", F.col("o_orderdate").alias("d")).distinct()
    ranges = o.select("o_custkey", F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("end"), "o_orderkey")
    return M.interval_lookup(points, ranges, "o_custkey", "d", "start", "end", "o_orderkey").select("o_custkey", "d", F.col("r_o_orderkey").alias("o_orderkey"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def sets_keep_latest(spark, sf_dir):
    return Q.keep_latest(table(spark, sf_dir, "lineitem"), ["l_suppkey"], [F.desc("l_shipdate"), "l_orderkey", "l_linenumber"]).select("l_suppkey", "l_orderkey", "l_linenumber")


@query(
    "WITH a AS (SELECT event_type FROM events WHERE user_id % 2 = 0), b AS (SELECT event_type FROM events WHERE user_id % 2 = 1) SELECT *, 'kept' AS how FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b) "
    "UNION ALL SELECT *, 'deleted' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'added' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"
)
def sets_multiset_moves(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return M.multiset_moves(e.filter("user_id % 2 = 0").select("event_type"), e.filter("user_id % 2 = 1").select("event_type"))


@query(
    "SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, coalesce(b.c_acctbal, a.c_acctbal) AS c_acctbal FROM (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 > 0) a FULL JOIN (SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0) b USING (c_custkey)"
)
def sets_overlay(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return M.overlay(c.filter("c_custkey % 3 > 0"), c.filter("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"], ["c_acctbal"])


@query("SELECT sha256(text) AS sha256, count(*)::BIGINT AS one FROM (SELECT DISTINCT text FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 4 = 0)) GROUP BY 1")
def sets_content_store(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    stored = d.filter("doc_id % 4 = 0").select(F.sha2("text", 256).alias("sha256")).distinct()
    return M.content_store(d.select("text"), stored, "text").select("sha256", F.lit(1).cast("long").alias("one"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def sets_unmatched(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return M.unmatched(table(spark, sf_dir, "part").select("p_partkey"), l, "p_partkey")


TRACK_SQL = "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'delete' WHEN l_discount >= 0.05 THEN 'match' WHEN l_discount > 0 THEN 'no_match' ELSE 'new' END AS tb, CASE WHEN l_tax < 0.02 THEN 'missing' WHEN l_tax < 0.05 THEN 'adapt' ELSE 'cw_only' END AS cw, l_linestatus = 'O' AS ic, CASE WHEN l_returnflag = 'R' THEN 'conflict' ELSE 'none' END AS pic FROM lineitem"
MARK_SQL = "CASE WHEN tb = 'new' AND cw = 'missing' THEN 'unique_new' WHEN tb = 'match' AND cw = 'missing' THEN 'unique_tb' WHEN cw = 'cw_only' AND tb <> 'match' THEN 'unique_cw' WHEN tb = 'match' AND cw = 'adapt' AND NOT ic AND pic NOT IN ('conflict', 'missing') THEN 'agree' ELSE 'conflict' END"


@query(
    f"SELECT l_orderkey, l_linenumber, tb, cw, mark, CASE WHEN tb = 'delete' THEN 'delete' WHEN mark = 'agree' THEN 'reuse_as_is' WHEN mark = 'unique_new' THEN 'create_new' WHEN ic OR pic = 'conflict' THEN 'remake_from_ref' WHEN mark IN ('unique_tb', 'unique_cw') THEN 'optimize' ELSE 'remake_from_ref' END AS fusion FROM (SELECT *, {MARK_SQL} AS mark FROM ({TRACK_SQL}))"
)
def decide_dual_track(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    tb = D.match_class(F.col("l_discount"), F.lit(0.05), F.col("l_quantity") >= 5)
    cw = F.when(F.col("l_tax") < 0.02, "missing").when(F.col("l_tax") < 0.05, "adapt").otherwise("cw_only")
    t = l.select("l_orderkey", "l_linenumber", tb.alias("tb"), cw.alias("cw"), (F.col("l_linestatus") == "O").alias("ic"), F.when(F.col("l_returnflag") == "R", "conflict").otherwise("none").alias("pic"))
    args = [F.col(c) for c in ("tb", "cw", "pic", "ic")]
    return t.withColumn("mark", D.compare_mark(*args)).select("l_orderkey", "l_linenumber", "tb", "cw", "mark", D.fusion_action(F.col("mark"), *args).alias("fusion"))


@query(
    "WITH c AS (SELECT l_orderkey, l_linenumber, l_discount * 9 AS ch, l_tax * 10 AS s, l_tax * 10 - l_discount AS r, l_linestatus = 'O' AS x, l_quantity > 5 AS p, CASE l_returnflag WHEN 'R' THEN 'remove' WHEN 'A' THEN 'reuse_as_is' ELSE 'optimize' END AS b FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN NOT p OR b IN ('remove', 'new_build') THEN b WHEN x AND ch > 0.05 AND ch < 0.70 THEN 'reference' WHEN ch >= 0.70 THEN 'new_build' WHEN ch > 0.30 THEN 'reference' WHEN ch > 0.05 AND b = 'reuse_as_is' THEN 'optimize' WHEN ch <= 0.05 AND b = 'optimize' THEN 'reuse_as_is' ELSE b END AS refined, "
    "CASE WHEN NOT p THEN 'high' WHEN s - r < 0.10 THEN 'low' WHEN abs(ch - 0.05) <= 0.03 OR abs(ch - 0.30) <= 0.03 OR abs(ch - 0.70) <= 0.03 THEN 'low' WHEN s < 0.35 THEN 'low' WHEN s >= 0.6 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN b = 'optimize' THEN CASE WHEN ch <= 0.20 THEN 'text_only' ELSE 're_voice' END END AS subtype FROM c"
)
def decide_block_judgement(spark, sf_dir):
    base = F.when(F.col("l_returnflag") == "R", "remove").when(F.col("l_returnflag") == "A", "reuse_as_is").otherwise("optimize")
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 9).alias("ch"), (F.col("l_tax") * 10).alias("s"), (F.col("l_tax") * 10 - F.col("l_discount")).alias("r"), (F.col("l_linestatus") == "O").alias("x"), (F.col("l_quantity") > 5).alias("p"), base.alias("b"))
    none = F.lit(None).cast("string")
    return c.select("l_orderkey", "l_linenumber", D.refine_action(F.col("b"), F.col("ch"), F.col("x"), F.col("p")).alias("refined"), D.confidence(F.col("ch"), F.col("s"), F.col("r"), F.col("p")).alias("confidence"), D.optimize_subtype(F.col("b"), none, none, F.col("ch")).alias("subtype"))


GRADE_SQL = "SELECT l_orderkey, count(*) FILTER (a = 'reuse_as_is') AS u, count(*) FILTER (a = 'optimize') AS o, count(*) FILTER (a = 'reference') AS f, count(*) FILTER (a = 'remove' AND l_quantity > 40) AS n, count(*) FILTER (a = 'optimize' AND l_tax > 0.04) AS v, count(*) FILTER (a = '') AS p, count(*) AS e, count(*) FILTER (a IN ('reuse_as_is', 'optimize')) AS r FROM (SELECT *, " + ACTION_SQL + " AS a FROM lineitem) GROUP BY 1"


@query(
    f"SELECT l_orderkey, CASE WHEN p = 0 AND o = 0 AND f = 0 AND n = 0 AND u > 0 THEN 'direct_reuse' WHEN n::DOUBLE / e >= 0.45 OR n >= greatest(2, e * 0.35::DOUBLE) THEN 'new_production' WHEN NOT ok AND s < 1 / 3 AND n > 0 THEN 'new_production' WHEN f > 0 OR NOT ok THEN 'cw_material_video_rerecord' "
    f"WHEN p = 0 AND n = 0 AND v = 0 THEN 'video_clip' WHEN p = 0 AND n = 0 AND v > 0 THEN 'partial_rerecord' WHEN o > 0 AND n = 0 THEN 'partial_rerecord' ELSE 'new_production' END AS grade FROM (SELECT *, r::DOUBLE / e AS s, r >= 2 AND r::DOUBLE / e >= 1 / 3 AS ok FROM ({GRADE_SQL}))"
)
def decide_lesson_grades(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("a", action())
    count = lambda c: F.count_if(c)
    g = l.groupBy("l_orderkey").agg(
        count(F.col("a") == "reuse_as_is").alias("u"), count(F.col("a") == "optimize").alias("o"), count(F.col("a") == "reference").alias("f"), count((F.col("a") == "remove") & (F.col("l_quantity") > 40)).alias("n"),
        count((F.col("a") == "optimize") & (F.col("l_tax") > 0.04)).alias("v"), count(F.col("a") == "").alias("p"), F.count("*").alias("e"), count(F.col("a").isin("reuse_as_is", "optimize")).alias("r"),
    )
    grade = D.lesson_grade(*[F.col(c) for c in "uofnvpe"], F.col("r") >= 2, F.col("r") / F.col("e"), F.lit(None).cast("boolean"))
    return g.select("l_orderkey", grade.alias("grade"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount >= 0.08 AND l_tax * 10 - l_discount * 5 >= 0.10 THEN 'swap_primary' WHEN l_discount >= 0.08 THEN NULL WHEN l_discount * 5 >= 0.38 THEN 'confirmed' WHEN l_discount * 5 <= 0.22 THEN 'heavy_change' END AS verdict, "
    "CASE WHEN l_tax * 12 >= 0.85 THEN '画面接近' WHEN l_tax * 12 >= 0.55 THEN '可能有改动' ELSE '疑似换图' END AS grade FROM lineitem"
)
def decide_prescan(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    verdict = D.prescan_verdict(F.lit(True), F.col("l_discount") < 0.08, F.col("l_tax") * 10, F.col("l_discount") * 5)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", verdict.alias("verdict"), D.visual_grade(F.col("l_tax") * 12).alias("grade"))


@query(
    f"WITH b AS ({BOX_SQL}) SELECT a.page, a.id AS a_id, b.id AS b_id, (0.65 * greatest(0.0, 1 - (abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) / 0.22 + abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) / 0.35) / 2) + 0.35 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) / greatest((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))) >= 0.38 AS anchored FROM b a JOIN b ON a.page = b.page AND a.id < b.id"
)
def layout_image_anchors(spark, sf_dir):
    b = boxes(spark, sf_dir).select("page", "id", F.struct("x0", "y0", "x1", "y1").alias("box"))
    p = b.select("page", F.col("id").alias("a_id"), F.col("box").alias("a")).join(b.select("page", F.col("id").alias("b_id"), F.col("box").alias("b")), "page").filter("a_id < b_id")
    return p.select("page", "a_id", "b_id", (S.image_anchor(F.col("a"), F.col("b")) >= 0.38).alias("anchored"))


@query("SELECT p_brand, p_size, min(p_partkey) AS first_row, max(p_partkey) AS last_row FROM part GROUP BY 1, 2")
def catalogue_row_span(spark, sf_dir):
    return C.row_span(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_partkey")


@query(
    "WITH p AS (SELECT p_partkey, p_brand, p_type, p_size, p_partkey % 50 AS no FROM part), m AS (SELECT * FROM p WHERE p_size <= 25), s AS (SELECT p_brand, min(no) AS lo, max(no) AS hi FROM m GROUP BY 1), "
    "c AS (SELECT p.*, row_number() OVER (PARTITION BY p.p_brand, no ORDER BY p_partkey) AS rn FROM p JOIN s USING (p_brand) WHERE p_size > 25 AND no BETWEEN lo AND hi AND (p.p_brand, p_type) IN (SELECT (p_brand, p_type) FROM m) "
    "AND (p.p_brand, no) NOT IN (SELECT (p_brand, no) FROM m)) SELECT p_partkey, p_brand, p_type, no FROM m UNION ALL SELECT p_partkey, p_brand, p_type, no FROM c WHERE rn = 1"
)
def catalogue_misgraded_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", (F.col("p_partkey") % 50).alias("no"))
    return C.add_misgraded(p.filter("p_size <= 25").drop("p_size"), p.filter("p_size > 25").drop("p_size"), "p_brand", "p_type", "no", "p_partkey")


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS units, count(*) FILTER (l_returnflag <> 'R') AS numbered, max(l_linenumber)::BIGINT AS highest FROM lineitem GROUP BY 1")
def catalogue_score(spark, sf_dir):
    return C.catalogue_score(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber", F.col("l_returnflag") == "R")


@query("SELECT conv_id, coalesce(avg(CASE WHEN turn <= 30 THEN (length(trim(coalesce(text, ''), ' ')) < 24)::INT END) >= 0.45, true) AS is_sparse FROM conversations GROUP BY 1")
def catalogue_sparse_text(spark, sf_dir):
    return C.sparse(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


RANGE_SQL = "SELECT s_suppkey, s_suppkey % 15 + 1 AS s, s_suppkey % 15 + 13 AS e FROM supplier"


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("volume"), (F.col("s_suppkey") % 15 + 1).alias("s"), (F.col("s_suppkey") % 15 + 13).alias("e"))


@query(
    f"WITH g AS (SELECT DISTINCT l_suppkey, l_partkey % 40 AS p FROM lineitem WHERE l_quantity > 5), r AS ({RANGE_SQL}), x AS (SELECT s_suppkey, s, e, unnest(range(s, e + 1)) AS p FROM r), "
    "k AS (SELECT s_suppkey, max(x.p) AS last FROM x LEFT JOIN g ON l_suppkey = s_suppkey AND g.p = x.p WHERE g.p IS NULL GROUP BY 1) SELECT s_suppkey, s, greatest(s, coalesce(last, s)) AS e FROM r LEFT JOIN k USING (s_suppkey)"
)
def sequence_trim_tail(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("volume"), (F.col("l_partkey") % 40).alias("page"), (F.col("l_quantity") > 5).alias("blank"))
    return C.trim_tail(page_ranges(spark, sf_dir), pages, ["s_suppkey"], "volume", "page", "s", "e", "blank")


@query(f"SELECT s_suppkey, s, CASE WHEN s < 20 AND e >= 20 THEN 19 ELSE e END AS e FROM ({RANGE_SQL})")
def sequence_trim_back_matter(spark, sf_dir):
    return C.trim_back_matter(page_ranges(spark, sf_dir).withColumn("back", F.lit(20)), "s", "e", "back").select("s_suppkey", "s", "e")


@query(
    "WITH l AS (SELECT DISTINCT l_suppkey, l_linenumber * 3 AS a FROM lineitem), f AS (SELECT DISTINCT l_suppkey, l_partkey % 60 AS b FROM lineitem), n AS (SELECT l_suppkey, b - a AS o, count(*) AS hits FROM l JOIN f USING (l_suppkey) WHERE b - a BETWEEN 1 AND 30 GROUP BY 1, 2) "
    "SELECT l_suppkey, o AS page_offset, hits FROM n WHERE hits >= 2 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY hits DESC, o) = 1"
)
def sequence_page_offset(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return C.page_offset(l.select("l_suppkey", (F.col("l_linenumber") * 3).alias("a")), l.select("l_suppkey", (F.col("l_partkey") % 60).alias("b")), "l_suppkey", "a", "b")


@query(
    "WITH a AS (SELECT c_custkey, c_mktsegment AS m, c_nationkey AS n FROM customer WHERE c_custkey % 3 > 0), b AS (SELECT c_custkey, c_mktsegment AS m, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END AS n FROM customer WHERE c_custkey % 4 > 0) "
    "SELECT c_custkey, a.m AS old_m, a.n AS old_n, b.m AS new_m, b.n AS new_n FROM a FULL JOIN b USING (c_custkey) WHERE a.m IS DISTINCT FROM b.m OR a.n IS DISTINCT FROM b.n"
)
def sets_changed_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("m", F.col("c_mktsegment"))
    old, new = c.filter("c_custkey % 3 > 0").withColumn("n", F.col("c_nationkey")), c.filter("c_custkey % 4 > 0").withColumn("n", F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("c_nationkey")))
    return C.changed_rows(old, new, ["c_custkey"], ["m", "n"])


@query(
    "WITH b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN [] ELSE list_distinct([l_partkey % 4, l_suppkey % 4]) END AS atoms FROM lineitem), h AS (SELECT l_orderkey, x, count(*) AS n FROM (SELECT l_orderkey, unnest(atoms) AS x FROM b) GROUP BY 1, 2), "
    "v AS (SELECT DISTINCT l_orderkey, l_partkey % 6 AS x, true AS seen FROM lineitem), a AS (SELECT l_orderkey, count(seen) AS n_visible, count(*) FILTER (seen AND n IS NOT NULL) AS n_assigned, count(*) FILTER (n > 1) AS n_twice FROM v FULL JOIN h USING (l_orderkey, x) GROUP BY 1) "
    "SELECT l_orderkey, n_visible, n_assigned, n_twice, (SELECT count(*) FROM b WHERE b.l_orderkey = a.l_orderkey AND len(atoms) = 0) AS n_empty FROM a"
)
def rollup_coverage(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    atoms = F.when(F.col("l_quantity") > 45, F.array().cast("array<bigint>")).otherwise(F.array(F.col("l_partkey") % 4, F.col("l_suppkey") % 4))
    return C.coverage(l.select("l_orderkey", "l_linenumber", atoms.alias("atoms")), l.select("l_orderkey", (F.col("l_partkey") % 6).alias("x")), "l_orderkey", "l_linenumber", "atoms", "x")


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN w * h < 0.0002 OR w < 0.012 OR h < 0.012 ELSE (w * h < 0.00008 AND length(l_linestatus) <= 2) OR (w < 0.01 AND h < 0.01 AND length(l_linestatus) <= 1) END AS tiny, "
    "length(l_shipinstr) BETWEEN 2 AND 28 AND (l_tax * 5 < 0.16 OR l_discount * 10 > 0.84) AS edge FROM (SELECT *, l_discount / 10 AS w, l_tax / 10 AS h, l_returnflag || l_linestatus || l_linenumber AS l_shipinstr FROM lineitem)"
)
def layout_noise(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    tiny = C.is_tiny(F.when(F.col("l_returnflag") == "R", "image").otherwise("text"), F.col("l_discount") / 10, F.col("l_tax") / 10, F.col("l_linestatus"))
    edge = C.is_edge_fragment(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")), F.col("l_tax") * 5, F.col("l_discount") * 10)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tiny.alias("tiny"), edge.alias("edge"))


AREA_SQL = "SELECT a.page, a.id AS a_id, b.id AS b_id, {0} AS o, (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb, (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1 AS c FROM b a JOIN b ON a.page = b.page".format(OVER_SQL)


@query(
    f"WITH b AS ({BOX_SQL}), p AS ({AREA_SQL} WHERE a.id > 2 AND b.id <= 2) SELECT page, id, x0, y0, x1, y1 FROM b WHERE id > 2 AND NOT EXISTS "
    "(SELECT 1 FROM p WHERE p.page = b.page AND a_id = id AND ((o >= sa * 0.35::DOUBLE AND sa > 0) OR (o >= (sa + sb - o) * 0.2975::DOUBLE AND o > 0)))"
)
def layout_outside_regions(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return C.outside_regions(b.filter("id > 2"), b.filter("id <= 2"), "page")


@query(
    f"WITH b AS ({BOX_SQL}), p AS ({AREA_SQL} WHERE a.id <> b.id AND a.id > 1 AND b.id = 1), h AS (SELECT page, b_id AS outer_id, list_sort(list(DISTINCT a_id)) AS i FROM p WHERE c AND sa <= sb * 0.92::DOUBLE AND (o >= sa * 0.55::DOUBLE OR sa <= sb * 0.45::DOUBLE) GROUP BY 1, 2) "
    "SELECT page, outer_id, array_to_string(i, ',') AS piece_ids FROM h WHERE len(i) >= 2"
)
def layout_pieces_inside(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return C.pieces_inside(b.filter("id > 1"), b.filter("id = 1"), "page").withColumn("piece_ids", F.array_join(F.col("piece_ids").cast("array<string>"), ","))


@query(
    "SELECT c_custkey, CASE WHEN a = '' OR b = '' THEN '无法命名' WHEN a = b OR s >= 0.72 OR contains(a, b) OR contains(b, a) OR t >= 0.55 THEN '主题一致' ELSE '主题改写' END AS theme, "
    "CASE WHEN a = '' AND b = '' THEN '无图注' WHEN a = '' THEN '旧无图注' WHEN b = '' THEN '新无图注' WHEN a = b OR s >= 0.85 THEN '图注一致' ELSE '图注改写' END AS caption FROM "
    "(SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS a, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE substr(c_mktsegment, 1 + c_nationkey % 2) || c_nationkey END AS b, (c_custkey % 100) / 100 AS s, (c_nationkey % 10) / 10 AS t FROM customer)"
)
def decide_pictures(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    old, new = F.when(k % 5 == 0, "").otherwise(F.col("c_mktsegment")), F.when(k % 7 == 0, "").otherwise(F.concat(F.substr("c_mktsegment", 1 + n % 2), n.cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", C.theme_change(old, new, (k % 100) / 100, (n % 10) / 10).alias("theme"), C.caption_change(old, new, (k % 100) / 100).alias("caption"))


@query(
    "WITH l AS (SELECT s_suppkey, s_nationkey AS v, s_suppkey % 20 AS a, CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey % 20 + s_suppkey % 7 - 2 END AS b FROM supplier), "
    "c AS (SELECT p_partkey % 25 AS v, p_partkey // 25 AS page, CASE p_size % 5 WHEN 0 THEN '一致' WHEN 1 THEN '仅标点差异' WHEN 2 THEN '文字标点差异' WHEN 3 THEN '音标变动注意' END AS t, p_size - 10 AS n, CASE p_size % 3 WHEN 0 THEN '一致' WHEN 1 THEN '插图差异' END AS i, (p_size % 11 = 0)::INT AS k FROM part), "
    "s AS (SELECT *, unnest(CASE WHEN a > 0 AND coalesce(b, a) >= a THEN range(a, coalesce(b, a) + 1) ELSE [NULL] END) AS page FROM l), "
    "j AS (SELECT s.*, t, n, i, (t IS NOT NULL AND t IN ('文字标点差异', '音标变动注意')) OR (i IS NOT NULL AND (i = '插图差异' OR k > 0)) AS d FROM s LEFT JOIN c USING (v, page)) "
    "SELECT s_suppkey, count(page) AS pages_total, count(*) FILTER (t IS NOT NULL OR i IS NOT NULL) AS pages_compared, count(*) FILTER (d) AS pages_changed, coalesce(sum(greatest(0, n)) FILTER (t IS NOT NULL), 0)::BIGINT AS changed_blocks, "
    "count(*) FILTER (t = '音标变动注意') AS attention_pages, coalesce(string_agg(page, ',' ORDER BY page) FILTER (d), '') AS changed_pages FROM j GROUP BY 1"
)
def rollup_page_changes(spark, sf_dir):
    k, z = F.col("s_suppkey"), F.col("p_size")
    first = k % 20
    lessons = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("v"), first.alias("a"), F.when(k % 7 > 0, first + k % 7 - 2).alias("b"))
    text = F.when(z % 5 == 0, "一致").when(z % 5 == 1, "仅标点差异").when(z % 5 == 2, "文字标点差异").when(z % 5 == 3, "音标变动注意")
    picture = F.when(z % 3 == 0, "一致").when(z % 3 == 1, "插图差异")
    compares = table(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("v"), F.floor(F.col("p_partkey") / 25).alias("page"), text.alias("t"), (z - 10).alias("n"), picture.alias("i"), (z % 11 == 0).cast("int").alias("k"))
    out = P.page_changes(lessons, compares, ["s_suppkey"], "v", "a", "b", "page", "t", "n", "i", "k")
    return out.withColumn("changed_pages", F.array_join(F.col("changed_pages").cast("array<string>"), ","))


@query(
    "WITH p AS (SELECT coalesce(nullif(trim(CASE WHEN l_linenumber < 3 THEN l_returnflag || l_linestatus WHEN l_linenumber = 3 THEN ' ' END), ''), '印刷页 ' || CASE WHEN l_quantity > 10 THEN l_suppkey END, '修订 p' || l_linenumber) AS label, "
    "CASE l_suppkey % 5 WHEN 0 THEN '基本一致' WHEN 1 THEN '文字差异' WHEN 2 THEN '' WHEN 3 THEN '没变化' END AS c FROM lineitem), n AS (SELECT label, coalesce(nullif(c, ''), '未知') AS change, count(*) AS n FROM p GROUP BY 1, 2) "
    "SELECT label, sum(n)::BIGINT AS page_count, coalesce(sum(n) FILTER (change NOT IN ('基本一致', '一致', '仅标点差异', '没变化')), 0)::BIGINT AS changed_pages, string_agg(change || ':' || n, ',' ORDER BY encode(change)) AS by_change FROM n GROUP BY 1"
)
def rollup_chapter_overview(spark, sf_dir):
    no, s = F.col("l_linenumber"), F.col("l_suppkey")
    label = F.when(no < 3, F.concat("l_returnflag", "l_linestatus")).when(no == 3, " ")
    change = F.when(s % 5 == 0, "基本一致").when(s % 5 == 1, "文字差异").when(s % 5 == 2, "").when(s % 5 == 3, "没变化")
    rows = table(spark, sf_dir, "lineitem").select(label.alias("label"), F.when(F.col("l_quantity") > 10, s).alias("printed"), no.alias("page"), change.alias("change"))
    out = P.chapter_overview(rows, "label", "printed", "page", "change")
    return out.withColumn("by_change", F.array_join(F.transform("by_change", lambda x: F.concat(x["change"], F.lit(":"), x["n"].cast("string"))), ","))


@query(
    "WITH p AS (SELECT o_custkey AS lesson, o_orderkey AS page, o_orderstatus = 'F' AS done, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 3 = 0 END AS pic FROM orders), "
    "a AS (SELECT l_orderkey AS page, bool_or(coalesce(nullif(k, ''), 'text') IN ('text', 'title')) AS t, bool_or(coalesce(nullif(k, ''), 'text') = 'image') AS i, count(*) AS n FROM (SELECT l_orderkey, CASE WHEN l_suppkey % 4 = 0 THEN 'image' WHEN l_suppkey % 4 = 1 THEN 'title' WHEN l_suppkey % 4 = 2 THEN 'caption' WHEN l_tax > 0.04 THEN '' END AS k FROM lineitem WHERE l_quantity > 25) GROUP BY 1), "
    "s AS (SELECT lesson, count(*) AS pages_total, count(*) FILTER (done) AS pages_done, count(*) FILTER (t OR done) AS text_pages, count(*) FILTER (i) AS image_pages, coalesce(sum(n), 0)::BIGINT AS atom_count, count(n) AS pages_with_atoms, bool_or(coalesce(i, false) OR (done AND coalesce(pic, false))) AS pics FROM p LEFT JOIN a USING (page) GROUP BY 1) "
    "SELECT * EXCLUDE (pics), text_pages = pages_total AS text_complete, pages_done = pages_total OR (text_pages = pages_total AND (NOT pics OR image_pages = pages_total)) AS image_complete FROM s"
)
def rollup_recognition_status(spark, sf_dir):
    key, s = F.col("o_orderkey"), F.col("l_suppkey")
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lesson"), key.alias("page"), (F.col("o_orderstatus") == "F").alias("done"), F.when(key % 5 > 0, key % 3 == 0).alias("pic"))
    kind = F.when(s % 4 == 0, "image").when(s % 4 == 1, "title").when(s % 4 == 2, "caption").when(F.col("l_tax") > 0.04, "")
    atoms = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("page"), kind.alias("kind")).join(pages.select("lesson", "page"), "page")
    return P.recognition_status(pages, atoms, "lesson", "page", "done", "pic", "kind")


@query(
    "SELECT c_custkey, count(o_orderkey) AS lesson_count, count(o_orderkey) > 0 AS catalog_ok, count(o_orderkey) > 0 AND count(o_orderkey) = count(*) FILTER (o_orderstatus <> 'P' AND o_orderkey % 4 > 0) AS parse_ok FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"
)
def rollup_readiness(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") != "P", 1).alias("a"), F.when(F.col("o_orderkey") % 4 > 0, 2).alias("b"))
    return P.readiness(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", "a", "b")


@query(
    "WITH v AS (SELECT s_nationkey AS n_nationkey, s_suppkey % 8 AS grade, CASE WHEN s_suppkey % 3 = 0 THEN '上' ELSE '下' END AS term, s_suppkey % 9 AS lesson_count FROM supplier), h AS (SELECT n_nationkey, grade, term, sum(lesson_count)::BIGINT AS n FROM v GROUP BY 1, 2, 3) "
    "SELECT n_nationkey, g.grade, t.term, h.n IS NOT NULL AS in_db, coalesce(h.n, 0) AS lesson_count FROM nation CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) g(grade) CROSS JOIN (VALUES ('上'), ('下')) t(term) LEFT JOIN h USING (n_nationkey, grade, term)"
)
def rollup_edition_grid(spark, sf_dir):
    k = F.col("s_suppkey")
    v = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), (k % 8).alias("grade"), F.when(k % 3 == 0, "上").otherwise("下").alias("term"), (k % 9).alias("lesson_count"))
    return P.edition_grid(table(spark, sf_dir, "nation").select("n_nationkey"), v, "n_nationkey", "grade", "term", [1, 2, 3, 4, 5, 6], ["上", "下"])


STAGES = ["await_prescan", "prescan_ok", "confirmed", "heavy_change", "no_old", "await_prescan_match", "else"]


@query(
    f"WITH s AS (SELECT user_id, value > 90 AS r, {STAGES}[1 + event_id % 7] AS g FROM events) SELECT user_id, count(*) AS lesson_count, count(*) FILTER (coalesce(r, false)) AS needs_review, count(*) FILTER (NOT coalesce(r, false) AND g IN ('await_prescan', 'await_prescan_match')) AS await_prescan, "
    "count(*) FILTER (NOT coalesce(r, false) AND g = 'prescan_ok') AS prescan_ok_pending, count(*) FILTER (NOT coalesce(r, false) AND g = 'confirmed') AS confirmed, count(*) FILTER (NOT coalesce(r, false) AND g IN ('heavy_change', 'no_old')) AS other_done FROM s GROUP BY 1"
)
def rollup_stage_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stage = F.get(F.array(*map(F.lit, STAGES)), (F.col("event_id") % 7).cast("int"))
    return P.stage_counts(e.select("user_id", (F.col("value") > 90).alias("r"), stage.alias("g")), "user_id", "r", "g")


@query(
    "WITH m AS (SELECT l_orderkey AS lesson, 'n' || (l_partkey % 4) AS new_id, CASE WHEN l_tax > 0 THEN 'o' || (l_suppkey % 5) END AS old_id, l_linenumber AS p, l_discount, l_tax FROM lineitem), "
    "nb AS (SELECT lesson, new_id, min(p) AS place, max(l_discount)::DOUBLE AS score, min(l_tax)::DOUBLE AS runner_up FROM m WHERE p <> 5 GROUP BY 1, 2), ob AS (SELECT lesson, old_id, max(p) AS place FROM m WHERE p <> 3 AND old_id IS NOT NULL GROUP BY 1, 2), "
    "nx AS (SELECT *, row_number() OVER (PARTITION BY lesson ORDER BY place, new_id) - 1 AS nth FROM nb), ox AS (SELECT *, row_number() OVER (PARTITION BY lesson ORDER BY place, old_id) - 1 AS nth FROM ob), "
    "pr AS (SELECT lesson, new_id, old_id, count(*) AS n FROM m WHERE old_id IS NOT NULL GROUP BY 1, 2, 3), st AS (SELECT pr.*, ox.place, ox.nth, ox.place - lag(ox.place) OVER (PARTITION BY pr.lesson, new_id ORDER BY ox.place NULLS FIRST) AS step FROM pr LEFT JOIN ox ON pr.lesson = ox.lesson AND pr.old_id = ox.old_id), "
    "g AS (SELECT lesson, new_id, count(*) AS olds, sum(n) AS n, bool_or(place IS NULL OR coalesce(step > 1, false)) AS apart, min(coalesce(nth, 9999)) AS low, max(coalesce(nth, 9999)) AS high FROM st GROUP BY 1, 2), "
    "t AS (SELECT g.*, max(high) OVER (PARTITION BY g.lesson ORDER BY coalesce(nx.nth, 9999), g.new_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g LEFT JOIN nx ON g.lesson = nx.lesson AND g.new_id = nx.new_id) "
    "SELECT lesson, 'duplicate_anchor' AS flag, 'high' AS severity, old_id AS target FROM pr GROUP BY lesson, old_id HAVING count(*) > 1 UNION ALL SELECT lesson, 'non_contiguous_multi_anchor', 'high', new_id FROM g WHERE olds > 1 AND apart "
    "UNION ALL SELECT lesson, 'duplicate_pair', 'medium', new_id FROM g WHERE olds = 1 AND n > 1 UNION ALL SELECT lesson, 'low_confidence', 'medium', new_id FROM nb WHERE score - runner_up < 0.1::DOUBLE UNION ALL SELECT lesson, 'order_inversion', 'high', new_id FROM t WHERE low < before"
)
def sequence_compare_flags(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("lesson"), F.concat(F.lit("n"), (F.col("l_partkey") % 4).cast("string")).alias("new_id"), F.when(F.col("l_tax") > 0, F.concat(F.lit("o"), (F.col("l_suppkey") % 5).cast("string"))).alias("old_id"),
        F.col("l_linenumber").alias("p"), "l_discount", "l_tax",
    )
    new = m.filter("p <> 5").groupBy("lesson", "new_id").agg(F.min("p").alias("place"), F.max("l_discount").alias("score"), F.min("l_tax").alias("runner_up"))
    old = m.filter("p <> 3 and old_id is not null").groupBy("lesson", "old_id").agg(F.max("p").alias("place"))
    return P.compare_flags(m.select("lesson", "new_id", "old_id"), new, old, "lesson")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def sets_compare_queue(spark, sf_dir):
    blocks = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return P.with_any(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), blocks, "c_custkey")


@query(
    "SELECT p_partkey, coalesce(CASE WHEN p_size % 4 = 0 THEN p_size END, CASE WHEN regexp_full_match(no, '\\d+') THEN no::BIGINT * 10 END, 99990)::BIGINT AS place FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE (p_partkey % 40)::VARCHAR END AS no FROM part)"
)
def sequence_lesson_places(spark, sf_dir):
    k = F.col("p_partkey")
    no = F.when(k % 3 == 0, F.col("p_brand")).otherwise(F.concat(F.lit(" "), (k % 40).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", T.lesson_place(F.when(F.col("p_size") % 4 == 0, F.col("p_size")), no).alias("place"))


@query(
    "WITH p AS (SELECT doc_id // 10 AS book, doc_id % 10 AS page, CASE WHEN doc_id % 10 < 1 + doc_id // 10 % 5 THEN '目录' || chr(10) || '第1课 水 ' || (doc_id % 90) || chr(13) || ' 第2课 光 12 ' || chr(10) ELSE '' END || coalesce(text, '') AS t, doc_id % 7 = 3 AS body FROM documents), "
    r"l AS (SELECT *, len(list_filter(list_transform(string_split(replace(t, chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$', '', 'g')), lambda x: length(x) BETWEEN 4 AND 90 AND regexp_matches(x, '[\x{4e00}-\x{9fff}]') AND regexp_matches(x, '\p{Nd}$'))) AS n FROM p), "
    "c AS (SELECT *, n >= 3 OR (contains(t, '目录') AND n >= 2) AS c FROM l), e AS (SELECT *, min(page) FILTER (body AND NOT c) OVER (PARTITION BY book) AS stop FROM c WHERE page < 8) "
    "SELECT book, coalesce(max(page) FILTER (c AND (stop IS NULL OR page < stop)), -1)::BIGINT AS last_page FROM e GROUP BY 1"
)
def sequence_last_contents_page(spark, sf_dir):
    i = F.col("doc_id")
    head = F.concat(F.lit("目录\n第1课 水 "), (i % 90).cast("string"), F.lit("\r 第2课 光 12 \n"))
    t = F.concat(F.when(i % 10 < 1 + F.floor(i / 10) % 5, head).otherwise(""), F.coalesce("text", F.lit("")))
    pages = table(spark, sf_dir, "documents").select(F.floor(i / 10).alias("book"), (i % 10).alias("page"), t.alias("t"), (i % 7 == 3).alias("body")).withColumn("n", T.catalog_line_count(F.col("t")))
    return P.last_contents_page(pages, "book", "page", T.is_contents_page(F.col("t"), F.lit(0), F.col("n")), F.col("body"), 8)


from . import book_queries, contents_queries, given_queries, match_queries, page_queries, record_queries, review_queries  # noqa: E402, F401 - they register theirs

__all__ = ["QUERIES", "SQL"]
