"""Queries of the joins of lessons, blocks, matches and files: the driver's tables, and fixtures with values worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import records as R
from .registry import query, table

LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n FROM lineitem)"
TRACKS = (
    f"(WITH l AS {LINES}, t AS (SELECT l_orderkey || '-' || n AS u, CASE l_returnflag WHEN 'A' THEN 'tb' ELSE '' END AS s, CASE WHEN l_discount >= 0.05 THEN 'match' WHEN l_discount > 0 THEN 'no_match' END AS m, CASE WHEN l_linestatus = 'O' THEN 'conflict' END AS g, l_discount AS x FROM l WHERE l_quantity > 10), "
    "c AS (SELECT l_orderkey || '-' || n AS u, 'cw' AS s, CASE WHEN l_tax < 0.05 THEN 'adapt' ELSE 'cw_only' END AS st, l_returnflag = 'R' AS cf, l_tax AS x FROM l WHERE l_tax > 0.02) "
    "SELECT coalesce(t.u, c.u) AS u, coalesce(nullif(t.s, ''), c.s, '') AS section, coalesce(t.m, 'new') AS match_class, coalesce(c.st, 'missing') AS status, coalesce(t.g, 'none') AS tag, coalesce(c.cf, false) AS conflict, t.x AS tb_score, c.x AS cw_score FROM t FULL JOIN c ON t.u = c.u)"
)


def tracks(spark, sf_dir):
    from .queries import lines

    l = lines(spark, sf_dir).withColumn("u", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    match_class = F.when(F.col("l_discount") >= 0.05, "match").when(F.col("l_discount") > 0, "no_match")
    t = l.filter("l_quantity > 10").select("u", F.when(F.col("l_returnflag") == "A", "tb").otherwise("").alias("section"), match_class.alias("match_class"), F.when(F.col("l_linestatus") == "O", "conflict").alias("tag"), F.col("l_discount").alias("score"))
    c = l.filter("l_tax > 0.02").select("u", F.lit("cw").alias("section"), F.when(F.col("l_tax") < 0.05, "adapt").otherwise("cw_only").alias("status"), (F.col("l_returnflag") == "R").alias("conflict"), F.col("l_tax").alias("score"))
    return R.dual_join(t, c, "u")


@query(f"SELECT * FROM {TRACKS}")
def records_dual_join(spark, sf_dir):
    return tracks(spark, sf_dir)


@query(f"SELECT match_class, status, count(*) AS n, count(tb_score) AS n_tb, count(cw_score) AS n_cw FROM {TRACKS} GROUP BY 1, 2")
def records_dual_counts(spark, sf_dir):
    return tracks(spark, sf_dir).groupBy("match_class", "status").agg(F.count("*").alias("n"), F.count("tb_score").alias("n_tb"), F.count("cw_score").alias("n_cw"))


@query(
    f"SELECT l_orderkey, l_partkey, n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN n = 3 THEN 99 ELSE n END, l_partkey) AS k FROM {LINES} WHERE l_returnflag IN ('A', 'R') AND l_partkey % 7 > 0) WHERE k = 1"
)
def records_best_matches(spark, sf_dir):
    from .queries import lines

    tier = F.when(F.col("l_returnflag") == "A", "exact").when(F.col("l_returnflag") == "R", "high_similarity").otherwise("none")
    m = lines(spark, sf_dir).select("l_orderkey", F.when(F.col("l_partkey") % 7 > 0, F.col("l_partkey")).alias("l_partkey"), tier.alias("tier"), F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("rank"), F.col("l_linenumber").alias("n"))
    return R.best_matches(m, "l_orderkey", "l_partkey", "tier", "rank").select("l_orderkey", "l_partkey", "n")


@query(
    "SELECT o_orderkey, coalesce(n, 0) AS n_blocks, CASE WHEN o_orderstatus = 'F' THEN 'confirmed' WHEN n > 0 THEN 'pending' ELSE 'no_blocks' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1) ON o_orderkey = l_orderkey"
)
def records_block_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("confirmed"))
    b = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.block_status(o, b, "o_orderkey", "confirmed").select("o_orderkey", "n_blocks", "status")


@query(f"WITH l AS {LINES} SELECT DISTINCT a.l_orderkey, b.n FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey WHERE a.n = 1 AND (b.n = 1 OR b.l_linestatus = a.l_linestatus OR abs(b.n - a.n) <= 2)")
def records_neighbours(spark, sf_dir):
    from .queries import lines

    l = lines(spark, sf_dir).select(F.col("l_orderkey").alias("volume"), F.col("l_linenumber").alias("lesson"), F.col("l_linestatus").alias("unit"), F.col("l_linenumber").alias("no"))
    out = R.structural_neighbours(l.filter("no = 1").withColumn("key", F.col("volume")), l)
    return out.select(F.col("key").alias("l_orderkey"), F.col("lesson").alias("n"))


@query(
    "SELECT l_suppkey::VARCHAR AS new_block, array_to_string(list_transform(list_sort(list(DISTINCT {'p': l_linenumber, 'c': l_linenumber::VARCHAR})), lambda x: x.c), ',') AS old_blocks, max(l_linenumber) - min(l_linenumber) = count(DISTINCT l_linenumber) - 1 AS contiguous FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY 1"
)
def records_ordered_groups(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey").cast("string")).otherwise(" ").alias("new_block"), F.col("l_linenumber").cast("string").alias("old_block"), "l_linenumber")
    return R.ordered_groups(m, "new_block", "old_block", "l_linenumber").select("new_block", F.array_join("old_blocks", ",").alias("old_blocks"), "contiguous")


@query(
    "WITH t AS (SELECT l_orderkey, max(l_discount) AS m FROM lineitem GROUP BY 1) SELECT l.l_orderkey, min(l_suppkey) AS l_suppkey, max(m) AS l_discount FROM lineitem l JOIN t ON l.l_orderkey = t.l_orderkey AND l_discount = m WHERE m >= 0.04 GROUP BY 1"
)
def records_best_blocks(spark, sf_dir):
    return R.best_blocks(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_discount"), "l_orderkey", "l_suppkey", "l_discount", 0.04)


@query(
    "SELECT l_partkey, l_returnflag AS winner, n AS votes FROM (SELECT l_partkey, l_returnflag, count(*) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_returnflag) AS k FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2) WHERE k = 1"
)
def records_voted_blocks(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("b"))
    return R.voted_blocks(l, "l_partkey", "b")


@query(
    "WITH m AS (SELECT CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS old_id, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey END AS new_id FROM orders WHERE o_orderkey % 3 = 0), o AS (SELECT c_custkey, c_name FROM customer), n AS (SELECT o_orderkey, o_orderpriority FROM orders) "
    "SELECT 'matched' AS how, m.old_id, m.new_id, c_name AS old_name, o_orderpriority AS new_name FROM m LEFT JOIN o ON c_custkey = old_id LEFT JOIN n ON o_orderkey = new_id "
    "UNION ALL SELECT 'old_only', c_custkey, NULL, c_name, NULL FROM o WHERE NOT EXISTS (SELECT 1 FROM m WHERE old_id = c_custkey) UNION ALL SELECT 'new_only', NULL, o_orderkey, NULL, o_orderpriority FROM n WHERE NOT EXISTS (SELECT 1 FROM m WHERE new_id = o_orderkey)"
)
def records_reuse_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = o.filter("o_orderkey % 3 = 0").select(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).alias("old_id"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey")).alias("new_id"))
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return R.reuse_report(m, old, o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name")))


@query("SELECT p_partkey FROM part WHERE contains(lower(coalesce(p_name, '') || ' ' || coalesce(p_brand, '') || ' ' || coalesce(p_type, '')), 'ste') ORDER BY p_partkey LIMIT 50")
def records_searched(spark, sf_dir):
    """A search box: its limit is the feature."""
    return R.searched(table(spark, sf_dir, "part"), " STE ", ["p_name", "p_brand", "p_type"], ["p_partkey"], 50).select("p_partkey")


@query(
    "WITH s AS (SELECT l_orderkey, l_suppkey % 3 AS ref, CASE WHEN l_returnflag = 'N' THEN 0.5 * p WHEN l_linestatus = 'O' THEN CASE WHEN l_linenumber % 2 = 0 THEN 0.4 * t + 0.6 * p ELSE 0.15 * t + 0.85 * p END ELSE 0.72 * t + 0.28 * p END AS x "
    "FROM (SELECT *, l_discount * 10 AS t, CASE WHEN l_quantity > 5 THEN greatest(0, 1 - abs(l_tax * 10 - 0.3) * 2.5) ELSE 0 END AS p FROM lineitem)) SELECT l_orderkey, round(max(m), 6) AS fit FROM (SELECT l_orderkey, ref, avg(x) AS m FROM s GROUP BY 1, 2) GROUP BY 1"
)
def records_block_fit(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    score = R.atom_block_score(F.col("l_discount") * 10, F.col("l_returnflag") != "N", F.col("l_tax") * 10, F.when(F.col("l_quantity") > 5, F.lit(0.3)), F.col("l_linestatus") == "O", F.col("l_linenumber") % 2 == 0)
    s = l.select("l_orderkey", (F.col("l_suppkey") % 3).alias("ref"), score.alias("x"))
    return R.block_fit(s, "l_orderkey", "ref", "x").select("l_orderkey", F.round("fit", 6).alias("fit"))
