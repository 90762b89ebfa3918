"""Queries of review states, block profiles and notes: the driver's tables, and fixtures with values worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import review as R
from .registry import query, table

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'pending_review' WHEN 'O' THEN 'suggested' ELSE 'rejected' END"


def pairs(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "pending_review").when(F.col("o_orderstatus") == "O", "suggested").otherwise("rejected")
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey")).alias("old"))


@query(f"SELECT o_orderkey, CASE WHEN {STATUS} = 'pending_review' AND o_orderkey % 4 > 0 THEN 'confirmed' ELSE {STATUS} END AS status FROM orders")
def review_confirm_all(spark, sf_dir):
    return R.confirmed_all(pairs(spark, sf_dir), "status", "old").select("o_orderkey", "status")


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 AND {STATUS} <> 'rejected' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30) THEN 'pending_review' ELSE {STATUS} END AS status FROM orders")
def review_ready(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.ready_for_review(pairs(spark, sf_dir), done, "o_orderkey", "status", "old").select("o_orderkey", "status")


@query(
    "WITH l AS (SELECT l_orderkey, l_quantity < 10 AS f, l_quantity > 30 AS x, CASE l_returnflag WHEN 'A' THEN 'reuse_as_is' WHEN 'R' THEN 'optimize' ELSE CASE WHEN l_discount < 0.05 THEN 'new_build' ELSE '' END END AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS p FROM lineitem), "
    "e AS (SELECT *, a IN ('reuse_as_is', 'optimize') AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY p) AS rn FROM l WHERE NOT f), i AS (SELECT *, rn - sum(r::INT) OVER (PARTITION BY l_orderkey ORDER BY rn) AS g FROM e), n AS (SELECT l_orderkey, max(n) AS n FROM (SELECT l_orderkey, g, count(*) AS n FROM i WHERE r GROUP BY 1, 2) GROUP BY 1), "
    "t AS (SELECT l_orderkey, count(*) FILTER (x) AS nx, CASE WHEN count(*) FILTER (x) > 0 AND NOT bool_or(x AND a = '') THEN bool_and(NOT x OR r) END AS k FROM e GROUP BY 1), c AS (SELECT l_orderkey, count(*) AS total, count(*) FILTER (NOT f) AS effective, count(*) FILTER (f) AS fragments FROM l GROUP BY 1) "
    "SELECT c.*, CASE WHEN n >= 2 THEN n ELSE 0 END AS run, round(CASE WHEN n >= 2 THEN n ELSE 0 END / greatest(effective, 1), 3) AS share, coalesce(nx, 0) AS n_experiments, k AS all_retained FROM c LEFT JOIN n USING (l_orderkey) LEFT JOIN t USING (l_orderkey)"
)
def review_lesson_stats(spark, sf_dir):
    from .queries import lines

    action = F.when(F.col("l_returnflag") == "A", "reuse_as_is").when(F.col("l_returnflag") == "R", "optimize").when(F.col("l_discount") < 0.05, "new_build").otherwise("")
    b = lines(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").alias("place"), (F.col("l_quantity") < 10).alias("fragment"), action.alias("action"), (F.col("l_quantity") > 30).alias("experiment"))
    return R.lesson_stats(b, "l_orderkey")


@query(
    "SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN t <= 0 THEN '知识点讲解' WHEN l_linenumber <= 1 THEN '课件名称页' WHEN l_linenumber >= t THEN '课件尾页（练习提醒）' WHEN l_linenumber = 2 THEN '导入' WHEN l_linenumber = t - 1 AND t > 3 THEN '知识小结' ELSE '知识点讲解' END AS stage "
    "FROM (SELECT *, l_suppkey % 9 AS t FROM lineitem)"
)
def review_stages(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", R.stage_name(F.col("l_linenumber"), F.col("l_suppkey") % 9).alias("stage"))


