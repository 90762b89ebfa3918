"""Queries of catalogues, contents entries and page ranges: the driver's tables, and fixtures with values worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import contents as C
from .registry import query, table


@query("SELECT l_orderkey, l_suppkey, l_linenumber + coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 10 END, 0) AS page FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def contents_physical_pages(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("page"))
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 10).alias("offset"))
    return C.physical_pages(e, o, "l_orderkey", "page")


@query(
    "SELECT l_orderkey, l_suppkey, l_linenumber, CASE WHEN m THEN s - 2 ELSE s END AS start_page, CASE WHEN m THEN coalesce(e, s) - 2 ELSE e END AS end_page, m AS moved FROM "
    "(SELECT *, coalesce(min(s) OVER (PARTITION BY l_orderkey) - 2 >= 1, false) AND s IS NOT NULL AS m FROM (SELECT *, CASE WHEN l_returnflag <> 'R' THEN l_linenumber * 2 END AS s, CASE WHEN l_linestatus = 'O' THEN l_linenumber * 2 + 1 END AS e FROM lineitem))"
)
def contents_shifted_ranges(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber") * 2
    r = l.select("l_orderkey", "l_suppkey", "l_linenumber", F.when(F.col("l_returnflag") != "R", n).alias("start"), F.when(F.col("l_linestatus") == "O", n + 1).alias("end"))
    return C.shifted_ranges(r, "l_orderkey", -2).withColumnsRenamed({"start": "start_page", "end": "end_page"})


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 > 0 AND lower(trim(CASE WHEN o_orderstatus = 'P' THEN ' None ' ELSE o_orderstatus END)) NOT IN ('none', 'unmatched', 'no_match')")
def contents_matched_items(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", " None ").otherwise(F.col("o_orderstatus")).alias("method"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).alias("old"))
    return C.chosen_items(o, "method", "old", True, False).select("o_orderkey")


@query("SELECT o_orderstatus AS status_code, CASE WHEN o_orderstatus = 'P' THEN '待入库' WHEN o_orderkey % 3 > 0 AND o_orderkey % 4 > 0 THEN '已上架' ELSE '建设中' END AS shelf, count(*) AS n FROM orders GROUP BY 1, 2")
def contents_shelf_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    shelf = C.shelf_status(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 3, F.col("o_orderkey") % 4)
    return o.groupBy(F.col("o_orderstatus").alias("status_code"), shelf.alias("shelf")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(*) < 12 OR count(DISTINCT l_linestatus) < 3 OR max(l_linenumber) < count(*) * 0.6 AS suspect FROM lineitem GROUP BY 1")
def contents_suspects(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_linestatus").alias("u"), F.count("*").alias("n"), F.max("l_linenumber").alias("m"))
    return l.select("l_orderkey", C.is_suspect(F.col("u"), F.col("n"), F.col("m")).alias("suspect"))


