"""Queries of the edition match and of functions of titles: fixtures with values worked out by hand, and the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import decisions as D
from .functions import text as T
from .operators import editions as E
from .plans import page_steps
from .registry import query, table


@query(
    "WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS h, l_discount * 10 AS l, l_tax * 12 AS u, l_discount * 5 + l_tax * 5 AS c, l_linenumber % 4 - 1 AS g, CASE WHEN l_returnflag = 'R' THEN l_quantity / 45 END AS core FROM lineitem), "
    "m AS (SELECT *, CASE WHEN h < 0.405 OR g >= 3 OR (g >= 2 AND u < 0.38) OR (g >= 1 AND u < 0.38 AND c < 0.42) OR (u >= 0.38 AND l >= 0.36 AND l < 0.68) THEN false WHEN g = 0 AND u >= 0.38 AND c >= 0.42 AND l < 0.36 THEN true "
    "WHEN (u >= 0.38 AND l < 0.68) OR (u < 0.32 AND l < 0.44 AND c < 0.29) THEN false ELSE l >= 0.44 OR c >= 0.42 END AS k FROM p) "
    "SELECT l_orderkey, l_linenumber, g = 0 AND h >= 0.405 AND (k OR (u >= 0.38 AND l >= 0.36) OR coalesce(core - h < 0.08, false)) AS runner FROM m"
)
def match_runner_up(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    core = F.when(F.col("l_returnflag") == "R", q / 45)
    return l.select("l_orderkey", "l_linenumber", E.runner_up(q / 50, d * 10, t * 12, d * 5 + t * 5, F.col("l_linenumber") % 4 - 1, core).alias("runner"))


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN g = 0 AND s THEN 0 WHEN g = 0 THEN 1 WHEN g = 1 THEN 2 WHEN g = 2 THEN 3 ELSE 4 + g END AS place FROM (SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS g, l_returnflag = 'N' AS s FROM lineitem)"
)
def match_location_rank(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", E.location_rank(F.col("l_linenumber") - 1, F.col("l_returnflag") == "N").alias("place"))


@query("SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\\x{4e00}-\\x{9fff}]', '', 'g') AS body FROM documents")
def text_bodies(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.body_text_match_key(F.col("text")).alias("body"))


@query("SELECT l_orderkey, l_linenumber, coalesce(nullif(trim(CASE WHEN l_returnflag = 'N' THEN '  ' ELSE l_returnflag END), ''), trim(' ' || l_linestatus || ' ')) AS action FROM lineitem")
def decide_effective_action(spark, sf_dir):
    own = F.when(F.col("l_returnflag") == "N", "  ").otherwise(F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", D.effective_action(own, F.concat(F.lit(" "), "l_linestatus", F.lit(" "))).alias("action"))


@query(
    "SELECT o_orderkey, unnest(generate_series(o_custkey % 5, o_custkey % 5 + o_orderkey % 4 - 1)) AS page FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 4 > 0"
)
def rollup_page_steps(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    start = (F.col("o_custkey") % 5).cast("long")
    p = o.select("o_orderkey", start.alias("s"), (start + F.col("o_orderkey") % 4 - 1).alias("e"), F.when(F.col("o_orderstatus") == "O", "suggested").otherwise("done").alias("status"))
    return page_steps(p, "o_orderkey", "s", "e", "status")
