"""Aggregations: all partial on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decisions import ACTIONS, EFFORT, page_level


def action_stats(df: DataFrame, key: str, action: Column) -> DataFrame:
    """key, code, n, share (3 places): counts of each action; unknown and empty ones are pending."""
    code = F.when(action.isin(*ACTIONS), action).otherwise("pending")
    counts = df.select(key, code.alias("code")).groupBy(key, "code").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(key)), 3))


def modification_percent(df: DataFrame, key: str, action: Column) -> DataFrame:
    """key, pct: the mean effort of the actions, 0 to 100; halves go to the even number."""
    effort = F.coalesce(*[F.when(action == a, n) for a, n in EFFORT.items()], F.lit(EFFORT["pending"]))
    return df.select(key, effort.alias("e")).groupBy(key).agg(F.bround(F.sum("e") / F.count("*"), 0).cast("long").alias("pct"))


def page_levels(df: DataFrame, keys: list[str], pages: str, reusable: Column) -> DataFrame:
    """keys, page, block_count, share, level: of the blocks on each page the share that can be used again."""
    on = df.select(*keys, reusable.alias("r"), F.explode(pages).alias("page"))
    out = on.groupBy(*keys, "page").agg(F.count("*").alias("block_count"), F.round(F.avg(F.col("r").cast("double")), 3).alias("share"))
    return out.withColumn("level", page_level(F.col("share")))


def status_totals(df: DataFrame, group: str, status: str) -> DataFrame:
    """group (null: all groups), status, n: counts per group and over all, in one pass."""
    return df.rollup(status, group).agg(F.count("*").alias("n"), F.grouping(status).alias("g")).filter("g = 0").select(group, status, "n")


def histogram(df: DataFrame, value: str, domain: list) -> DataFrame:
    """value, n for each value of the domain, those that are not there included."""
    known = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(domain)], f"place int, {value} string")
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return known.join(counts, value, "left").select("place", value, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def slot_status(df: DataFrame, key: str, status: str, building: str, shelved: str, waiting: str) -> DataFrame:
    """One status per slot: building if any copy is or if copies differ, shelved if all are, else waiting."""
    s = F.col(status)
    out = df.groupBy(key).agg(F.bool_or(s == building).alias("b"), F.bool_and(s == shelved).alias("a"), F.bool_or(s == shelved).alias("o"))
    return out.select(key, F.when(F.col("b"), building).when(F.col("a"), shelved).when(F.col("o"), building).otherwise(waiting).alias("slot_status"))


def reuse_ratio(df: DataFrame, key: str, slides: str, reusable: Column) -> DataFrame:
    """key, total, used, ratio: different slides, those of reusable rows, and their share (of at least one)."""
    on = df.select(key, reusable.alias("r"), F.explode(slides).alias("s"))
    out = on.groupBy(key).agg(F.count_distinct("s").alias("total"), F.count_distinct(F.when(F.col("r"), F.col("s"))).alias("used"))
    return out.withColumn("ratio", F.round(F.col("used") / F.greatest(F.lit(1), F.col("total")), 4))


def experiment_status(df: DataFrame, key: str, experiment: Column, action: Column, kept: list[str]) -> DataFrame:
    """key, n_experiments, all_retained: null while any is pending or if there are none."""
    on = df.select(key, experiment.alias("x"), F.coalesce(F.nullif(action, F.lit("")), F.lit("pending")).alias("a"))
    out = on.groupBy(key).agg(F.count_if("x").alias("n_experiments"), F.bool_or(F.col("x") & (F.col("a") == "pending")).alias("p"), F.bool_and(~F.col("x") | F.col("a").isin(*kept)).alias("k"))
    return out.select(key, "n_experiments", F.when((F.col("n_experiments") > 0) & ~F.col("p"), F.col("k")).alias("all_retained"))


def most_frequent(df: DataFrame, key: str, vote: str) -> DataFrame:
    """key, winner, votes: the value with most votes; of equals the smallest."""
    counts = df.groupBy(key, vote).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(F.struct(F.col(vote).alias("v"), "n"), F.struct(-F.col("n"), F.col(vote))).alias("b")).select(key, F.col("b.v").alias("winner"), F.col("b.n").alias("votes"))
