"""Whole jobs out of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators.matching import tiered_match


def coarse_match(new: DataFrame, old: DataFrame) -> DataFrame:
    """Lessons of a new edition (id, volume, unit, lesson) to those of an old one (old_id, volume, unit, lesson), by exact key, else by similar titles in the volume."""
    keyed = lambda d: d.filter(~T.is_unit_summary_label(F.col("lesson"))).withColumn("k", T.lesson_reuse_match_key(F.col("lesson")))
    return tiered_match(keyed(new), keyed(old), "k", "volume", "id", "old_id", S.raw(F.col("n_k"), F.col("o_k")), S.THRESHOLD, [F.col("o_lesson")])


def page_steps(pairs: DataFrame, key: str, start: str, end: str, status: str) -> DataFrame:
    """One row per page of each pair that is still suggested and has a range."""
    return pairs.filter((F.col(status) == "suggested") & (F.col(start) <= F.col(end))).select(key, F.explode(F.sequence(start, end)).alias("page"))
