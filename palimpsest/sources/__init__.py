"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, JSON lines or CSV with a header, by the name's ending."""
    if path.rstrip("/").endswith((".json", ".jsonl")):
        return spark.read.json(path)
    if path.rstrip("/").endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    return spark.read.parquet(path)


def read_cached_compares(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Staged JSON files with the page pair out of their names (`..._<old>_<new>.json`)."""
    df = spark.read.option("pathGlobFilter", pattern).json(folder)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return df.withColumns({"old_page": F.regexp_extract(name, r"_(\d+)_(\d+)\.json$", 1).try_cast("int"), "new_page": F.regexp_extract(name, r"_(\d+)_(\d+)\.json$", 2).try_cast("int")})


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Overwrites the partitions that df has rows of, and no others: delete and append by key."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_report(df: DataFrame, path: str, by: str | None = None) -> None:
    """A flat report as JSON lines, one folder per value of `by`."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)
