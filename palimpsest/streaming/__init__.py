"""Incremental recomputation: a file stream whose batches are merged by key. The reference has no event time, so there are no watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import keep_latest


def upsert_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], latest: str):
    """Merges each batch of Parquet files into the table at target, which keeps the latest row of each key; ends when no file is left."""

    def merge(batch: DataFrame, number: int) -> None:
        old = f"{target}/v{number}"
        rows = batch if number == 0 else spark.read.schema(schema).parquet(old).unionByName(batch)
        keep_latest(rows, keys, [F.desc(latest)]).write.mode("overwrite").parquet(f"{target}/v{number + 1}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
