"""Sources, sinks and the stream of upserts, by round trips."""

from pyspark.sql import functions as F

from palimpsest import sources
from palimpsest.streaming import upsert_stream

ROWS = [(1, "a", 1.5), (2, None, None), (2, "b", 2.0)]
SCHEMA = "id long, name string, x double"


def rows(df):
    return sorted((tuple(r) for r in df.select("id", "name", "x").collect()), key=repr)


def test_tables_by_ending(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for ending, write in ((".parquet", df.write.parquet), (".json", df.write.json), (".csv", lambda p: df.write.option("header", True).csv(p))):
        path = f"{tmp_path}/t{ending}"
        write(path)
        back = sources.read_table(spark, path)
        assert rows(back.select(F.col("id").cast("long").alias("id"), "name", F.col("x").cast("double").alias("x"))) == rows(df)


def test_cached_compares_know_their_pages(spark, tmp_path):
    for name, verdict in (("v_3_14.json", "same"), ("v_x.json", "other")):
        (tmp_path / name).write_text('{"verdict": "%s"}' % verdict)
    got = {r.verdict: (r.old_page, r.new_page) for r in sources.read_cached_compares(spark, str(tmp_path)).collect()}
    assert got == {"same": (3, 14), "other": (None, None)}


def test_only_partitions_with_rows_are_replaced(spark, tmp_path):
    path = f"{tmp_path}/p"
    sources.replace_partitions(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], SCHEMA), path, ["id"])
    sources.replace_partitions(spark.createDataFrame([(2, "c", 3.0)], SCHEMA), path, ["id"])
    assert {(r.id, r.name) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}


def test_reports_are_json_lines(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    sources.write_report(df, f"{tmp_path}/r")
    sources.write_report(df, f"{tmp_path}/by", "id")
    assert spark.read.json(f"{tmp_path}/r").count() == 3 and {r.id for r in spark.read.json(f"{tmp_path}/by").collect()} == {1, 2}


def test_a_stream_keeps_the_latest_row_of_each_key(spark, tmp_path):
    source, target, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    last = 0
    for batch in ([(1, "old", 1.0), (2, "two", 1.0)], [(1, "new", 2.0), (3, "three", 1.0)], [(1, "older", 0.5)]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        upsert_stream(spark, source, SCHEMA, target, checkpoint, ["id"], "x").awaitTermination()
        last += 1
    assert rows(spark.read.parquet(f"{target}/v{last}")) == [(1, "new", 2.0), (2, "two", 1.0), (3, "three", 1.0)]
