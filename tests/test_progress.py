"""The progress operators on nulls, empty tables and ties."""

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import progress as P

COMPARES = "v long, page long, t string, n int, i string, k int"


def test_page_changes(spark):
    lessons = spark.createDataFrame([(1, 1, 2, 4), (2, 1, 3, None), (3, 1, None, 5), (4, None, 2, 3), (5, 1, 4, 2)], "id long, v long, a long, b long")
    compares = spark.createDataFrame([(1, 2, "音标变动注意", 3, None, None), (1, 3, None, 9, "一致", 0), (1, 4, "标点与空格", -2, "x", 1), (None, 2, "文字差异", 5, None, None)], COMPARES)
    of = lambda c: {r["id"]: tuple(r)[1:] for r in P.page_changes(lessons, c, ["id"], "v", "a", "b", "page", "t", "n", "i", "k").collect()}
    assert of(compares) == {1: (3, 3, 2, 3, 1, [2, 4]), 2: (1, 1, 0, 0, 0, []), 3: (0, 0, 0, 0, 0, []), 4: (2, 0, 0, 0, 0, []), 5: (0, 0, 0, 0, 0, [])}
    assert of(spark.createDataFrame([], COMPARES))[1] == (3, 0, 0, 0, 0, [])


def test_text_changed(spark):
    rows = [("一致", False), (None, False), (" 没变化 ", False), ("标点差异", False), ("标点文字差异", True), ("音标变动注意", True), ("大改", True)]
    got = spark.createDataFrame(rows, "v string, want boolean").select("want", P.text_changed(F.col("v")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_compare_flags(spark):
    matches = "lesson long, new_id string, old_id string"
    blocks = "lesson long, {0}_id string, place int"
    new = spark.createDataFrame([(1, "a", 1, 0.9, 0.85), (1, "b", 2, 0.9, None), (1, "c", None, 0.9, 0.1)], blocks.format("new") + ", score double, runner_up double")
    old = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "z", 4)], blocks.format("old"))
    pairs = spark.createDataFrame([(1, "a", "z"), (1, "a", "z"), (1, "b", "x"), (1, "b", "z"), (1, "c", "x"), (1, "c", "y"), (1, "d", "q"), (1, None, "y"), (1, "b", "")], matches)
    got = {(r["flag"], r["target"]) for r in P.compare_flags(pairs, new, old, "lesson").collect()}
    assert got == {("duplicate_anchor", "x"), ("duplicate_anchor", "z"), ("duplicate_pair", "a"), ("low_confidence", "a"), ("non_contiguous_multi_anchor", "b"), ("order_inversion", "b")}
    assert P.compare_flags(spark.createDataFrame([], matches), new, old, "lesson").count() == 0


def test_compare_flags_in_few_shuffles(spark, tmp_path):
    """Blocks without a place, ids without a partner and equal places; the rows are read and dealt out once for each of the three inputs, and once by lesson."""
    columns = "lesson long, new_id string, old_id string, p int, score double, runner_up double"
    rows = [(1, "a", "x", 1, 0.9, 0.1), (1, "a", "x", 2, 0.9, 0.1), (1, "b", "q", 3, 0.9, 0.1), (1, "c", "x", 3, 0.9, 0.85), (1, "", "x", 9, 0.9, 0.9), (2, "a", "y", 1, 0.9, 0.1), (2, "b", "x", 1, 0.9, 0.1), (None, "a", "x", 1, 0.5, 0.5), (None, "a", "x", 2, 0.5, 0.5), (3, "e", None, 1, 0.5, 0.5), (3, "f", "", None, 0.5, None)]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/m")
    m = spark.read.parquet(f"{tmp_path}/m")
    new, old = m.groupBy("lesson", "new_id").agg(F.min("p").alias("place"), F.max("score").alias("score"), F.max("runner_up").alias("runner_up")), m.filter("old_id <> 'q'").groupBy("lesson", "old_id").agg(F.min("p").alias("place"))
    out = P.compare_flags(m.select("lesson", "new_id", "old_id"), new, old, "lesson")
    got = sorted((tuple(r) for r in out.collect()), key=str)
    high, medium = lambda i, flag, t: (i, flag, "high", t), lambda i, flag, t: (i, flag, "medium", t)
    want = [
        high(1, "duplicate_anchor", "x"), medium(1, "duplicate_pair", "a"), medium(1, "low_confidence", "c"), medium(1, "low_confidence", ""), high(1, "order_inversion", "c"),
        high(2, "order_inversion", "b"), medium(None, "duplicate_pair", "a"), medium(3, "low_confidence", "e"),
    ]
    assert got == sorted(want, key=str)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") <= 5


def test_recognition_and_readiness_of_nothing(spark):
    pages = spark.createDataFrame([(1, 1, None, None), (1, 2, True, True), (2, 1, False, None)], "lesson long, page int, done boolean, pic boolean")
    atoms = spark.createDataFrame([(1, 1, None), (1, 1, ""), (2, 1, "title"), (9, 1, "image")], "lesson long, page int, kind string")
    got = {r["lesson"]: r for r in P.recognition_status(pages, atoms, "lesson", "page", "done", "pic", "kind").collect()}
    assert (got[1]["text_complete"], got[1]["image_complete"], got[1]["atom_count"]) == (True, False, 2)
    assert (got[2]["text_complete"], got[2]["image_complete"]) == (True, True)
    none = spark.createDataFrame([], "v long, a int, b int")
    row = P.readiness(spark.createDataFrame([(1,)], "v long"), none, "v", "a", "b").first()
    assert (row["lesson_count"], row["catalog_ok"], row["parse_ok"]) == (0, False, False)


def test_contents_pages(spark):
    t = spark.createDataFrame([("目录\n水 1\n火 2",), (None,), ("山 1\r火2\r木头 33\r土地 4",), ("目录",)], "t string")
    got = t.select(T.catalog_line_count(F.col("t")).alias("n"), T.is_contents_page(F.col("t"), F.lit(1), T.catalog_line_count(F.col("t"))).alias("c")).collect()
    assert [(r["n"], r["c"]) for r in got] == [(0, True), (0, False), (2, True), (0, False)]
    pages = spark.createDataFrame([(1, 0, True, None), (1, 1, False, True), (1, 2, True, False), (2, 9, True, False)], "k int, p int, c boolean, b boolean")
    assert {tuple(r) for r in P.last_contents_page(pages, "k", "p", F.col("c"), F.col("b"), 8).collect()} == {(1, 0), (2, -1)}
