"""Golden cases, worked out by hand from the rules."""

from pyspark.sql import functions as F

from palimpsest.functions import similarity as S
from palimpsest.functions import text as T
from palimpsest.operators import catalogue as C
from palimpsest.operators import matching as M
from palimpsest.operators import sequence as Q


def one(spark, rows, schema, **cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()]


def test_lesson_keys(spark):
    rows = [("1 水的变化",), ("水变化",), ("第3课 月相",), (None,), ("",)]
    assert one(spark, rows, "t string", k=T.lesson_reuse_match_key(F.col("t"))) == [("水变化",), ("水变化",), ("月相",), ("",), ("",)]


def test_norm_text_drops_latin_only_if_asked(spark):
    assert one(spark, [("哺（bǔ）乳 Abc-动物",)], "t string", a=T.norm_text(F.col("t")), b=T.norm_text(F.col("t"), drop_latin=False)) == [("哺乳动物", "哺乳abc动物")]


def test_ranges_and_specs(spark):
    assert one(spark, [([5, 3, 4],), ([7, 3],), ([],), (None,)], "p array<int>", r=T.format_cw_range(F.col("p"))) == [("P3-5",), ("P3/P7",), ("",), ("",)]
    assert one(spark, [("5-3",), ("3",), ("x",)], "p string", r=T.parse_slides_spec(F.col("p"))) == [([3, 4, 5],), ([3],), ([],)]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_ratios():
    for a, b in [("kitten", "sitting"), ("月相", "月亮"), ("", ""), ("", "a"), ("abcabc", "cba"), ("aaaa", "aa")]:
        assert S.lcs_length(a, b) == lcs(a, b)
    assert round(S.indel_ratio("kitten", "sitting"), 4) == 0.6154
    assert S.partial_ratio("cat", "a cat sat") == 1.0
    assert S.token_set_ratio("new york mets", "mets new york city") == 1.0
    assert S.token_set_ratio("", "a") == 0.0
    assert S.common_substring("abcde", "xbcdy") == 3
    assert S.raw_similarity("水变化", "水变化") == 1.0 and S.raw_similarity("", "x") == 0.0


def test_longest_run_takes_the_first_of_equals(spark):
    rows = [("a", i, f) for i, f in enumerate([1, 1, 0, 1, 1])] + [("b", 0, 1), ("c", 0, 0)]
    df = spark.createDataFrame(rows, "k string, o int, f int")
    out = {r.k: (r.raw_length, r.length, r.first_place) for r in Q.longest_run(df, "k", ["o"], F.col("f") == 1).collect()}
    assert out == {"a": (2, 2, 1), "b": (1, 0, None), "c": (0, 0, None)}


def test_unit_page_ends(spark):
    df = spark.createDataFrame([("v", 1, "u1", 2), ("v", 2, "u1", 6), ("v", 3, "u2", 12)], "k string, o int, u string, s int").withColumn("total", F.lit(20))
    assert [r.page_end for r in Q.unit_page_ends(df, "k", "o", "u", "s", "total").orderBy("o").collect()] == [5, 10, 20]


def test_greedy_assignment_is_one_to_one(spark):
    df = spark.createDataFrame([("g", 1, 1, 0.9), ("g", 1, 2, 0.8), ("g", 2, 1, 0.9), ("g", 2, 2, 0.3), ("h", 1, 1, 0.2)], "g string, l int, r int, s double")
    assert sorted(tuple(x) for x in M.greedy_assignment(df, "g", "l", "r", "s", 0.25).collect()) == [("g", 1, 1, 0.9), ("g", 2, 2, 0.3)]


def test_merge_by_key_keeps_the_first_place(spark):
    a = spark.createDataFrame([("d", 1, "x", 1), ("d", 2, "y", 5)], "doc string, pos int, key string, score int")
    b = spark.createDataFrame([("d", 1, "x", 9), ("d", 2, "z", 1)], "doc string, pos int, key string, score int")
    out = M.merge_by_key(a, b, ["doc", "key"], "pos", [F.desc("score")]).orderBy("pos").collect()
    assert [(r.key, r.score) for r in out] == [("x", 9), ("y", 5), ("z", 1)]


def test_upsert_stream(spark, tmp_path):
    from palimpsest.streaming import upsert_stream

    schema = "id int, v string, at int"
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    upsert_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), ["id"], "at").awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/v1")).collect()) == [(1, "b", 2), (2, "c", 1)]


def test_coarse_match(spark):
    from palimpsest.plans import coarse_match

    new = spark.createDataFrame([("n1", "v", "u", "1 水的变化"), ("n2", "v", "u", "单元小结"), ("n3", "w", "u", "月相")], "id string, volume string, unit string, lesson string")
    old = spark.createDataFrame([("o1", "v", "u", "1 水变化"), ("o2", "w", "u", "月相变化")], "old_id string, volume string, unit string, lesson string")
    assert sorted((r.id, r.old_id, r.tier) for r in coarse_match(new, old).collect()) == [("n1", "o1", "exact"), ("n3", "o2", "similar")]


def test_catalogue_edges(spark):
    pages = spark.createDataFrame([(1, 1, None), (1, 2, " "), (1, 3, "x" * 30), (2, 1, "y" * 24), (3, 31, "")], "k int, p int, t string")
    assert {r.k: r.is_sparse for r in C.sparse(pages, "k", "p", "t").collect()} == {1: True, 2: False, 3: True}  # 3 has no page that counts
    rows = spark.createDataFrame([("a", "u", 1, 1), ("a", "u", 4, 2)], "k string, unit string, no int, pos int")
    more = spark.createDataFrame([("a", "u", 2, 5), ("a", "u", 2, 3), ("a", "u", 4, 1), ("a", "v", 3, 1), ("a", "u", 5, 1), ("a", "u", None, 1), ("b", "u", 2, 1)], rows.schema)
    assert sorted((r.no, r.pos) for r in C.add_misgraded(rows, more, "k", "unit", "no", "pos").collect()) == [(1, 1), (2, 3), (4, 2)]
    assert C.add_misgraded(rows.limit(0), more, "k", "unit", "no", "pos").count() == 0


def test_trim_tail_keeps_the_first_page(spark):
    ranges = spark.createDataFrame([(1, "v", 1, 4), (2, "v", 5, 6), (3, "w", 1, 3)], "id int, volume string, s int, e int")
    pages = spark.createDataFrame([("v", p, p in (2, 4, 5, 6)) for p in range(1, 7)] + [("w", 3, None)], "volume string, page int, blank boolean")
    out = C.trim_tail(ranges, pages, ["id"], "volume", "page", "s", "e", "blank")
    assert {r.id: (r.s, r.e) for r in out.collect()} == {1: (1, 3), 2: (5, 5), 3: (1, 3)}


def test_coverage_and_changes(spark):
    blocks = spark.createDataFrame([(1, "a", ["x", "y", "x"]), (1, "b", ["y", "z"]), (1, "c", []), (2, "d", None)], "lesson int, block string, atoms array<string>")
    seen = spark.createDataFrame([(1, "x"), (1, "y"), (1, "q"), (3, "x")], "lesson int, atom string")
    out = {r.lesson: tuple(r)[1:] for r in C.coverage(blocks, seen, "lesson", "block", "atoms", "atom").collect()}
    assert out == {1: (3, 2, 1, 1), 2: (0, 0, 0, 1), 3: (1, 0, 0, 0)}
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None), (4, None)], a.schema)
    assert sorted(r.k for r in C.changed_rows(a, b, ["k"], ["v"]).collect()) == [1, 3, 4]
