"""Cases in which a query once differed from its SQL, did less than it said, or grew faster than its input."""

import datetime
import re

import duckdb
import pytest

LINEITEM = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
DAY = datetime.datetime(1995, 1, 1)


def both_ways(spark, folder, name: str) -> tuple[list, list]:
    """The rows of a query and of its SQL over the tables of a folder."""
    import __spark_entry__

    df = __spark_entry__.queries()[name](spark, str(folder))
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}/*.parquet'")
    told = con.execute(f"SELECT {', '.join(df.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=str), sorted(told, key=str)


def test_anchors_at_the_threshold(spark, tmp_path):
    """F8: two boxes whose score is 0.38 but for the order of a product and a division."""
    spark.createDataFrame([(1, 1, 1, 3, 12.0, 1.0, 0.01, 0.07, "N", "O", DAY), (1, 1, 1, 4, 24.0, 1.0, 0.04, 0.08, "N", "O", DAY)], LINEITEM).write.parquet(f"{tmp_path}/lineitem.parquet")
    mine, told = both_ways(spark, tmp_path, "layout_image_anchors")
    assert mine == told == [(1, 3, 4, True)]


def test_hints_of_rows_alike(spark, tmp_path):
    """of two claimants alike in all that orders them one is the owner, not both; rows without a claimed row are kept."""
    row = lambda order, part, flag: (order, part, 1, 6, 12.0, 5.0, 0.01, 0.07, flag, "O", DAY)
    spark.createDataFrame([row(1, 7, "N"), row(1, 7, "N"), row(2, 8, "A"), row(2, 8, "A"), row(3, 9, "R"), row(4, None, "N")], LINEITEM).write.parquet(f"{tmp_path}/lineitem.parquet")
    mine, told = both_ways(spark, tmp_path, "sequence_build_hints")
    assert mine == told and [x for x in mine if x[2]] == [(1, 6, "traceability"), (2, 6, "primary_collision")]


@pytest.mark.parametrize("few", [0, 3, 64])
def test_overlaps_of_small_and_large_pages(spark, monkeypatch, few):
    """Pages of FEW boxes or less meet directly, larger ones through the grid; both tell each pair that has a point in common once."""
    import random

    from palimpsest.operators import grid

    monkeypatch.setattr(grid, "FEW", few)
    r = random.Random(5)
    boxes = []
    for page, many in (("one", 1), ("two", 2), ("four", 4), ("many", 70)):
        for i in range(many):
            x, y = round(r.uniform(-0.1, 1), 2), round(r.uniform(-0.1, 1), 2)
            boxes.append((page, i, x, y, round(x + r.choice([0, 0.1, 0.3]), 2), round(y + r.choice([0, 0.1, 0.3]), 2)))
    boxes += [("two", 7, None, 0.0, 1.0, 1.0), ("four", 8, 1.0, 0.0, 0.5, 1.0), (None, 0, 0.0, 0.0, 1.0, 1.0), (None, 1, 0.0, 0.0, 1.0, 1.0)]
    whole = [b for b in boxes if b[0] and None not in b and b[4] >= b[2]]
    want = sorted((a[0], a[1], b[1]) for a in whole for b in whole if a[0] == b[0] and a[1] < b[1] and max(a[2], b[2]) <= min(a[4], b[4]) and max(a[3], b[3]) <= min(a[5], b[5]))
    df = grid.overlapping(spark.createDataFrame(boxes, "page string, id long, x0 double, y0 double, x1 double, y1 double"), "page")
    assert sorted(tuple(x) for x in df.select("page", "a_id", "b_id").collect()) == want


def test_bodies_go_before_the_windows(spark):
    """pairs of lessons carry a body's score, not the bodies, through the windows."""
    from pyspark.sql import functions as F

    from palimpsest.operators import editions as E

    text = "水" * 300
    row = lambda i, name: (i, "p", 3, "上", "第一单元 水", "", name, text)
    schema = "id string, pool string, grade int, semester string, unit string, no string, name string, body string"
    new, old = E.candidates(spark.createDataFrame([row("n", "水的变化一")], schema)), E.candidates(spark.createDataFrame([row("o", "水的变化二")], schema))
    out = E.hybrid_scores(E.scored_pairs(new, old))
    assert not {"n_body", "o_body"} & set(out.columns)
    assert [tuple(x) for x in out.select("n_id", "o_id", F.round("body", 6)).collect()] == [("n", "o", 1.0)]


def test_body_keys_are_made_before_lessons_meet(spark):
    """F2 of round 4: a body's key is made once a lesson, not for each pair; common subsequences of long texts, from either side, are those of plain dynamic programming."""
    import random

    from palimpsest.functions import similarity as S
    from palimpsest.operators import editions as E

    row = lambda i, name: (i, "p", 3, "上", "第一单元 水", "", name, "水a" * 50)
    schema = "id string, pool string, grade int, semester string, unit string, no string, name string, body string"
    new, old = E.candidates(spark.createDataFrame([row("n", "水的变化一")], schema)), E.candidates(spark.createDataFrame([row("o", "水的变化二")], schema))
    out = E.hybrid_scores(E.scored_pairs(new, old))
    assert [x.body for x in out.collect()] == [1.0]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    key = "regexp_replace(coalesce(body"
    assert key not in (above := plan[: plan.index("Join Inner")]) and "regexp_replace(coalesce(n_body" not in above and plan.count(key) == 2
    r = random.Random(42)
    for n, m, letters in ((3, 200, "ab"), (700, 90, "abcd水火"), (90, 700, "abcd水火"), (700, 600, "abcdefgh"), (600, 610, "".join(map(chr, range(97, 400))))):
        a, b = ("".join(r.choice(letters) for _ in range(k)) for k in (n, m))
        line = [0] * (m + 1)
        for x in a:
            line = [0] + [k for k in _next(line, x, b)]
        assert S.lcs_length(a, b) == S.lcs_length(b, a) == line[-1]


def _next(line: list, x: str, b: str):
    """The next line of the table of common subsequences."""
    last = 0
    for j, y in enumerate(b):
        last = line[j] + 1 if x == y else max(line[j + 1], last)
        yield last


def test_names_are_made_once_before_pairs(spark):
    """above the join of files and lessons only the pairs' scores are made, once, whatever filters follow."""
    from palimpsest.operators import records as R

    files = spark.createDataFrame([("p", "课件_水的变化.zip")], "pool string, file string")
    lessons = spark.createDataFrame([("p", "l", "", 1, "第一单元", "1", "水的变化")], "pool string, lesson string, course_id string, unit_no int, unit string, no string, name string")
    out = R.file_candidates(files, lessons).filter("score >= 0.9")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join ")]
    assert 0 < above.count("EvalPython") <= 1
    assert [(x.lesson, x.score) for x in out.collect()] == [("l", 0.94)]


def test_book_names_are_read_once(spark):
    """a file's name is cleaned once for its grade, not once for each pattern; scores are what they were."""
    from pyspark.sql import functions as F

    from palimpsest.operators import records as R

    rows = [("XK-3S-NEW 扫描版.pdf",), ("湘科版三年级上册 1.pdf",), ("苏教版三年级上册.pdf",), ("说明.pdf",), ("xiangke 四下.pdf",), (None,)]
    f = spark.createDataFrame(rows, "file string")
    known = R.grade_and_term(F.col("file"))
    score = R.book_score(F.col("file"), F.lit("XK-3S-NEW"), F.lit(3), F.lit("上"), F.lit("湘科版"), F.lit("XK"), F.lit(""))
    out = f.select("file", known.alias("known"), score.alias("score"))
    assert [(x.known and tuple(x.known)) for x in out.collect()] == [(3, "上"), (3, "上"), (3, "上"), None, (4, "下"), None]
    assert [x.score > 0 for x in out.collect()] == [True, True, False, False, False, False]
    plan = f.select(known.alias("known"))._jdf.queryExecution().optimizedPlan().expressions().mkString()
    assert plan.count("教科书") <= 1


#: Finding, query, and a column with some of the values that its SQL had lost.
WHOLE = [
    ("F10", "text_norm_unicode", "line", {"第十二单元 雨雪花草 单元小结"}),
    ("F11", "diff_block_verdicts", "verdict", {"一致", "仅标点差异", "音标变动注意", "文字有差异", "新有旧无", "旧有新无"}),
    ("F11", "diff_block_verdicts", "pinyin", {True, False}),
    ("F12", "diff_text_forms", "role", {"writing_grid", "side_note", "other"}),
    ("F13", "records_name_similarity", "names", {0.0}),
    ("F14", "review_notes", "note", {"旧课件P9；课件固定课件例题，无新教材对应块；旧课件该页可直接沿用；新侧无原子文本，需核对建块；旧课件可直接沿用", "请补充：旧课件哪页→新教材哪块→怎么改"}),
    ("F15", "decide_change_types", "change_type", {"L001", "L002", "L004", "L005", "L006", "L008", "L009"}),
]


@pytest.mark.parametrize("finding, name, column, values", WHOLE)
def test_whole_again(spark, tmp_path, finding, name, column, values):
    """Columns and cases that a change of the SQL had left out: the query and its SQL agree, and tell them."""
    text = "\n".join(f"{chr(97 + i % 26)}bcd efgh {i % 7}" for i in range(30))
    spark.createDataFrame([(1, text), (2, None), (3, "abc\n\nabcdabcd")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    mine, told = both_ways(spark, tmp_path, name)
    assert mine == told
    import __spark_entry__

    at = __spark_entry__.queries()[name](spark, str(tmp_path)).columns.index(column)
    assert values <= {x[at] for x in mine}


def test_pairs_of_a_brand_are_spread(spark, tmp_path):
    """the pairs of one brand are made by many tasks, each pair once; rounded shares are those of round()."""
    from pyspark.sql import functions as F

    from palimpsest.functions import similarity as S

    names = ["large ring", "hot bolt", "水滴 ring", "水壶", "abcdefghijklmnopqrstuvwxyz 0123456789" * 2, "".join(map(chr, range(33, 127)))]
    spark.createDataFrame([(i, names[i % 6], "Brand#1") for i in range(60)], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    mine, told = both_ways(spark, tmp_path, "similarity_char_jaccard")
    assert mine == told and len(mine) == 60 * 59 // 2
    import __spark_entry__

    made_by = __spark_entry__.queries()["similarity_char_jaccard"](spark, str(tmp_path)).select(F.spark_partition_id().alias("task")).distinct()
    assert made_by.count() >= 4
    bits = lambda c: F.struct(F.expr(f"shiftleft(1L, {c}) - 1").alias("low"), F.lit(0).cast("long").alias("high"), F.array().cast("array<string>").alias("rest"))
    all_ = spark.range(63).select(F.col("id").cast("int").alias("x")).crossJoin(spark.range(63).select(F.col("id").cast("int").alias("y")))
    wrong = all_.filter(S.char_sets_jaccard(bits("x"), bits("y"), 6) != F.round(S.char_sets_jaccard(bits("x"), bits("y")), 6))
    assert wrong.count() == 0


def test_rows_of_one_name_go_together(spark, tmp_path):
    """F3 of round 4: what is shuffled grows with the names and the keys of their rows, not with whole rows sent to each share; equal names, null brands and null keys count as in SQL."""
    import __spark_entry__

    rows = [(i % 150 if i % 50 else None, ["large ring", "hot bolt", "水滴", "ring"][i % 4], [None, "Brand#1", "Brand#2"][i % 3]) for i in range(400)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    mine, told = both_ways(spark, tmp_path, "similarity_char_jaccard")
    assert mine == told and mine
    plan = __spark_entry__.queries()["similarity_char_jaccard"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    generate, join = plan.index("Generate explode(olds"), plan.index("Join Inner")
    assert generate < join and "bit_count" not in plan[:generate] and plan.count("collect_list(p_partkey") == 2


def test_only_pairs_that_come_up_are_scored(monkeypatch):
    """of a page of equal boxes no pair is scored by its subsequences, of random ones fewer than all; the anchors are those of all scores in order."""
    import random

    from palimpsest.operators import alignment as A

    made = []
    whole = A.S.indel_ratio
    monkeypatch.setattr(A.S, "indel_ratio", lambda a, b: made.append((a, b)) or whole(a, b))
    r = random.Random(3)
    text = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(8, 40)))
    for kind in range(60):
        old = [text("abcd efgh") for _ in range(r.randint(1, 9))]
        new = list(old) if kind == 0 else [r.choice([t, t + text("ab"), text("abcd"), t[: len(t) // 2], ""]) for t in old] + [text("efgh")]
        rows = [("p", A._OLD, i, None, t, *[None] * 7) for i, t in enumerate(old)] + [("p", A._NEW, None, i, t, *[None] * 7) for i, t in enumerate(new)]
        flat = lambda: (round(r.random() * 0.5, 2), r.choice([0.0, 0.5, 0.93, 1.0]), r.choice([5, 12, 30]), r.choice([0.0, 0.14, -0.16]), r.choice([0.0, 0.08, -0.5]), r.choice([0.0, 0.28]))
        pairs = [("p", A._PAIR, i, j, None, *flat(), None) for i in range(len(old)) for j in range(len(new))]
        if kind == 0:
            pairs = [(*p[:5], 0.3, 1.0, 12, 0.0, 0.0, 0.0, None) for p in pairs]
        made.clear()
        got = {(x[2], x[3]): x[11] for x in A._chosen(rows + pairs) if x[1] == A._PAIR}
        assert len(made) == 0 if kind == 0 else len(set(made)) <= len(pairs)
        scored = {}
        for p in pairs:
            a, b = old[p[2]], new[p[3]]
            ratio = whole(a, b) if a and b else 0.0
            scored[p[2], p[3]] = (A._score(max(ratio, 0.55 * ratio + 0.45 * p[5]), *p[6:11]), max(ratio, p[5]), ratio)
        chosen, olds, news = [], set(), set()
        for o, n in sorted(scored, key=lambda k: (-scored[k][0], abs(k[0] - k[1]), k)):
            if scored[o, n][0] >= A.LEAST and o not in olds and n not in news:
                olds.add(o), news.add(n), chosen.append((o, n))
        A._repair(chosen, lambda o, n: scored[o, n][1], lambda o, n: scored[o, n][2], lambda o, n: 1.0)
        assert got == {k: scored[k][0] for k in chosen}


def test_boxes_not_pairs_go_to_the_helper(spark):
    """F4 of round 4: a page's boxes, not all pairs of them, go to the helper that aligns them; what it makes of two boxes is what the columns say."""
    import random

    from pyspark.sql import functions as F

    from palimpsest.operators import alignment as A

    r = random.Random(44)
    texts = ["“小草发芽了”是吗？水火", "水火山石田土木禾虫鱼？", "水火山石田土木禾虫鱼鸟？", "我说「小草发芽了」", "abcd efgh", "abcd", "图1 水", "水%", "", None, "水" * 130]
    edge = lambda *of: r.choice([None, *of])
    boxes = [(1, i, edge(0.1, 0.4), edge(0.2, 0.5), edge(0.1, 0.5, 0.05), edge(0.3, 0.9), r.choice(texts)) for i in range(60)]
    b = spark.createDataFrame(boxes, "pair int, id int, y0 double, y1 double, x0 double, x1 double, text string")
    box = F.struct("y0", "y1", "x0", "x1", "text")
    b = b.select("id", A.traits(box, A.C.page_norm(F.col("text"))).alias("t"), A.letters(A.C.page_norm(F.col("text"))).alias("c"))
    parts = A.score_parts(F.col("t"), F.col("u"))
    met = b.crossJoin(b.select(F.col("id").alias("jd"), F.col("t").alias("u"), F.col("c").alias("e")))
    want = {(x.id, x.jd): tuple(x)[2:] for x in met.select("id", "jd", A.letters_overlap(F.col("c"), F.col("e")), *parts.values()).collect()}
    known = {x.id: x.t.asDict() | {"letters": frozenset(x.c) - {""}} for x in b.collect()}
    assert {(i, j): A._pair_parts(known[i], known[j]) for i in known for j in known} == want
    page = spark.createDataFrame(boxes, "pair int, id int, y0 double, y1 double, x0 double, x1 double, text string")
    assert "Join" not in A.align(page, page, "pair")._jdf.queryExecution().optimizedPlan().toString()


def test_covers_are_found_without_pairs(spark):
    """F1 of round 4: which boxes cover which is told by a page's boxes, not by joined pairs of them; the same covers as those of all pairs."""
    import random

    from palimpsest.functions import similarity as S
    from palimpsest.operators import containment as N

    r = random.Random(41)
    text = lambda n: "".join(r.choice("abcd水火") for _ in range(n))
    new = [(p, i, text(r.randint(0, 40))) for p in range(12) for i in range(6)]
    blur = lambda t: t if r.random() < 0.4 else t[: len(t) // 2] + "x" + t[len(t) // 2 + 1 :]
    old = [(p, i, t + blur(r.choice(new)[2] if r.random() < 0.3 else new[(p * 6 + i + 1) % len(new)][2]) if i % 2 else t) for p, i, t in new] + [(99, 0, text(20)), (0, 9, None)]
    side = lambda rows: spark.createDataFrame(rows, "pair int, id long, text string")
    for edge, least, shortest in ((False, N.LIKE, N.SHORTEST), (True, N.EDGE_LIKE, N.EDGE_SHORTEST)):
        out = N.covering(side(old), side(new), "pair", edge)
        want = {(p, s, i, j) for s, hosts, parts in (("old", old, new), ("new", new, old)) for p, i, h in hosts for q, j, t in parts if p == q and shortest <= len(t or "") <= N.LARGEST * len(h or "") and S.reaches(h or "", t or "", least)}
        assert sorted(map(tuple, out.collect())) == sorted(want) and want
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_read_as_chinese_once(spark, tmp_path):
    """a plan makes the Chinese characters of a line once for each time that it reads the lines, not once for each use."""
    import __spark_entry__

    spark.createDataFrame([(1, "abc def\nxyz")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("layout_reading_text", "catalogue_listed", "catalogue_merged", "contents_experiments"):
        plan = __spark_entry__.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert 1 <= plan.count("translate(lower(") <= plan.count("FileScan"), name


def test_best_stretches_from_one_table():
    """the best stretches of many pairs at once are those of all stretches one by one."""
    import random

    from palimpsest.functions import similarity as S

    r = random.Random(4)
    text = lambda: "".join(r.choice("abcde 水") for _ in range(r.randint(0, 30)))
    pairs = [(text(), text()) for _ in range(400)] + [(t, t[::-1]) for t in (text() for _ in range(40))] + [("", ""), ("a", ""), ("ab", "ba")]
    assert S.partial_ratios(pairs) == [S.partial_ratio(a, b) for a, b in pairs]


def test_whole_lines_are_compared(spark, tmp_path):
    """F5 of round 4: lines are compared whole; tables of texts of uneven lengths, side by side, give the best stretches of all stretches one by one."""
    import random

    import __spark_entry__
    from palimpsest.functions import similarity as S

    r = random.Random(45)
    line = lambda n: " ".join(r.choice(["ab", "cab", "水火", "d"]) for _ in range(n))
    first = line(12)
    lines = [first + " " + line(30), first + " " + line(9), first, line(3), "x" + line(80), line(80)]
    spark.createDataFrame([(1, "\n\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.pos: tuple(x)[2:] for x in __spark_entry__.queries()["similarity_ratios"](spark, str(tmp_path)).collect()}
    assert got == {i: tuple(round(f(a, b), 6) for f in (S.indel_ratio, S.partial_ratio, S.token_set_ratio)) for i, (a, b) in enumerate(zip(lines, lines[1:]))}
    text = lambda n: "".join(r.choice("abcde 水") for _ in range(r.randint(1, n)))
    pairs = [(text(n), text(60)) for n in (3, 20, 60) for _ in range(150)] + [(chr(0x4E00 + i), chr(i + 33) * 2) for i in range(40)]
    assert S.partial_ratios(pairs) == [S.partial_ratio(a, b) for a, b in pairs]
    assert all(S.all_reach(pairs, least) == [S.reaches(a, b, least) for a, b in pairs] for least in (0.5, 0.82, 0.92))


def test_raw_titles_score_many_at_once(spark, tmp_path, monkeypatch):
    """F16: raw scores of many pairs are those one by one, tables are made for pairs that can gain by them only, and a plan makes each key of a line once a side."""
    import random

    import __spark_entry__
    from palimpsest.functions import similarity as S

    r = random.Random(16)
    text = lambda: "".join(r.choice("abc 水火　") for _ in range(r.randint(0, 14)))
    pairs = [(text(), text()) for _ in range(1500)] + [(t, t) for t in (text() for _ in range(20))] + [(" a", "a "), ("a b", "b a"), ("水火", "火水水火火")]
    asked, many = [], S.partial_ratios
    monkeypatch.setattr(S, "partial_ratios", lambda p: asked.extend(p) or many(p))
    assert S.raw_similarities(pairs) == [S.raw_similarity(a, b) for a, b in pairs]
    assert 0 < len(asked) < len(pairs)
    spark.createDataFrame([(1, "abc def\nxyz")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = __spark_entry__.queries()["similarity_raw_titles"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(doc_id") == 2 and plan.count("normal(") == 4


def test_frames_grow_with_their_group(spark, tmp_path):
    """what stands behind a row is looked up from the back, since a frame up to a group's end is made anew for each row; gaps are filled as before."""
    import __spark_entry__
    from palimpsest.operators import sequence as Q
    from palimpsest.operators import starts as B

    lessons = spark.createDataFrame([("v", i, "u", s, 99, 3) for i, s in enumerate([None, 5, None, None, 9, 12, 15, 20, None], 1)] + [("w", 1, "u", None, 9, 0)], "volume string, pos int, unit string, start int, total int, offset int")
    plan = B.page_plan(lessons, "volume")
    assert [r.logical_start for r in plan.orderBy("pos").collect()] == [4, 5, 6, 6, 9, 12, 15, 20, 21]
    df = spark.createDataFrame([("a", 1, None, 9), ("a", 2, 3, 9), ("a", 3, 3, 9), ("a", 4, 7, 9), ("b", 1, None, 2)], "k string, o int, s int, t int")
    assert [r.page_end for r in Q.page_ends(df, "k", "s", "t").orderBy("k", "o").collect()] == [None, 6, 6, 9, None]
    assert [r.filled for r in Q.fill_hints(df, "k", "o", "s").orderBy("k", "o").collect()] == [3, 3, 3, 7, None]
    for out in (plan, Q.page_ends(df, "k", "s", "t"), Q.fill_hints(df, "k", "o", "s")):
        frames = re.findall(r"specifiedwindowframe\((.*?)\)\)", out._jdf.queryExecution().optimizedPlan().toString())
        assert frames and all("unboundedfollowing" not in f or f.startswith("RowFrame, unboundedpreceding") for f in frames)


def test_texts_are_cleaned_once_for_their_clauses(spark, tmp_path):
    """a document is cleaned once a side, not once for each of its clauses; rows are dealt out before."""
    import __spark_entry__

    long = "这是一个很长很长的句子，要有十二个字"
    spark.createDataFrame([(1, long + "。" + long + "二\nCMYK"), (2, long + "；课题1" + long[::-1]), (3, None), (5, long)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    mine, told = both_ways(spark, tmp_path, "diff_missing_clauses")
    assert mine == told == [(1, 2, 2), (2, 2, 1), (3, 0, 0), (5, 1, 1)]
    plan = __spark_entry__.queries()["diff_missing_clauses"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CMYK") <= 2 and "RoundRobinPartitioning" in plan


def test_long_texts_are_cut_in_one_pass(spark):
    """cutting a text reads it once, not once for each of its pieces; blanks, dots and needles that aren't there count as before."""
    from palimpsest.operators import located

    lines = [f"第{i}行 ·水{i * 7919 % 1000}_" for i in range(40_000)]
    df = spark.createDataFrame([(1, "  ".join(lines), lines), (2, None, ["a", None]), (3, "a b", None), (4, " ab·c ", ["b c", "c", "x ", "…"])], "i int, t string, n array<string>")
    got = {r.i: r.c for r in df.select("i", located.cut_at(df.t, df.n).alias("c")).collect()}
    assert got[1] == [x.strip("·_") for x in lines]
    assert got[2] == ["a", ""] and got[3] is None and got[4] == ["b", "c", "x", "…"]
    assert len(located._pieces("  ".join(lines), lines)) == len(lines)


def test_pieces_exclude_no_pair_that_reaches(spark):
    """pairs are told apart by pieces before their texts go to the helper; no pair that reaches the ratio is lost, and most others are."""
    import random

    from palimpsest.functions import similarity as S

    r = random.Random(27)
    pairs = []
    for i in range(600):
        long = "".join(r.choice("abcdef水火山") for _ in range(r.randint(12, 60)))
        at, n = r.randrange(len(long)), r.randint(4, 28)
        short = list(long[at : at + n]) or ["a"]
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(short) + 1)
            short[k : k + r.randint(0, 1)] = r.choice(["", "x", "水"])
        pairs.append((i, long, "".join(short)[: len(long) - 1]))
    df = spark.createDataFrame(pairs, "i int, h string, n string").filter("n <> ''")
    for least in (0.92, 0.94):
        got = {x.i: x.may for x in df.select("i", S.may_reach(df.h, df.n, least).alias("may")).collect()}
        assert all(got[i] for i, h, n in pairs if n and S.reaches(h, n, least)) and not all(got.values())


def test_long_groups_are_numbered_in_stretches(spark):
    """rows of a group are numbered as row_number does, in stretches that no task holds together; nulls and repeated values too."""
    import random

    from palimpsest.operators import scans

    r = random.Random(22)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 3, 3, *range(90)]), i) for i in range(900)]
    out = scans.numbered(spark.createDataFrame(rows, "g string, a int, b int").repartition(3), "g", ["a", "b"], "pos", 50)
    want = []
    for g in ("a", "b", None):
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        want += [(*x, i) for i, x in enumerate(mine, 1)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert "windowspecdefinition(g#" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and re.search(r"row_number\(\) windowspecdefinition\(g#\d+, at_stretch", plan)


def test_phrases_are_read_before_they_meet(spark):
    """sentences and labels are cut and read once each, below the join of pictures and texts; what is told of them is as before."""
    from palimpsest.operators import pictures as I

    i = spark.createDataFrame([("p", 1, 0.1, 0.2, 0.1, 0.5, "山川云雨"), ("p", 2, 0.5, 0.6, 0.1, 0.5, None)], "page string, image int, y0 double, y1 double, x0 double, x1 double, label string")
    t = spark.createDataFrame([("p", 3, 0.2, 0.3, 0.1, 0.5, "看山川云雨。别的句子在这里", "text"), ("p", 4, 0.6, 0.7, 0.1, 0.5, "花草 树木很多！", "text")], "page string, id int, y0 double, y1 double, x0 double, x1 double, text string, kind string")
    out = I.matched_phrases(i, t, "page")
    assert [(r.image, r.phrase, r.theme) for r in out.orderBy("image").collect()] == [(1, "看山川云雨", "山川云雨"), (2, "花草树木很多", "花草树木很多")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above, join = plan[: plan.index("Join Inner")], plan[plan.index("Join Inner") :]
    assert "array_distinct(" in join and "array_distinct(" not in above


def test_pages_are_cleaned_before_they_meet(spark):
    """F32: a page's normal form is made once, not once for each page that it meets."""
    from palimpsest.operators import preview as V

    pages = spark.createDataFrame([("b", 1, "山川云雨雪花\nCMYK"), ("b", 2, "草木竹松梅兰")], "book string, page int, text string")
    new = pages.selectExpr("book", "3 - page AS page", "CAST(NULL AS string) AS key", "text")
    offsets = spark.createDataFrame([("b", 0)], "book string, offset int")
    out = V.resolved_pages(new, pages, pages.selectExpr("book", "'k' AS key", "page").limit(0), offsets, "book")
    assert sorted((r.page, r.old_page, r.method) for r in out.collect()) == [(1, 2, "content"), (2, 1, "position")]
    for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines():
        assert "CMYK" not in line or "old_text" not in line
