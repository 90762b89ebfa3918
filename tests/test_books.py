"""Located patterns, many-to-one alignment, grids, lesson starts, scanned lines and continued paragraphs against brute force and values worked out by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from palimpsest import book_queries as Q
from palimpsest.functions import similarity as S
from palimpsest.operators import containment, continued, grid, located, scans, starts

SF = "/root/testdata/sf0.001"


def test_reaches_is_the_partial_ratio():
    r = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, n))) for n in (14, 30))
        if r.random() < 0.5 and a:
            i, c = r.randint(0, len(b)), list(a)
            for _ in range(r.randint(0, 2)):
                c[r.randrange(len(a))] = r.choice("abcd")
            b = b[:i] + "".join(c) + b[i:]
        for least in (0.5, 0.7, 0.82, 0.92, 0.94, 1.0):
            assert S.reaches(a, b, least) == (S.partial_ratio(a, b) >= least), (a, b, least)


@pytest.mark.parametrize("size", [located.AUTOMATON, 6])
def test_located(spark, monkeypatch, size):
    monkeypatch.setattr(located, "AUTOMATON", size)
    texts = [(1, "abcabcabc"), (2, None), (3, ""), (4, "aaaa"), (5, "水水火\U0001f600水"), (4, "xabc")]
    patterns = [(1, "abc"), (2, "bca"), (3, "aa"), (4, ""), (5, None), (6, "水"), (7, "abc"), (8, "\U0001f600"), (9, "nowhere")]
    got = located.located(spark.createDataFrame(texts, "t long, x string"), spark.createDataFrame(patterns, "p long, y string"))
    want = [(t, p, i, len(y)) for t, x in texts for p, y in patterns if y for i in range(len(x or "")) if (x or "").startswith(y, i)]
    assert got.columns == ["t", "p", "at", "size"] and sorted(map(tuple, got.collect())) == sorted(want)
    none = located.located(spark.createDataFrame(texts, "t long, x string"), spark.createDataFrame([], "p long, y string"))
    assert none.collect() == []


CUTS = [
    ("水是生命之源。 小草发芽", ["水是生命之源", "小草发芽"], ["水是生命之源", "小草发芽"]),
    ("abcdabcd", ["abcd", "abcd"], ["abcd", "abcd"]),
    ("xx abc yy", ["yy", "abc"], ["yy", "abc"]),  # not there behind the one before, but before it
    ("abcdef", ["abcd", "cdef"], ["ab", "cdef"]),  # what overlaps is cut where the next begins
    ("a b·c d", ["bc", "nowhere", ""], ["b·c", "nowhere", ""]),
    (None, ["x"], ["x"]),
    ("  lead…… tail  ", ["lead", "tail"], ["lead", "tail"]),
]


def test_cut_at(spark):
    df = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(CUTS)], "i int, t string, n array<string>")
    got = {r.i: r.c for r in df.select("i", located.cut_at(F.col("t"), F.col("n")).alias("c")).collect()}
    assert got == {i: c for i, (_, _, c) in enumerate(CUTS)}


# Many-to-one ------------------------------------------------------------------------------------------


def page_norm(t):
    return "".join(c for c in t or "" if c not in located.LEFT_OUT)


def covers(h, n):
    h, n = page_norm(h), page_norm(n)
    return 8 <= len(n) <= 0.92 * len(h) and S.partial_ratio(h, n) >= 0.92


def bound(old, new, anchors):
    """The rule of a page, one anchor after the other: {(old, new): (cut, part, parts)}."""
    text = {("o", b[0]): b[5] for b in old} | {("n", b[0]): b[5] for b in new}
    place = {(s, b[0]): (b[1] + b[2], b[3], b[0]) for s, side in (("o", old), ("n", new)) for b in side}
    size = lambda k: len(page_norm(text[k]))
    lone_old, lone_new = {b[0] for b in old} - {a[0] for a in anchors}, {b[0] for b in new} - {a[1] for a in anchors}
    out, gone = {}, set()

    def cut(host_side, host, parts):
        other = "n" if host_side == "o" else "o"
        for k, p in enumerate(sorted(parts, key=lambda i: place[other, i])):
            out[(host, p) if host_side == "o" else (p, host)] = ("old" if host_side == "o" else "new", k + 1, len(parts))

    for o, n, _ in anchors:
        if o in gone:
            continue
        parts = {n} | {u for u in lone_new if covers(text["o", o], text["n", u])}
        if len(parts) > 1 and covers(text["o", o], text["n", n]) and size(("o", o)) > 1.25 * size(("n", n)):
            cut("o", o, parts)
            lone_new -= parts
            gone.add(o)
            continue
        parts = {o} | {u for u in lone_old if covers(text["n", n], text["o", u])}
        texts = {text["o", p] for p in parts}
        for p, m, _ in anchors:
            if p != o and p not in gone and covers(text["n", n], text["o", p]) and S.partial_ratio(page_norm(text["n", m]), page_norm(text["o", p])) < 0.82 and text["o", p] not in texts:
                parts.add(p)
                texts.add(text["o", p])
        if len(parts) > 1 and covers(text["n", n], text["o", o]) and size(("n", n)) > 1.25 * size(("o", o)):
            cut("n", n, parts)
            lone_old -= parts
            gone |= parts
            out = {k: v for k, v in out.items() if v or k[0] not in parts}
            continue
        out[o, n] = None
    for side, mine, theirs in (("o", lone_old, lone_new), ("n", lone_new, lone_old)):
        other = "n" if side == "o" else "o"
        content = lambda i: len([c for c in text[side, i] or "" if c.isalnum()])
        for host in sorted(mine, key=lambda i: (-content(i), place[side, i])):
            parts = {u for u in theirs if covers(text[side, host], text[other, u])}
            if len(parts) > 1 and size((side, host)) >= 12 and sum(size((other, u)) for u in parts) >= max(8, int(size((side, host)) * 0.45)):
                cut(side, host, parts)
                theirs -= parts
    return out


def test_rebind(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9)))
    old, new, anchors, want = [], [], [], {}
    for pair in range(40):
        parts = [" ".join(word() for _ in range(r.randint(2, 5))) for _ in range(r.randint(2, 7))]
        sides = []
        for _ in range(2):  # each side joins neighbours in its own way, loses some boxes and misreads a letter here and there
            side, i = [], 0
            while i < len(parts):
                j = i + r.choice([1, 1, 2, 3])
                t = "".join(parts[i:j])
                if r.random() < 0.3:
                    k = r.randrange(len(t))
                    t = t[:k] + "z" + t[k + 1 :]
                side.append((i, i / 8, min(j, 8) / 8, 0.1, 0.9, t))
                i = j
            sides.append([b for b in side if r.random() < 0.9] + ([(20, 0.9, 0.95, 0.1, 0.9, None)] if pair % 9 == 0 else []))
        a, b = sides
        ids = r.sample([x[0] for x in b], min(len(a), len(b)))
        made = [(x[0], y, round(r.uniform(0.4, 1.0), 3)) for x, y in zip(r.sample(a, len(ids)), ids)]
        made = sorted((m for m in made if r.random() < 0.8), key=lambda m: (-m[2], m[0], m[1]))
        old += [(pair, *x) for x in a]
        new += [(pair, *x) for x in b]
        anchors += [(pair, *m) for m in made]
        want[pair] = bound(a, b, made)
    box = "pair long, id long, y0 double, y1 double, x0 double, x1 double, text string"
    out = containment.rebind(spark.createDataFrame(old, box), spark.createDataFrame(new, box), spark.createDataFrame(anchors, "pair long, old_id long, new_id long, score double"), "pair").collect()
    got = {}
    for x in out:
        got.setdefault(x.pair, {})[x.old_id, x.new_id] = None if x.cut is None else (x.cut, x.part, x.parts)
    assert got == {k: v for k, v in want.items() if v}
    assert {"old", "new", None} == {x.cut for x in out}
    of = {(s, x[0], x[1]): x[6] for s, side in (("old", old), ("new", new)) for x in side}
    for x in out:
        if x.cut:  # a piece is a stretch of its box, or the other side's text where that isn't there word for word; its band is inside the box
            piece, part = (x.old_text, x.new_text) if x.cut == "old" else (x.new_text, x.old_text)
            host = of[x.cut, x.pair, x.old_id if x.cut == "old" else x.new_id]
            assert piece in host or piece == part
            assert x.score >= 0.55 and 0 <= x.y0 < x.y1 <= 1


def test_overlapping_and_pictures(spark):
    r = random.Random(9)
    rows = []
    for page in range(30):
        for i in range(r.randint(1, 14)):
            x, y = r.choice([r.uniform(-0.2, 1.1), r.randint(0, 16) / 16]), r.uniform(0, 1)
            rows.append((page, i, x, y, x + r.choice([0.0, 0.0625, r.uniform(0, 0.6)]), y + r.uniform(0, 0.5)))
            if r.random() < 0.4:  # much the same frame again
                rows.append((page, 100 + i, x + 0.01, y, rows[-1][4] + 0.01, rows[-1][5]))
    rows.append((99, 1, None, 0.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "page long, id long, x0 double, y0 double, x1 double, y1 double")
    pairs = [(a, b) for a, b in itertools.combinations(sorted(x for x in rows if x[2] is not None), 2) if a[0] == b[0]]
    meet = [(a, b) for a, b in pairs if max(a[2], b[2]) <= min(a[4], b[4]) and max(a[3], b[3]) <= min(a[5], b[5])]
    got = grid.overlapping(df, "page").select("page", "a_id", "b_id").collect()
    assert sorted(map(tuple, got)) == sorted((a[0], a[1], b[1]) for a, b in meet)

    area = lambda a: max(0.0, a[4] - a[2]) * max(0.0, a[5] - a[3])
    both = lambda a, b: max(0.0, min(a[4], b[4]) - max(a[2], b[2])) * max(0.0, min(a[5], b[5]) - max(a[3], b[3]))
    inside = lambda a, b: both(a, b) / area(a) if area(a) > 0 else 0.0

    def same(a, b):
        union = area(a) + area(b) - both(a, b)
        iou = both(a, b) / union if union > 0 else 0.0
        outer, inner = (a, b) if area(a) >= area(b) else (b, a)
        ratio = area(outer) / max(area(inner), 1e-9)
        near = inside(inner, outer)
        return iou >= 0.52 or (inside(a, b) >= 0.82 and inside(b, a) >= 0.82) or (near >= 0.65 and iou >= 0.35) or (ratio > 1.03 and near >= 0.68 and ratio <= 3 and iou >= 0.1)

    def first_goes(a, b):
        for by, least in ((1.03, 0.65), (1.02, 0.75)):
            if area(a) > area(b) * by and inside(b, a) >= least:
                return True
            if area(b) > area(a) * by and inside(a, b) >= least:
                return False
        return False

    stay = []
    for page in sorted({x[0] for x in rows}):
        mine, gone = sorted(x for x in rows if x[0] == page), set()
        for i, a in enumerate(mine):
            if a[1] in gone:
                continue
            for b in mine[i + 1 :]:
                if b[1] not in gone and page != 99 and same(a, b):
                    gone.add(a[1] if first_goes(a, b) else b[1])
        stay += [(page, x[1]) for x in mine if x[1] not in gone]
    assert sorted((x.page, x.id) for x in grid.distinct_pictures(df, "page").collect()) == stay


def test_pinyin_pairs(spark):
    r = random.Random(12)
    rows = []
    for page in range(60):
        for i in range(r.randint(2, 9)):
            x, y, latin = r.uniform(0, 0.6), r.uniform(0, 0.9), r.random() < 0.5
            text = r.choice(["shuǐ dī", "cǎo 12", "Huā"]) if latin else r.choice(["水滴", "草 a", "花"])
            rows.append((page, i, round(x, 3), round(y, 3), round(x + r.uniform(0.1, 0.4), 3), round(y + r.uniform(0.02, 0.12), 3), text))
    rows += [(70, 1, 0.1, 0.1, 0.2, 0.2, None), (70, 2, 0.1, 0.21, 0.2, 0.3, "1234"), (70, 3, 0.1, 0.21, 0.2, 0.3, "水")]
    df = spark.createDataFrame(rows, "page long, id long, x0 double, y0 double, x1 double, y1 double, text string")
    han = lambda t: any("\u4e00" <= c <= "\u9fff" for c in t or "")
    latin = lambda t: bool(t) and not han(t) and any("a" <= c.lower() <= "z" for c in t) and sum(c.isalpha() or c == " " for c in t) >= 0.75 * len(t)
    want = []
    for page in sorted({x[0] for x in rows}):
        mine, fit = [x for x in rows if x[0] == page], []
        for u in mine:
            for low in mine:
                if latin(u[6]) and han(low[6]):
                    share = max(0, min(u[4], low[4]) - max(u[2], low[2])) / min(u[4] - u[2], low[4] - low[2])
                    gap, cu, cl = low[3] - u[5], (u[3] + u[5]) / 2, (low[3] + low[5]) / 2
                    row = abs(cu - cl) <= max(0.018, 0.55 * min(u[5] - u[3], low[5] - low[3])) and cl <= cu + 0.002
                    under = cl > cu and -0.008 <= round(gap, 9) <= 0.09
                    framed = (low[3] >= u[3] + (u[5] - u[3]) * 0.28 and low[3] <= u[5] + 0.102) or (low[3] >= u[3] and low[5] <= u[5] + 0.102)
                    if low[2] <= u[2] + 0.20 and share >= 0.35 and not row and (under or framed):
                        fit.append((round(gap, 9), -round(share, 9), u[1], low[1]))
        uppers, lowers = set(), set()
        for _, _, a, b in sorted(fit):
            if a not in uppers and b not in lowers:
                uppers.add(a)
                lowers.add(b)
                want.append((page, a, b))
    got = sorted((x.page, x.upper, x.lower) for x in grid.pinyin_pairs(df, "page").collect())
    assert got == sorted(want) and len(got) > 10


# Books ------------------------------------------------------------------------------------------------


def test_best_chain_over_all_assignments():
    r = random.Random(6)
    for _ in range(300):
        rows = sorted({(l, p): (0, l, p, r.randint(1, 5)) for l, p in ((r.randint(1, 5), r.randint(1, 6)) for _ in range(r.randint(0, 10)))}.values())
        got = starts.best_chain(rows)
        assert all(a[1] < b[1] and a[2] < b[2] for a, b in zip(got, got[1:])) and set(got) <= set(rows)
        best = max((sum(x[3] for x in c), len(c)) for n in range(len(rows) + 1) for c in itertools.combinations(rows, n) if all(a[1] < b[1] and a[2] < b[2] for a, b in zip(c, c[1:])))
        assert (sum(x[3] for x in got), len(got)) == best


def test_title_worth(spark):
    page = "1 水的变化\n水在变。\n1 水的循环之二"
    rows = [("1 水的变化", 8), ("1水的变化", 8), ("1 水的循环", 4), ("在变", 2), ("月相", 0), ("", 0), (None, 0)]
    df = spark.createDataFrame([(i, page, t) for i, (t, _) in enumerate(rows)], "i int, p string, t string")
    assert [r.w for r in df.select("i", starts.title_worth(F.col("p"), F.col("t")).alias("w")).orderBy("i").collect()] == [w for _, w in rows]
    hints = spark.createDataFrame([(1, 1), (5, 7), (5, 8), (20, 6), (21, 6), (3, None)], "p int, h int")
    assert [r[0] for r in hints.select(starts.hint_worth(F.col("p"), F.col("h"))).collect()] == [16, 14, 0, 2, 0, 0]


def test_carried_in_parts(spark):
    r = random.Random(3)
    rows = [(g, p, r.choice([None, None, p])) for g in ("a", "b", None) for p in r.sample(range(100), 60)]
    df = spark.createDataFrame(rows, "g string, p long, v long")
    for size in (1, 7, 1000):
        got = {(x.g, x.p): x.last for x in scans.carried(df, "g", "p", {"last": F.col("v")}, size).collect()}
        for g, p, _ in rows:
            assert got[g, p] == max((v for h, q, v in rows if h == g and q <= p and v is not None), default=None)


CATALOGUE = ["目录", "1 光的传播……2", "第一单元 光 第二单元 声音", "1光的传播 2 13声音的产生 20", "第三单元 水", "2 水的变化……7", "水 单元小结 9", "单元小结 10", "第四单元 空气 3 空气的成分", None, "出版社 1 水", "5 空气 11"]
FOUND = [(3, "第一单元光", "1 光的传播", None), (3, "第二单元声音", "13 声音的产生", None), (5, "第三单元水", "2 水的变化", None), (6, "第三单元水", "单元小结", 9), (11, "第四单元空气", "5 空气", 11)]
EXPERIMENTS = [
    "课题1 未开始", "目 录", "绪论 化学使世界更美好", "第一单元 走进化学世界", "课题1 物质的变化", "", "和性质 5", "12", "课题2 实验", "实验活动1", "氧气的制取", "与性质", "实验活动2", "第二单元 空气", "整理与提升", "编者的话", "课题1 空气", "课题2 氧气", "针对每课题梳理", "课题3 不再", "第三单元 水", "课题1 水",
]
LESSONS = [
    (2, "绪论", "1 化学使世界更美好"), (4, "第一单元 走进化学世界", "课题1 物质的变化和性质"), (8, "第一单元 走进化学世界", "课题2 实验"), (10, "第一单元 走进化学世界", "实验活动1 氧气的制取与性质"),
    (14, "第二单元 空气", "整理与提升"), (16, "第二单元 空气", "课题1 空气"), (17, "第二单元 空气", "课题2 氧气"), (21, "第三单元 水", "课题1 水"),
]


@pytest.mark.parametrize("size", [3, 4096])
def test_catalogue_lines_by_hand(spark, size):
    lines = lambda texts: spark.createDataFrame([(v, i, t) for v in (1, 2) for i, t in enumerate(texts)], "volume long, pos long, line string")
    got = scans.catalogue_rows(lines(CATALOGUE), "volume", size).orderBy("volume", "pos", "part", "piece").collect()
    assert [(x.pos, x.unit, x.lesson, x.page) for x in got if x.volume == 1] == FOUND and len(got) == 2 * len(FOUND)
    got = scans.experiment_contents(lines(EXPERIMENTS), "volume", size).orderBy("volume", "pos").collect()
    assert [(x.pos, x.unit, x.lesson) for x in got if x.volume == 2] == LESSONS and len(got) == 2 * len(LESSONS)


def test_catalogues_in_parts(spark):
    text = Q.catalogue_text(spark, SF).cache()
    whole, parts = (sorted(map(repr, scans.catalogue_rows(text, "volume", n).collect())) for n in (1 << 20, 5))
    assert whole == parts and len(whole) > 1000
    lines = Q.experiment_text(spark, SF).cache()
    whole, parts = (sorted(map(repr, scans.experiment_contents(lines, "volume", n).collect())) for n in (1 << 20, 5))
    assert whole == parts and len(whole) > 400


def test_continued(spark):
    rows = [
        (1, 1, 1, 0.1, 0.2, "一个段落。"), (1, 1, 2, 0.8, 0.9, "这一段还没有"), (1, 2, 1, 0.0, 0.9, "结束，整页都是"), (1, 3, 1, 0.1, 0.2, "它，到这里结束。"), (1, 3, 2, 0.8, 0.9, "下一页太低"),
        (1, 4, 1, 0.5, 0.6, "不接"), (1, 5, 1, 0.1, 0.2, "2 标题"), (1, 7, 1, 0.1, 0.2, "隔了一页"), (2, 1, 1, 0.1, 0.2, None), (2, 2, 1, 0.1, 0.2, "另一本"),
    ]
    out = continued.continued(spark.createDataFrame(rows, "book long, page long, id long, y0 double, y1 double, text string").withColumn("x0", F.lit(0.1)), "book").orderBy("book", "chain").collect()
    assert [(x.book, x.first_page, x.pages, x.parts, x.text) for x in out] == [
        (1, 1, 1, 1, "一个段落。"), (1, 1, 3, 3, "这一段还没有结束，整页都是它，到这里结束。"), (1, 3, 1, 1, "下一页太低"), (1, 4, 1, 1, "不接"), (1, 5, 1, 1, "2 标题"), (1, 7, 1, 1, "隔了一页"), (2, 2, 1, 1, "另一本"),
    ]


def test_absorbed(spark):
    loose = [
        (1, 2, 1, 0.05, 0.1, "续行的尾巴"), (1, 2, 2, 0.06, 0.1, "续行的尾巴"), (1, 2, 3, 0.5, 0.6, "续行的尾巴"), (1, 2, 4, 0.9, 0.95, "下页的开头"), (1, 2, 5, 0.05, 0.1, "别处没有的"), (1, 3, 1, 0.05, 0.1, None), (1, 2, 6, 0.05, 0.1, "这是一个很长很长的段落，它有三十多个字，所以不是残段，是一个完整的段落。"),
    ]
    others = [(1, 1, 1, 0.8, 0.9, "上一页的最后一段，带着续行的尾巴"), (1, 1, 2, 0.1, 0.2, "页顶也有续行的尾巴，更长更长更长更长更长"), (1, 1, 3, 0.75, 0.8, "短的续行的尾巴"), (1, 3, 9, 0.1, 0.2, "下页的开头在这里，后面还有"), (1, 3, 8, 0.8, 0.9, "下页的开头在页底，太低了不算数")]
    box = "book long, page long, id long, y0 double, y1 double, text string"
    out = continued.absorbed(spark.createDataFrame(loose, box), spark.createDataFrame(others, box), "book").collect()
    assert sorted(map(tuple, out)) == [(1, 2, 1, 1, 1), (1, 2, 4, 3, 9)]  # the host's stretch is told once
