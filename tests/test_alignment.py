"""Alignment of boxes against the rule as it is stated, on random pages."""

import random

from palimpsest.operators import alignment as A


def choose(rows):
    """Greedy anchors and repair by hand."""
    at = {(r[0], r[1]): r for r in rows}
    pairs, used_old, used_new = [], set(), set()
    for r in sorted(rows, key=lambda r: (-r[2], abs(r[0] - r[1]), r[0], r[1])):
        if r[2] >= 0.38 and r[0] not in used_old and r[1] not in used_new:
            used_old.add(r[0])
            used_new.add(r[1])
            pairs.append([r[0], r[1]])
    sim = lambda o, n: at[o, n][3]
    for _ in range(min(6, len(pairs))):
        changed = False
        for i, a in enumerate(pairs):
            if at[tuple(a)][4] >= 0.62:
                continue
            gains = []
            for j, b in enumerate(pairs):
                mine, theirs, was, were = sim(a[0], b[1]), sim(b[0], a[1]), sim(*a), sim(*b)
                if i != j and (mine >= 0.5 or theirs >= 0.5) and mine >= was - 0.02 and theirs >= were - 0.02:
                    gains.append((mine + theirs - was - were, -j))
            if gains and max(gains)[0] > 0.08:
                j = -max(gains)[1]
                a[1], pairs[j][1] = pairs[j][1], a[1]
                changed = True
        if not changed:
            break
    return {tuple(p) for p in pairs}


def test_anchors_and_repair_like_the_rule(spark):
    r = random.Random(6)
    pages = {}
    for page in range(25):
        n, m = r.randint(1, 7), r.randint(1, 7)
        pages[page] = [(o, k, round(r.random(), 3), round(r.random(), 3), round(r.random() * 0.8, 3)) for o in range(n) for k in range(m)]
    scored = spark.createDataFrame([(p, *x) for p, rows in pages.items() for x in rows], "page int, old_id int, new_id int, score double, sim double, ratio double")
    got = {}
    for x in A.anchors(scored, "page").collect():
        got.setdefault(x.page, set()).add((x.old_id, x.new_id))
    assert got == {p: c for p, rows in pages.items() if (c := choose(rows))}
    assert A.anchors(scored.limit(0), "page").count() == 0


def test_nothing_is_lost(spark):
    """Every box of either side is in exactly one row."""
    r = random.Random(7)
    words = ["水是生命之源", "小草在春天里发芽", "日月星辰", "abc", "", None]
    box = lambda i, side: (1, i, y := r.random(), y + 0.1, 0.1, 0.9, r.choice(words))  # noqa: E731, F841
    schema = "pair int, id int, y0 double, y1 double, x0 double, x1 double, text string"
    old, new = (spark.createDataFrame([box(i, s) for i in range(12)], schema) for s in "on")
    out = A.align(old, new, "pair").collect()
    assert sorted(x.old_id for x in out if x.old_id is not None) == sorted(x.new_id for x in out if x.new_id is not None) == list(range(12))
