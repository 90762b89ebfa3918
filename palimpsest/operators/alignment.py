"""Alignment of the text boxes of two pages: scores, one-to-one anchors, repair, binding to figures.

Boxes are compared within a pair of pages only, so what a task holds at once is bounded by a page.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compare as C
from ..functions import similarity as S
from ..functions.text import HAN, has_any
from .matching import by_group
from .scans import settled

# Reach of positions, weights by how alike the contents are, floors, bonuses and penalties.
REACH = 0.28
REGIMES = [(0.78, 0.08), (0.55, 0.15), (0.40, 0.28)]
WEAK = 0.45
LEAST, GAIN, SETTLED, LOSS, ENOUGH, ROUNDS = 0.38, 0.08, 0.62, 0.02, 0.50, 6
SENTENCE_WORDS = ["通过", "实验", "测定", "我们", "可以", "因为", "所以"]
QUESTIONS = ["？", "?"]
INSIDE = 0.45


def middle(a: Column) -> Column:
    return (a["y0"] + a["y1"]) / 2


def letters(norm: Column) -> Column:
    """The different letters, digits and Han characters of a normalised text."""
    return F.array_distinct(F.split(only_letters(norm), ""))


def only_letters(norm: Column) -> Column:
    return F.regexp_replace(norm, r"[^\p{L}\p{N}]+", "")


def char_overlap(a: Column, b: Column) -> Column:
    """Jaccard of the different letters, digits and Han characters; 0 if a side has none."""
    return letters_overlap(letters(C.page_norm(a)), letters(C.page_norm(b)))


def letters_overlap(x: Column, y: Column) -> Column:
    x, y = F.array_remove(x, ""), F.array_remove(y, "")
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def layout_role(a: Column) -> Column:
    """body, figure_caption or figure_label."""
    t = F.trim(F.coalesce(a["text"], F.lit("")))
    sentence = t.rlike("[。；！？]")
    label = ((F.length(t) <= 14) & t.contains("%") & ~sentence) | ((F.length(t) <= 10) & (a["x0"] >= 0.45) & ~sentence & ~has_any(t, SENTENCE_WORDS))
    return F.when(t == "", "body").when(t.rlike(r"^(图|表)\s*\d") | t.rlike("^图[一二三四五六七八九十]"), "figure_caption").when(label, "figure_label").otherwise("body")


def is_margin_note(a: Column) -> Column:
    """In a narrow column at the left or right, and not a long narrative."""
    width = a["x1"] - a["x0"]
    narrow = ((a["x1"] <= 0.34) & (width <= 0.30)) | ((a["x0"] >= 0.48) & (width <= 0.52))
    return narrow & (F.length(F.regexp_replace(F.coalesce(a["text"], F.lit("")), r"\s+", "")) <= 120)


def traits(a: Column, norm: Column) -> Column:
    """What the comparison of a box with any other needs of it, made once a box; quotes and Han characters for margin notes alone."""
    t = F.coalesce(a["text"], F.lit(""))
    quotes = F.when(is_margin_note(a), F.regexp_extract_all(t, F.lit("[“\"「『]([^”\"」』]{2,20})[”\"」』]"), F.lit(1)))
    han = F.when(is_margin_note(a), F.array_distinct(F.regexp_extract_all(t, F.lit(f"[{HAN}]"), F.lit(0))))
    parts = {"role": layout_role(a), "note": is_margin_note(a), "size": F.length(F.trim(t)), "middle": middle(a), "x0": a["x0"], "quotes": quotes, "han": han, "ask": has_any(t, QUESTIONS), "norm": norm}
    return F.struct(*[c.alias(k) for k, c in parts.items()])


def note_signal(a: Column, b: Column) -> Column:
    """What two rewritten margin notes (traits) share: a quotation, the frame of a question, many characters."""
    x, y = a["han"], b["han"]
    shared, union = F.size(F.array_intersect(x, y)), F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    return (
        F.when(F.arrays_overlap(a["quotes"], b["quotes"]), 0.35).when((F.size(x) == 0) | (F.size(y) == 0), 0.0)
        .when(a["ask"] & b["ask"] & (shared / union >= 0.28) & (shared >= 6), 0.28).when((shared / union >= 0.4) & (shared >= 8), 0.22).otherwise(0.0)
    )


def score_parts(a: Column, b: Column) -> dict[str, Column]:
    """What the score of two boxes (traits) is made of but for their contents: nearness, the shorter's length, and what is added for notes and roles and taken off for uneven lengths."""
    place = F.greatest(F.lit(0.0), 1 - F.abs(a["middle"] - b["middle"]) / REACH)
    short, long = F.least(a["size"], b["size"]), F.greatest(a["size"], b["size"])
    notes, one_note = a["note"] & b["note"], a["note"] != b["note"]
    for_notes = F.when(notes, 0.14 + note_signal(a, b)).when(one_note & (F.abs(a["x0"] - b["x0"]) > 0.25), -0.16).otherwise(0.0)
    r, q = a["role"], b["role"]
    for_roles = F.when(r == q, F.when(r != "body", 0.08).otherwise(0.0)).when((r == "body") | (q == "body"), -0.5).otherwise(-0.45)
    # one much shorter than the other, unless it is the other's begin or end, cut by a page's edge
    first = a["size"] <= b["size"]
    least, most = F.when(first, a["norm"]).otherwise(b["norm"]), F.when(first, b["norm"]).otherwise(a["norm"])
    cut = (least != "") & (F.startswith(most, least) | F.endswith(most, least))
    uneven = (short > 0) & (short / long < 0.35) & ((r == "body") | (q == "body")) & ~notes & ~cut
    return {"place": place, "short": short, "for_notes": for_notes, "for_roles": for_roles, "off": F.when(uneven, 0.28).otherwise(0.0)}


def anchor_score(a: Column, b: Column) -> Column:
    """How well an old box and a new one (y0, y1, x0, x1, text) match, by content first and by place where content is weak."""
    x, y = a["text"], b["text"]
    ratio = C.fuzz(x, y)
    content = F.greatest(ratio, 0.55 * ratio + 0.45 * char_overlap(x, y))
    weight = F.lit(WEAK)
    for from_, w in reversed(REGIMES):
        weight = F.when(content >= from_, w).otherwise(weight)
    p = score_parts(traits(a, C.page_norm(x)), traits(b, C.page_norm(y)))
    score = weight * p["place"] + (1 - weight) * content
    score = F.when((content >= 0.48) & (p["short"] >= 12), F.greatest(score, 0.32 + 0.58 * content)).otherwise(score)
    return score + p["for_notes"] + p["for_roles"] - p["off"]


def _score(content: float, place: float, short: int, for_notes: float, for_roles: float, off: float) -> float:
    """anchor_score of a content."""
    weight = next((w for from_, w in REGIMES if content >= from_), WEAK)
    score = weight * place + (1 - weight) * content
    if content >= 0.48 and short >= 12:
        score = max(score, 0.32 + 0.58 * content)
    return score + for_notes + for_roles - off


def _most(content: float, place: float, short: int, for_notes: float, for_roles: float, off: float) -> float:
    """What the score can be at most where the content is at most this; the score falls where a regime begins, so each regime's end counts."""
    most, end = 0.0, content
    for from_, weight in REGIMES:
        if content >= from_:
            most, end = max(most, weight * place + (1 - weight) * end), from_
    most = max(most, WEAK * place + (1 - WEAK) * end)
    if content >= 0.48 and short >= 12:
        most = max(most, 0.32 + 0.58 * content)
    return most + for_notes + for_roles - off + 1e-9


def anchors(scored: DataFrame, pair: str) -> DataFrame:
    """One-to-one anchors of each pair of pages: the best score first (LEAST or more), of equals those near in order; then repaired.

    scored: pair, old_id, new_id, score, sim for all boxes of both pages. Repair: where an anchor's sim is below SETTLED,
    it changes partners with the anchor that gains most, if both have more of it or lose LOSS at most.
    """

    def choose(rows: list[tuple]) -> list[tuple]:
        at = {(r[1], r[2]): r for r in rows}
        taken_old, taken_new, chosen = set(), set(), []
        for r in rows:
            if r[3] >= LEAST and r[1] not in taken_old and r[2] not in taken_new:
                taken_old.add(r[1])
                taken_new.add(r[2])
                chosen.append((r[1], r[2]))
        _repair(chosen, lambda o, n: at[o, n][4], lambda o, n: at[o, n][5], lambda o, n: at[o, n][4])
        return [at[c] for c in chosen]

    order = [F.desc("score"), F.abs(F.col("old_id") - F.col("new_id")), "old_id", "new_id"]
    return by_group(scored.select(pair, "old_id", "new_id", "score", "sim", "ratio"), pair, order, choose)


def _repair(chosen: list[tuple], sim: Callable, ratio: Callable, most: Callable) -> None:
    """Anchors change partners where both gain; most: what a sim can be at most, by which pairs that can't gain are told unscored."""
    for _ in range(min(ROUNDS, len(chosen))):
        moved = False
        for i, (o, n) in enumerate(chosen):
            if ratio(o, n) >= SETTLED:
                continue
            best, swap, own = GAIN, None, sim(o, n)
            for j, (p, m) in enumerate(chosen):
                were, a, b = sim(p, m), most(o, m), most(p, n)
                if j == i or a + b - own - were < best - 1e-9 or max(a, b) < ENOUGH or a < own - LOSS or b < were - LOSS:
                    continue
                mine, theirs = sim(o, m), sim(p, n)
                gain = mine + theirs - own - were
                if max(mine, theirs) >= ENOUGH and gain > best and mine >= own - LOSS and theirs >= were - LOSS:
                    best, swap = gain, j
            if swap is not None:
                p, m = chosen[swap]
                chosen[i], chosen[swap] = (o, m), (p, n)
                moved = True
        if not moved:
            break


# Rows of a page as the helper sees them.
_OLD, _NEW, _PAIR = range(3)
_LENGTHS, _LETTERS, _EXACT = range(3)


def _chosen(rows: list[tuple]) -> list[tuple]:
    """(pair, what, old_id, new_id, norm, shared, place, short, for_notes, for_roles, off, score): the normalised texts of a page, then all its pairs. Returns the pairs that are anchors with their score, and the texts' rows of boxes without one.

    The same anchors as of all pairs' scores in order, but a pair is scored only if it comes up: it stands in the queue with
    what its score can be at most, by the lengths, then by the letters in common, then with the score itself.
    """
    old, new = {r[2]: r[4] for r in rows if r[1] == _OLD}, {r[3]: r[4] for r in rows if r[1] == _NEW}
    at = {(r[2], r[3]): r for r in rows if r[1] == _PAIR}
    letters: dict[str, Counter] = {}
    known: list[dict] = [{}, {}, {}]

    def ratio(o, n, level: int = _EXACT) -> float:
        """The ratio of two texts (0 if one is empty), or what it is at most."""
        if (o, n) in known[_EXACT]:
            return known[_EXACT][o, n]
        if (o, n) not in known[level]:
            a, b = old[o], new[n]
            if not a or not b or a == b:
                known[_EXACT][o, n] = 1.0 if a and b else 0.0
                return known[_EXACT][o, n]
            if level == _EXACT:
                value = S.indel_ratio(a, b)
            elif level == _LENGTHS:
                value = 2 * min(len(a), len(b)) / (len(a) + len(b))
            else:
                x, y = (letters.setdefault(t, Counter(t)) if t not in letters else letters[t] for t in (a, b))
                value = 2 * sum(min(k, y[ch]) for ch, k in x.items() if ch in y) / (len(a) + len(b))
            known[level][o, n] = value
        return known[level][o, n]

    def queued(o, n, level: int) -> tuple:
        r, shared = ratio(o, n, level), at[o, n][5]
        if (o, n) in known[_EXACT]:
            level = _EXACT
        worth = (_score if level == _EXACT else _most)(max(r, 0.55 * r + 0.45 * shared), *at[o, n][6:11])
        return -worth, abs(o - n), o, n, level

    queue = [queued(o, n, _LENGTHS) for o, n in at]
    heapq.heapify(queue)
    free_old, free_new, chosen = set(old), set(new), []
    while queue and queue[0][0] <= -LEAST:
        worth, _, o, n, level = heapq.heappop(queue)
        if o not in free_old or n not in free_new:
            continue
        if level < _EXACT:
            heapq.heappush(queue, queued(o, n, level + 1))
            continue
        free_old.discard(o)
        free_new.discard(n)
        chosen.append((o, n))
    _repair(chosen, lambda o, n: max(ratio(o, n), at[o, n][5]), ratio, lambda o, n: max(ratio(o, n, _LETTERS), at[o, n][5]))
    out = []
    for o, n in chosen:
        r, shared = ratio(o, n), at[o, n][5]
        out.append((*at[o, n][:11], _score(max(r, 0.55 * r + 0.45 * shared), *at[o, n][6:11])))
    return out + [r for r in rows if (r[1] == _OLD and r[2] in free_old) or (r[1] == _NEW and r[3] in free_new)]


def _pair_parts(a: dict, b: dict) -> tuple:
    """score_parts of two boxes' traits, and the share of letters that they have in common first."""
    x, y = a["letters"], b["letters"]
    shared = len(x & y) / len(x | y) if x and y else 0.0
    place = max(0.0, 1 - abs(a["middle"] - b["middle"]) / REACH) if None not in (a["middle"], b["middle"]) else 0.0
    short, long = sorted((a["size"], b["size"]))
    notes = False if False in (a["note"], b["note"]) else None if None in (a["note"], b["note"]) else True
    for_notes = 0.0
    if notes:
        for_notes = 0.14 + _note_signal(a, b)
    elif None not in (a["note"], b["note"], a["x0"], b["x0"]) and a["note"] != b["note"] and abs(a["x0"] - b["x0"]) > 0.25:
        for_notes = -0.16
    r, q = a["role"], b["role"]
    for_roles = (0.08 if r != "body" else 0.0) if r == q else -0.5 if "body" in (r, q) else -0.45
    least, most = (a["norm"], b["norm"]) if a["size"] <= b["size"] else (b["norm"], a["norm"])
    uneven = short > 0 and short / long < 0.35 and "body" in (r, q) and notes is False and not (least and (most.startswith(least) or most.endswith(least)))
    return shared, place, short, for_notes, for_roles, 0.28 if uneven else 0.0


def _note_signal(a: dict, b: dict) -> float:
    """note_signal of two margin notes' traits."""
    x, y = set(a["han"]), set(b["han"])
    if set(a["quotes"]) & set(b["quotes"]):
        return 0.35
    shared, union = len(x & y), max(1, len(x | y))
    if not x or not y:
        return 0.0
    return 0.28 if a["ask"] and b["ask"] and shared / union >= 0.28 and shared >= 6 else 0.22 if shared / union >= 0.4 and shared >= 8 else 0.0


def _aligned(rows: list[tuple]) -> list[tuple]:
    """(pair, what, old_id, new_id, score, box): the boxes of a page, new ones behind old ones. Returns (pair, old_id, new_id, score)."""
    pair = rows[0][0]
    for r in rows:
        r[5]["letters"] = frozenset(r[5]["letters"])
    old, new = [r for r in rows if r[1] == _OLD], [r for r in rows if r[1] == _NEW]
    texts = [(*r[:4], r[5]["norm"], *[None] * 7) for r in rows]
    pairs = [(pair, _PAIR, o[2], n[3], None, *_pair_parts(o[5], n[5]), None) for o in old for n in new]
    return [(pair, r[2], r[3], r[11]) for r in _chosen(texts + pairs)]


def align(old: DataFrame, new: DataFrame, pair: str) -> DataFrame:
    """pair, old_id, new_id, score: anchors, and the boxes of either side without one. old and new: pair, id, y0, y1, x0, x1, text."""
    box = F.struct("y0", "y1", "x0", "x1", "text")

    def side(df: DataFrame, what: int, key: str) -> DataFrame:
        # what a text needs for every comparison is made once; boxes, not pairs of them, go to the helper
        norm = settled(df.select(pair, F.col("id").alias(key), box.alias("box"), "text"), norm=C.page_norm(F.col("text"))).drop("text")
        known = norm.select(pair, key, traits(F.col("box"), F.col("norm")).alias("box"), only_letters(F.col("norm")).alias("letters"))
        return known.select(pair, F.lit(what).alias("what"), key, F.lit(None).cast("double").alias("score"), F.col("box").withField("letters", F.col("letters")).alias("box"))

    rows = side(old, _OLD, "old_id").unionByName(side(new, _NEW, "new_id"), allowMissingColumns=True).select(pair, "what", "old_id", "new_id", "score", "box")
    return by_group(rows, pair, ["what", "old_id", "new_id"], _aligned, [pair, "old_id", "new_id", "score"])


def figure_parts(parts: DataFrame, figures: DataFrame, page: str, margin: float = 0.015) -> DataFrame:
    """page, part, figure: each box bound to the smallest figure whose bounds (and a margin) hold its centre, of equals the nearest; else to the one that covers most of it, INSIDE at least."""
    corners = ["x0", "y0", "x1", "y1"]
    p = parts.select(page, F.col("id").alias("part"), F.struct(*corners).alias("p"))
    f = figures.select(page, F.col("id").alias("figure"), F.struct(*corners).alias("f"))
    mid = lambda b, lo, hi: (b[lo] + b[hi]) / 2
    a, b = F.col("p"), F.col("f")
    within = lambda lo, hi: mid(a, lo, hi).between(b[lo] - margin, b[hi] + margin)
    gap = F.pow(mid(a, "x0", "x1") - mid(b, "x0", "x1"), 2) + F.pow(mid(a, "y0", "y1") - mid(b, "y0", "y1"), 2)
    met = p.join(f, page).withColumns({"inside": within("x0", "x1") & within("y0", "y1"), "covered": S.containment(a, b)}).filter(F.col("inside") | (F.col("covered") >= INSIDE))
    order = [F.desc("inside"), F.when(F.col("inside"), F.round(S.area(b), 9)), F.when(F.col("inside"), F.round(gap, 9)), F.desc(F.round("covered", 9)), "figure"]
    return met.withColumn("k", F.row_number().over(Window.partitionBy(page, "part").orderBy(*order))).filter("k = 1").select(page, "part", "figure")


def boxes_inside(boxes: DataFrame, outer: DataFrame, page: str, least: int = 2) -> DataFrame:
    """page, outer, ids: the boxes whose centre lies inside an outer one, not above 92 % of its size and well inside or below 45 % of it; only where there are `least`."""
    b = boxes.select(page, "id", F.struct("x0", "y0", "x1", "y1").alias("b"))
    o = outer.select(page, F.col("id").alias("outer"), F.struct("x0", "y0", "x1", "y1").alias("o"))
    x, y = F.col("b"), F.col("o")
    centre = ((x["x0"] + x["x1"]) / 2).between(y["x0"], y["x1"]) & ((x["y0"] + x["y1"]) / 2).between(y["y0"], y["y1"])
    share = F.when(S.area(y) > 0, S.area(x) / S.area(y)).otherwise(F.lit(9.0))
    hit = b.join(o, page).filter(centre & (share <= 0.92) & ((S.containment(x, y) >= 0.55) | (share <= 0.45)))
    return hit.groupBy(page, "outer").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter(F.size("ids") >= least)


# Boxes before they are aligned ----------------------------------------------------------------------


def list_items(text: Column) -> Column:
    """A text's list items, each with its bullet in front; a text with fewer than two bullets is one item, an empty one none."""
    t = F.trim(F.coalesce(text, F.lit("")))
    parts = F.filter(F.transform(F.split(t, f"(?=[{C.BULLETS}])"), lambda x: F.trim(x)), lambda x: x != "")
    bullets = F.length(t) - F.length(F.translate(t, C.BULLETS, ""))
    return F.when(t == "", F.array().cast("array<string>")).when((bullets >= 2) & (F.size(parts) >= 2), parts).otherwise(F.array(t))


def band(y0: Column, y1: Column, index: Column, total: Column, weights: Column) -> tuple[Column, Column]:
    """The index-th (from 0, held within bounds) of `total` bands of a box, by weights if there are as many and they weigh something, else of equal height."""
    n = F.greatest(F.lit(1), total)
    i = F.greatest(F.lit(0), F.least(index, n - 1))
    last = F.when(y1 > y0, y1).otherwise(y0 + 0.05 * n)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    whole = add(weights.cast("array<double>"))
    weighed = F.coalesce((F.size(weights) == n) & (whole > 0), F.lit(False))
    share = lambda k: F.when(weighed, add(F.slice(weights.cast("array<double>"), F.lit(1), k)) / whole).otherwise(k / n)
    return y0 + (last - y0) * share(i), y0 + (last - y0) * share(i + 1)


def exploded_lists(boxes: DataFrame) -> DataFrame:
    """Boxes (id, y0, y1, text and more) with a box for each list item: id#pN, its band of the box, and the box it came from."""
    parts = boxes.withColumn("parts", F.when(F.size(list_items(F.col("text"))) > 1, list_items(F.col("text"))).otherwise(F.array("text"))).withColumn("n", F.size("parts"))
    out = parts.select(*[c for c in boxes.columns if c != "text"], "n", F.posexplode("parts").alias("at", "text"))
    top, bottom = band(F.col("y0"), F.col("y1"), F.col("at"), F.col("n"), F.lit(None).cast("array<double>"))
    split = F.col("n") > 1
    return out.select(
        *[c for c in boxes.columns if c not in ("id", "y0", "y1", "text")], F.when(split, F.concat("id", F.lit("#p"), (F.col("at") + 1).cast("string"))).otherwise(F.col("id")).alias("id"),
        F.when(split, top).otherwise(F.col("y0")).alias("y0"), F.when(split, bottom).otherwise(F.col("y1")).alias("y1"), "text", F.when(split, F.col("id")).alias("split_from"),
    )


def reading_text(boxes: DataFrame, page: str) -> DataFrame:
    """page, text: the body's boxes (y0, y1, x0, x1, text) from top to bottom, then left to right, a line each; captions and labels are left out."""
    box = F.struct("y0", "y1", "x0", "x1", "text")
    body = boxes.withColumn("box", box).filter((F.trim(F.coalesce("text", F.lit(""))) != "") & (layout_role(F.col("box")) == "body"))
    lines = F.sort_array(F.collect_list(F.struct(middle(F.col("box")).alias("y"), F.col("box.x0").alias("x"), F.trim("text").alias("t"))))
    return boxes.select(page).distinct().join(body.groupBy(page).agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("text")), page, "left").withColumn("text", F.coalesce("text", F.lit("")))
