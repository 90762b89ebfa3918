"""Many-to-one alignment of boxes: one box of a page that covers several of the other side is cut into pieces, one for each.

Boxes are compared within a pair of pages only. Which covers which is found relationally; a small helper settles the order of a page.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compare as C
from ..functions import similarity as S
from . import alignment as A
from .located import cut_at
from .matching import by_group

# Shortest needle and floor of likeness inside a page and at its edge, largest share, what a host must have more, what all parts must cover.
SHORTEST, EDGE_SHORTEST, LIKE, EDGE_LIKE = 8, 4, 0.92, 0.94
LARGEST, LONGER, REDEEM, SLICE = 0.92, 1.25, 0.82, 0.55
HOST, PARTS, COVER = 12, 8, 0.45


def may_cover(h: Column, n: Column, edge: bool = False) -> Column:
    """Whether the lengths of two normalised texts allow that the first covers the second."""
    return (F.length(n) >= (EDGE_SHORTEST if edge else SHORTEST)) & (F.length(n) <= LARGEST * F.length(h))


def covers(h: Column, n: Column, edge: bool = False) -> Column:
    """The second of two normalised texts stands in the first, word for word or nearly; and is no more than LARGEST of it."""
    least = EDGE_LIKE if edge else LIKE
    return may_cover(h, n, edge) & S.may_reach(h, n, least) & S.partial_reaches(h, n, least)


def _sides(old: DataFrame, new: DataFrame, pair: str) -> DataFrame:
    """All boxes with what the choice needs: side, place in reading order, lengths."""
    t = F.coalesce("text", F.lit(""))
    box = lambda df, side: df.select(pair, F.lit(side).alias("side"), "id", (F.col("y0") + F.col("y1")).alias("y"), "x0", t.alias("text"))
    both = box(old, "old").unionByName(box(new, "new"))
    place = F.row_number().over(Window.partitionBy(pair, "side").orderBy("y", "x0", "id"))
    return both.select(pair, "side", "id", place.alias("place"), F.length(C.page_norm(F.col("text"))).alias("size"), F.length(C.content_key(F.col("text"))).alias("content"), F.xxhash64("text").alias("same"))


def _may_cover(rows: list[tuple], edge: bool = False) -> list[tuple]:
    """(pair, side, host, part, h, p): the boxes of a page as hosts with their normalised texts. Returns which box may cover which of the other side, with both texts; with empty ones, where the second stands in the first word for word."""
    out = []
    for pair, side, host, _, h, _ in rows:
        for _, other, part, _, p, _ in rows:
            if other == side or not (EDGE_SHORTEST if edge else SHORTEST) <= len(p) <= LARGEST * len(h):
                continue
            if p in h:
                out.append((pair, side, host, part, "", ""))  # of two empty texts one stands in the other
            elif S.pieces_allow(h, p, EDGE_LIKE if edge else LIKE):
                out.append((pair, side, host, part, h, p))
    return out


def covering(old: DataFrame, new: DataFrame, pair: str, edge: bool = False) -> DataFrame:
    """pair, side, host, part: which boxes of either side cover which of the other."""
    side = lambda df, k: df.select(pair, F.lit(k).alias("side"), F.col("id").alias("host"), F.lit(None).cast("long").alias("part"), C.page_norm(F.col("text")).alias("h"), F.lit(None).cast("string").alias("p"))
    met = by_group(side(old, "old").unionByName(side(new, "new")), pair, ["side", "host"], partial(_may_cover, edge=edge))
    return met.filter(S.partial_reaches(F.col("h"), F.col("p"), EDGE_LIKE if edge else LIKE)).select(pair, "side", "host", "part")


# Rows of a page as the helper sees them.
_ANCHOR, _BOX, _COVER, _SLICE = range(4)


def _settle(rows: list[tuple]) -> list[tuple]:
    """(pair, what, side, a, b, i, j, k, x, score): anchors (old, new, -, -, -, score) in order, boxes (id, -, place, size, content, hash as x), covers (host, part, 1 if the part's own anchor is at least REDEEM like it).
    Returns kept anchors and slices (host, part, number, parts)."""
    anchors = [r for r in rows if r[1] == _ANCHOR]
    box = {(r[2], r[3]): r for r in rows if r[1] == _BOX}
    parts_of: dict[tuple, set] = {}
    redeemed = {(r[2], r[3], r[4]) for r in rows if r[1] == _COVER and r[5]}
    for r in rows:
        if r[1] == _COVER:
            parts_of.setdefault((r[2], r[3]), set()).add(r[4])
    place, size = lambda s, i: box[s, i][5], lambda s, i: box[s, i][6]
    lone = {"old": {i for s, i in box if s == "old"} - {r[3] for r in anchors}, "new": {i for s, i in box if s == "new"} - {r[4] for r in anchors}}
    out, gone = [], set()

    def cut(side: str, host: int, parts: set) -> None:
        other = "new" if side == "old" else "old"
        for k, part in enumerate(sorted(parts, key=lambda i: (place(other, i), i))):
            out.append((rows[0][0], _SLICE, side, host, part, k, len(parts), 0, 0, None))

    for r in anchors:
        o, n = r[3], r[4]
        if o in gone:
            continue
        mine = parts_of.get(("old", o), set())
        covered = {n} | (mine & lone["new"])
        if len(covered) > 1 and n in mine and size("old", o) > size("new", n) * LONGER:
            cut("old", o, covered)
            lone["new"] -= covered
            gone.add(o)
            continue
        mine = parts_of.get(("new", n), set())
        covered = {o} | (mine & lone["old"])
        texts, stolen = {box["old", i][8] for i in covered}, set()
        for q in anchors:
            p = q[3]
            if p != o and p not in gone and p in mine and ("new", n, p) not in redeemed and box["old", p][8] not in texts:
                covered.add(p)
                stolen.add(p)
                texts.add(box["old", p][8])
        if len(covered) > 1 and o in mine and size("new", n) > size("old", o) * LONGER:
            cut("new", n, covered)
            lone["old"] -= covered
            gone |= covered
            continue
        out.append(r)
    # an anchor whose old box was redeemed by a later one is undone
    held = {r[4] for r in out if r[1] == _SLICE and r[2] == "new"}
    out = [r for r in out if r[1] != _ANCHOR or r[3] not in held]
    for side, other in (("old", "new"), ("new", "old")):
        for host in sorted(lone[side], key=lambda i: (-box[side, i][7], place(side, i), i)):
            if host not in lone[side]:
                continue
            covered = parts_of.get((side, host), set()) & lone[other]
            whole = size(side, host)
            if len(covered) > 1 and whole >= HOST and sum(size(other, i) for i in covered) >= max(PARTS, int(whole * COVER)):
                cut(side, host, covered)
                lone[other] -= covered
                lone[side].discard(host)
    return out


def rebind(old: DataFrame, new: DataFrame, anchors: DataFrame, pair: str) -> DataFrame:
    """pair, old_id, new_id, part, parts, cut, score, old_text, new_text, y0, y1: anchors with one box cut into pieces where it covers several of the other side.

    old and new: pair, id, y0, y1, x0, x1, text; anchors: pair, old_id, new_id, score (one-to-one, see align). cut: the side whose box is
    cut (null: none), part: the piece's number in reading order, y0 and y1 its band of that box by the parts' lengths. A box of
    an anchor takes in boxes without one that it covers; a new box also redeems old boxes it covers from anchors to boxes they are
    not like. Boxes of neither anchor that cover two or more that have none are cut as well, the longest first. Null texts
    count as empty; a box belongs to one anchor, unless it is cut.
    """
    whole = old.select(pair, F.lit("new").alias("side"), F.col("id").alias("part"), F.col("text").alias("pt"))
    theirs = anchors.select(pair, F.col("old_id").alias("part"), F.col("new_id").alias("own")).join(new.select(pair, F.col("id").alias("own"), F.col("text").alias("wt")), [pair, "own"])
    own = theirs.join(whole, [pair, "part"]).select(pair, "side", "part", "wt", "pt", F.lit(True).alias("anchored"))
    # the texts go along with the covers, so that neither covers nor anchors are made once more
    cover = covering(old, new, pair).join(own, [pair, "side", "part"], "left")
    like = S.partial_reaches(C.page_norm(F.col("wt")), C.page_norm(F.col("pt")), REDEEM)
    cover = cover.select(pair, "side", "host", "part", F.when(F.col("anchored"), like.cast("long")).otherwise(F.lit(0).cast("long")).alias("like"))
    zero = F.lit(0).cast("long")
    shape = lambda df, what, side, *more, score=F.lit(None).cast("double"): df.select(pair, F.lit(what).alias("what"), side.alias("side"), *[c.cast("long").alias(k) for c, k in zip(more, "abijkx")], score.alias("score"))
    ordered = anchors.withColumn("place", F.row_number().over(Window.partitionBy(pair).orderBy(F.desc("score"), "old_id", "new_id")))
    boxes = _sides(old, new, pair)
    # anchors come in the order in which they were made: the best first
    rows = shape(ordered, _ANCHOR, F.lit(""), F.col("old_id"), F.col("new_id"), F.col("place"), zero, zero, zero, score=F.col("score").cast("double"))
    rows = rows.unionByName(shape(boxes, _BOX, F.col("side"), F.col("id"), zero, F.col("place"), F.col("size"), F.col("content"), F.col("same")))
    rows = rows.unionByName(shape(cover, _COVER, F.col("side"), F.col("host"), F.col("part"), F.col("like"), zero, zero, zero))
    settled = by_group(rows, pair, ["what", "i", "a", "b"], _settle)
    kept = settled.filter(F.col("what") == _ANCHOR).select(pair, F.col("a").alias("old_id"), F.col("b").alias("new_id"), "score")
    side_of = lambda df, k: df.select(pair, F.col("id").alias(f"{k}_id"), *[F.col(c).alias(f"{k}_{c}") for c in ("y0", "y1", "x0", "x1", "text")])
    o, n = side_of(old, "old"), side_of(new, "new")
    plain = kept.join(o, [pair, "old_id"]).join(n, [pair, "new_id"])
    plain = plain.select(pair, "old_id", "new_id", F.lit(None).cast("long").alias("part"), F.lit(1).cast("long").alias("parts"), F.lit(None).cast("string").alias("cut"), "score", "old_text", "new_text", F.lit(None).cast("double").alias("y0"), F.lit(None).cast("double").alias("y1"))
    found = settled.filter(F.col("what") == _SLICE).select(pair, F.col("side").alias("cut"), F.when(F.col("side") == "old", F.col("a")).otherwise(F.col("b")).alias("old_id"), F.when(F.col("side") == "old", F.col("b")).otherwise(F.col("a")).alias("new_id"), F.col("a").alias("host"), F.col("i").alias("part"), F.col("j").alias("parts"))
    found = found.join(o, [pair, "old_id"]).join(n, [pair, "new_id"])
    mine = F.when(F.col("cut") == "old", F.col("new_text")).otherwise(F.col("old_text"))
    per_host = found.groupBy(pair, "cut", "host").agg(F.sort_array(F.collect_list(F.struct("part", mine.alias("t")))).alias("needles"))  # the parts of one box
    found = found.join(per_host, [pair, "cut", "host"])
    host = F.when(F.col("cut") == "old", F.col("old_text")).otherwise(F.col("new_text"))
    found = found.withColumn("pieces", cut_at(host, F.transform("needles", lambda x: x["t"])))
    weights = F.transform("needles", lambda x: F.greatest(F.lit(1.0), F.length(C.page_norm(x["t"])).cast("double")))
    edge = lambda c: F.when(F.col("cut") == "old", F.col(f"old_{c}")).otherwise(F.col(f"new_{c}"))
    top, bottom = A.band(edge("y0"), edge("y1"), F.col("part"), F.col("parts"), weights)
    found = found.withColumns({"y0": top, "y1": bottom, "piece": F.get("pieces", F.col("part").cast("int"))})
    box = lambda k: F.when(F.col("cut") == k, F.struct(F.col("y0"), F.col("y1"), F.col(f"{k}_x0").alias("x0"), F.col(f"{k}_x1").alias("x1"), F.col("piece").alias("text"))).otherwise(
        F.struct(F.col(f"{k}_y0").alias("y0"), F.col(f"{k}_y1").alias("y1"), F.col(f"{k}_x0").alias("x0"), F.col(f"{k}_x1").alias("x1"), F.col(f"{k}_text").alias("text")))
    found = found.withColumns({"a": box("old"), "b": box("new")})
    found = found.withColumn("score", F.greatest(F.lit(SLICE), A.anchor_score(F.col("a"), F.col("b"))))
    found = found.select(pair, "old_id", "new_id", F.col("part") + 1, "parts", "cut", "score", F.col("a.text").alias("old_text"), F.col("b.text").alias("new_text"), "y0", "y1").toDF(*plain.columns)
    return plain.unionByName(found)
