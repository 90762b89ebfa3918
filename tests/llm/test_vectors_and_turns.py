"""Centroid clustering, top-k search and conversation repair against brute force on small fixtures with nulls, ties, repeats and clashing names."""

import hashlib
import heapq
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from palimpsest.llm import centroids, repair, top_k, vectors

VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, cluster string, block string, rank int"


def whole(v):
    return [math.floor(1024 * float(np.float32(x))) for x in v]


def valid(v, dims=None):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and (dims is None or len(v) == dims)


def rows_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z", "b", 7) for i, v in rows], VECTORS).repartition(parts)


@pytest.fixture(scope="module")
def vectors_():
    r = random.Random(3)
    point = lambda: [r.gauss(0, 0.1) for _ in range(64)]
    hubs = [point() for _ in range(4)]
    rows = [(i, [x + r.gauss(0, 0.02) for x in r.choice(hubs)]) for i in range(150)] + [(150 + i, point()) for i in range(80)]
    rows += [(1000 + i, hubs[0]) for i in range(70)]  # one vector very often
    rows += [(5, hubs[1]), (5, hubs[1]), (None, hubs[2]), (None, point()), (-100, [0.0] * 64), (300, [0.0] * 63 + [1e-9])]
    rows += [(400, None), (401, [None] + [0.1] * 63), (402, [math.nan] * 64), (403, [math.inf] * 64), (404, [0.5] * 63), (405, []), (406, [0.25] * 65), (407, [-0.001] * 64)]
    return rows


def lloyd(rows, k=8, rounds=10, dims=64, salt=3):
    kept = [(i, whole(v)) for i, v in rows if valid(v, dims)]
    named = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in named[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(c)), key=lambda z: (dist(v, c[z]), z))
    for _ in range(rounds):
        told = [nearest(v) for _, v in kept]
        for z in range(len(c)):
            mine = [v for (_, v), t in zip(kept, told) if t == z]
            if mine:
                c[z] = [sum(x) // len(mine) for x in zip(*mine)]
    told = [nearest(v) for _, v in kept]
    d = [dist(v, c[t]) for (_, v), t in zip(kept, told)]
    per = [sum(x for x, t in zip(d, told) if t == z) for z in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, t, x, per[t], sum(d), sha[t]) for (i, _), t, x in zip(kept, told, d)), key=repr), c


@pytest.mark.parametrize("tree, leaf", [(8192, 32), (40, 3)])
def test_centroids(spark, vectors_, monkeypatch, tree, leaf):
    monkeypatch.setattr(centroids, "TREE", tree)
    monkeypatch.setattr(centroids, "LEAF", leaf)
    out, c = centroids.kmeans(rows_of(spark, vectors_))
    want, final = lloyd(vectors_)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == want and c == final


def test_centroids_ties_few_and_huge(spark):
    grid = [(i, [float(x), float(y)]) for i, (x, y) in enumerate(itertools.product(range(-3, 4), repeat=2))]  # many equal distances
    huge = [(i, [v[0] * 5e4, v[1] * 5e4]) for i, v in grid]  # squares beyond the doubles' whole numbers
    for rows in (grid, huge, grid[:3], [(1, [0.5, 0.5])] * 5):
        out, c = centroids.kmeans(rows_of(spark, rows), k=5, rounds=4, dims=2)
        want, final = lloyd(rows, k=5, rounds=4, dims=2)
        assert sorted(map(tuple, out.collect()), key=repr) == want and c == final
    none, c = centroids.kmeans(rows_of(spark, [(1, None)]))
    assert none.collect() == [] and c == [] and centroids.kmeans(rows_of(spark, [(None, [0.5, 0.5])]), dims=2)[1] == []
    with pytest.raises(Exception, match="long"):
        centroids.kmeans(rows_of(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0]), (3, [-1e30, 0.0])]), k=1, dims=2)
    with pytest.raises(ValueError):
        centroids.kmeans(rows_of(spark, grid), k=1 << 20, dims=64)


def test_filtering_prunes():
    """On well separated groups almost no vector is looked at by itself, and the assignment is still exact."""
    r = np.random.default_rng(1)
    hubs = r.integers(-4000, 4000, (6, 16)).astype(float)
    points = (hubs[r.integers(0, 6, 4000)] + r.integers(-20, 20, (4000, 16))).astype(float)
    order, nodes = centroids.grow(points)
    tree = centroids.measured(points[order], nodes)
    single, to = [0], np.full(len(points), -1)

    def settle(found, *told):
        if found is None:
            single[0] += len(told[0])
            to[told[0]] = told[1]
        else:
            for node, z in zip(found, told[0]):
                to[tree.first[node] : tree.last[node]] = z

    centroids.descend(tree, hubs, settle)
    assert (to == ((tree.points[:, None] - hubs) ** 2).sum(2).argmin(1)).all()
    assert single[0] < len(points) / 5
    assert tree.sums[0].tolist() == points.sum(0).tolist() and tree.squares[0] == (points**2).sum()


def best(rows, k, every):
    kept = [(i, whole(v)) for i, v in rows if valid(v)]
    out = []
    for a, (q, v) in enumerate(kept):
        if q is not None and q % every == 0:
            scored = [(-sum(x * y for x, y in zip(v, w)), i is None, i or 0) for b, (i, w) in enumerate(kept) if b != a]
            out += [(q, n + 1, None if null else i, -s) for n, (s, null, i) in enumerate(heapq.nsmallest(k, scored))]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, group", [(8192, 1 << 16), (50, 1 << 16), (64, 20)])
def test_top_k(spark, vectors_, monkeypatch, block, group):
    monkeypatch.setattr(top_k, "BLOCK", block)
    monkeypatch.setattr(top_k, "GROUP", group)
    out = top_k.top_k(rows_of(spark, vectors_), every=10)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, out.collect()), key=repr) == best(vectors_, 10, 10)


def test_top_k_few_huge_and_empty(spark):
    rows = [(i * 100, [float(i), 1.0]) for i in range(4)] + [(0, [1e8, 1.0]), (100, [2.0**-10, -5e6, 3.0]), (7, []), (None, [1.0])]
    assert sorted(map(tuple, top_k.top_k(rows_of(spark, rows)).collect()), key=repr) == best(rows, 10, 100)
    assert top_k.top_k(rows_of(spark, [(1, [1.0]), (100, None)])).collect() == []
    assert top_k.top_k(rows_of(spark, [(100, [1.0])])).collect() == []
    assert [tuple(r) for r in top_k.top_k(rows_of(spark, [(100, []), (1, [])])).collect()] == [(100, 1, 1, 0)]
    with pytest.raises(Exception, match="long"):
        top_k.top_k(rows_of(spark, [(100, [1e30]), (1, [1e30])])).collect()


def test_block_leaves_early():
    """Where one group of rows is far better, the search ends with few possible members, and no member of the top k is among those left out."""
    r = np.random.default_rng(2)
    numbers = r.integers(-300, 300, (4000, 24)).astype(float)
    numbers[:40] += 900
    order = numbers.argsort(0, kind="stable")
    low, high = numbers.min(0), numbers.max(0)
    level = np.minimum(((np.take_along_axis(numbers, order, 0) - low) / ((high - low) / top_k.LEVELS)).astype(int), top_k.LEVELS - 1)
    begins = np.stack([np.searchsorted(level[:, d], np.arange(top_k.LEVELS + 1)) for d in range(24)])
    width, raw = vectors.pack(numbers)
    block = top_k.Block(24, width, raw, order.T.astype("<u2").tobytes(), begins.astype("<i4").tobytes(), 4000)
    for query in (np.full(24, 3.0), r.integers(-9, 9, 24).astype(float), np.zeros(24)):
        found = set(block.search(query, 10, -np.inf, None).tolist())
        scores = numbers @ query
        assert {i for i in range(4000) if scores[i] > np.partition(scores, -10)[-10]} <= found
    assert len(block.search(np.full(24, 3.0), 10, -np.inf, None)) <= 4000 * top_k.FEW
    assert len(block.search(np.full(24, 3.0), 10, 1e9, None)) == 0


# Conversations -------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, uid string, conv string, audit string"


PUT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """The least (cost, letters, lines) of all edits from each row and state on, from the end."""
    put_first = lambda best, p: (best[PUT[p][1]][0] + 3, "I" + best[PUT[p][1]][1], (PUT[p][0] + ":", *best[PUT[p][1]][2]))

    def inserted(best):
        for _ in range(3):
            best = {p: min(([best[p]] if p in best else []) + ([put_first(best, p)] if PUT[p][1] in best else [])) for p in PUT if p in best or PUT[p][1] in best}
        return best

    best = inserted({0: (0, "", ()), 3: (0, "", ())})
    for own, text, fault in reversed(rows):
        now = {}
        for p, (role, q) in PUT.items():
            cost, letters, lines = best[p]
            options = [(cost + 4, "D" + letters, lines)]
            if fault in (0, 3):
                cost, letters, lines = best[q]
                options.append((cost + 3 + fault, "R" + letters, (f"{role}:{text}", *lines)))
                if (p, own[:1]) in KEPT:
                    cost, letters, lines = best[KEPT[p, own[:1]]]
                    options.append((cost + fault, "K" + letters, (f"{own}:{text}", *lines)))
            now[p] = min(options)
        best = inserted(now)
    cost, letters, lines = best[0]
    return cost, letters, "\n".join(lines)


def searched(rows):
    """All edits by growing (cost, letters): what is found first is the least."""
    put, kept = PUT, KEPT
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, p, out = heapq.heappop(heap)
        if i == len(rows) and p in (0, 3):
            return cost, audit, "\n".join(out)
        if (i, p, audit) in seen:
            continue
        seen.add((i, p, audit))
        role, q = put[p]
        if audit[-3:] != "III":
            heapq.heappush(heap, (cost + 3, audit + "I", i, q, (*out, role + ":")))
        if i < len(rows):
            own, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, p, out))
            if fault in (0, 3):
                heapq.heappush(heap, (cost + 3 + fault, audit + "R", i + 1, q, (*out, f"{role}:{text}")))
                if (p, own[:1]) in kept:
                    heapq.heappush(heap, (cost + fault, audit + "K", i + 1, kept[p, own[:1]], (*out, f"{own}:{text}")))


def repaired(rows):
    """Brute force of one conversation's damaged rows (turn, role, text), in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    seen, told = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        told.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults = [f for _, _, f in told]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
    cost, audit, text = cheapest(told)
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if f == 1 else "".join(c for c in text if c not in ".!?") if f == 2 else text
        out += [(conv, turn, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    return out


@pytest.fixture(scope="module")
def conversations():
    r = random.Random(11)
    rows = []
    for conv in range(60):
        said = [r.choice(["a.", "b!", "c?", "no end", " \n", "", "é .", "x. \t"]) for _ in range(3)] + [f"t{i}." for i in range(9)]
        n = r.choice([1, 1, 2, 3, 5, 8])
        for t in range(n):
            role = r.choice(["system", "user", "assistant"]) if r.random() < 0.5 else ["user", "assistant"][t % 2]
            rows.append((conv, r.choice([t, t, t, 2 * t, None]), role, r.choice(said)))
    rows += [(70, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(300)]  # a third of all rows
    rows += [(None, 0, "user", "q?"), (None, None, None, None), (None, 1, "tool", "x."), (71, None, None, "x."), (71, None, "uncle", "y."), (72, 1, "user", "w." * 50_000), (72, 2, "assistant", "z.")]
    rows += [(73, 5, "user", "same."), (73, 5, "user", "same."), (73, 5, "assistant", "same."), (74, 3, "", "no role.")]
    return rows


def test_repair(spark, conversations):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in conversations], TURNS).repartition(5)
    assert sorted(map(repr, repair.damage(df).select("conv_id", "turn", "role", "text").collect())) == sorted(f"Row(conv_id={a!r}, turn={b!r}, role={c!r}, text={d!r})" for a, b, c, d in damaged(conversations))
    got = {r[0]: tuple(r[1:]) for r in repair.repair_report(repair.damage(df), df).collect()}
    after = damaged(conversations)
    want = {}
    for conv in {r[0] for r in conversations}:
        mine = [r[1:] for r in after if r[0] == conv]
        want[conv] = repaired(mine) if mine else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == want
    kept = repair.repair(df)
    rows = sorted((r for r in kept.rows().collect()), key=lambda r: (repr(r.conv_id), r.place))
    for conv, mine in itertools.groupby(rows, key=lambda r: r.conv_id):
        mine = list(mine)
        initials = "".join(r.role[0] for r in mine)
        assert [r.place for r in mine] == list(range(len(mine))) and initials.removeprefix("s") == "ua" * (len(initials) // 2)
    empty = df.limit(0)
    assert repair.repair_report(empty, empty).collect() == [] and repair.repair(empty).rows().collect() == []


def test_lazy_automaton():
    """All words of up to four symbols: cost and least audit are those of a search over all edits; the automaton stays small."""
    lazy = repair.Lazy()
    roles = ["system", "user", "assistant", "tool"]
    for n in range(5):
        for symbols in itertools.product(range(16), repeat=n) if n < 3 else random.Random(n).sample(list(itertools.product(range(16), repeat=n)), 300):
            rows = [(roles[s % 4], "t", [0, 1, 2, 3][s // 4]) for s in symbols]
            assert lazy.repair(bytes(symbols)) == cheapest(rows)[:2] == searched(rows)[:2]
    assert len(lazy.vectors) < 100  # 76 are met here; a vector has few different costs
    long = bytes(random.Random(5).choices(range(16), k=200_000))
    cost, audit = lazy.repair(long)
    assert len([x for x in audit if x != "I"]) == 200_000 and cost > 0
