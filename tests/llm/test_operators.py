"""The operators against brute force on a small fixture with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import bpe, chat, common, decontam, license_scan, quality, repeats, sharding, simhash, substring_dedup, suffix_dedup, warc
from palimpsest.llm.components import components
from palimpsest.llm.template import Template, TemplateError

SCHEMA = "doc_id long, text string, lang string, rid string, k1 string, n_words int"


def fixture_texts():
    r = random.Random(7)
    vocab = ["w%d" % i for i in range(300)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = prose(60)
    out = [prose(r.randint(1, 150)) for _ in range(20)]
    out += [f"{prose(30)}\n{passage}\n{prose(20)}" for _ in range(4)] + [f"a {passage}", passage]
    out += [out[0]] * 3 + [out[1].replace("w1", "w2", 1)]
    out += [None, "", " \n\t ", "x", "a " * 400, "náïve \U0001f600 café " * 30, prose(4000), "All rights reserved. CC BY-NC 4.0", "Licensed under the GNU General Public License, version 3."]
    out += ["\x0b".join(["tab"] * 50), "#$%& " * 20, "Ünï ÄÖ " * 40]
    return out


@pytest.fixture(scope="module")
def texts():
    return fixture_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], "r", "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def covered(units, k):
    seen = Counter(tuple(u[i : i + k]) for u in units for i in range(len(u) - k + 1))
    out = []
    for u in units:
        flags = [False] * len(u)
        for i in range(len(u) - k + 1):
            if seen[tuple(u[i : i + k])] > 1:
                flags[i : i + k] = [True] * k
        out.append(flags)
    return out


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_substring_dedup(docs, texts, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)  # 1: all that share a minimiser are dealt out by window
    words = [(t or "").encode().split() for t in texts]
    want = {i: (len(w), sum(f), hashlib.sha256(b" ".join(x for x, y in zip(w, f) if not y)).hexdigest()) for i, (w, f) in enumerate(zip(words, covered(words, 35)))}
    assert {r[0]: tuple(r[1:]) for r in substring_dedup.substring_digests(docs).collect()} == want
    full = substring_dedup.substring_dedup(docs)
    assert full.columns == [*docs.columns, "n_words_", "n_removed"]
    assert {r.doc_id: hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() for r in full.collect()} == {i: v[2] for i, v in want.items()}


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_suffix_dedup(docs, texts, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    units = [(t or "").encode() for t in texts]
    want = {}
    for i, (u, f) in enumerate(zip(units, covered(units, 200))):
        want[i] = (len(u), sum(f), sum(f[j] and not (j and f[j - 1]) for j in range(len(f))), hashlib.sha256(bytes(x for x, y in zip(u, f) if not y)).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.suffix_digests(docs).collect()} == want


def test_suffix_dedup_keeps_columns_and_bytes(docs, texts):
    """The DataFrame form: all columns but the text, kept bytes as by brute force, names that clash."""
    full = suffix_dedup.suffix_dedup(docs.withColumn("kept", F.lit("mine")))
    assert full.columns == ["doc_id", "lang", "rid", "k1", "n_words", "kept", "n_bytes", "n_removed", "n_spans", "kept_"]
    units = [(t or "").encode() for t in texts]
    want = {i: bytes(x for x, y in zip(u, f) if not y) for i, (u, f) in enumerate(zip(units, covered(units, 200)))}
    got = full.collect()
    assert {r.doc_id: bytes(r.kept_) for r in got} == want and all(r.kept == "mine" and r.n_bytes - r.n_removed == len(r.kept_) for r in got)


def test_clashing_output_names(spark, docs, texts):
    """Columns that a table has already stay as they are; what is added takes other names."""
    own = docs.select("doc_id", "text", "lang", *[F.lit("mine").alias(c) for c in ("shard", "slot", "token_ids", "n_tokens", "kept", "failed", "rates", "part", "of")])
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for out, added in ((sharding.shard_rows(own, 3), ["shard_", "slot_"]), (bpe.bpe_encode(own, path()), ["token_ids_", "n_tokens_", "ids_sha256", "decoded_sha256", "decoded"]), (quality.judge(own, labels), ["measured", "rates_", "base_failed", "failed_", "kept_"])):
        assert out.columns == [*own.columns, *added]
        rows = out.collect()
        assert len(rows) == len(texts) and all(r[c] == "mine" for r in rows for c in own.columns[3:])


def test_suffix_family_spans_batches():
    """All pairs of equal strings are found, within and across batches, the arrays are in byte order and grow geometrically."""
    import numpy as np

    r, k = np.random.default_rng(1), 40
    source = r.integers(97, 99, 3000, dtype=np.uint8).tobytes() + b"\0" * 60 + b"\xff" * 60
    strings = [source[s : s + n] for s, n in zip(r.integers(0, 3000, 60).tolist(), r.integers(k, 120, 60).tolist())]
    family, begins = suffix_dedup.Family(k), []
    for lo in range(0, 60, 5):
        begins += family.add(strings[lo : lo + 5])[:-1].tolist()
    many = Counter(s[i : i + k] for s in strings for i in range(len(s) - k + 1))
    for s, at in zip(strings, begins):
        assert [bool(family.flags[at + i]) for i in range(len(s) - k + 1)] == [many[s[i : i + k]] > 1 for i in range(len(s) - k + 1)]
    sizes = [len(level) for level in family.levels]
    assert sum(sizes) == sum(len(s) - k + 1 for s in strings) and all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and len(sizes) <= 6 and family.scans >= 11
    data = family.data.tobytes()
    for level in family.levels:
        assert all(data[a : a + k] <= data[b : b + k] for a, b in zip(level.tolist(), level[1:].tolist()))


def test_families_get_every_batch_of_the_table(spark, monkeypatch):
    """With one family for all strings, its batches are those of the whole table, and repeats across batches are found."""
    seen = []
    real = suffix_dedup.Family.add
    monkeypatch.setattr(suffix_dedup.Family, "add", lambda self, strings: (seen.append((id(self), len(strings))), real(self, strings))[1])
    r = random.Random(4)
    shared = "".join(r.choice("abcdefghij") for _ in range(700)).encode()
    rows = []
    for t in range(64):
        text = bytes(r.choice(b"klmnop") for _ in range(150)) + shared
        rows += [(0, t % repeats.BATCHES, 5, (t << 8) + i, 1, text[i : i + 260]) for i in range(0, 500, 61)]
    rows.sort(key=lambda x: x[:2])
    found = {}
    for mz, pk, f, t in suffix_dedup.by_suffixes(iter(rows), 200):
        for p, a, b in zip(pk.tolist(), f.tolist(), t.tolist()):
            found.setdefault(p, set()).update(range(a, b))
    assert len(seen) == repeats.BATCHES and len({x for x, _ in seen}) == 1
    many = Counter(x[5][i : i + 200] for x in rows for i in range(61))
    assert found == {x[3]: s for x in rows if (s := {i for i in range(61) if many[x[5][i : i + 200]] > 1})}


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n)), "".join("ba"[i.bit_count() & 1] for i in range(n))


def test_words_and_bytes_that_polynomials_confuse(spark):
    """Different words and strings with equal polynomial hashes modulo 2**64 are not repeats."""
    a, b = thue_morse(1024)
    lead = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(0, f"{lead} {a}"), (1, f"{lead} {b}"), (2, "x" * 300 + a), (3, "x" * 300 + b), (4, a + "y" * 90), (5, b + "y" * 90)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_digests(df).collect()} == dict.fromkeys(range(6), 0)
    units = [r.text.encode() for r in df.orderBy("doc_id").collect()]
    assert [r.n_removed for r in suffix_dedup.suffix_digests(df).orderBy("doc_id").collect()] == [sum(f) for f in covered(units, 200)]


def test_equal_hashes_are_told_apart_by_bytes():
    import numpy as np

    raw = b"abcabdabcxabd"
    first = np.array([0, 3, 6, 10])
    label = substring_dedup.classes(raw, first, first + 3, np.zeros(4, np.uint64))
    assert label[0] == label[2] and label[1] == label[3] and label[0] != label[1]


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (
        substring_dedup.substring_dedup(empty), suffix_dedup.suffix_dedup(empty), simhash.simhash_components(empty), simhash.simhash_dedup(empty), decontam.contamination(empty, bench),
        license_scan.scan(empty), sharding.shard_rows(empty, 3), quality.judge(empty, labels), bpe.bpe_encode(empty, path()),
        chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
        warc.read_pages(warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))),
    ):
        assert out.count() == 0


def brute_print(t):
    import xxhash

    w = (t or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("tile", [16_384, 4])
def test_simhash(spark, docs, texts, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)  # 4: buckets are cut into tiles
    prints = [brute_print(t) for t in texts]
    root = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            root[i] = min(root[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 4)
            root[i] = root[root[i]]
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert out == {i: (f"{p:016x}", root[i]) for i, p in enumerate(prints)}
    assert sorted(r.doc_id for r in simhash.simhash_dedup(docs).collect()) == sorted(set(root))


def test_near_is_exact():
    import numpy as np

    r = np.random.default_rng(3)
    a = r.integers(0, 2**64, 130, dtype=np.uint64)
    b = np.concatenate([a ^ (np.uint64(1) << r.integers(0, 64, 130).astype(np.uint64)) for _ in range(3)])
    for radius in (0, 1, 4, 7, 20):
        hits = simhash.near(simhash.planes(a), simhash.planes(b), len(b), radius)
        got = np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little")[: len(a), : len(b)].astype(bool)
        assert (got == (np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)).all()
    wide = r.integers(0, 2**64, (100, 4), dtype=np.uint64)
    wide[50:] = wide[:50] ^ (r.integers(0, 2**64, (50, 4), dtype=np.uint64) & r.integers(0, 2**64, (50, 4), dtype=np.uint64) & r.integers(0, 2**64, (50, 4), dtype=np.uint64))
    got = np.unpackbits(simhash.near(simhash.planes(wide), simhash.planes(wide), 100, 40).view(np.uint8), axis=1, bitorder="little")[:100, :100]
    assert (got == (np.bitwise_count(wide[:, None] ^ wide[None]).sum(axis=2) <= 40)).all()


def test_near_abandons_blocks():
    """Of unrelated fingerprints, compared with themselves, few blocks are met by all planes, and no link is lost by it."""
    import numpy as np

    prints = np.random.default_rng(4).integers(0, 2**64, 4096, dtype=np.uint64)
    met: list[int] = []
    vertical = simhash.planes(prints)
    hits = simhash.near(vertical[:, :4], vertical, 4096, 4, met)
    assert met[0] == 256 * 64 and met[-1] < met[0] / 20 and sum(met) < 0.6 * met[0] * 64
    assert np.bitwise_count(hits).sum() == 256  # each finds itself


@pytest.mark.parametrize("tile", [3, 20])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, tile):
    """Many fingerprints that share most bits: buckets are cut by further bits and by tiles; components as by brute force."""
    monkeypatch.setattr(simhash, "TILE", tile)
    r = random.Random(9)
    base = r.getrandbits(64)
    prints = {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 9))) for _ in range(150)} | {r.getrandbits(64) for _ in range(30)}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y, key=signed.get)] = min(x, y, key=signed.get)
    df = spark.createDataFrame([(p,) for p in signed.values()], "fp long")
    got = {x.node: x.root for x in components(simhash.links(df, 4)).collect()}
    assert got == {signed[p]: signed[find(p)] for p in prints if find(p) != p}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (101, 100)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100}


def item_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))


@pytest.mark.parametrize("most", [16 << 20, 0])
def test_decontamination(spark, docs, texts, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)  # 0: nothing is broadcast
    items = [(1, " ".join(texts[0].split()[:25])), (2, texts[20]), (3, "w1 w2"), (4, "CAFÉ"), (5, None), (6, "!!"), (10, texts[25]), (11, "tab tab tab")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = {}
    for i, t in items:
        w = item_words(t)
        for s in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[s : s + 10]), set()).add(str(i))
    want = {}
    for i, t in enumerate(texts):
        w, hit, found = item_words(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        want[i] = (len(w), len(hit), sorted(found), bool(hit))
    out = decontam.contamination(docs, bench)
    assert {r[0]: (r[6], r[7], r[9], r[10]) for r in out.collect()} == want


def test_decontamination_of_many_equal_items(spark):
    """2,000 items and a text of 3,000 words that all are the same word: the rows are places and items, not their product."""
    bench = spark.range(2000).selectExpr("id AS item_id", "'yes' AS text")
    df = spark.createDataFrame([(1, "Yes! " * 3000), (2, "no")], "doc_id long, text string")
    wins = decontam.item_windows(bench, "item_id", "text", 10)
    keyed = df.select(F.xxhash64("text").alias("k1"), F.lit(0).cast("long").alias("k2"), "text")
    assert decontam.occurrences(keyed, wins.select("id1", "id2", "win").distinct()).count() == 3000
    r = {r.doc_id: r for r in decontam.contamination(df, bench).collect()}
    assert (r[1].n_words, r[1].n_hit, r[1].n_items, r[2].n_hit) == (3000, 3000, 2000, 0)


def test_quality_measures(spark, docs, texts):
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0) for i in range(len(texts))] + [(1, 0), (2, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c, cov = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)), set()
        for j in range(len(w) - 4):
            if c[tuple(w[j : j + 5])] > 1:
                cov |= set(range(j, j + 5))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        m = out[i].measured
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov))
        assert out[i].base_failed == (len(w) < 10 or 100 * len(cov) > 20 * len(w))


def test_safe_cutoffs_hold_their_bound(spark):
    """The bound is for all rules of a stratum together, over different texts: copies of a labelled text count once."""
    from math import comb

    schema = "stratum string, good boolean, k1 long, rates struct<symbol_rate:double,dup_line_rate:double,repeat_rate:double,word_length:double,capital_rate:double,mark_rate:double>"
    rows = [("s", True, i, (float(i % 2000), 0.0, float(i * 7 % 1999), 0.0, 0.0, 0.0)) for i in range(4000)] * 3
    rows += [("few", True, i, (0.0,) * 6) for i in range(100)] + [("s", False, 256, (9e9,) * 6), ("no other texts", True, 1, (0.0,) * 6)]
    other = [("s", None, i, (float(i % 2000), 0.0, float(i * 11 % 1999), 0.0, 0.0, 0.0)) for i in range(5000, 9000)] + [("few", None, i, (0.0,) * 6) for i in range(50)]
    drawn = spark.createDataFrame(other, schema)
    out = quality.safe_cutoffs(spark.createDataFrame(rows, schema), drawn, 0.02, 0.05).collect()
    assert [r.stratum for r in out] == ["s"]
    r = out[0]
    exact = sum(comb(r.n, k) * 0.02**k * 0.98 ** (r.n - k) for k in range(r.rejected + 1))
    assert abs(exact - r.chance) < 1e-9 and r.chance <= 0.05 / 2 and 0 < r.candidate < len(quality.CANDIDATES) - 1
    held = [x[3] for x in rows[:4000] if x[2] != 256]  # that text has contradicting labels
    assert r.n == len(held) and r.rejected == sum(any(a > b for a, b in zip(x, r.cutoffs)) for x in held)


def test_kept_like_brute_force(spark):
    """A learnt rule rejects: base, rule set and verdict, all from the rule as it is stated."""
    import math
    from fractions import Fraction

    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(12)) + (" #" * r.choice([0, 0, 0, 1])) for _ in range(1500)]
    texts += [t + " # $ % & # $ % &" for t in texts[:60]] + texts[:200] + ["x", None]
    df = spark.createDataFrame([(i, t, "en", "a", "b", 0) for i, t in enumerate(texts)], SCHEMA)
    labels = {i: 0 if 1500 <= i < 1560 else 1 for i in range(len(texts)) if i % 2 or i >= 1560}
    out = {x.doc_id: x for x in quality.judge(df, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    keys = {x.doc_id: x.k for x in df.selectExpr("doc_id", "xxhash64(coalesce(text, '')) AS k").collect()}
    known = {keys[i] for i in labels if not out[i].base_failed}
    held = list({keys[i]: tuple(out[i].rates) for i in labels if labels[i] and not out[i].base_failed}.values())
    drawn = [tuple(out[i].rates) for i in out if not out[i].base_failed and keys[i] not in known]
    assert len(held) > 500 and len(drawn) > 500
    cutoffs = None
    for level in quality.CANDIDATES:
        q = [sorted(v)[max(0, math.ceil(Fraction(str(level)) * len(v)) - 1)] for v in zip(*drawn)]
        k, n = sum(any(a > b for a, b in zip(x, q)) for x in held), len(held)
        if sum(math.comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(k + 1)) > 0.05:
            break
        cutoffs = q
    assert cutoffs
    for i, x in out.items():
        assert x.kept == (not x.base_failed and not any(a > b for a, b in zip(x.rates, cutoffs))), i
    assert any(not x.kept and not x.base_failed for x in out.values()) and sum(not x.kept for x in out.values() if x.doc_id < 1500) < 150
    assert sorted(x.doc_id for x in quality.quality_filter(df, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()) == sorted(i for i in out if out[i].kept)


def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_bpe_like_the_library(docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path())
    mine = bpe.load(path())
    hostile = [*texts, "a" * 3000, "aaa <|endoftext|><|endoftext|> x", "don't I'LL 　\n\n  y", "abababab" * 60, "\x00\x01 \r\n "]
    for t in hostile:
        want = library.encode(t or "", add_special_tokens=False).ids
        got = next(mine.encode([t or ""]))
        assert got == want and mine.decode(got) == library.decode(want, skip_special_tokens=False) == (t or "")
    r = random.Random(8)
    for n in (1, 2, 3, 500, 1024, 1025, 5000):  # rounds and the heap agree, with each other and with the library
        w = "".join(r.choice("etaoinsh") for _ in range(n))
        assert tuple(mine._long(w.encode())) == mine._learn([w])[w] == tuple(library.encode(w, add_special_tokens=False).ids)
    began = time.process_time()
    assert next(mine.encode(["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(80_000))]))
    assert time.process_time() - began < 2 and max(map(len, mine.known)) <= bpe.SHORT
    out = bpe.bpe_encode(docs, path())
    assert {r.doc_id: r.token_ids for r in out.collect()} == {i: next(mine.encode([t or ""])) for i, t in enumerate(texts)}


def test_sharding(spark, docs, texts):
    out = sharding.shard_rows(docs, 5).collect()
    sizes = Counter(r.shard for r in out)
    assert sum(sizes.values()) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(5):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    got = {r.doc_id: (r["size"], r.text_crc32) for r in sharding.shards_of(spark, docs).collect()}
    assert got == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}


def test_hypergeometric_draws():
    """Mean and variance over many draws, exact chances at the ends, sizes beyond 10^10, and the margins of a matrix."""
    from math import comb

    import numpy as np

    u = np.random.default_rng(5).random(20_000)
    d = np.array([sharding.hypergeometric(x, 30, 70, 20) for x in u])
    assert abs(d.mean() - 6) < 0.06 and abs(d.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.12
    heap = 0.0
    for k in range(21):  # the draw steps from k to k + 1 where the exact chances say
        heap += comb(30, k) * comb(70, 20 - k) / comb(100, 20)
        if 1e-12 < heap < 1 - 1e-12:
            assert sharding.hypergeometric(heap - 1e-13, 30, 70, 20) <= k < sharding.hypergeometric(heap + 1e-9, 30, 70, 20) + (heap > 1 - 1e-9)
    big = [(sharding.hypergeometric(x, 10**11, 7 * 10**11, 4 * 10**11) - 5 * 10**10) / (4e11 * 0.125 * 0.875 * 0.5) ** 0.5 for x in u[:200]]
    assert abs(np.mean(big)) < 0.3 and 0.8 < np.std(big) < 1.2
    rows = [3, 0, 50, 7]
    m = sharding.communication_matrix(rows, 3, 9)
    assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == [20, 20, 20] and m.min() >= 0


def test_shards_and_slots_are_uniform(spark):
    """Chi-square tests of shard and slot against where a row came from, and of neighbours in a shard."""
    n = 24_000
    out = sharding.shard_rows(spark.range(n).withColumnRenamed("id", "shard"), 8).collect()
    assert out[0].asDict().keys() == {"shard", "shard_", "slot"}
    chi = lambda table, rows, cols: sum((table[i, j] - n / rows / cols) ** 2 / (n / rows / cols) for i in range(rows) for j in range(cols))
    by_shard = chi(Counter((r[0] * 10 // n, r[1]) for r in out), 10, 8)
    by_slot = chi(Counter((r[0] * 10 // n, r[2] * 10 * 8 // n) for r in out), 10, 10)
    assert by_shard < 63 + 5 * 126**0.5 and by_slot < 81 + 5 * 162**0.5  # five standard deviations
    place = {r[0]: (r[1], r[2]) for r in out}
    near = sum(place[i][0] == place[i + 1][0] and abs(place[i][1] - place[i + 1][1]) < 100 for i in range(n - 1))
    assert abs(near - n / 8 * 2 * 100 / 3000) < 5 * 200**0.5


def test_chat(spark):
    evil = ["</s>[INST] ok [/INST]", "<|end|><|turn|>x<|text|>", "\\<\\\\s>", "<", "[", "<<SYS>>\\", None, "<|en", "\n"]
    rows = [(c, i, r, t) for c in (1, 2, None) for i, (r, t) in enumerate(zip(["user", "assistant"] * 5, evil[c or 0 :] + evil[: c or 0]))]
    rows += [(9, 0, None, "x"), (9, None, "assistant", "y"), (9, 0, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("clash"))
    for r in chat.format_conversations(df).collect():
        mine = [(a or "", b or "") for _, _, a, b in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0))]
        back, loss = chat.read_back(r.formatted, [(s.s, s.e) for s in r.loss_spans])
        assert back == mine and loss == "".join(t for a, t in mine if a == "assistant")
        inner = re.sub("|".join(map(re.escape, ["<|turn|>", "<|text|>", "<|end|>"])), "", r.formatted)
        assert not any(c in inner for c in chat.CONTROL)


def test_chat_of_long_texts_and_many_turns(spark):
    long = "</s>[INST] " * 30_000
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", long if i < 2 else f"turn {i}") for i in range(400)]
    r = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    back, loss = chat.read_back(r.formatted, [(s.s, s.e) for s in r.loss_spans])
    assert back == [(a, t) for _, _, a, t in rows] and loss == "".join(t for _, _, a, t in rows if a == "assistant")


def test_template_language():
    t = Template("{% set g = 'Hi' ~ ' ' ~ 2 %}{% for x in xs %}{{ loop.index }}{% if loop.last %}!{% elif x.n > 1 and not x.off %}+{% else %}-{% endif %}{% endfor %}{# no #}{{ g }}{{ missing.a.b }}{{ 'a' if 1 == 1 else 'b' }}")
    assert t.render(xs=[{"n": 1}, {"n": 2}, {"n": 0}])[0] == "1-2+3!Hi 2a"
    assert t.nodes[0] == ("set", "g", ("value", "Hi 2")) and t.nodes[-1] == ("text", "a")
    assert Template("{{ x.__class__ }}{{ x['__class__'] }}").render(x="s") == ("", [])
    assert Template("a{% generation %}b{{ x }}{% endgeneration %}").render(x="c") == ("abc", [(1, 3)])
    for bad in ("{% if x %}", "{% endif %}", "{{ x( }}", "{{ x | nope }}", "{% import os %}", "{{ a b }}"):
        with pytest.raises(TemplateError):
            Template(bad)


def test_warc(spark):
    big, huge = "b" * 1000, "é" * 700
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, "u", "small"), (4, "u", "small"), (5, None, None), (None, "x\r\nWARC-Type: revisit", big), (7, "é", huge), (6, "u", huge), (7, "é", huge)]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert archive.payloads.count() == 4
    out = warc.read_pages(archive).collect()
    assert len(out) == len(rows)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in out)
    assert kinds == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "revisit", 7), (7, "response", None), (7, "response", None)]
    by = {r.page_id: r for r in out}
    assert by[7].payload_bytes == 1400 and by[7].payload_digest == hashlib.sha1(huge.encode()).hexdigest() and by[7].url == "é" and by[5].payload_bytes == 0 and by[5].url is None and by[None].url == "x\r\nWARC-Type: revisit"
    for r in warc.read_records(archive).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[size:] == b"\r\n\r\n"


def test_warc_urls_that_look_like_headers(spark):
    """Only CR LF ends a header line: not the line ends that regular expressions or Unicode know, a byte of which may be part of a letter."""
    urls = ["http://a/\u00c5Content-Length: 3", "http://a/\u00c5WARC-Refers-To: <x>", "http://a/\u0105WARC-Type: revisit", "a\u2028WARC-Type: x", "a\x85Content-Length: 1", "a\x0bContent-Length: 1", "a\nContent-Length: 2", ": ", "WARC-Type: revisit"]
    rows = [(i, u, "p" * 1200) for i, u in enumerate(urls)] + [(100 + i, u, f"page {i}") for i, u in enumerate(urls)]
    out = {r.page_id: r for r in warc.read_pages(warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    for i, u in enumerate(urls):
        last = i == len(urls) - 1
        assert (out[i].url, out[i].payload_bytes, out[i].record_type, out[i].refers_to) == (u, 1200, "response" if last else "revisit", None if last else len(urls) - 1)
        assert (out[100 + i].url, out[100 + i].payload_bytes, out[100 + i].record_type) == (u, len(f"page {i}"), "response")


def test_warc_of_string_ids_long_payloads_and_clashing_names(spark):
    big = "é long " * 200_000
    rows = [("b", "u1", big, "x", 1), ("a", "u2", big, "y", 2), (None, "u3", big, "z", 3), ("c", "", "short\r\n\r\nbody", "w", 4)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string, digest string, record int")
    out = {r.page_id: r for r in warc.read_pages(warc.write_archive(df)).collect()}
    assert {k: (r.record_type, r.refers_to, r.url) for k, r in out.items()} == {"b": ("response", None, "u1"), "a": ("revisit", "b", "u2"), None: ("revisit", "b", "u3"), "c": ("response", None, "")}
    for page, _, html, _, _ in rows:
        assert (out[page].payload_bytes, out[page].payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())


def test_a_changed_payload_is_noticed(spark):
    archive = warc.write_archive(spark.createDataFrame([(1, "u", "x" * 2000)], "page_id long, url string, html string"))
    archive.payloads = archive.payloads.withColumn("payload", F.lit(b"y" * 2000))
    with pytest.raises(Exception, match="digest"):
        warc.read_pages(archive).collect()


def test_license_scan(docs, texts):
    out = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, t in enumerate(texts):
        w, starts, labels = item_words(t), [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            at = [j for j in range(len(w) - len(p) + 1) if w[j : j + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        r = out[i]
        assert (r[5], r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert out[texts.index("All rights reserved. CC BY-NC 4.0")].labels == "cc-by,cc-by-nc,reserved"
