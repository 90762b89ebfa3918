"""Benchmark decontamination: a prefix-filtered join of item windows with documents, all in DataFrame functions.

An item's windows are its runs of `size` words (the whole item if it is shorter). A window is there only if all its
shingles are, so its prefix is one shingle: the rarest in the corpus. A first pass counts the benchmark's shingles in all
documents (one aggregation with map-side combining), which settles their order; a second one joins documents' shingles
with the prefixes alone. The place of the shingle in the window bounds where the window may begin, the lengths bound where
it may end, and then the words themselves are compared. Windows go by 128 bits until then, items join at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, materialise, plain, small

#: Words in a shingle; windows of fewer words are shingles themselves.
SHINGLE = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def shingles(words: Column, n: int) -> Column:
    at = F.sequence(F.lit(1), F.size(words) - F.lit(n - 1))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.xxhash64(F.lit(n), *[F.element_at(words, i + j) for j in range(n)]))).otherwise(F.array().cast("array<long>"))


IDS, KEYS = ["id1", "id2"], ["k1", "k2"]


def item_windows(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """id1, id2 (of the window's words), item (its id as string), win (words): a row for each window of each item."""
    w = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), item_words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(size - 1))))
    wins = w.select("item", "w", start.alias("s")).select("item", F.slice("w", F.col("s"), F.lit(size)).alias("win"))
    return wins.select(F.xxhash64("win").alias("id1"), F.xxhash64(F.lit(0x5DEECE66D), "win").alias("id2"), "item", "win")


def window_tokens(win: Column) -> Column:
    """The window's shingles, from left to right."""
    tokens = F.when(F.size(win) >= SHINGLE, shingles(win, SHINGLE))
    for n in range(1, SHINGLE):
        tokens = tokens.when(F.size(win) == n, shingles(win, n))
    return tokens


def doc_tokens(words: Column, sizes: list[int]) -> Column:
    """Each shingle of a document with its place (from 0)."""
    parts = [F.transform(shingles(words, n), lambda h, i: F.struct(h.alias("h"), i.alias("p"))) for n in sizes]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def prefixes(docs: DataFrame, wins: DataFrame, sizes: list[int]) -> DataFrame:
    """h, o, id1, id2, length: each window's rarest shingle in the documents (of equals the leftmost) and its place; windows with a shingle that is nowhere have none.

    docs: w (words); wins: id1, id2, win.
    """
    tokens = wins.select(*IDS, F.size("win").alias("length"), F.posexplode(window_tokens(F.col("win"))).alias("o", "h"))
    asked = materialise(tokens.select(F.col("h").alias("asked")).distinct(), "asked-shingles")
    seen = docs.select(F.explode(F.concat(*[shingles(F.col("w"), n) for n in sizes])).alias("h"))
    counts = seen.join(small(asked, asked.count(), 16), F.col("h") == F.col("asked")).groupBy("h").agg(F.count("*").alias("times"))
    counts = materialise(counts, "shingle-counts")
    best = tokens.join(counts, "h", "left").groupBy(*IDS, "length").agg(F.min(F.struct("times", "o", "h")).alias("rare"), F.count_if(F.col("times").isNull()).alias("nowhere"))
    return materialise(best.filter("nowhere = 0").select(F.col("rare.h").alias("rare"), F.col("rare.o").alias("o"), *IDS, "length"), "prefixes", asked, counts)


def occurrences(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """k1, k2, start, length, id1, id2: every place of a window in the texts. docs: k1, k2 (of the text), text; wins: id1, id2, win."""
    sizes = sorted(r[0] for r in wins.select(F.least(F.size("win"), F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]  # SHINGLE different ones at most
    worded = docs.select(*KEYS, item_words(F.col("text")).alias("w"))
    prefix = prefixes(worded, wins, sizes)
    tokens = worded.select(*KEYS, F.size("w").alias("n"), F.explode(doc_tokens(F.col("w"), sizes)).alias("d")).select(*KEYS, "n", F.col("d.p").alias("p"), F.col("d.h").alias("h"))
    hits = tokens.join(small(prefix, prefix.count(), 64), F.col("h") == F.col("rare")).withColumn("start", F.col("p") - F.col("o")).filter("start >= 0 AND start + length <= n")
    hits = materialise(hits.select(*KEYS, "start", "length", *IDS).distinct(), "hits")  # copies of a text meet on the map side
    # the words themselves: each text once, each candidate with its own stretch of it
    some = materialise(hits.select(*KEYS).distinct(), "texts-with-hits")
    mine = docs.join(small(some, some.count(), 32), KEYS).groupBy(*KEYS).agg(F.first("text").alias("text"))
    at = hits.groupBy(*KEYS).agg(F.collect_list(F.struct("start", "length", *IDS)).alias("at"))
    cut = F.transform("at", lambda c: F.struct(c["start"].alias("start"), c["length"].alias("length"), c["id1"].alias("id1"), c["id2"].alias("id2"), F.slice(F.col("w"), c["start"] + 1, c["length"]).alias("words")))
    stretches = mine.join(at, KEYS).select(*KEYS, item_words(F.col("text")).alias("w"), "at").select(*KEYS, F.explode(cut).alias("x")).select(*KEYS, "x.*")
    return stretches.join(wins, IDS).filter("words = win").select(*KEYS, "start", "length", *IDS)


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """df with n_words, n_hit, n_items, items (sorted ids as strings) and contaminated, under names that df doesn't have.

    A document word is hit if it is in any occurrence of an item's window; contaminated: n_hit > 0. Null and empty texts
    have no words and are clean; items without words have no windows; a null item id counts as ''; copies of a text share
    their candidates and get the same values; an empty benchmark leaves all clean; an empty table gives an empty one.
    """
    named = [*df.columns, *fresh(df, "n_words", "n_hit", "n_items", "items", "contaminated")]
    df, at = plain(df)
    t = F.coalesce(F.col(at[text]), F.lit(""))
    keyed = df.withColumns({"k1": F.xxhash64(t), "k2": F.xxhash64(F.lit(0x5DEECE66D), t)})
    owned = item_windows(benchmark, item_id, item_text, size)
    wins = materialise(owned.groupBy(*IDS).agg(F.first("win").alias("win")), "windows")
    owners = materialise(owned.select(*IDS, "item").distinct(), "window-owners")
    there = materialise(occurrences(keyed.select(*KEYS, t.alias("text")), wins), "occurrences")
    places = there.groupBy(*KEYS).agg(F.sort_array(F.collect_set(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("length")).alias("e")))).alias("places"))
    hit = F.aggregate(
        F.col("places"),
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["sum"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["end"], x["s"]))).alias("sum"), F.greatest(acc["end"], x["e"]).alias("end")),
        lambda acc: acc["sum"],
    )
    items = there.select(*KEYS, *IDS).distinct().join(owners, IDS).groupBy(*KEYS).agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = materialise(places.select(*KEYS, hit.alias("n_hit")).join(items, KEYS), "contaminated", there, owners, wins)
    many, ids = found.agg(F.count("*"), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    found = small(found.withColumnsRenamed({"k1": "of1", "k2": "of2"}), 1, 64 * many + 64 * ids)
    worded = keyed.withColumn("n_words", F.size(item_words(t)).cast("long"))
    out = worded.join(found, (F.col("k1") == F.col("of1")) & (F.col("k2") == F.col("of2")), "left")
    none = F.array().cast("array<string>")
    out = out.select(*df.columns, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
    return out.select(*df.columns, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated")).toDF(*named)
