"""Quality rules with risk-controlled thresholds, all in DataFrame functions.

A rule rejects a text whose measure exceeds a cutoff; a stratum's rule set has one cutoff for each measure. The texts
without a label give each stratum's candidate rule sets, quantiles from loose to tight; the labelled good ones, all of
them the holdout, test them in that order. A rule set is safe if so few good texts break any of its rules that, were the
true rate of false rejections above `risk`, so few would have a chance of at most `delta` / number of strata (the exact
binomial bound of Clopper and Pearson, corrected over strata after Bonferroni). Testing in an order that was fixed before,
up to the first set that isn't safe, needs no correction over candidates. Of the safe sets the tightest is taken. A text counts
once in the test, however many copies of it are labelled, and no text is on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, plain, small

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Measures with a learnt cutoff; a text is rejected if one exceeds it.
RATES = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_length", "capital_rate", "mark_rate")
#: Candidate rule sets from loose to tight: the share of the stratum's unlabelled texts up to each cutoff.
CANDIDATES = (1.0, 0.999, 0.998, 0.995, 0.99, 0.985, 0.98, 0.97, 0.96, 0.95, 0.93, 0.9, 0.85, 0.8)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def windows(words: Column, n: int) -> Column:
    """A hash of each n words in a row."""
    at = F.sequence(F.lit(1), F.size(words) - F.lit(n - 1))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(n)]))).otherwise(F.array().cast("array<long>"))


def twins(hashes: Column) -> Column:
    """The hashes with their places, sorted; empty if all differ. It must become a column before covered() reads it."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def covered(pairs: Column, n: int) -> Column:
    """Places under windows whose hash is there twice; equal hashes are neighbours in pairs, and the gaps between their sorted places add up."""
    same = lambda p, j: (F.get(pairs, j - 1)["h"] == p["h"]) | (F.get(pairs, j + 1)["h"] == p["h"])
    flagged = F.transform(F.filter(pairs, same), lambda p: p["i"])
    return F.aggregate(
        F.array_sort(flagged),
        F.struct(F.lit(0).alias("sum"), F.lit(-n).alias("last")),
        lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(n), i - acc["last"])).alias("sum"), i.alias("last")),
        lambda acc: acc["sum"],
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a struct column `measured`: MEASURES, n_capitals, n_marks, n_lines; all longs. A null text counts as empty."""
    raw, words, lines, hashes, pairs = fresh(df, "raw_text", "its_words", "its_lines", "its_windows", "its_pairs")
    t, w, x = F.col(raw), F.col(words), F.col(lines)
    without = lambda chars: F.length(F.translate(t, chars, ""))
    fields = {
        "n_words": F.size(w),
        "word_chars": without(" " + SPACES),
        "n_symbols": F.length(t) - without(SYMBOLS),
        "n_dup_lines": F.size(x) - F.size(F.array_distinct(x)),
        "n_repeat_words": covered(F.col(pairs), 5),
        "n_capitals": F.length(t) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_marks": F.length(t) - without("!?"),
        "n_lines": F.size(x),
    }
    step = df.withColumn(raw, F.coalesce(F.col(text), F.lit("")))
    step = step.withColumns({words: words_of(t), lines: F.filter(F.split(t, "\n"), lambda s: F.length(F.translate(s, " " + SPACES, "")) > 0)})
    step = step.withColumn(hashes, windows(w, 5))
    step = step.withColumn(pairs, twins(F.col(hashes)))
    return step.select(*df.columns, F.struct(*[v.cast("long").alias(k) for k, v in fields.items()]).alias("measured"))


def rates(m: Column) -> Column:
    share = lambda a, b: F.coalesce(F.try_divide(m[a], m[b]), F.lit(0.0))
    return F.struct(
        share("n_symbols", "n_words").alias("symbol_rate"),
        share("n_dup_lines", "n_lines").alias("dup_line_rate"),
        share("n_repeat_words", "n_words").alias("repeat_rate"),
        share("word_chars", "n_words").alias("word_length"),
        share("n_capitals", "word_chars").alias("capital_rate"),
        share("n_marks", "n_words").alias("mark_rate"),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def at_most(k: Column, n: Column, p: float) -> Column:
    """The chance of k or fewer in n trials with chance p, summed term by term from the exact first one."""
    first = n * F.log1p(F.lit(-p))
    odds = F.log(F.lit(p / (1 - p)))
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        F.struct(first.alias("log"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct((acc["log"] + F.log((n - i).cast("double") / (i + 1)) + odds).alias("log"), (acc["sum"] + F.exp(acc["log"])).alias("sum")),
        lambda acc: acc["sum"],
    )
    # beyond the mean the chance is near a half or more, and no test asks how near
    return F.when((n == 0) | (k >= n) | (k > p * n + 1), F.lit(1.0)).otherwise(total)


def safe_cutoffs(scored: DataFrame, drawn: DataFrame, risk: float, delta: float) -> DataFrame:
    """scored (labelled rows): stratum, good (boolean), k1, rates; drawn (rows of texts without a label): stratum, rates ->
    stratum, candidate, cutoffs (by measure), n, rejected, chance: the tightest safe rule set of each stratum that has one.

    Quantiles are merged sketches (exact below 10,000 texts; the test doesn't depend on them), counts one aggregation with
    map-side combining; nothing is gathered and no row is collected.
    """
    texts = scored.groupBy("stratum", "k1").agg(F.min("good").alias("low"), F.first("rates").alias("rates"))
    held = texts.filter("low").select("stratum", "rates")
    grid = drawn.groupBy("stratum").agg(*[F.percentile_approx(F.col("rates")[r], F.lit(list(CANDIDATES)), F.lit(10_000)).alias(r) for r in RATES])
    sets = [F.struct(F.lit(i).alias("candidate"), F.struct(*[F.col(r)[i].alias(r) for r in RATES]).alias("cutoffs")) for i in range(len(CANDIDATES))]
    grid = materialise(grid.select("stratum", F.array(*sets).alias("sets")), "candidates")
    strata = grid.count()
    held = held.join(small(grid, strata, 2048), "stratum").select("stratum", "rates", F.explode("sets").alias("x")).select("stratum", "rates", "x.*")
    breaks = F.greatest(*[(F.col("rates")[r] > F.col("cutoffs")[r]).cast("long") for r in RATES])
    counts = held.groupBy("stratum", "candidate").agg(F.first("cutoffs").alias("cutoffs"), F.count("*").alias("n"), F.sum(breaks).alias("rejected"))
    tested = counts.withColumn("chance", at_most(F.col("rejected"), F.col("n"), risk))
    failed = F.coalesce(F.min(F.when(F.col("chance") > F.lit(delta / max(1, strata)), F.col("candidate"))).over(Window.partitionBy("stratum")), F.lit(len(CANDIDATES)))
    safe = tested.withColumn("failed", failed).filter("candidate < failed")  # the candidates of a stratum are few
    return safe.groupBy("stratum").agg(F.max(F.struct("candidate", "cutoffs", "n", "rejected", "chance")).alias("x")).select("stratum", "x.*")


def judge(df: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", id_col: str = "doc_id", risk: float = 0.02, delta: float = 0.05, drop_text: bool = False) -> DataFrame:
    """df with, under names that it doesn't have, `measured`, `rates`, `base_failed`, `failed` (names of the measures beyond their cutoff) and `kept`.

    labels: id_col and quality (1: good). With chance 1 - delta at least, in every stratum the rules together reject at
    most a share `risk` of the different good texts that pass the base. A stratum with too few labelled good texts to show that,
    or with no other texts to take cutoffs from, has no rules, so its texts are kept if they pass the base. Labels that contradict each other (of a row or of copies of
    a text) or are null don't count; null strata form one stratum; null texts have no words and fail the base; repeated
    rows are judged alike; empty tables give empty results.
    """
    named = [*(c for c in df.columns if not (drop_text and c == text)), *fresh(df, "measured", "rates", "base_failed", "failed", "kept")]
    df, at = plain(df)
    text, stratum, id_col, label_id = at[text], at[stratum], at[id_col], id_col
    seen = df.withColumn("k1", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = materialise(measure(seen, text).withColumn("rates", rates(F.col("measured"))).drop(*[text] * drop_text), "measured")
    one = labels.filter("quality is not null").groupBy(F.col(label_id).alias("labelled")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    name = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    passing = rows.filter(~base_failed(F.col("measured")))
    scored = passing.join(one, F.col(id_col) == F.col("labelled")).select(name.alias("stratum"), (F.col("low") == 1).alias("good"), F.col("low").eqNullSafe(F.col("high")).alias("clear"), "k1", "rates")
    scored = materialise(scored, "labelled")
    known = scored.select("k1").distinct()
    drawn = passing.select(name.alias("stratum"), "k1", "rates").join(small(known, scored.count(), 16), "k1", "left_anti")
    rules = materialise(safe_cutoffs(scored.filter("clear"), drawn, risk, delta).select(F.col("stratum").alias("of"), "cutoffs"), "rules", scored)
    strata = rules.count()
    judged = rows.join(small(rules, strata, 1024), name == F.col("of"), "left")
    broken = F.array_compact(F.array(*[F.when(F.col("rates")[r] > F.col("cutoffs")[r], F.lit(r)) for r in RATES]))
    judged = judged.withColumns({"base_failed": base_failed(F.col("measured")), "failed": F.array_sort(broken)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("of", "cutoffs", "k1").toDF(*named)


def quality_filter(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of df that judge() keeps, with df's columns."""
    judged = judge(df, labels, **options)
    return judged.filter(F.col(judged.columns[-1])).select(*df.columns)
