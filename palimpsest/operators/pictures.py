"""Pictures of a page and the texts around them: places, captions, phrases, colour histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compare as C
from .alignment import letters, letters_overlap
from .scans import settled

# Reaches below and above a picture, floors and weights.
BELOW, ABOVE, SIDE, EDGE = 0.20, 0.35, 0.10, 0.02
NEAR, LABELLED = 0.35, 0.28
ENDS = "[，。；！？,.;!?]"


def _middle(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def _across(image: Column, text: Column) -> Column:
    """How much of the picture's width the text covers; negative apart."""
    return (F.least(image["x1"], text["x1"]) - F.greatest(image["x0"], text["x0"])) / F.greatest(F.lit(1e-6), image["x1"] - image["x0"])


def _beside(image: Column, text: Column, reach: float) -> Column:
    return (F.abs(_middle(text) - _middle(image)) < reach) & ((text["x0"] >= image["x1"] - EDGE) | (text["x1"] <= image["x0"] + EDGE))


def proximity(image: Column, text: Column) -> Column:
    """How near a text (y0, y1, x0, x1) is to a picture: below, above (a little better), at its side, or weakly anywhere on the page."""
    share, gap = _across(image, text), F.abs(_middle(text) - _middle(image))
    below = (text["y0"] >= image["y1"] - EDGE) & (text["y0"] <= image["y1"] + BELOW)
    above = (text["y1"] <= image["y0"] + EDGE) & (text["y1"] >= image["y0"] - ABOVE)
    far = F.when(below, F.abs(text["y0"] - image["y1"]) / BELOW).otherwise(F.abs(text["y1"] - image["y0"]) / ABOVE)
    close = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), far) + F.when(above, 0.08).otherwise(0.0)) + 0.25 * F.greatest(F.lit(0.0), share)
    weak = F.greatest(F.lit(0.0), 0.28 * (1 - F.least(F.lit(1.0), gap / 0.7))) * F.greatest(F.lit(0.2), share + 0.3)
    return F.when(below | above, F.when(share < 0.12, 0.05).otherwise(close)).when(_beside(image, text, SIDE), 0.55).when((share < 0.05) & (gap > 0.45), 0.0).otherwise(weak)


def phrase_score(phrase: Column, label: Column) -> Column:
    """How well a phrase fits a label: ratio, shared characters, and how many of the label's it has."""
    return score_of_parts(phrase_parts(phrase), phrase_parts(label))


def phrase_parts(c: Column) -> Column:
    """What phrase_score needs of a phrase or a label, made once before they meet: whether it is empty, its normal form, its different letters and those of its key."""
    key = F.array_distinct(F.filter(F.split(C.hanzi_key(c), ""), lambda x: x != ""))
    return F.struct((F.coalesce(c, F.lit("")) == "").alias("empty"), C.page_norm(c).alias("norm"), letters(C.page_norm(c)).alias("letters"), key.alias("key"))


def score_of_parts(phrase: Column, label: Column) -> Column:
    """phrase_score of two phrase_parts."""
    held = F.coalesce(F.try_divide(F.size(F.array_intersect(phrase["key"], label["key"])), F.size(label["key"])), F.lit(0.0))
    return F.when(phrase["empty"] | label["empty"], F.lit(0.0)).otherwise(0.35 * C.fuzz_of_norms(phrase["norm"], label["norm"]) + 0.35 * letters_overlap(phrase["letters"], label["letters"]) + 0.30 * held)


def theme_name(text: Column, most: int = 18) -> Column:
    """The text up to its first mark, without blanks and pinyin."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), rf"\([{C.PINYIN}]+\)", ""), r"\s+", "")
    return F.substring(F.get(F.split(bare, ENDS), F.lit(0)), 1, most)


def _paired(images: DataFrame, texts: DataFrame, page: str, *more: str) -> DataFrame:
    """Pictures and texts of the same page. images: page, image, y0, y1, x0, x1 and more; texts: page, id, y0, y1, x0, x1 and text, kind or `more`."""
    box = F.struct("y0", "y1", "x0", "x1")
    i = images.withColumn("i", box).drop("y0", "y1", "x0", "x1")
    t = texts.select(page, F.col("id").alias("t_id"), box.alias("t"), *(more or ("text", "kind")))
    return i.join(t, page)


def _first(pairs: DataFrame, page: str, score: Column, least: float | None = None) -> DataFrame:
    scored = settled(pairs, score=score)
    scored = scored if least is None else scored.filter(F.col("score") >= least)
    best = Window.partitionBy(page, "image").orderBy(F.desc("score"), "t_id")
    return scored.withColumn("k", F.row_number().over(best)).filter("k = 1")


def nearest_texts(images: DataFrame, texts: DataFrame, page: str) -> DataFrame:
    """page, image, text: the nearest text of at most 200 characters, if it is near at all."""
    p = _paired(images, texts, page).filter(F.length("text").between(1, 200))
    return _first(p, page, proximity(F.col("i"), F.col("t")), NEAR).select(page, "image", "text")


def captions(images: DataFrame, texts: DataFrame, page: str) -> DataFrame:
    """page, image, text: the caption below a picture or at its side; a text that isn't of kind caption must be short and no sentence."""
    p = _paired(images, texts, page).filter(F.coalesce(F.length("text"), F.lit(0)) > 0)
    i, t, named = F.col("i"), F.col("t"), F.col("kind") == "caption"
    share = _across(i, t)
    below = (t["y0"] >= i["y1"] - EDGE) & (t["y0"] <= i["y1"] + 0.10)
    ok = named | ((F.length("text") <= 20) & ~F.col("text").rlike("[。！？]"))
    p = p.filter(ok & (below | _beside(i, t, 0.08)) & ~(below & (share < 0.2) & ~named))
    far = F.when(below, F.abs(t["y0"] - i["y1"])).otherwise(0.05)
    score = 1 - F.least(F.lit(1.0), far / 0.12) + 0.3 * F.greatest(F.lit(0.0), share) + F.when(named, 0.5).otherwise(0.0)
    return _first(p, page, score).select(page, "image", "text")


def matched_phrases(images: DataFrame, texts: DataFrame, page: str) -> DataFrame:
    """page, image, phrase, theme, score: the sentence of the page that fits a picture's label and place best. images have label (null: only the place counts)."""
    parts = F.filter(F.transform(F.split("text", "[。！？；\n]"), lambda x: F.regexp_replace(x, r"\s+", "")), lambda x: F.length(x).between(4, 120))
    # sentences and labels are cut and read once, before pictures and texts meet
    t = texts.withColumn("phrase", F.explode(F.array_distinct(parts)))
    many = F.size(F.array_distinct(F.split(C.hanzi_key(F.col("phrase")), "")))
    t = settled(t, read=F.struct(many.alias("letters"), phrase_parts(F.col("phrase")).alias("parts")))
    i = settled(images, label_parts=phrase_parts(F.coalesce("label", F.lit(""))))
    p = _paired(i, t, page, "phrase", "read")
    label = F.coalesce(F.col("label"), F.lit(""))
    place = proximity(F.col("i"), F.col("t"))
    score = F.when(label != "", 0.62 * score_of_parts(F.col("read.parts"), F.col("label_parts")) + 0.38 * place).otherwise(0.85 * place + 0.15 * F.least(F.lit(1.0), F.col("read.letters") / 12))
    best = _first(p, page, score).filter(F.col("score") >= F.when(label != "", LABELLED).otherwise(NEAR))
    return best.select(page, "image", "phrase", theme_name(F.coalesce(F.nullif(label, F.lit("")), F.col("phrase")), 20).alias("theme"), F.round("score", 3).alias("score"))


def histogram_similarity(a: Column, b: Column) -> Column:
    """Correlation of two colour histograms (arrays of counts), from 0 to 1; 0 if one is missing."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    off = lambda x: F.transform(x, lambda v: v - mean(x))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    x, y = off(a.cast("array<double>")), off(b.cast("array<double>"))
    flat = F.sqrt(dot(x, x) * dot(y, y))
    corr = F.when(flat > 0, dot(x, y) / flat).otherwise(1.0)
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (corr + 1) / 2)))


def picture_rows(layout: DataFrame, named: DataFrame, visuals: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs of pictures with their captions and visual grades, where there are any."""
    return layout.join(named, keys, "left").join(visuals, keys, "left")
