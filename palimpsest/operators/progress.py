"""Roll-ups of how far volumes and lessons have come, and checks of their matches.

Nulls in a key form a group of their own where rows are counted and meet nothing in joins; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Verdicts that count as no change, the one that asks for attention, and limits of the rules.
SAME_TEXT = ("一致", "仅标点差异", "没变化")
SAME_PICTURE = ("一致", "没变化")
SAME_PAGE = ("基本一致", "一致", "仅标点差异", "没变化")
ATTENTION = "音标变动注意"
LISTED_PAGES = 20
LEAST_GAP = 0.10


def _said(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def text_changed(verdict: Column) -> Column:
    v = _said(verdict)
    marks_only = v.contains("标点") & ~v.contains("文字") & ~v.contains("音标")
    return (v != "") & ~v.isin(*SAME_TEXT) & ~marks_only


def picture_changed(verdict: Column, changed: Column) -> Column:
    v = F.coalesce(verdict, F.lit(""))
    return (~v.isin(*SAME_PICTURE) & v.contains("差异")) | (F.coalesce(changed, F.lit(0)) > 0)


def page_changes(lessons: DataFrame, compares: DataFrame, keys: list[str], volume: str, start: str, end: str, page: str, text: str, blocks: str, picture: str, changed: str) -> DataFrame:
    """keys with pages_total, pages_compared, pages_changed, changed_blocks, attention_pages, changed_pages (the first 20).

    Lessons become one row per page of their range, so that they meet the compares (one per volume and page) by equality.
    A null verdict means that side was not compared; a null end is the start; no start, or an end before it, is no page.
    """
    last = F.coalesce(end, start)
    spans = lessons.select(*keys, volume, F.explode_outer(F.when((F.col(start) > 0) & (last >= F.col(start)), F.sequence(start, last))).alias(page))
    t, p = F.col(text), F.col(picture)
    seen = t.isNotNull() | p.isNotNull()
    differs = (t.isNotNull() & text_changed(t)) | (p.isNotNull() & picture_changed(p, F.col(changed)))
    rows = spans.join(compares.select(volume, page, text, blocks, picture, changed), [volume, page], "left")
    out = rows.groupBy(*keys).agg(
        F.count(page).alias("pages_total"),
        F.count_if(seen).alias("pages_compared"),
        F.count_if(differs).alias("pages_changed"),
        F.coalesce(F.sum(F.when(t.isNotNull(), F.greatest(F.lit(0), F.coalesce(blocks, F.lit(0))))), F.lit(0)).cast("long").alias("changed_blocks"),
        F.count_if(_said(t) == ATTENTION).alias("attention_pages"),
        F.array_sort(F.collect_list(F.when(differs, F.col(page)))).alias("all"),
    )
    return out.withColumn("changed_pages", F.slice("all", 1, LISTED_PAGES)).drop("all")


def chapter_overview(df: DataFrame, label: str, printed: str, page: str, change: str) -> DataFrame:
    """label, page_count, changed_pages, by_change (change and n, sorted): pages without a label go by their printed number, else their own."""
    name = F.coalesce(F.nullif(F.trim(label), F.lit("")), F.concat(F.lit("印刷页 "), F.col(printed).cast("string")), F.concat(F.lit("修订 p"), F.col(page).cast("string")))
    said = F.coalesce(F.nullif(F.col(change), F.lit("")), F.lit("未知"))
    n = df.groupBy(name.alias("label"), said.alias("change")).agg(F.count("*").alias("n"))
    return n.groupBy("label").agg(
        F.sum("n").alias("page_count"), F.sum(F.when(~F.col("change").isin(*SAME_PAGE), F.col("n")).otherwise(0)).alias("changed_pages"), F.array_sort(F.collect_list(F.struct("change", "n"))).alias("by_change")
    )


def recognition_status(pages: DataFrame, atoms: DataFrame, lesson: str, page: str, recognised: str, pictured: str, kind: str) -> DataFrame:
    """lesson with pages_total, pages_done, text_pages, image_pages, atom_count, pages_with_atoms, text_complete, image_complete.

    pages: one row each, whether recognised, and whether the recognised page has a picture. A lesson whose text is
    complete and which shows no picture needs none; a null or empty kind is text.
    """
    k = F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit("text"))
    found = atoms.groupBy(lesson, page).agg(F.bool_or(k.isin("text", "title")).alias("has_text"), F.bool_or(k == "image").alias("has_image"), F.count("*").alias("n"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    done = yes(F.col(recognised))
    s = pages.join(found, [lesson, page], "left").groupBy(lesson).agg(
        F.count("*").alias("pages_total"),
        F.count_if(done).alias("pages_done"),
        F.count_if(yes(F.col("has_text")) | done).alias("text_pages"),
        F.count_if(yes(F.col("has_image"))).alias("image_pages"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("atom_count"),
        F.count("n").alias("pages_with_atoms"),
        F.bool_or(yes(F.col("has_image")) | (done & yes(F.col(pictured)))).alias("pictures"),
    )
    s = s.withColumn("text_complete", F.col("text_pages") >= F.col("pages_total"))
    complete = (F.col("pages_done") >= F.col("pages_total")) | (F.col("text_complete") & (~F.col("pictures") | (F.col("image_pages") >= F.col("pages_total"))))
    return s.withColumn("image_complete", complete).drop("pictures")


def readiness(volumes: DataFrame, lessons: DataFrame, volume: str, start: str, end: str) -> DataFrame:
    """volumes with lesson_count, catalog_ok (it has a lesson), parse_ok (and all have both pages)."""
    n = lessons.groupBy(volume).agg(F.count("*").alias("n"), F.count_if(F.col(start).isNotNull() & F.col(end).isNotNull()).alias("parsed"))
    out = volumes.join(n, volume, "left").withColumn("lesson_count", F.coalesce("n", F.lit(0)))
    return out.withColumns({"catalog_ok": F.col("lesson_count") > 0, "parse_ok": F.coalesce(F.col("parsed") == F.col("n"), F.lit(False))}).drop("n", "parsed")


def edition_grid(editions: DataFrame, volumes: DataFrame, edition: str, grade: str, term: str, grades: list, terms: list) -> DataFrame:
    """Every edition with every grade and term, and of its volumes there: in_db and lesson_count (a column of volumes, summed)."""
    grid = editions.select(edition, F.explode(F.array(*map(F.lit, grades))).alias(grade)).select("*", F.explode(F.array(*map(F.lit, terms))).alias(term))
    have = volumes.groupBy(edition, grade, term).agg(F.sum("lesson_count").alias("n"), F.count("*").alias("v"))
    return grid.join(have, [edition, grade, term], "left").select(edition, grade, term, F.col("v").isNotNull().alias("in_db"), F.coalesce("n", F.lit(0)).alias("lesson_count"))


def stage_counts(df: DataFrame, key: str, review: str, stage: str) -> DataFrame:
    """key, lesson_count and how many need review, wait for the prescan, passed it, are confirmed, or ended otherwise; review comes first."""
    s, r = F.coalesce(stage, F.lit("")), F.coalesce(review, F.lit(False))
    of = lambda *names: F.count_if(~r & s.isin(*names))
    return df.groupBy(key).agg(
        F.count("*").alias("lesson_count"), F.count_if(r).alias("needs_review"), of("await_prescan", "await_prescan_match").alias("await_prescan"), of("prescan_ok").alias("prescan_ok_pending"),
        of("confirmed").alias("confirmed"), of("heavy_change", "no_old").alias("other_done"),
    )


def compare_flags(matches: DataFrame, new: DataFrame, old: DataFrame, lesson: str) -> DataFrame:
    """lesson, flag, severity, target: the doubtful matches, each once.

    matches: lesson, new_id, old_id; new: lesson, new_id, place, score, runner_up; old: lesson, old_id, place. Flags: an
    old block with several new ones, a new block with several old ones that aren't neighbours (an unknown one never is),
    the same pair twice, a score less than 0.10 ahead of the runner-up, and a new block whose first old block is before
    one that an earlier new block has; unknown blocks come last, and equal places go by id.
    """
    # ids are unique in new and old. One shuffle of the matches serves both results, another one, by lesson, all windows; where blocks stand is told by place and id, without numbering them
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    place, known = F.coalesce("place", F.lit(0)), F.col("place").isNotNull()
    pairs = matches.select(lesson, "new_id", "old_id").repartition(lesson, "old_id").groupBy(lesson, "new_id", "old_id").agg(F.count("*").alias("rows")).withColumn("given", given("new_id") & given("old_id"))
    shared = pairs.groupBy(lesson, "old_id").agg(F.count_if("given").alias("n")).filter("n > 1")
    met = pairs.join(old.select(lesson, "old_id", place.alias("place")), [lesson, "old_id"], "left")
    at = F.when(F.col("given"), F.struct((~known).alias("unknown"), "place", F.when(known, F.col("old_id")).alias("id")))
    met = met.select(lesson, "new_id", "given", "rows", "place", at.alias("at"))
    blocks = new.filter(F.col(lesson).isNotNull() & F.col("new_id").isNotNull()).select(lesson, "new_id", place.alias("new_place"), (F.col("score") - F.col("runner_up") < LEAST_GAP).alias("close"))
    step = F.col("place") - F.lag("place").over(Window.partitionBy(lesson, "new_id").orderBy(F.desc("given"), "place"))
    rows = met.unionByName(blocks, allowMissingColumns=True).repartition(lesson).withColumn("apart", F.when(F.col("given"), F.col("place").isNull() | F.coalesce(step > 1, F.lit(False))))
    groups = rows.groupBy(lesson, "new_id").agg(
        F.count("given").alias("matched"), F.count_if("given").alias("olds"), F.sum(F.when(F.col("given"), F.col("rows"))).alias("rows"), F.bool_or("apart").alias("apart"), F.min("at").alias("low"), F.max("at").alias("high"),
        F.min("new_place").alias("new_place"), F.bool_or("close").alias("close"),
    )
    ordered = Window.partitionBy(lesson).orderBy(F.asc_nulls_last("new_place"), "new_id").rowsBetween(Window.unboundedPreceding, -1)
    flags = [
        (F.expr("olds > 1 and apart"), "non_contiguous_multi_anchor", "high"),
        (F.expr("olds = 1 and rows > 1"), "duplicate_pair", "medium"),
        (F.expr("matched > 0 and close"), "low_confidence", "medium"),
        (F.col("low") < F.col("before"), "order_inversion", "high"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(flag).alias("flag"), F.lit(severity).alias("severity"))) for c, flag, severity in flags]))
    own = groups.withColumn("before", F.max("high").over(ordered)).select(lesson, "new_id", F.explode(found).alias("f")).select(lesson, "f.flag", "f.severity", F.col("new_id").alias("target"))
    return shared.select(lesson, F.lit("duplicate_anchor").alias("flag"), F.lit("high").alias("severity"), F.col("old_id").alias("target")).unionByName(own)


def with_any(rows: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """The rows that have a part."""
    return rows.join(parts.select(key), key, "left_semi")


def last_contents_page(pages: DataFrame, key: str, page: str, contents: Column, body: Column, most: int) -> DataFrame:
    """key, last_page: of the first `most` pages (from 0) the last contents page before the first page that is body and not contents; -1 if none."""
    p = pages.select(key, page, F.coalesce(contents, F.lit(False)).alias("c"), F.coalesce(body, F.lit(False)).alias("b")).filter((F.col(page) >= 0) & (F.col(page) < most))
    ends = F.min(F.when(~F.col("c") & F.col("b"), F.col(page))).over(Window.partitionBy(key))
    found = p.withColumn("ends", ends).groupBy(key).agg(F.max(F.when(F.col("c") & (F.col("ends").isNull() | (F.col(page) < F.col("ends"))), F.col(page))).alias("last"))
    return pages.select(key).distinct().join(found, key, "left").select(key, F.coalesce("last", F.lit(-1)).cast("long").alias("last_page"))
