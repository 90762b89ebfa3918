"""States of pairs, blocks and notes in a review: transitions as whole-table updates, block profiles, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import similarity as S
from ..functions import text as T
from .rollup import experiment_status
from .sequence import longest_run

# States, words that open, fill and close a lesson step, limits, hints.
STATES = ["suggested", "pending_review", "confirmed", "rejected"]
OPENS, FILLS, CLOSES = ["导入", "情境", "问题", "引入", "激趣"], ["实验", "探究", "活动", "观察", "操作"], ["总结", "小结", "归纳", "结论", "反思"]
FULL_ATOMS, EXPERIMENT_ATOMS, FEW_ATOMS, FEW_CHARS = 5, 3, 1, 15
WHOLE_KINDS = ["intro", "activity", "explain", "practice", "summary", "cw_fixed"]
HINTS = {"reuse_as_is": "旧课件可直接沿用", "optimize": "可参考旧课件，更新文字/排版/页码", "reference": "可参考旧课件素材，按新教材结构重制", "new_build": "需全新制作", "remove": "新教材已无此模块，课件可跳过"}
EMPTY_NOTE = "请补充：旧课件哪页→新教材哪块→怎么改"
STAGES = ["课件名称页", "导入", "知识点讲解", "知识小结", "课件尾页（练习提醒）"]
REUSABLE = ["reuse_as_is", "optimize"]


def confirmed_all(pairs: DataFrame, status: str, old: str) -> DataFrame:
    """Pairs that await confirmation and have an old lesson become confirmed; all others stay."""
    return pairs.withColumn(status, F.when((F.col(status) == "pending_review") & F.col(old).isNotNull(), "confirmed").otherwise(F.col(status)))


def ready_for_review(pairs: DataFrame, compared: DataFrame, key: str, status: str, old: str) -> DataFrame:
    """Pairs that have been compared await confirmation, unless they are confirmed, rejected or without an old lesson."""
    done = compared.select(key).distinct().withColumn("compared", F.lit(True))
    may = F.coalesce("compared", F.lit(False)) & F.col(old).isNotNull() & ~F.coalesce(F.col(status), F.lit("")).isin("confirmed", "rejected")
    return pairs.join(done, key, "left").withColumn(status, F.when(may, "pending_review").otherwise(F.col(status))).drop("compared")


def edited_pairs(pairs: DataFrame, edits: DataFrame, lessons: DataFrame, key: str) -> DataFrame:
    """pairs (key, old_volume, old_lesson, method, status) after edits (key, clear, lesson, status; null: left as it is).

    A lesson must belong to the pair's old volume and a status must be known, else that part of the edit is not done. An
    edit of the lesson makes the method manual; an empty lesson clears it. lessons: lesson, volume.
    """
    e = edits.select(key, F.col("clear").alias("e_clear"), F.trim("lesson").alias("e_lesson"), F.trim("status").alias("e_status"))
    known = lessons.select(F.col("lesson").alias("e_lesson"), F.col("volume").alias("e_volume"))
    out = pairs.join(e.join(known, "e_lesson", "left"), key, "left")
    clear = F.coalesce("e_clear", F.lit(False)) | F.coalesce(F.col("e_lesson") == "", F.lit(False))
    set_ = ~clear & F.coalesce(F.col("e_volume") == F.col("old_volume"), F.lit(False))
    return out.select(
        key, "old_volume", F.when(clear, None).when(set_, F.col("e_lesson")).otherwise(F.col("old_lesson")).alias("old_lesson"), F.when(clear | set_, "manual").otherwise(F.col("method")).alias("method"),
        F.when(F.col("e_status").isin(STATES), F.col("e_status")).otherwise(F.col("status")).alias("status"),
    )


def is_complete(name: Column, texts: Column, atoms: Column, kind: Column, said: Column) -> Column:
    """Whether a block is a whole step: as said, or with an opening, an activity and a close, or an experiment of some size, or large. texts: of its atoms, joined."""
    blob = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(texts, F.lit("")))
    steps = T.has_any(blob, OPENS) & T.has_any(blob, FILLS) & T.has_any(blob, CLOSES)
    return F.coalesce(said, steps | (D.is_experiment(name, kind, F.lit(None).cast("boolean")) & (atoms >= EXPERIMENT_ATOMS)) | (atoms >= FULL_ATOMS))


def is_fragment(name: Column, texts: Column, codes: Column, pages: Column, kind: Column, complete: Column, said: Column) -> Column:
    """Whether a block doesn't count: no whole step, no telling kind, and next to nothing in it. codes, pages: how many atoms and courseware pages it has."""
    whole = F.coalesce(complete, F.lit(False)) | D.block_kind(name, kind).isin(WHOLE_KINDS) | D.is_experiment(name, kind, F.lit(None).cast("boolean"))
    short = (codes == 1) & (F.length(F.coalesce(texts, F.lit(""))) < FEW_CHARS)
    rest = F.when(whole, False).when((pages > 0) & (codes == 0), False).when(codes > FEW_ATOMS, False).when((codes == 0) & (pages == 0), True).otherwise(short)
    return F.coalesce(said, rest)


def lesson_stats(blocks: DataFrame, lesson: str) -> DataFrame:
    """Per lesson: blocks, effective and fragment ones, the longest run of reusable effective blocks and its share, experiments. blocks: lesson, place, fragment, action, experiment."""
    effective = blocks.filter("NOT fragment")
    n = blocks.groupBy(lesson).agg(F.count("*").alias("total"), F.count_if(~F.col("fragment")).alias("effective"), F.count_if("fragment").alias("fragments"))
    run = longest_run(effective, lesson, ["place"], F.coalesce(F.col("action").isin(REUSABLE), F.lit(False))).select(lesson, F.col("length").alias("run"))
    tests = experiment_status(effective, lesson, F.col("experiment"), F.col("action"), REUSABLE)
    out = n.join(run, lesson, "left").join(tests, lesson, "left").withColumn("run", F.coalesce("run", F.lit(0).cast("long")))
    share = F.round(F.col("run") / F.greatest("effective", F.lit(1)), 3)
    return out.select(lesson, "total", "effective", "fragments", "run", share.alias("share"), F.coalesce("n_experiments", F.lit(0).cast("long")).alias("n_experiments"), "all_retained")


def stage_name(slide: Column, total: Column) -> Column:
    """The block that a slide opens, guessed by its place."""
    title, intro, body, summary, last = STAGES
    return F.when(total <= 0, body).when(slide <= 1, title).when(slide >= total, last).when(slide == 2, intro).when((slide == total - 1) & (total > 3), summary).otherwise(body)


def teacher_note(old_name: Column, new_name: Column, new_id: Column, pages: Column, old_pages: Column, new_pages: Column, old_text: Column, new_text: Column, action: Column) -> Column:
    """What a teacher is told of a pair of blocks; a side without a name is missing. pages: the courseware's; all pages arrays of numbers."""
    a, b, x, y = (F.coalesce(c, F.lit("")) for c in (old_name, new_name, old_text, new_text))
    old, new = old_name.isNotNull(), new_name.isNotNull()
    both, fixed = old & new, D.is_fixed_page(a)
    numbers = lambda p: F.array_join(p.cast("array<string>"), "/")
    moved = both & (F.size(F.coalesce(old_pages, F.array().cast("array<int>"))) > 0) & (F.size(F.coalesce(new_pages, F.array().cast("array<int>"))) > 0) & (old_pages != new_pages)
    cw = T.format_cw_range(pages)
    alike = S.token_set(x, y) * 100
    excerpt = lambda c: F.substring(F.replace(c, F.lit("\n"), F.lit(" ")), 1, 36)
    text = (
        F.when((x != "") & (y != ""), F.when(alike >= 80, "核心内容基本一致").when(alike < 50, "内容差异较大，需按新教材重制").when(excerpt(x) != excerpt(y), F.concat(F.lit("内容有调整（旧："), excerpt(x), F.lit("…→新："), excerpt(y), F.lit("…）"))))
        .when(y != "", "旧侧无原子文本，以新教材为准").when(x != "", "新侧无原子文本，需核对建块")
    )
    parts = [
        F.when(cw != "", F.concat(F.lit("旧课件"), cw)), F.when(both & (a != "") & (b != "") & (a != b), F.concat(F.lit("「"), a, F.lit("」→「"), b, F.lit("」"))), F.when(both & (F.coalesce(new_id, F.lit("")) != ""), F.concat(F.lit("→新区块 "), new_id)),
        F.when(moved, F.concat(F.lit("教材页旧P"), numbers(old_pages), F.lit("→新P"), numbers(new_pages))),
        F.when(new & ~old, F.concat(F.lit("新教材新增「"), b, F.lit("」（"), F.coalesce(new_id, F.lit("")), F.lit("）；旧教材无对应块"))),
        F.when(old & ~new, F.when(fixed, F.concat(F.lit("课件固定"), F.when(a.contains("课件例题"), "课件例题").otherwise("课件尾页"), F.lit("，无新教材对应块；旧课件该页可直接沿用"))).otherwise(F.concat(F.lit("旧块「"), a, F.lit("」在新教材已删除")))),
        text, F.coalesce(*[F.when(action == k, v) for k, v in HINTS.items()]),
    ]
    note = F.concat_ws("；", *parts)
    return F.when(note == "", EMPTY_NOTE).otherwise(note)
