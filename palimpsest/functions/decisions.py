"""Rule classifiers as ordered conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_any, stripped

# Keyword families and thresholds of the rules.
LITERACY = ["反思", "评价", "量规", "归纳法", "思想方法", "素养", "信箱"]
ACTIVITY = ["实验", "探究", "活动", "操作", "游戏"]
MEDIA = ["图", "插图", "照片", "素材", "示意图"]
EQUIPMENT = ["器材", "材料", "工具", "仪器"]
FIXED_PAGES = ["课件例题", "课件尾页"]
KINDS = {
    "cover": ["课件名称", "课头封面", "封面", "名称页"], "intro": ["导入", "情境", "问题情境", "激趣", "引入"], "explain": ["知识点", "讲解", "新知", "概念", "讲授"],
    "activity": ["实验", "活动", "探究", "操作", "研究"], "practice": ["练习", "典例", "习题", "课堂练习"], "summary": ["小结", "归纳", "知识小结", "总结"],
    "end": ["尾页", "结束页", "练习提醒", "结束"], "cw_fixed": ["课件例题", "课件尾页"],
}
EXPERIMENT = ["实验", "探究", "演示", "操作"]
ACTIONS = ["reuse_as_is", "optimize", "reference", "new_build", "remove", "pending"]
EFFORT = {"reuse_as_is": 2, "optimize": 15, "reference": 50, "new_build": 90, "remove": 5, "pending": 40}
MARKS = ["agree", "unique_new", "unique_tb", "unique_cw", "conflict"]
BOUNDARIES, GAP = [0.05, 0.30, 0.70], 0.10


def is_fixed_page(name: Column) -> Column:
    return has_any(stripped(name), FIXED_PAGES)


def effective_action(own: Column, suggested: Column) -> Column:
    return F.coalesce(F.nullif(stripped(own), F.lit("")), stripped(suggested))


def optimize_subtype(action: Column, own: Column, suggested: Column, change: Column) -> Column:
    sub = effective_action(own, suggested)
    by_change = F.when(change <= 0.20, "text_only").when(change > 0.20, "re_voice")
    return F.when(action == "optimize", F.when(sub.isin("text_only", "re_voice"), sub).otherwise(by_change))


def block_kind(name: Column, explicit: Column) -> Column:
    n = stripped(name)
    by_name = F.coalesce(*[F.when(has_any(n, words), kind) for kind, words in KINDS.items()], F.lit("other"))
    return F.when(stripped(explicit) != "", stripped(explicit)).otherwise(by_name)


def is_experiment(name: Column, explicit_kind: Column, flag: Column) -> Column:
    return F.coalesce(flag, (block_kind(name, explicit_kind) == "activity") | has_any(stripped(name), EXPERIMENT))


def change_type(has_old: Column, has_new: Column, old_name: Column, new_name: Column, old_text: Column, new_text: Column, name_ratio: Column, text_ratio: Column, pages_differ: Column) -> Column:
    """L001 to L009; the ratios (0 to 100) are 0 where a side is empty."""
    o, n, x, y = (F.coalesce(c, F.lit("")) for c in (old_name, new_name, old_text, new_text))
    combined = F.concat_ws(" ", o, n, x, y)
    only_new = F.when(has_any(F.concat(y, n), LITERACY), "L001").otherwise("L008")
    only_old = F.when(is_fixed_page(o), "L002").otherwise("L007")
    both = (
        F.when((name_ratio >= 88) & (text_ratio >= 78), "L002").when(has_any(combined, EQUIPMENT), "L005").when(has_any(combined, MEDIA), "L006")
        .when(has_any(combined, ACTIVITY) & (text_ratio < 62), "L004").when(has_any(combined, LITERACY) & (text_ratio < 55), "L001")
        .when(pages_differ & (text_ratio < 70), "L003").when(text_ratio >= 72, "L002").when(text_ratio >= 42, "L004").otherwise("L009")
    )
    return F.when(~has_old & has_new, only_new).when(has_old & ~has_new, only_old).otherwise(both)


def reuse_action(kind: Column, has_old: Column, has_new: Column, old_name: Column, text_ratio: Column, has_courseware: Column) -> Column:
    keep = F.when(is_fixed_page(old_name), "reuse_as_is").otherwise("remove")
    by_kind = F.when((text_ratio >= 84) & has_courseware, "reuse_as_is").otherwise("optimize")
    rest = F.when((text_ratio >= 86) & has_courseware, "reuse_as_is").when(kind == "L005", "reference").when(kind == "L009", "new_build").otherwise("optimize")
    return (
        F.when(~has_old & has_new, "new_build").when(has_old & ~has_new, keep).when(kind == "L007", "remove").when(kind.isin("L008", "L001"), "new_build")
        .when(kind.isin("L002", "L003", "L006"), by_kind).when(kind == "L004", "reference").otherwise(rest)
    )


def refine_action(base: Column, change: Column, experiment: Column, paired: Column) -> Column:
    """The base action moved to what the share of changed text says; bucket by change_bucket()."""
    light, medium, heavy = change <= 0.05, (change > 0.05) & (change <= 0.30), (change > 0.30) & (change < 0.70)
    in_experiment = F.when(change >= 0.30, F.when(change < 0.70, "reference").otherwise("new_build")).otherwise("reference")
    return (
        F.when(~paired | base.isin("remove", "new_build"), base).when(experiment & (medium | heavy), in_experiment).when(change >= 0.70, "new_build")
        .when(heavy & base.isin("reuse_as_is", "optimize"), "reference").when(medium & (base == "reuse_as_is"), "optimize").when(light & (base == "optimize"), "reuse_as_is").otherwise(base)
    )


def confidence(change: Column, score: Column, runner_up: Column, paired: Column) -> Column:
    near = F.lit(False)
    for b in BOUNDARIES:
        near = near | (F.abs(change - b) <= 0.03)
    return F.when(~paired, "high").when((score - runner_up) < GAP, "low").when(near, "low").when(score < 0.35, "low").when(score >= 0.6, "high").otherwise("medium")


def compare_mark(tb: Column, cw: Column, picture: Column, picture_conflict: Column) -> Column:
    return (
        F.when((tb == "new") & (cw == "missing"), "unique_new").when((tb == "match") & (cw == "missing"), "unique_tb").when((cw == "cw_only") & (tb != "match"), "unique_cw")
        .when((tb == "match") & (cw == "adapt") & ~picture_conflict & ~picture.isin("conflict", "missing"), "agree").otherwise("conflict")
    )


def fusion_action(mark: Column, tb: Column, cw: Column, picture: Column, picture_conflict: Column) -> Column:
    return (
        F.when(tb == "delete", "delete").when(mark == "agree", "reuse_as_is").when(mark == "unique_new", "create_new").when(picture_conflict | (picture == "conflict"), "remake_from_ref")
        .when((mark == "unique_tb") & (tb == "match"), "optimize").when((mark == "unique_cw") & (cw == "cw_only"), "optimize").when(mark == "conflict", "remake_from_ref")
        .when((tb == "match") & (cw == "adapt"), "reuse_as_is").otherwise("optimize")
    )


def match_class(score: Column, least: Column, has_atoms: Column) -> Column:
    return F.when(~has_atoms, "delete").when(score >= least, "match").when(score > 0, "no_match").otherwise("new")


def text_match_status(score: Column, least: Column) -> Column:
    return F.when(score >= least, "matched").when(score >= least * 0.5, "partial").otherwise("none")


def page_level(share: Column) -> Column:
    return F.when(share >= 0.8, "mostly_reuse").when(share >= 0.5, "partial_adjust").otherwise("major_rebuild")


def core_match(hybrid: Column, lesson: Column, unit: Column, context: Column, gap: Column) -> Column:
    """Whether a scored old lesson may be the main counterpart."""
    same_unit = unit >= 0.38
    lost = (
        (hybrid < 0.405) | (gap >= 3) | ((gap >= 2) & (unit < 0.38)) | ((gap >= 1) & (unit < 0.38) & (context < 0.42)) | (same_unit & lesson.between(0.36, 0.68) & (lesson < 0.68))
    )
    rescued = (gap == 0) & same_unit & (context >= 0.42) & (lesson < 0.36)
    weak = (same_unit & (lesson < 0.68)) | ((unit < 0.32) & (lesson < 0.44) & (context < 0.29))
    return F.when(lost, False).when(rescued, True).when(weak, False).otherwise((lesson >= 0.44) | (context >= 0.42))


def traceable(hybrid: Column, lesson: Column, unit: Column, context: Column, gap: Column) -> Column:
    return ~core_match(hybrid, lesson, unit, context, gap) & (gap >= 1) & (hybrid >= 0.405) & ((unit >= 0.28) | ((lesson >= 0.48) & (context >= 0.36)))


def lesson_grade(reuse: Column, optimize: Column, reference: Column, new: Column, re_voice: Column, pending: Column, effective: Column, run_ok: Column, run_share: Column, retained: Column) -> Column:
    """The grade of a lesson from its blocks' action counts, its longest reusable run and whether its experiments are kept (null: unknown)."""
    eff = F.greatest(F.lit(1), effective)
    steady = run_ok & (run_share >= 1 / 3)
    lost = F.coalesce(~retained, F.lit(False))
    clean = (reference == 0) & (new == 0)
    return (
        F.when((pending == 0) & (optimize == 0) & clean & (reuse > 0), "direct_reuse")
        .when((new / eff >= 0.45) | (new >= F.greatest(F.lit(2.0), eff * 0.35)), "new_production").when(~steady & (run_share < 1 / 3) & (new > 0), "new_production")
        .when(lost | (reference > 0) | ~steady, "cw_material_video_rerecord").when((pending == 0) & clean & (re_voice == 0), "video_clip")
        .when((pending == 0) & clean & (re_voice > 0), "partial_rerecord").when((optimize > 0) & clean, "partial_rerecord").otherwise("new_production")
    )


def prescan_verdict(has_primary: Column, best_is_primary: Column, best: Column, primary: Column) -> Column:
    """What to do with the main counterpart, from the scores of the text; null if it needs a look."""
    p = F.coalesce(primary, F.lit(0.0))
    return (
        F.when(best.isNull(), F.when(~has_primary, "no_old")).when(has_primary & ~best_is_primary, F.when(best - p >= 0.10, "swap_primary"))
        .when(p >= 0.38, "confirmed").when(p <= 0.22, "heavy_change")
    )


def visual_grade(similarity: Column) -> Column:
    return F.when(similarity >= 0.85, "画面接近").when(similarity >= 0.55, "可能有改动").otherwise("疑似换图")
