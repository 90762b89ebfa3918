"""Comparison of two texts of a page: markers, edits, verdicts, clauses. Column -> Column, null counts as empty."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import similarity as S
from .text import HAN, has_any, let

# Forms that count as one, marks, families of words and thresholds.
PUNCT_FROM = "（）【】［］〔〕〖〗｛｝，、。．；：？！「」『』“”‘’—–−"
PUNCT_TO = "()[][][][]{},,..;:?!\"\"\"\"\"\"''---"
DOTS = "·•●"
BULLETS = "◇◆◊♦●•○□■▪▫※"
CIRCLED = {"⑳": "20", "⑲": "19", "⑱": "18", "⑰": "17", "⑯": "16", "⑮": "15", "⑭": "14", "⑬": "13", "⑫": "12", "⑪": "11", "⑩": "10", "⒑": "10"}
DIGITS_FROM = "①②③④⑤⑥⑦⑧⑨⒈⒉⒊⒋⒌⒍⒎⒏⒐１２３４５６７８９０⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉"
DIGITS_TO = "12345678912345678912345678900123456789" + "0123456789"
FOOTNOTES = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉"
MARKERS = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳⒈⒉⒊⒋⒌⒍⒎⒏⒐⒑１２３４５６７８９０⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉*＊★☆※"
STARS = "*＊★☆※"
QUOTES = "\"'「」『』“”‘’"
TONED = "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜĀÁǍÀĒÉĚÈĪÍǏÌŌÓǑÒŪÚǓÙǕǗǙǛ"
PINYIN = "a-zA-ZüÜāáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜ"
VOWELS = "aeiouüAEIOUāáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜ"
INVISIBLE = r"\s\x{200b}\x{200c}\x{200d}\x{feff}\x{00a0}\x{3000}"
BLANK = " \t\n\x0b\f\r\u200b\u200c\u200d\ufeff\u00a0\u3000"  # the characters of it
NOTE_PHRASES = ["读这段话", "我仿佛", "我觉得", "边观察", "记录吧"]
PREVIEW_FRONT = ["本书主要栏目", "主要栏目及说明", "栏目及说明", "致同学", "编者的话", "使用说明", "图书在版编目"]
COLUMNS = ["资料卡片", "方法导引", "跨学科实践活动", "探究与实践"]
CLAUSE_LABELS = ["思考与讨论", "探究", "复习与提高", "整理与提升", "资料", "练习"]
SCAN_MARKS = r"(?i)CMYK|Time\s*:\s*\d{4}/\d{2}/\d{2}|TLPC\d+|SCGL|New\s+D\b|pdf_p\d+|p\d{4}_p\d{4}"
PRESS = "人民教育出版社"
SUMMARIES = {
    "基本一致": "版式或扫描差异为主，知识点与表述大体沿用旧版。", "局部改写": "同一主题下题目、表述或板块有调整，框架仍相近。",
    "明显修改": "同一位置内容有较明显改写，建议人工核对增删。", "大幅重写": "与旧书对应页文本差异很大，可能重写、换题或仅为近似页。",
}
EQUIVALENT, PARTLY, CHANGED, SHOWN, CLAUSE = 0.88, 0.92, 0.58, 120, 12


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _without(c: Column, pattern: str) -> Column:
    return F.regexp_replace(_filled(c), pattern, "")


def _only(c: Column, chars: str) -> Column:
    """Of nothing but these characters, and of one at least, blanks left out."""
    t = _without(c, f"[{INVISIBLE}]+")
    return (t != "") & (F.translate(t, chars, "") == "")


def soft_punct(c: Column) -> Column:
    """Full and half width punctuation, bullets and quotes made one; without blanks and dots."""
    t = F.translate(_filled(c), PUNCT_FROM + DOTS, PUNCT_TO)
    return _without(F.translate(t, BULLETS.replace("◇", ""), "◇" * (len(BULLETS) - 1)), f"[{INVISIBLE}]+")


def lesson_markers(c: Column) -> Column:
    """Circled, raised, lowered and full width numbers as digits; without stars; blanks single."""
    t = _filled(c)
    for mark, number in CIRCLED.items():
        t = F.replace(t, F.lit(mark), F.lit(number))
    t = F.translate(F.translate(t, DIGITS_FROM, DIGITS_TO), STARS, "")
    return F.trim(F.regexp_replace(t, f"[{INVISIBLE}]+", " "))


def content_key(c: Column) -> Column:
    """What counts as text: letters, digits and Han, without footnote marks behind Han or brackets."""
    t = _without(c, rf"(?<=[{HAN})）])[{FOOTNOTES}]+")
    return _without(lesson_markers(t), r"[^\p{L}\p{N}_]+")


def is_blank(c: Column) -> Column:
    return _without(c, f"[{INVISIBLE}]+") == ""


def is_footnote_only(c: Column) -> Column:
    return _only(c, FOOTNOTES)


def is_ornament_only(c: Column) -> Column:
    return _only(c, STARS + "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉")


def is_bullets_only(c: Column) -> Column:
    return _only(c, BULLETS)


def is_punct_only(c: Column) -> Column:
    return ~F.translate(_filled(c), FOOTNOTES, "").rlike(r"[\p{L}\p{N}_]")


def is_noisy_latin(c: Column) -> Column:
    """A splinter of pinyin: one plain letter, or letters without a vowel; a toned vowel is none."""
    t = F.trim(_filled(c))
    compact = _without(t, f"[{INVISIBLE}]+")
    latin = t.rlike(rf"^[{PINYIN}\s]+$") & ~compact.rlike(f"^[{TONED}]+$")
    return latin & ((F.length(compact) <= 1) | ~t.rlike(f"[{VOWELS}]"))


def same_markers(a: Column, b: Column) -> Column:
    """Equal, or equal but for the form of lesson marks of which there are some."""
    marked = lambda c: F.translate(_filled(c), MARKERS, "") != _filled(c)
    return (_filled(a) == _filled(b)) | ((lesson_markers(a) == lesson_markers(b)) & (marked(a) | marked(b)))


def same_punct(a: Column, b: Column) -> Column:
    x, y = soft_punct(a), soft_punct(b)
    return (x == y) | (is_bullets_only(a) & (y == "")) | (is_bullets_only(b) & (x == ""))


def same_but_quotes(a: Column, b: Column) -> Column:
    bare = lambda c: soft_punct(F.translate(_filled(c), QUOTES, ""))
    return (content_key(a) == content_key(b)) & (bare(a) == bare(b))


def quoted(c: Column) -> Column:
    """What stands between Chinese double quotes."""
    return F.transform(F.regexp_extract_all(_filled(c), F.lit("[“\"]([^”\"]*)[”\"]"), F.lit(1)), lambda x: F.trim(x))


def quote_move(a: Column, b: Column) -> Column:
    """The note on moved quotes; null unless only quotes differ."""
    shown = lambda c: F.when(F.size(quoted(c)) > 0, F.array_join(quoted(c), "／")).otherwise("（无）")
    some = (F.size(quoted(a)) > 0) | (F.size(quoted(b)) > 0)
    note = F.when(some, F.concat(F.lit("旧引号内：「"), shown(a), F.lit("」→ 新引号内：「"), shown(b), F.lit("」"))).otherwise("引号挪位或增减，汉字未改")
    return F.when(same_but_quotes(a, b) & (soft_punct(a) != soft_punct(b)), F.concat(F.lit("引号位置改动；"), note))


def hanzi_key(c: Column) -> Column:
    """content_key without pinyin in brackets behind Han."""
    return content_key(F.regexp_replace(_filled(c), rf"([{HAN}])\([{PINYIN}]+\)", "$1"))


def pinyin_differs(a: Column, b: Column) -> Column:
    """The same Han content with other pinyin."""
    inline = lambda c: F.regexp_extract_all(_filled(c), F.lit(rf"[{HAN}]\([{PINYIN}]+\)"), F.lit(0))
    latin = lambda c: F.array_join(F.regexp_extract_all(_filled(c), F.lit(f"[{PINYIN}]+"), F.lit(0)), "")
    return (_filled(a) != _filled(b)) & (hanzi_key(a) == hanzi_key(b)) & ((inline(a) != inline(b)) | (latin(a) != latin(b)))


def percents_differ(a: Column, b: Column) -> Column:
    """Both have percentages, and not the same."""
    of = lambda c: F.regexp_extract_all(_filled(c), F.lit(r"(\d+\.?\d*)%"), F.lit(1))
    return (F.size(of(a)) > 0) & (F.size(of(b)) > 0) & (of(a) != of(b))


def page_norm(c: Column) -> Column:
    """Without blanks, dots, dashes and underscores."""
    return F.translate(_filled(c), BLANK + "·●…．._—-", "")  # cheaper than a pattern


def fuzz(a: Column, b: Column) -> Column:
    """The indel ratio of the normalised texts; 0 if a side is empty."""
    return fuzz_of_norms(page_norm(a), page_norm(b))


def fuzz_of_norms(x: Column, y: Column) -> Column:
    return F.when((x == "") | (y == ""), F.lit(0.0)).otherwise(S.ratio(x, y))


def same_to_a_reader(a: Column, b: Column) -> Column:
    """Alike enough to be one text read twice."""
    folded = lambda c: F.replace(F.replace(page_norm(c), F.lit("Os"), F.lit("O5")), F.lit("oS"), F.lit("o5"))
    x, y = folded(a), folded(b)
    near = F.least(F.length(x), F.length(y)) >= 0.75 * F.greatest(F.length(x), F.length(y), F.lit(1))
    return (fuzz(a, b) >= EQUIVALENT) | (x == y) | (fuzz(x, y) >= EQUIVALENT) | (near & (x != "") & (y != "") & (S.partial(x, y) >= PARTLY))


def anchor_change(a: Column, b: Column) -> Column:
    """What became of an anchored text."""
    return F.when(percents_differ(a, b), "数据变化").when(same_to_a_reader(a, b), "一致").when(fuzz(a, b) >= 0.72, "轻微差异").otherwise("改写")


# Edits --------------------------------------------------------------------------------------------

EDIT = "array<struct<tag:string,old:string,new:string,old_at:int,new_at:int>>"


def _edit_script(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for old, new in pairs:
        out = []
        for a, b in zip(old, new):
            found = SequenceMatcher(None, a or "", b or "", autojunk=False).get_opcodes() if a != b else ()
            out.append([(tag, (a or "")[i:j], (b or "")[k:n], i, k) for tag, i, j, k, n in found if tag != "equal"])
        yield pd.Series(out)


def edits(old: Column, new: Column) -> Column:
    """The stretches that differ, from matching blocks: tag (replace, delete, insert), both sides and their places."""
    return F.pandas_udf(_edit_script, EDIT)(F.replace(_filled(old), F.lit("$"), F.lit("")), F.replace(_filled(new), F.lit("$"), F.lit("")))


def edit_kind(e: Column) -> Column:
    """文字 or 标点 with 改写, 删除, 新增 or 差异; null for what isn't worth telling."""
    old, new, tag = e["old"], e["new"], e["tag"]
    same_content = content_key(old) == content_key(new)
    marks = is_footnote_only(old) & is_footnote_only(new)
    both_punct = is_punct_only(old) & is_punct_only(new)
    soft = same_punct(old, new)
    replaced = F.when(marks, "标点差异").when(soft & (is_punct_only(old) | is_punct_only(new) | same_content), None).when(same_content | both_punct, "标点差异").otherwise("文字改写")
    one = lambda c, verb: F.when(is_footnote_only(c) | is_ornament_only(c), None).when(is_punct_only(c), "标点" + verb).otherwise("文字" + verb)
    kind = F.when(tag == "replace", replaced).when(tag == "delete", one(old, "删除")).otherwise(one(new, "新增"))
    noisy_old, noisy_new = is_noisy_latin(old), is_noisy_latin(new)
    splinter = (noisy_old & noisy_new) | (noisy_old & (content_key(new) == "")) | (noisy_new & (content_key(old) == ""))
    return F.when((is_blank(old) & is_blank(new)) | same_markers(old, new), None).when(kind.startswith("标点") & soft, None).when(kind.startswith("文字") & splinter, None).otherwise(kind)


def told_edits(found: Column, most: int | None = 40) -> Column:
    """The edits with a kind, the first `most` (None: all, for a verdict that no edit escapes), each side cut to SHOWN characters for display."""
    kinds = F.filter(F.transform(found, lambda e: F.struct(edit_kind(e).alias("kind"), F.substring(e["old"], 1, SHOWN).alias("old"), F.substring(e["new"], 1, SHOWN).alias("new"), e["old_at"].alias("old_at"), e["new_at"].alias("new_at"))), lambda e: e["kind"].isNotNull())
    return kinds if most is None else F.slice(kinds, 1, most)


def block_verdict(told: Column, old: Column, new: Column) -> Column:
    a, b = _filled(old), _filled(new)
    words = F.size(F.filter(told, lambda e: ~e["kind"].startswith("标点")))
    marks = F.size(told) - words
    same = content_key(a) == content_key(b)
    return (
        F.when((a == "") & (b == ""), "无文字").when(a == "", "新有旧无").when(b == "", "旧有新无")
        .when(same_but_quotes(a, b), F.when(soft_punct(a) == soft_punct(b), "一致").otherwise("仅标点差异"))
        .when(F.size(told) == 0, "一致").when(same, F.when((words == 0) & (marks > 0), "仅标点差异").otherwise("一致"))
        .when(words == 0, "仅标点差异").when(pinyin_differs(a, b), "音标变动注意").otherwise("文字有差异")
    )


def block_role(c: Column) -> Column:
    """writing_grid (single Han characters set apart), side_note or other; lists of pairs are told by their parsers."""
    t = _filled(c)
    plain = _without(t, f"[{INVISIBLE}]+")
    han = F.length(_without(t, f"[^{HAN}]"))
    singles = F.size(F.filter(F.regexp_extract_all(t, F.lit(f"[{HAN}]+"), F.lit(0)), lambda w: F.length(w) == 1))
    grid = (han >= 8) & (han >= 0.9 * F.length(plain)) & ~plain.rlike("[。，、；：？！“”\"'（）()]") & (singles >= 6)
    return F.when(grid, "writing_grid").when(F.length(plain).between(6, 80) & has_any(plain, NOTE_PHRASES), "side_note").otherwise("other")


# Pages --------------------------------------------------------------------------------------------


def is_scan_noise(line: Column) -> Column:
    """A line of printers' marks: nothing to read, or metadata of the scan."""
    s = F.trim(_filled(line))
    press = s.contains(PRESS) & (F.length(s) < 20)
    return (F.length(s) <= 1) | press | s.rlike(SCAN_MARKS) | s.rlike(r"S\d{3}\b") | s.rlike(r"^[_./:\-\d\s]+$") | s.rlike(r"^[\sL]+$")


def without_scan_noise(text: Column) -> Column:
    """The page's lines without noise, blanks single."""
    lines = F.transform(F.split(_filled(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~is_scan_noise(x)), "\n")


def is_preview_front_matter(text: Column) -> Column:
    t = _filled(text)
    hits = sum((t.contains(w).cast("int") for w in COLUMNS), F.lit(0))
    numbered = F.size(F.regexp_extract_all(t, F.lit(r"(?m)^\s*\d+\."), F.lit(0)))
    return has_any(F.substring(t, 1, 400), PREVIEW_FRONT) | ((hits >= 3) & (numbered < 2) & ~t.rlike(r"课题\s*\d"))


def page_blob(text: Column) -> Column:
    """A page's text without noise, blanks and line breaks: what clauses are cut from and searched in."""
    return page_norm(without_scan_noise(text))


def clauses(text: Column) -> Column:
    """The sentences of a page of CLAUSE characters or more, cut before marks and labels too, whatever the line breaks."""
    return clauses_of(page_blob(text))


def clauses_of(blob: Column) -> Column:
    """clauses of a page_blob."""
    blob = F.regexp_replace(blob, r"([①②③④⑤⑥⑦⑧⑨⑩]|课题\d+|图\d+)", "。$1")
    for label in CLAUSE_LABELS:
        blob = F.replace(blob, F.lit(label), F.lit("。" + label))
    return F.filter(F.split(blob, "[。！？；：]"), lambda x: F.length(x) >= CLAUSE)


def missing_clauses(text: Column, other: Column) -> Column:
    """Clauses of a page that don't stand word for word on the other."""
    return let(page_blob(other), lambda blob: missing_from(clauses(text), blob))


def missing_from(some: Column, blob: Column) -> Column:
    """Of some clauses those that don't stand in a page_blob."""
    return F.filter(some, lambda x: ~F.contains(blob, x))


def page_similarity(a: Column, b: Column) -> Column:
    return fuzz(without_scan_noise(a), without_scan_noise(b))


def level_name(similarity: Column) -> Column:
    return F.when(similarity >= 0.88, "基本一致").when(similarity >= 0.70, "局部改写").when(similarity >= 0.45, "明显修改").otherwise("大幅重写")


def level_summary(level: Column) -> Column:
    return F.coalesce(*[F.when(level == k, v) for k, v in SUMMARIES.items()], F.lit(""))


def draft_kind(page: Column, text: Column, is_contents: Column) -> Column:
    """封面, 前言说明, 新目录页 or 正文."""
    return F.when(page == 1, "封面").when(is_preview_front_matter(text), "前言说明").when(is_contents, "新目录页").otherwise("正文")


def skip_summary(kind: Column, note: Column) -> Column:
    return (
        F.when(kind == "封面", "封面，不参与正文对比。").when(kind == "前言说明", "新课标预览的栏目说明，旧书无同页对照。")
        .when(kind == "新目录页", "新课标目录页，页码体系与旧书不同。").otherwise(F.coalesce(note, F.lit("不参与正文对比。")))
    )
