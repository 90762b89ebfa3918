"""Lines of a catalogue: normal forms, kinds, keys. Column -> Column, null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Titles that stand by themselves, columns with a number, columns without, words of exercises, and their places in a unit.
SPECIAL = ["整理与提升", "复习与提高", "回顾与反思", "复习题"]
NUMBERED = {"E": "实验活动", "X": "跨学科实践活动", "G": "综合实践活动", "W": "微项目"}
PREFIXES = "课题|实验活动|跨学科实践活动|综合实践活动|微项目"
MATH_BLOCKS, LANGUAGE_BLOCKS, TABLES = "读一读|数学活动|主题探究", "口语交际|习作|语文园地|快乐读书吧", "识字表|写字表|词语表"
NO_SUBTITLE = ["例文", "阅读", "口语交际", "习作", "语文园地"]
EXERCISES = ["下列", "判断", "填空", "简答", "计算", "连线", "选择", "举例", "观察你", "简要说明", "哪些是", "该词语", "该说法", "是否正确"]
ORDER = {"整理与提升": 10, "复习与提高": 20, "回顾与反思": 70, "复习题": 80}
NUMBERED_ORDER = {"实验活动": 30, "跨学科实践活动": 40, "综合实践活动": 50, "微项目": 60}
LETTER = rf"[{T.HAN}「」《》A-Za-z]"
MATH_SECTION = rf"^\d{{1,2}}\.\d{{1,2}}\s*[*＊]?\s+{LETTER}"
PAGE_SUFFIX = r"(?:[·●…．._—\-]+\s*|\s+)\d{1,3}\s*$"
LONG_EXERCISE, SHORTEST_GLUED = 36, 16


def _trimmed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\x{00a0}\x{3000}]+", " "))


def special_title(c: Column) -> Column:
    """One of SPECIAL, blanks between its characters and a page number aside; null for other lines."""
    t = F.regexp_replace(F.regexp_replace(T.stripped(c), PAGE_SUFFIX, ""), rf"[{T.BLANK}]+", "")
    return F.when(t.isin(SPECIAL), t)


def normal_line(c: Column) -> Column:
    """The line without page number and leaders, blanks single; a special title as it is listed."""
    t = F.trim(F.regexp_replace(_trimmed(c), PAGE_SUFFIX, ""))
    return F.coalesce(special_title(t), t)


def is_exercise(c: Column) -> Column:
    """A question or task of the text, no entry of a catalogue."""
    return T.let(normal_line(c), _exercise)


def _exercise(t: Column) -> Column:
    listed = special_title(t).isNotNull() | t.rlike(MATH_SECTION) | t.rlike(rf"^(?:{MATH_BLOCKS})(?:\s|$|：|:|·|（|\()")
    asks = t.rlike(r"[（(]\s*[）)]") | t.rlike("[？?]") | T.has_any(t, EXERCISES) | (t.rlike(r"^\d+\s+") & (F.length(t) > LONG_EXERCISE))
    return (t != "") & ~listed & asks


def is_lesson_line(c: Column) -> Column:
    """An entry of a catalogue that is a lesson: a special title, a summary, a column, a table or a number with a name."""
    return T.let(normal_line(c), _lesson)


def _lesson(t: Column) -> Column:
    kinds = [
        special_title(t).isNotNull(), t.contains("单元小结"), t.rlike(rf"^(?:{PREFIXES})\s*\d+"), t.rlike(MATH_SECTION), t.rlike(rf"^(?:{MATH_BLOCKS})(?:\s|$|：|:|·|（|\()"), t.rlike(rf"^\d{{1,2}}\s*[*＊]?\s*{LETTER}"),
        t.rlike(rf"^(?:{LANGUAGE_BLOCKS})(?:\s|$|：|:|·)"), t.rlike(rf"^(?:{TABLES})(?:\s|$|¹|1)"),
    ]
    some = kinds[0]
    for k in kinds[1:]:
        some = some | k
    return F.length(t).between(2, 120) & ~is_exercise(t) & some


def is_subtitle(c: Column) -> Column:
    """The name of a poem or a sample text under a lesson: short, without number, no entry by itself."""
    t = normal_line(c)
    plain = t.rlike(rf"^(?:例文\s+)?[{T.HAN}《》「」『』·、A-Za-z0-9]{{2,24}}$")
    return (t != "") & ~t.isin(NO_SUBTITLE) & ~is_lesson_line(t) & ~is_exercise(t) & ~t.rlike(r"^\d") & plain


def subtitle(c: Column) -> Column:
    return F.trim(F.regexp_replace(normal_line(c), r"^例文\s+", ""))


def split_glued(c: Column) -> Column:
    """The lessons of a line into which several have run together; a line that is one stays one, an empty line has none."""
    t = normal_line(c)
    one_column = (F.size(F.regexp_extract_all(t, F.lit(rf"(?:{PREFIXES})\s*\d+"), F.lit(0))) == 1) & t.rlike(rf"^(?:{PREFIXES})\s*\d+")
    by_block = F.split(t, r"(?=口语交际|习作例文|(?<!口语交际)习作(?!例文)|语文园地|快乐读书吧)")
    by_number = F.flatten(F.transform(by_block, lambda x: F.split(x, rf"(?=(?<![\d.])\d{{1,2}}\s*[*＊]?\s*[{T.HAN}《「]{{2,}})")))
    parts = F.filter(F.transform(by_number, lambda x: F.trim(F.regexp_replace(F.trim(x), rf"(?<=[{T.HAN}])\d{{1,3}}$", ""))), lambda x: F.length(x) >= 2)
    whole = F.aggregate(parts, F.lit(0), lambda s, x: s + F.length(x)) >= F.length(t) * 0.5
    return F.when(t == "", F.array().cast("array<string>")).when((F.length(t) < SHORTEST_GLUED) | one_column | (F.size(parts) < 2) | ~whole, F.array(t)).otherwise(parts)


def semantic_key(unit: Column, lesson: Column) -> Column:
    """What makes two rows one lesson, whatever the wording: the unit's number and the kind and number of the line; empty for an empty line."""
    u = F.coalesce(T.unit_no_from_title(_trimmed(unit)).cast("string"), _trimmed(unit))
    t = normal_line(lesson)
    number = lambda p: F.regexp_extract(t, p, 1)
    tagged = lambda tag, *parts: F.concat_ws("|", F.lit(tag), *parts)
    key = F.when(t == "", "").when(special_title(t).isNotNull(), tagged("S", special_title(t)))
    for tag, word in NUMBERED.items():
        key = key.when(number(rf"^{word}\s*(\d+)") != "", tagged(tag, number(rf"^{word}\s*(\d+)").try_cast("int").cast("string")))
    section = r"^(\d{1,2})\.(\d{1,2})\b"
    key = key.when(t.rlike(section), tagged("M", F.regexp_extract(t, section, 1), F.regexp_extract(t, section, 2)))
    key = key.when(t.rlike("^(读一读|数学活动)"), tagged("MB", number("^(读一读|数学活动)"), T.norm_text(F.regexp_replace(t, r"^(读一读|数学活动)\s*", ""), normal=False)))
    key = key.when(t.rlike(r"^主题探究\s*[（(][^）)]+[）)]"), tagged("MP", F.trim(number(r"^主题探究\s*[（(]([^）)]+)[）)]")))).when(t.startswith("主题探究"), tagged("MP", T.norm_text(F.regexp_replace(t, r"^主题探究\s*", ""), normal=False)))
    key = key.when(number(r"^(?:课题\s*)?(\d+)(?!\.\d)") != "", tagged("N", number(r"^(?:课题\s*)?(\d+)(?!\.\d)").try_cast("long").cast("string")))
    block = number(rf"^({LANGUAGE_BLOCKS})(?:\s|$|：|:|·)")
    key = key.when(block != "", tagged("Y", block, T.norm_text(T.strip_lesson_seq(F.regexp_replace(t, rf"^({LANGUAGE_BLOCKS})", "")), normal=False)))
    return F.when(t == "", "").otherwise(F.concat_ws("/", u, key.otherwise(tagged("R", t))))


def place_in_unit(c: Column) -> Column:
    """Sorts lessons of a unit: numbers, then other lines and columns in their order, then the summary."""
    s = T.cell_str(c)
    number = lambda p: F.regexp_extract(s, p, 1).try_cast("int")
    place = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("n"), s.alias("s"))
    special = special_title(s)
    out = F.when(s.contains("单元小结"), place(3, F.lit(9999))).when(special.isNotNull(), place(2, F.coalesce(*[F.when(special == k, v) for k, v in ORDER.items()], F.lit(15))))
    for word, base in NUMBERED_ORDER.items():
        out = out.when(number(rf"^{word}\s*(\d+)").isNotNull(), place(2, base + number(rf"^{word}\s*(\d+)")))
    out = out.when(s.rlike(f"^({MATH_BLOCKS})"), place(2, F.lit(65))).when(number(r"^课题\s*(\d+)").isNotNull(), place(0, number(r"^课题\s*(\d+)")))
    section = r"^(\d{1,2})\.(\d{1,2})\b"
    out = out.when(s.rlike(section), place(0, F.regexp_extract(s, section, 1).try_cast("int") * 100 + F.regexp_extract(s, section, 2).try_cast("int")))
    return out.when(number(r"^(\d+)").isNotNull(), place(0, number(r"^(\d+)"))).otherwise(place(2, F.lit(0)))


def row_worth(unit: Column, lesson: Column) -> Column:
    """Which of two rows of one lesson is shown: entries before exercises, fuller units, shorter lines."""
    x, u = F.coalesce(lesson, F.lit("")), F.coalesce(unit, F.lit(""))
    worth = F.when(x.rlike(r"^课题\s*\d+"), 200).otherwise(0) + F.when(special_title(x).isNotNull(), 200).otherwise(0) + F.when(x.rlike(r"^实验活动\s*\d+"), 150).otherwise(0) + F.when(x.startswith("跨学科"), 150).otherwise(0)
    return F.when(is_exercise(x), -1000).otherwise(worth + F.least(F.length(u), F.lit(40)) - F.greatest(F.lit(0), F.length(x) - 32))
