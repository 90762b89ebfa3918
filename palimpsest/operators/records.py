"""Joins of lessons, blocks and their matches: neighbours, claims, suggestions, files, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import similarity as S
from ..functions import text as T
from .matching import greedy_assignment
from .rollup import most_frequent
from .scans import settled

# Words of block names, weights, bonuses, limits.
NAME_WORDS = ["导入", "探究", "实验", "观察", "记录", "反思", "总结", "练习", "拓展", "引入", "讲解", "讨论", "归纳", "应用", "情境"]
CONTAINED, CHARS_SHARE, NAME_SHARE, WORDS_SHARE = 0.85, 0.45, 0.55, 0.7
SAME_LESSON, SAME_UNIT, SAME_KIND, USED = 0.35, 0.18, 0.22, 0.35
COMPARED_TIERS = ["exact", "high_similarity"]
NUMBER_RADIUS, COARSE_RANKS, FILE_LEAST, FILE_TOP = 2, 4, 0.62, 5
FILE_NOISE = r"(?i)^(课件|courseware|ppt|slides?|zip|压缩包)[_\-\s]*"

# Textbook files: noise in their names, the code of a volume, grades and terms, editions and their short names, scores.
BOOK_NOISE = r"(?i)(小学)?科学|新教材|旧教材|教材|课本|扫描版?|学而思|专用|修订|电子版|PDF|教科书|全册|合订"
BOOK_CODE = r"(?i)([A-Z0-9]+)-(\d{1,2})([SX])-(D?OLD|D?NEW)"
GRADES = [
    (r"(\d{1,2})\s*年级\s*(上|下)\s*册?", False), (r"([一二三四五六七八九])\s*年级\s*(上|下)\s*册?", True), (r"(?<!\d)(\d{1,2})\s*[_\-·]?\s*(上|下)(?!\s*册?\s*[年级课])", False), (r"([一二三四五六七八九])\s*(上|下)(?!\s*册?\s*[年级课])", True),
]
EDITIONS = {
    "冀人版": ["冀人", "jiren", "jr"], "湘科版": ["湘科", "xiangke", "xk"], "苏教版": ["苏教", "sujiao", "sj"], "粤教科版": ["粤教", "粤科", "yuejiao", "yj"], "大象社版": ["大象", "daxiang", "dx"], "教科版": ["教科", "jiaoke", "jk"],
    "人教鄂教版": ["人教鄂教", "鄂教", "renejiao", "re"], "青岛版": ["青岛", "qingdao", "qd"],
}
SURE, LIKELY, UNSAID, BOOK_LEAST, BY_TITLE = 0.96, 0.92, 0.68, 0.72, 0.85


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def dual_join(textbook: DataFrame, courseware: DataFrame, key: str) -> DataFrame:
    """Units of either track with both tracks' fields, and what a missing track counts as. textbook: key, section, match_class, tag, score; courseware: key, section, status, conflict, score."""
    t = textbook.select(key, F.col("section").alias("t_section"), "match_class", "tag", F.col("score").alias("tb_score"))
    c = courseware.select(key, F.col("section").alias("c_section"), "status", "conflict", F.col("score").alias("cw_score"))
    first = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b, F.lit(""))
    return t.join(c, key, "full_outer").select(
        key, first(F.col("t_section"), F.col("c_section")).alias("section"), F.coalesce(F.nullif("match_class", F.lit("")), F.lit("new")).alias("match_class"),
        F.coalesce(F.nullif("status", F.lit("")), F.lit("missing")).alias("status"), F.coalesce(F.nullif("tag", F.lit("")), F.lit("none")).alias("tag"), F.coalesce("conflict", F.lit(False)).alias("conflict"), "tb_score", "cw_score",
    )


def dual_marks(joined: DataFrame) -> DataFrame:
    """joined with the mark of each unit."""
    return joined.withColumn("mark", D.compare_mark(F.col("match_class"), F.col("status"), F.col("tag"), F.col("conflict")))


def best_matches(matches: DataFrame, new: str, old: str, tier: str, rank: str) -> DataFrame:
    """The match of the lowest rank (null: 99) of each new lesson, among those to be compared."""
    m = matches.filter(F.col(old).isNotNull() & F.col(tier).isin(COMPARED_TIERS))
    first = Window.partitionBy(new).orderBy(F.coalesce(F.col(rank), F.lit(99)), old)
    return m.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")


def block_status(lessons: DataFrame, blocks: DataFrame, lesson: str, confirmed: str) -> DataFrame:
    """Each lesson's number of blocks and status: confirmed, pending or no_blocks."""
    n = blocks.groupBy(lesson).agg(F.count("*").alias("n_blocks"))
    out = lessons.join(n, lesson, "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0).cast("long")))
    return out.withColumn("status", F.when(F.col(confirmed), "confirmed").when(F.col("n_blocks") > 0, "pending").otherwise("no_blocks"))


def structural_neighbours(primaries: DataFrame, lessons: DataFrame) -> DataFrame:
    """key, lesson: of each primary (key, volume, lesson, unit, no) itself, the lessons of its unit and those within NUMBER_RADIUS of its number, in its volume. lessons: volume, lesson, unit, no."""
    p = primaries.select("key", "volume", F.col("lesson").alias("of"), F.col("unit").alias("p_unit"), F.col("no").alias("p_no"))
    near = F.abs(F.coalesce("no", F.lit(0)) - F.coalesce("p_no", F.lit(0))) <= NUMBER_RADIUS
    return p.join(lessons.select("volume", "lesson", "unit", "no"), "volume").filter((F.col("lesson") == F.col("of")) | F.col("unit").eqNullSafe(F.col("p_unit")) | near).select("key", "lesson").distinct()


def prescan_neighbours(matches: DataFrame, lessons: DataFrame) -> DataFrame:
    """new, lesson: the neighbours of the first COARSE_RANKS old lessons of each new one, once. matches: new, lesson, rank."""
    first = Window.partitionBy("new").orderBy("rank", "lesson")
    top = matches.filter("lesson IS NOT NULL").withColumn("k", F.row_number().over(first)).filter(F.col("k") <= COARSE_RANKS)
    p = top.select(F.col("new").alias("key"), "lesson").join(lessons, "lesson").select("key", "volume", "lesson", "unit", "no")
    return structural_neighbours(p, lessons).select(F.col("key").alias("new"), "lesson")


def claims(blocks: DataFrame) -> DataFrame:
    """ref, by_lesson, by_block: who first claimed each old block. blocks: place (in order), lesson, block, refs."""
    r = blocks.select("place", "lesson", "block", F.posexplode("refs").alias("at", "ref")).filter(F.trim("ref") != "")
    return r.groupBy(F.trim("ref").alias("ref")).agg(F.min_by(F.struct("lesson", "block"), F.struct("place", "at")).alias("x")).select("ref", F.col("x.lesson").alias("by_lesson"), F.col("x.block").alias("by_block"))


def claimed_rows(rows: DataFrame, claimed: DataFrame, paired: Column, current: Column) -> DataFrame:
    """Old blocks (ref, lesson, name, ...) with same_lesson, kind, locked (another lesson's) and used (the current lesson's)."""
    out = rows.join(claimed, "ref", "left")
    mine = F.col("by_lesson") == current
    return out.withColumns({"same_lesson": F.coalesce(F.col("lesson") == paired, F.lit(False)), "kind": D.block_kind(F.col("name"), F.lit("")), "locked": F.coalesce(~mine, F.lit(False)), "used": F.coalesce(mine, F.lit(False))})


def searched(rows: DataFrame, words: str, columns: list[str], order: list, limit: int | None = 500) -> DataFrame:
    """Rows that have the words in any of the columns, whatever the case, the first `limit` (1000 at most; None: all of them) in order."""
    blob = F.lower(F.concat_ws(" ", *[_filled(F.col(c).cast("string")) for c in columns]))
    found = rows.filter(F.contains(blob, F.lit(words.strip().lower()))) if words.strip() else rows
    return found.orderBy(*order) if limit is None else found.orderBy(*order).limit(min(limit, 1000))


def kind_match(a: Column, b: Column) -> Column:
    x, y = D.block_kind(a, F.lit("")), D.block_kind(b, F.lit(""))
    return F.when((x == y) & (x != "other"), 1.0).otherwise(0.0)


def _share(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def name_similarity(a: Column, b: Column) -> Column:
    """Shared keywords and characters of two block names."""
    words = lambda c: F.filter(F.array(*map(F.lit, NAME_WORDS)), lambda w: F.contains(_filled(c), w))
    bare = lambda c: S.chars(F.replace(_filled(c), F.lit(" "), F.lit("")))
    return F.when((_filled(a) == "") | (_filled(b) == ""), F.lit(0.0)).otherwise(WORDS_SHARE * _share(words(a), words(b)) + (1 - WORDS_SHARE) * _share(bare(a), bare(b)))


def query_similarity(query: Column, text: Column) -> Column:
    """How well a text answers a query: containment, else shared characters and names."""
    q, t = (F.lower(F.replace(_filled(c), F.lit(" "), F.lit(""))) for c in (query, text))
    alike = CHARS_SHARE * _share(S.chars(q), S.chars(t)) + NAME_SHARE * name_similarity(query, text)
    return F.when((q == "") | (t == ""), F.lit(0.0)).when(F.contains(t, q) | F.contains(q, t), CONTAINED).otherwise(alike)


def suggestion_score(query: Column, hint: Column, unit_no: Column, row: dict[str, Column]) -> Column:
    """row: text, name, unit_no, same_lesson, locked, used. 0 if locked, at most 1, 3 places."""
    score = query_similarity(query, row["text"]) + F.when(row["same_lesson"], SAME_LESSON).when(row["unit_no"] == unit_no, SAME_UNIT).otherwise(0.0)
    score += F.when((_filled(hint) != "") & (kind_match(hint, row["name"]) >= 1), SAME_KIND).otherwise(0.0)
    score *= F.when(row["used"], USED).otherwise(1.0)
    return F.when(row["locked"], F.lit(0.0)).otherwise(F.round(F.least(F.lit(1.0), score), 3))


def ordered_groups(matches: DataFrame, new: str, old: str, order: str) -> DataFrame:
    """new block, old_blocks (different, in their lesson's order) and whether these follow each other without gaps. Empty ids don't count."""
    m = matches.filter((F.trim(_filled(F.col(new))) != "") & (F.trim(_filled(F.col(old))) != "")).select(F.trim(new).alias(new), F.trim(old).alias("code"), F.col(order).alias("place")).distinct()
    g = m.groupBy(new).agg(F.sort_array(F.collect_set(F.struct("place", "code"))).alias("x"))
    steps = F.transform(F.sequence(F.lit(1), F.size("x")), lambda i: F.coalesce(F.get("x", i)["place"] - F.get("x", i - 1)["place"] <= 1, F.lit(True)))
    return g.select(new, F.transform("x", lambda x: x["code"]).alias("old_blocks"), F.forall(steps, lambda s: s).alias("contiguous"))


def by_number(new: DataFrame, old: DataFrame) -> DataFrame:
    """id, old_id: the old lesson of the same number; of several that of the same unit number, unit title, or begin of it, else the first. new: id, no, unit_no, unit; old: old_id, place too."""
    n = new.select("id", F.trim(_filled(F.col("no"))).alias("no"), F.col("unit_no").alias("u"), T.norm_text(F.col("unit")).alias("t")).filter("no <> ''")
    o = old.select("old_id", "place", F.trim(_filled(F.col("no"))).alias("no"), F.col("unit_no").alias("v"), T.norm_text(F.col("unit")).alias("s"))
    rule = F.when(F.col("u") == F.col("v"), 0).when((F.col("t") != "") & (F.col("t") == F.col("s")), 1).when((F.col("t") != "") & F.startswith("s", F.substring("t", 1, 4)), 2).otherwise(3)
    first = Window.partitionBy("id").orderBy("rule", "place", "old_id")
    return n.join(o, "no").withColumn("rule", rule).withColumn("k", F.row_number().over(first)).filter("k = 1").select("id", "old_id")


def best_blocks(scores: DataFrame, atom: str, block: str, score: str, least: float = 0.0) -> DataFrame:
    """The best old block of each atom (of equals the smaller code), if it reaches `least`."""
    top = scores.groupBy(F.col(atom).alias("of")).agg(F.max(score).alias("top"))
    return scores.join(top, (F.col(atom) == F.col("of")) & (F.col(score) == F.col("top"))).filter(F.col("top") >= least).groupBy(atom).agg(F.min(block).alias(block), F.max("top").alias(score))


def voted_blocks(assigned: DataFrame, unit: str, block: str) -> DataFrame:
    """The block that most of a unit's atoms were assigned to."""
    return most_frequent(assigned.filter(F.col(block).isNotNull()), unit, block)


def reuse_report(matches: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """how (matched, old_only, new_only), old_id, new_id, names: block matches with both sides, and the blocks of either side without one."""
    o, n = old.select(F.col("id").alias("old_id"), F.col("name").alias("old_name")), new.select(F.col("id").alias("new_id"), F.col("name").alias("new_name"))
    both = matches.select("old_id", "new_id").join(o, "old_id", "left").join(n, "new_id", "left").withColumn("how", F.lit("matched"))
    lone = lambda side, key, how: side.join(matches.select(key).filter(F.col(key).isNotNull()), key, "left_anti").withColumn("how", F.lit(how))
    out = both.unionByName(lone(o, "old_id", "old_only"), allowMissingColumns=True).unionByName(lone(n, "new_id", "new_only"), allowMissingColumns=True)
    return out.select("how", "old_id", "new_id", "old_name", "new_name")


def _file_forms(filename: Column) -> dict[str, Column]:
    """What a file's score needs of its name alone: lower case without and with blanks, pairs of numbers, its normalised variants (a repeated one is empty)."""
    low = F.lower(filename)
    stem = T.stripped(F.regexp_replace(filename, r"(?i)\.zip$", ""))
    clean = T.stripped(F.regexp_replace(stem, FILE_NOISE, ""))
    spaced = T.stripped(F.regexp_replace(F.regexp_replace(clean, r"[_\-]+", " "), r"\s+", " "))
    pair = F.regexp_extract_all(filename, F.lit(r"(?<!\d)\d{1,2}\s*[-_.、]\s*\d{1,2}(?!\d)"), F.lit(0))
    numbers = F.transform(pair, lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).cast("int").alias("unit"), F.regexp_extract(p, r"(\d+)$", 1).cast("int").alias("no")))
    variants = F.array_distinct(F.array(*[T.norm_lesson_title(x) for x in (stem, clean, spaced)]))
    return {"low": low, "close": F.replace(low, F.lit(" "), F.lit("")), "numbers": numbers, "variants": variants}


def _lesson_forms(lesson: dict[str, Column]) -> dict[str, Column]:
    """What a file's score needs of the lesson alone."""
    no, name = T.stripped(lesson["no"]), T.stripped(lesson["name"])
    label = F.when(no != "", T.stripped(F.concat_ws(" ", no, name))).otherwise(name)
    tokens = F.array(*[F.concat(lesson["unit_no"].cast("string"), F.lit(sep), no) for sep in ("-", "_", ".", "、")])
    return {
        "course": F.lower(T.stripped(lesson["course_id"])), "numbered": no.rlike(r"^\d+$") & (lesson["unit_no"] > 0), "at": F.struct(lesson["unit_no"].alias("unit"), no.try_cast("int").alias("no")), "tokens": tokens,
        "bare": T.norm_lesson_title(F.coalesce(F.nullif(T.strip_lesson_seq(name), F.lit("")), name)), "label": T.norm_lesson_title(label), "titled": T.norm_lesson_title(F.concat_ws(" ", lesson["unit"], label)),
    }


def _fit(f: dict[str, Column], l: dict[str, Column]) -> Column:
    score = F.when(l["numbered"] & F.coalesce(F.exists(f["numbers"], lambda p: (p["unit"] == l["at"]["unit"]) & (p["no"] == l["at"]["no"])), F.lit(False)), 0.98).otherwise(0.0)
    score = F.greatest(score, F.when(l["numbered"] & F.exists(l["tokens"], lambda x: F.contains(f["close"], x)), 0.96).otherwise(0.0))
    for i in range(3):
        v = F.coalesce(F.get(f["variants"], F.lit(i)), F.lit(""))
        inside = (l["bare"] != "") & (v != "") & (F.contains(v, l["bare"]) | F.contains(l["bare"], v))
        score = F.greatest(score, F.when(inside, 0.94).otherwise(0.0))
        for other in (l["label"], l["titled"]):
            score = F.greatest(score, F.when((v != "") & (other != ""), S.token_set(v, other)).otherwise(0.0))
    return F.when((l["course"] != "") & F.contains(f["low"], l["course"]), F.lit(1.0)).otherwise(score)


def file_score(filename: Column, lesson: dict[str, Column]) -> Column:
    """How well a courseware file's name fits a lesson (course_id, unit_no, unit, no, name)."""
    return _fit(_file_forms(filename), _lesson_forms(lesson))


def file_candidates(files: DataFrame, lessons: DataFrame) -> DataFrame:
    """pool, file, lesson, score: files and lessons of the same pool (a volume), scored. files: pool, file; lessons: pool, lesson, course_id, unit_no, unit, no, name.

    Names are normalised once a file and once a lesson, before they are paired, and a pair's score is made once, whatever filters follow.
    """
    of_file, of_lesson = _file_forms(F.col("file")), _lesson_forms({c: F.col(c) for c in ("course_id", "unit_no", "unit", "no", "name")})
    both = files.select("pool", "file", *[v.alias(f"f_{k}") for k, v in of_file.items()]).join(lessons.select("pool", "lesson", *[v.alias(f"l_{k}") for k, v in of_lesson.items()]), "pool")
    score = F.round(_fit({k: F.col(f"f_{k}") for k in of_file}, {k: F.col(f"l_{k}") for k in of_lesson}), 4)
    return settled(both.select("*", score.alias("made")), score=F.col("made")).filter("score > 0").select("pool", "file", "lesson", "score")


def ranked_files(candidates: DataFrame, top: int = FILE_TOP) -> DataFrame:
    first = Window.partitionBy("pool", "file").orderBy(F.desc("score"), "lesson")
    return candidates.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)


def assigned_files(candidates: DataFrame, least: float = FILE_LEAST) -> DataFrame:
    """One lesson per file and one file per lesson in each pool, the best scores first."""
    return greedy_assignment(candidates, "pool", "file", "lesson", "score", least)


def _book_stem(file: Column) -> Column:
    return F.trim(F.regexp_replace(_filled(file), r"(?i)\.pdf$", ""))


def _book_clean(stem: Column) -> Column:
    t = F.regexp_replace(F.translate(stem, "【】[]", "    "), BOOK_NOISE, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[_\-·.]+", " "), r"\s+", " "))


def _book_names(file: Column) -> Column:
    stem = _book_stem(file)
    return F.struct(stem.alias("stem"), _book_clean(stem).alias("clean"))


def grade_and_term(file: Column) -> Column:
    """grade and term out of a textbook file's name: of a volume's code, else as they are written; null if neither is there."""
    return T.let(_book_names(file), _grade_and_term)


def _grade_and_term(names: Column) -> Column:
    stem = names["stem"]
    shape = lambda grade, term: F.struct(grade.alias("grade"), term.alias("term"))
    grade, sem = F.regexp_extract(stem, BOOK_CODE, 2).try_cast("int"), F.upper(F.regexp_extract(stem, BOOK_CODE, 3))
    found = [F.when(grade.isNotNull(), shape(grade, F.when(sem == "S", "上").otherwise("下")))]
    read = lambda of: lambda m: F.when((m["term"] != "") & (of(m["g"]) > 0), shape(of(m["g"]), m["term"]))
    for pattern, chinese in GRADES:
        of = (lambda g: T.cn_numeral(g).cast("int")) if chinese else (lambda g: g.try_cast("int"))
        for t in (names["clean"], stem):
            found.append(T.let(F.struct(F.regexp_extract(t, pattern, 1).alias("g"), F.regexp_extract(t, pattern, 2).alias("term")), read(of)))
    return F.coalesce(*found)


def edition_evidence(file: Column, label: Column, prefix: Column) -> Column:
    """How a file's name speaks for an edition: 1 by code or label, less by a short name, 0.55 if it says nothing, 0 if it names another."""
    return T.let(_book_names(file), lambda n: T.let(F.struct(F.concat_ws(" ", n["stem"], n["clean"]).alias("text"), F.upper(F.regexp_extract(n["stem"], BOOK_CODE, 1)).alias("code")), lambda x: _evidence(x["text"], x["code"], label, prefix)))


def _evidence(text: Column, code: Column, label: Column, prefix: Column) -> Column:
    l = F.trim(_filled(label))
    short = F.replace(F.replace(l, F.lit("版"), F.lit("")), F.lit("社"), F.lit(""))
    alias, other = F.lit(False), F.lit(False)
    for name, aliases in EDITIONS.items():
        alias = alias | ((l == name) & T.has_any(F.lower(text), aliases))
        other = other | ((l != name) & T.has_any(text, [name.replace("版", "")]))
    return (
        F.when(code != "", F.when(code == F.upper(F.trim(_filled(prefix))), 1.0).otherwise(0.0)).when((l != "") & F.contains(text, l), 1.0)
        .when((F.length(short) >= 2) & F.contains(text, short), 0.95).when(alias, 0.9).when(other, 0.0).otherwise(0.55)
    )


def book_score(file: Column, code: Column, grade: Column, term: Column, label: Column, prefix: Column, title: Column, known: Column | None = None, plain: Column | None = None) -> Column:
    """How well a textbook file's name fits a volume; known and plain: its grade_and_term and plain_title where they are at hand."""
    shown = F.coalesce(F.nullif(_filled(title), F.lit("")), F.concat(_filled(label), grade.cast("string"), F.lit("年级"), term, F.lit("册")))
    made = F.struct((grade_and_term(file) if known is None else known).alias("known"), S.token_set(plain_title(file) if plain is None else plain, T.norm_text(shown)).alias("ratio"), edition_evidence(file, label, prefix).alias("said"))  # 0 if a side is empty
    by_code = (_filled(code) != "") & F.contains(F.upper(_book_stem(file)), F.upper(_filled(code)))

    def judged(m: Column) -> Column:
        by_edition = F.when(m["said"] <= 0, 0.0).when(m["said"] < 0.8, UNSAID).when(m["said"] >= 0.9, SURE).otherwise(LIKELY)
        fits = (m["known"]["grade"] == grade) & (m["known"]["term"] == term)
        return F.when(by_code, 1.0).when(m["known"].isNull(), F.when(m["ratio"] >= BOOK_LEAST, m["ratio"] * BY_TITLE).otherwise(0.0)).when(fits, by_edition).otherwise(0.0)

    return T.let(made, judged)


def plain_title(file: Column) -> Column:
    """A textbook file's name as a title is compared."""
    return T.norm_text(_book_clean(_book_stem(file)))


def assigned_books(files: DataFrame, volumes: DataFrame) -> DataFrame:
    """pool, file, code, score: one volume per file and one file per volume in each pool. files: pool, file; volumes: pool, code, grade, term, label, prefix, title."""
    named = settled(files.withColumns({"known": grade_and_term(F.col("file")), "plain": plain_title(F.col("file"))}), known_=F.col("known"), plain_=F.col("plain"))  # once a file, not once a pair
    both = named.join(volumes, "pool").withColumn("made", book_score(*[F.col(c) for c in ("file", "code", "grade", "term", "label", "prefix", "title")], F.col("known_"), F.col("plain_")))
    both = settled(both, score=F.col("made"))
    return greedy_assignment(both.select("pool", "file", "code", "score"), "pool", "file", "code", "score", BOOK_LEAST)


def atom_block_score(likeness: Column, has_query: Column, y: Column, old_y: Column, image: Column, label: Column) -> Column:
    """How well a new atom fits an old block: text and place, by place alone without a text, mostly by place for pictures."""
    place = F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(y - old_y) * 2.5), F.lit(0.0))
    mixed = F.when(image, F.when(label, 0.40 * likeness + 0.60 * place).otherwise(0.15 * likeness + 0.85 * place)).otherwise(0.72 * likeness + 0.28 * place)
    return F.when(has_query, mixed).otherwise(0.5 * place)


def block_fit(scores: DataFrame, block: str, reference: str, score: str) -> DataFrame:
    """The mean score of a block's atoms for each old block it refers to, and the best of them."""
    mean = scores.groupBy(block, reference).agg(F.avg(score).alias("mean"))
    return mean.groupBy(block).agg(F.max("mean").alias("fit"))
