"""License scans with a positional index of rare template words, all in DataFrame functions.

The index has a posting (template, place) for each word of a template. Of each file and template the template's words
that are in the file are looked up, those with the highest inverse document frequency first; a posting and a place in the
file fix where the template would begin, and the begins that half of the looked-up postings agree on are candidates. A
candidate counts if every mandatory key phrase of its template stands where the template has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, plain
from .decontam import item_words

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Passages of public licences and notices, as words, and the key phrases that must be there, all of them.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        ["permission is hereby granted free of charge", "without limitation the rights", "shall be included in all copies or substantial portions of the software"],
    ),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ["apache license version 2 0", "except in compliance with the license", "without warranties or conditions of any kind"],
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ["redistribution and use in source and binary forms", "redistributions of source code must retain", "redistributions in binary form must reproduce"],
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    (
        "gpl",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        ["without even the implied warranty of merchantability", "gnu general public license for more details"],
    ),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    (
        "unlicense",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ["anyone is free to copy modify publish use compile sell or distribute this software", "commercial or non commercial and by any means"],
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software for any purpose with or without fee"]),
]
#: The least number and share of looked-up postings that must agree on where a template begins.
AGREE, SHARE = 2, 0.5


def licence_words() -> list[str]:
    """The words of templates and base phrases: bounded, whatever the corpus."""
    return sorted({w for _, t, _ in TEMPLATES for w in t.split()} | {w for p in BASE for w in p.split()})


def places(words: Column, phrase: list[str]) -> Column:
    """Places (from 0) where the phrase's words stand one after the other."""
    first = F.filter(F.transform(words, lambda w, i: F.when(w == phrase[0], i)), lambda i: i.isNotNull())
    rest = lambda i: F.slice(words, i + 1, len(phrase)) == F.array(*map(F.lit, phrase))
    return F.filter(first, rest)


def postings(spark) -> DataFrame:
    """word -> template, offset: bounded by the templates above."""
    rows = [(w, n, o) for n, (_, t, _) in enumerate(TEMPLATES) for o, w in enumerate(t.split())]
    return spark.createDataFrame(rows, "word string, template int, offset int")


def _words(phrase: str) -> Column:
    return F.array(*map(F.lit, phrase.split()))


def _checks() -> Column:
    """template, label and its mandatory phrases with their places in it."""
    out = []
    for n, (label, t, phrases) in enumerate(TEMPLATES):
        words = t.split()
        must = []
        for p in phrases:
            pw = p.split()
            o = next(i for i in range(len(words)) if words[i : i + len(pw)] == pw)
            must.append(F.struct(F.lit(o).alias("o"), F.array(*map(F.lit, pw)).alias("phrase")))
        out.append(F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.array(*must).alias("must")))
    return F.array(*out)


def candidates(some: DataFrame, counts: DataFrame) -> DataFrame:
    """rid, candidates (array of template, begin, share). some: rid, w (words), has (its licence words); counts: word, files."""
    spark = some.sparkSession
    rarity = counts.agg(F.sort_array(F.collect_list(F.struct("files", "word"))).alias("rarity"))  # one row, as long as the vocabulary
    ranked = some.crossJoin(F.broadcast(rarity)).withColumn("ordered", F.array_intersect(F.transform("rarity", lambda r: r["word"]), "has"))
    of = []
    for n, (_, t, phrases) in enumerate(TEMPLATES):
        own = sorted(set(t.split()))
        must = F.array(*map(F.lit, sorted({w for p in phrases for w in p.split()})))
        of.append(F.when(F.size(F.array_except(must, "has")) == 0, F.struct(F.lit(n).alias("template"), F.array_intersect(F.col("ordered"), F.array(*map(F.lit, own))).alias("words"))))
    # of a template whose key phrases' words are all in the file, the rarest words, most of those there: as many as bear the vote
    looks = F.transform(F.array_compact(F.array(*of)), lambda x: F.struct(x["template"].alias("template"), F.slice(x["words"], F.lit(1), F.greatest(F.lit(8), F.ceil(F.size(x["words"]) * 0.7).cast("int"))).alias("words")))
    chosen = ranked.select("rid", "w", looks.alias("looks")).filter(F.size("looks") > 0)
    chosen = chosen.withColumn("look", F.array_distinct(F.flatten(F.transform("looks", lambda t: t["words"]))))
    # where each looked-up word stands, and where its templates would begin
    at = chosen.select("rid", "looks", F.explode(F.filter(F.transform("w", lambda x, i: F.when(F.array_contains(F.col("look"), x), F.struct(x.alias("word"), i.alias("p")))), lambda x: x.isNotNull())).alias("x"))
    index = postings(spark)
    mine = F.exists("looks", lambda t: (t["template"] == F.col("template")) & F.array_contains(t["words"], F.col("word")))
    begins = at.join(F.broadcast(index), F.col("x.word") == F.col("word")).filter(mine).select("rid", "template", (F.col("x.p") - F.col("offset")).alias("begin"))
    votes = begins.groupBy("rid", "template", "begin").agg(F.count("*").alias("agree")).filter(F.col("agree") >= AGREE)
    # how many postings the looked-up words have
    many = chosen.select("rid", F.explode("looks").alias("l")).select("rid", F.col("l.template").alias("template"), F.explode("l.words").alias("word")).join(F.broadcast(index), ["word", "template"])
    many = many.groupBy("rid", "template").agg(F.count("*").alias("looked"))
    shares = votes.join(many, ["rid", "template"]).withColumn("share", F.col("agree") / F.col("looked")).filter(F.col("share") >= SHARE)
    return shares.groupBy("rid").agg(F.collect_list(F.struct("template", "begin", "share")).alias("candidates"))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with n_words, n_base, first_word, last_word, base_labels, labels and score, under names that df doesn't have.

    score: the share of the best verified template's looked-up postings that agree on its place, 1 if only base phrases
    are there, 0 without any label. A null or empty text has no words and no labels. Overlapping phrases all count; a
    template that is there word for word is always found; repeated rows stay; an empty table gives an empty one.
    """
    rest = [c for c in df.columns if c != text]
    named = [*rest, *fresh(df, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")]
    df, names = plain(df)
    text = names[text]
    rid, words = "rid", "its_words"
    rest = [c for c in df.columns if c != text]
    worded = df.select(*rest, item_words(F.col(text)).alias(words))
    worded = worded.withColumn("has", F.array_intersect(F.array(*map(F.lit, licence_words())), words))
    # words are kept of files that have all words of some phrase
    phrases = sorted({*BASE, *(" ".join(ps) for _, _, ps in TEMPLATES)})
    may = F.exists(F.array(*map(_words, phrases)), lambda p: F.size(F.array_except(p, F.col("has"))) == 0)
    read = worded.select(*rest, F.size(words).cast("long").alias("n_words"), "has", F.when(may, F.col(words)).alias(words))
    read = materialise(read.withColumn(rid, F.monotonically_increasing_id()), "licence-words")
    some = read.filter(F.col(words).isNotNull()).select(F.col(rid).alias("rid"), F.col(words).alias("w"), "has")
    # in how many files each licence word is
    counts = materialise(read.select(F.explode("has").alias("word")).groupBy("word").agg(F.count("*").alias("files")), "licence-word-counts")
    there = lambda c: F.filter(
        F.filter(_checks(), lambda k: k["template"] == c["template"]),
        lambda k: F.forall(k["must"], lambda m: (c["begin"] + m["o"] >= 0) & (F.slice(F.col("w"), F.greatest(F.lit(1), c["begin"] + m["o"] + 1), F.size(m["phrase"])) == m["phrase"])),
    )
    verified = F.flatten(F.transform("candidates", lambda c: F.transform(there(c), lambda k: F.struct(k["label"].alias("label"), c["share"].alias("share")))))
    found = some.join(candidates(some, counts), "rid", "left")
    found = found.select("rid", *[places(F.col("w"), p.split()).alias(f"b{i}") for i, p in enumerate(BASE)], F.coalesce(verified, F.array().cast("array<struct<label:string,share:double>>")).alias("verified"))
    starts = F.concat(*[F.col(f"b{i}") for i in range(len(BASE))])
    base = F.array_compact(F.array(*[F.when(F.size(f"b{i}") > 0, label) for i, label in enumerate(BASE.values())]))
    found = found.select("rid", starts.alias("starts"), F.array_sort(F.array_distinct(base)).alias("base"), "verified")
    found = found.select(
        F.col("rid").alias("of"), F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", F.transform("verified", lambda x: x["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("verified", lambda x: x["share"])), F.when(F.size("starts") > 0, 1.0), F.lit(0.0)).alias("score"),
    )
    out = read.drop(words, "has").join(found, F.col(rid) == F.col("of"), "left")
    empty = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return out.select(*rest, "n_words", *[F.coalesce(c, empty[c]).alias(c) if c in empty else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")]).toDF(*named)
