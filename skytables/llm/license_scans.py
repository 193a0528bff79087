"""License notices in texts, by an exact set-similarity join with templates.

A text is cut into overlapping blocks of words. A block meets a template if it holds
at least THRESHOLD percent of the template's distinct words (containment). Only words
that some template has can count, so a block's set is its words out of that vocabulary,
put in the order of how many documents of the whole corpus hold them, rarest first. Then

* length filter: a block with fewer words than the template needs is out;
* prefix filter: of sets of n and s words that share `need`, the first s - need + 1 and
  n - need + 1 words must share one, so only these are joined;
* positional filter: words shared at positions i and j leave no more than
  1 + min(n - i, s - j) to share, which must reach `need`.

A pair is taken at its first common word only, so it comes once, and is verified there.
Phrases are templates that must be met wholly; the places where their words follow each
other are then looked up in the block. Everything is DataFrame functions.

Blocks start every STRIDE words and have BLOCK words, so whatever has BLOCK - STRIDE + 1
words or fewer lies whole in one of them. Long texts give as many blocks as they need.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER, saved, text_or_empty, whole_row

#: A word, before A-Z are lower-cased: no other ASCII than letters and digits (fixed value).
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK, STRIDE = 48, 24
#: Words of a template that a block must hold, in percent.
THRESHOLD = 90


class Template(NamedTuple):
    label: str
    text: str
    phrase: bool = False  # its words must follow each other


#: Phrases and labels of the base check (fixed values).
PHRASES = [
    Template("cc-by", "cc by", True), Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
]
#: Sentences by which licenses are known or named (fixed values).
NOTICES = [
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    Template("copyright", "the copyright holders disclaim all warranties"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose"),
    Template("lgpl", "under the terms of the gnu lesser general public license"),
    Template("mit", "released under the mit license"),
    Template("mit", "licensed under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    Template("no-derivatives", "no part of this publication may be reproduced without the prior written permission of the publisher"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def needed(n: int) -> int:
    """Least number of shared words that is THRESHOLD percent of `n`."""
    return -(-n * THRESHOLD // 100)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def scan(docs: DataFrame, templates: list[Template] = PHRASES + NOTICES, text: str = "text") -> DataFrame:
    """One row per row of `docs`: `_doc` (all its other columns), `n_words`, `places` and `met`.

    `places` has a struct (label, word) for every place of a phrase, `met` a struct
    (label, word, share) for every other template and block that meet, with the block's
    first word, both counted from 0 and in that order. Null text is empty and has none;
    an empty table gives no row; repeated rows give equal rows; a very long text gives
    blocks in proportion. `templates` is a list that the caller writes out; the join
    broadcasts it and nothing else.
    """
    spark = docs.sparkSession
    sets = [dict.fromkeys(words_of(t.text)) for t in templates]
    if any(not 0 < len(words_of(t.text)) <= BLOCK - STRIDE + 1 for t in templates):
        raise ValueError(f"a template has 1 to {BLOCK - STRIDE + 1} words")
    vocabulary = sorted({w for s in sets for w in s})
    raw = text_or_empty(text)
    # lower() also maps a few letters beyond ASCII to it: never fewer words of the vocabulary, and the same bounds of words.
    present = docs.select(F.explode(F.array_intersect(F.lit(vocabulary), _words(F.lower(raw)))).alias("w"))
    held = dict(present.groupBy("w").count().collect())  # a row per word of the templates
    order = sorted(vocabulary, key=lambda w: (held.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    needs = [len(s) if t.phrase else needed(len(s)) for t, s in zip(templates, sets, strict=True)]
    index = []
    for number, (t, s, need) in enumerate(zip(templates, sets, needs, strict=True)):
        by_order = sorted(s, key=place.__getitem__)
        index += [(w, i, number, t.label, t.phrase, len(s), need, by_order, words_of(t.text)) for i, w in enumerate(by_order[:len(s) - need + 1], 1)]
    kind = "token string, i int, template int, label string, phrase boolean, n int, need int, tokens array<string>, template_words array<string>"
    prefixes = F.broadcast(spark.createDataFrame(index, kind))

    first_words = sorted({row[0] for row in index})
    others = docs.drop(text)
    rows = saved(docs.select(
        (whole_row(others) if others.columns else F.struct(F.lit(None).alias("none")).alias("_doc")),
        F.monotonically_increasing_id().alias("_row"), raw.alias("_text"), _words(F.lower(raw)).alias("_words"),
    ).select(
        "_doc", "_row", F.size("_words").cast("bigint").alias("n_words"),
        F.when(F.arrays_overlap("_words", F.lit(first_words)), _words(F.translate("_text", UPPER, LOWER))).alias("words"),
    ), "license-words")

    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("words") - BLOCK) / STRIDE) * STRIDE).cast("int"), F.lit(STRIDE))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, BLOCK).alias("block")))
    blocks = rows.where("words is not null").select("_row", F.explode(cut).alias("b")).select("_row", "b.start", "b.block")
    blocks = blocks.withColumn("own", F.array_intersect(F.lit(order), "block")).withColumn("s", F.size("own"))
    least = min(needs, default=1)
    candidates = blocks.where(F.col("s") >= least).select(
        "*", F.posexplode(F.slice("own", F.lit(1), F.col("s") - least + 1)).alias("at", "token"))
    j, i, s, n, need = F.col("at") + 1, F.col("i"), F.col("s"), F.col("n"), F.col("need")
    filters = (s >= need) & (j <= s - need + 1) & (1 + F.least(n - i, s - j) >= need)
    common = F.array_intersect("own", "tokens")
    pairs = candidates.join(prefixes, "token").where(filters).withColumn("common", common)
    pairs = pairs.where((F.size("common") >= need) & (F.element_at("common", 1) == F.col("token")))
    m = F.size("template_words")
    steps = F.when(F.col("phrase") & (F.size("block") >= m), F.sequence(F.lit(0), F.size("block") - m)).otherwise(F.array())
    places = F.filter(steps, lambda k: F.slice("block", k + 1, m) == F.col("template_words"))
    found = pairs.select(
        "_row", F.transform(places, lambda k: F.struct("label", (k + F.col("start")).cast("bigint").alias("word"), F.col("template"))).alias("p"),
        F.when(~F.col("phrase"), F.struct("label", F.col("start").cast("bigint").alias("word"), (F.size("common") / n).alias("share"))).alias("m"))
    by_row = found.where((F.size("p") > 0) | F.col("m").isNotNull()).groupBy("_row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))).alias("places"), F.array_sort(F.collect_set("m")).alias("met"))
    kinds = {"places": "array<struct<label:string,word:bigint>>", "met": "array<struct<label:string,word:bigint,share:double>>"}
    plain = by_row.select("_row", F.transform("places", lambda x: F.struct(x["label"].alias("label"), x["word"].alias("word"))).alias("places"), "met")
    joined = rows.drop("words").join(plain, "_row", "left")
    return joined.select("_doc", "n_words", *[F.coalesce(c, F.array().cast(k)).alias(c) for c, k in kinds.items()])


def summary(rows: DataFrame) -> list[Column]:
    """Columns n_words, n_base, first_word, last_word, base_labels, labels and score of rows made by `scan`.

    The score is the largest share of a template that a block holds, 1 for a phrase, 0 for nothing.
    """
    words, base, met = F.col("places.word"), F.col("places.label"), F.col("met.label")
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    found = F.when(F.size("places") > 0, 1.0).otherwise(0.0)
    return [
        F.col("n_words"), F.size("places").cast("bigint").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        text(base).alias("base_labels"), text(F.concat(base, met)).alias("labels"),
        F.greatest(found, F.coalesce(F.array_max("met.share"), F.lit(0.0))).alias("score"),
    ]
