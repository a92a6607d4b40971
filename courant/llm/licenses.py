"""License scans: phrases, and an exact set-similarity join with license notices, without Python.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
A text block is a window of WINDOW words, one every STRIDE words; any notice of
the list fits into one whole. A block matches a notice that has at least
`containment` of its distinct words in the block.

The join is exact and filtered: words of the notices are ordered by their
frequency in all texts, rarest first. A match needs a common word among the
first n - a + 1 words of either side (n: its words known to the notices, a:
the overlap needed), blocks with fewer than a known words are left out, and
the places of the first common word must leave room for a words.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courant.functions.urls import let

WINDOW, STRIDE, CONTAINMENT = 64, 32, 0.9

# The phrases of the base labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Characteristic sentences of public licenses, at most STRIDE words each.
NOTICES = {
    "agpl": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "apache": "licensed under the Apache License Version 2.0 you may not use this file except in compliance with the License",
    "apache-2.0": "licensed under the Apache License, Version 2.0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided"
           " that the following conditions are met",
    "cc-by-nc": "licensed under CC BY-NC 4.0",
    "cc-by-sa": "licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
    "gpl": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"
           " the Free Software Foundation",
    "gpl-3.0": "this work is licensed under the GNU General Public License, version 3",
    "isc": "permission to use copy modify and/or distribute this software for any purpose with or without fee is"
           " hereby granted",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and"
           " associated documentation files to deal in the software without restriction",
    "mpl": "this source code form is subject to the terms of the Mozilla Public License v. 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), _BETWEEN), "")


def plain_words(text: str) -> list[str]:
    """The same for a text of ASCII characters on the driver."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def phrase_places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand in a row."""
    first, *rest = phrase.split(" ")

    def at(i: Column) -> Column:
        found = F.get(words, i) == first
        for k, word in enumerate(rest, 1):
            found = found & F.coalesce(F.get(words, i + k) == word, F.lit(False))
        return found

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), at)


def _base(text: Column, words: Column, phrases: Mapping[str, str]) -> Column:
    """array(struct(label, places)): only labels that are there; the phrase is looked for where its first word is."""
    low = lowered(text)
    found = [
        F.struct(
            F.lit(label).alias("label"),
            F.when(
                F.contains(low, F.lit(phrase.split(" ")[0])) & F.contains(low, F.lit(phrase.split(" ")[-1]))
                & (F.size(words) > 0), phrase_places(words, phrase),
            ).otherwise(F.array().cast("array<int>")).alias("places"),
        )
        for phrase, label in phrases.items()
    ]
    return F.filter(F.array(*found), lambda x: F.size(x["places"]) > 0)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES,
    notices: Mapping[str, str] = NOTICES, containment: float = CONTAINMENT,
) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    `matches` lists struct(label, block, shared, containment) of every block and
    notice that match; the score is 1 with a phrase, else the best containment
    matched, else 0. A null text counts as empty: no words, no labels, score 0. Rows equal in id
    and text count as one document and get the same. Other columns of `docs`
    are not looked at.
    """
    spark = docs.sparkSession
    sets = {label: sorted(set(plain_words(text))) for label, text in notices.items()}
    if any(len(plain_words(text)) > STRIDE for text in notices.values()):
        raise ValueError(f"a notice has more than {STRIDE} words")
    known = sorted({w for s in sets.values() for w in s})
    if any(not w.isascii() for w in known):
        raise ValueError("notices are ASCII texts")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("mark", F.xxhash64("text"))
    known_array = F.array(*[F.lit(w) for w in known])
    # Frequencies of the notices' words in all texts: as many rows as there are such words.
    counted = (
        rows.select(F.explode(F.array_intersect(words_of(F.col("text")), known_array)).alias("word"))
        .groupBy("word").agg(F.count("*").alias("n")).collect()
    )
    often = {r["word"]: r["n"] for r in counted}
    order = sorted(known, key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    need = {label: max(1, math.ceil(containment * len(s) - 1e-9)) for label, s in sets.items()}
    prefix = []
    for label, s in sets.items():
        first = sorted(s, key=rank.get)[: len(s) - need[label] + 1]
        prefix += [(w, label, j, len(s), need[label]) for j, w in enumerate(first)]
    values = ", ".join(f"('{w}', '{label}', {j}, {n}, {a})" for w, label, j, n, a in prefix)
    wanted = spark.sql(f"SELECT * FROM VALUES {values} AS t(word, label, j, size, need)")
    rarest = F.array(*[F.lit(w) for w in sorted({p[0] for p in prefix})])
    ordered = F.array(*[F.lit(w) for w in order])
    least = min(need.values())
    key = ["doc_id", "mark"]

    def block(words: Column, start: Column) -> Column:
        return F.array_intersect(ordered, F.slice(words, start + 1, F.lit(WINDOW)))

    blocks = (
        rows.select(*key, words_of(F.col("text")).alias("words"))
        .where(F.arrays_overlap("words", rarest))
        .select(*key, let(F.col("words"), lambda w: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - STRIDE - 1, F.lit(0)), F.lit(STRIDE)),
            lambda s: block(w, s),
        )).alias("blocks"))
        .select(*key, F.posexplode("blocks").alias("block", "has"))
        .where(F.size("has") >= least)
    )
    tokens = blocks.select(*key, "block", "has", F.posexplode("has").alias("i", "word"))
    found = tokens.join(F.broadcast(wanted), "word").where(
        "size(has) >= need AND i <= size(has) - need AND least(size(has) - i, size - j) >= need"
    ).select(*key, "block", "has", "label", "size", "need").distinct()
    own = F.create_map(*[
        x for label, s in sets.items() for x in (F.lit(label), F.array(*[F.lit(w) for w in s]))
    ])
    shared = F.size(F.array_intersect("has", F.element_at(own, F.col("label"))))
    matched = (
        found.withColumn("shared", shared).where("shared >= need")
        .select(*key, F.struct("label", "block", "shared", (F.col("shared") / F.col("size")).alias("containment")).alias("m"))
        .groupBy(F.col("doc_id").alias("id_"), F.col("mark").alias("mark_"))
        .agg(F.sort_array(F.collect_set("m")).alias("matches"))
    )
    counts = rows.select(*key, words_of(F.col("text")).alias("words"), "text").select(
        *key, F.size("words").cast("long").alias("n_words"),
        _base(F.col("text"), F.col("words"), phrases).alias("base"),
    )
    counts = counts.withColumn("places", F.flatten("base.places"))
    labels = F.coalesce(F.col("matches.label"), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max("matches.containment"), F.lit(0.0))

    def joined(names: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(names)), ",")

    same = counts["doc_id"].eqNullSafe(matched["id_"]) & (counts["mark"] == matched["mark_"])
    return counts.join(matched, same, "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat(F.col("base.label"), labels)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"), "matches",
    )
