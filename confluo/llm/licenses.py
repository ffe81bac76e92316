"""Operator 2, licence scans: positional rare-token index.

Licence templates are indexed by word and position.  Document frequencies of the
templates' words over the whole corpus give their inverse document frequencies.  For
each file and template the template's words in the file are looked up, the highest
first; each relative position that a posting of any of them gives and that leaves the
first mandatory phrase inside is an alignment of the template, so no alignment with a
matching word is passed over.  An alignment counts if the words there cover the
template by weight and every mandatory key phrase stands inside it.  All of it is
DataFrame expressions within a row; what is shared is one count per template word, a
number fixed by the templates.

Defined cases: a null or empty text has no words and score 0; a null id stays null;
repeated rows are scanned row by row; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm import common

# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Template labels, notices and mandatory key phrases.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "you may not use this file except in compliance with the license", ("in compliance with the license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted", "free of charge")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "binary forms")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", ("general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("reserved", "all rights reserved", ("all rights reserved",)),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Least cover.
COVER = 0.8


def normal_words(text: Column) -> Column:
    """The words of a text, joined by single spaces."""
    return F.trim(F.regexp_replace(common.ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS, " "))


def _strings(words) -> Column:
    return F.split(F.lit(" ".join(words)), " ") if words else F.array().cast("array<string>")


def vocabulary() -> list[str]:
    return sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})


def inverse_frequencies(docs: DataFrame) -> dict[str, float]:
    """log((1 + N) / (1 + df)) of each template word, over all documents."""
    words = docs.select(F.split(normal_words(F.col("text")), " ").alias("w"))
    marked = words.select(F.explode(F.concat(F.array_intersect("w", _strings(vocabulary())), F.array(F.lit("")))).alias("word"))
    count = {r["word"]: r["n"] for r in marked.groupBy("word").agg(F.count("*").alias("n")).collect()}
    n = count.pop("", 0)
    return {w: math.log((1 + n) / (1 + count.get(w, 0))) + 1e-3 for w in vocabulary()}


def _places(words: Column, phrase: list[str]) -> Column:
    at = F.sequence(F.lit(0), F.size(words) - len(phrase))
    same = lambda i: [F.get(words, i + k) == w for k, w in enumerate(phrase)]

    def all_of(i):
        out = same(i)[0]
        for c in same(i)[1:]:
            out = out & c
        return out

    return F.filter(at, all_of)


def _alignments(words: Column, hits: Column, notice: list[str], idf: dict[str, float], mandatory: tuple[str, ...]) -> Column:
    """Best cover of one template over its alignments in the file, 0 if none."""
    own = sorted(set(notice), key=lambda w: (-idf[w], w))
    looked = F.array_intersect(_strings(own), words)
    phrase = mandatory[0].split()

    def offsets(word: Column) -> Column:
        lists = None
        for w in own:
            at = F.array(*[F.lit(i) for i, x in enumerate(notice) if x == w])
            lists = F.when(word == w, at) if lists is None else lists.when(word == w, at)
        mine = F.filter(hits, lambda h: h["w"] == word)
        return F.array_distinct(F.flatten(F.transform(mine, lambda h: F.transform(lists, lambda q: h["i"] - q))))

    inside = F.array_distinct(F.flatten(F.transform(_places(words, phrase), lambda p: F.sequence(p - (len(notice) - len(phrase)), p))))
    proposed = F.array_intersect(inside, F.flatten(F.transform(looked, offsets)))
    weights = F.split(F.lit(",".join(f"{idf[w]:.12g}" for w in notice)), ",").cast("array<double>")
    total = sum(idf[w] for w in notice)
    template = _strings(notice)

    def cover(o: Column) -> Column:
        window = F.transform(F.sequence(F.lit(0), F.lit(len(notice) - 1)), lambda j: F.when(o + j >= 0, F.get(words, o + j)))
        matched = F.aggregate(
            F.arrays_zip(window.alias("a"), template.alias("b"), weights.alias("c")), F.lit(0.0),
            lambda acc, x: acc + F.when(x["a"] == x["b"], x["c"]).otherwise(0.0),
        )
        joined = F.concat(F.lit(" "), F.array_join(window, " "), F.lit(" "))
        verified = F.lit(True)
        for phrase in mandatory:
            verified = verified & F.contains(joined, F.lit(f" {phrase} "))
        return F.when(verified, matched / total).otherwise(0.0)

    return F.coalesce(F.when(F.size(looked) > 0, F.array_max(F.transform(proposed, cover))), F.lit(0.0))


def license_scan(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    idf = inverse_frequencies(docs)
    d = docs.withColumn("_norm", normal_words(F.col("text")))
    padded = F.concat(F.lit(" "), F.col("_norm"), F.lit(" "))
    phrases = list(dict.fromkeys([p for p, _ in BASE] + [p for *_, m in TEMPLATES for p in m]))
    candidate = F.lit(False)
    for p in phrases:
        candidate = candidate | F.contains("_padded", F.lit(f" {p} "))
    d = d.withColumn("_padded", padded).withColumn("_words", F.when(candidate, F.split("_norm", " ")))
    words = F.col("_words")
    for k, (phrase, _) in enumerate(BASE):
        d = d.withColumn(f"_b{k}", F.when(words.isNotNull() & F.contains("_padded", F.lit(f" {phrase} ")), _places(words, phrase.split())).otherwise(F.array().cast("array<int>")))
    places = F.concat(*[F.col(f"_b{k}") for k in range(len(BASE))])
    d = d.withColumn("_hits", F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(_strings(vocabulary()), x["w"])))
    for k, (_, notice, mandatory) in enumerate(TEMPLATES):
        worth = words.isNotNull()
        for p in mandatory:
            worth = worth & F.contains("_padded", F.lit(f" {p} "))
        d = d.withColumn(f"_t{k}", F.when(worth, _alignments(words, F.col("_hits"), notice.split(), idf, mandatory)).otherwise(0.0))
    based = F.array_compact(F.array(*[F.when(F.size(f"_b{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    found = F.array_compact(F.array(*[F.when(F.col(f"_t{k}") >= COVER, F.lit(label)) for k, (label, *_) in enumerate(TEMPLATES)]))
    best = F.greatest(*[F.col(f"_t{k}") for k in range(len(TEMPLATES))])
    n_words = F.when(F.col("_norm") == "", 0).otherwise(F.length("_norm") - F.length(F.replace("_norm", F.lit(" "), F.lit(""))) + 1)
    added = {
        "n_words": n_words.cast("long"),
        "n_base": F.size(places).cast("long"),
        "first_word": F.array_min(places).cast("long"),
        "last_word": F.array_max(places).cast("long"),
        "base_labels": F.array_join(F.array_sort(F.array_distinct(based)), ","),
        "labels": F.array_join(F.array_sort(F.array_distinct(F.concat(based, found))), ","),
        "score": F.when(F.size(places) > 0, 1.0).otherwise(F.least(best, F.lit(1.0))),
    }
    return d.select(*[c for c in docs.columns if c not in added], *[c.alias(n) for n, c in added.items()])


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
