"""License scans by an exact set-similarity join with license templates.

A text block is a window of ``BLOCK`` words, a new one every ``STEP`` words, so that any passage of up to
``STEP`` words lies whole in some block. Templates of more words have blocks of their own, twice as long until they fit; a
template is looked for in blocks of its width only. It is found in a block that holds at least ``PERCENT`` per cent
of its distinct words. Words are ordered by their frequency over all documents, rarest first: with
o words to be shared, a block that qualifies must hold one of the template's |T| - o + 1 rarest
(prefix filter), must have o distinct words (length filter), and must have enough words left
behind the first shared one, on both sides (positional filter). What remains is compared in full.

Base phrases are found by the place of their words in the text; they always give their label. Where
a template is found too, its own label is added.

Defined cases: null counts as an empty text; a text without words has no labels and score 0; texts and templates of any length
are taken whole; doc_ids may be null; repeated rows get equal results; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, words_of, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK, STEP, PERCENT = 64, 32, 80
# Phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Notices by which licenses are applied or begin, and their labels.
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
]


def places(words: Column, phrase: str) -> Column:
    """Words from 0 at which the phrase's words stand one after the other."""
    parts = phrase.split()
    ends = F.transform(words, lambda w, i: F.when(w == parts[-1], i - (len(parts) - 1)))
    starts = F.filter(ends, lambda i: i.isNotNull() & (i >= 0))
    return F.filter(starts, lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(parts[:-1])]))


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each template word occurs in all documents: one row a template word."""
    hits = F.filter(words_of(ascii_lower(F.col("text")), WORD), lambda w: w.isin(vocabulary))
    rows = docs.select(F.explode(hits).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.w: r.n for r in rows}


def width_of(template: str) -> int:
    """Words of the blocks in which a template is looked for: the least width whose step holds it whole."""
    width = BLOCK
    while width // BLOCK * STEP < len(template.split()):
        width *= 2
    return width


def prefixes(templates: list[tuple[str, str]], order: dict[str, int], percent: int) -> list[tuple]:
    """(nr, block width, words by order, words to share, prefix) of each template."""
    out = []
    for nr, (text, _) in enumerate(templates):
        words = sorted(set(text.split()), key=order.__getitem__)
        share = -(-percent * len(words) // 100)
        out.append((nr, width_of(text), words, share, words[: len(words) - share + 1]))
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, starts (of base phrases), base_labels and labels (arrays), score, found
    (template, block and containment of every template found)."""
    spark = docs.sparkSession
    vocabulary = sorted({w for t, _ in templates for w in t.split()})
    count = frequencies(docs, vocabulary)
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}
    plans = prefixes(templates, order, percent)
    rare = sorted({w for *_, p in plans for w in p})
    widths = sorted({width for _, width, *_ in plans})

    words = words_of(ascii_lower(F.col("text")), WORD)

    def told_of(w: Column, width: int) -> Column:
        # of each block its width and number, the template words in it, the number of its distinct words
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(width // BLOCK * STEP)), lambda at: F.slice(w, at + 1, width))
        return F.transform(blocks, lambda b, i: F.struct(F.lit(width).alias("width"), i.alias("block"), F.array_distinct(F.filter(b, lambda x: x.isin(vocabulary))).alias("words"), F.size(F.array_distinct(b)).alias("size")))

    def look(w: Column) -> Column:
        spots = [F.when(F.array_contains(w, phrase.split()[-1]), places(w, phrase)).otherwise(F.array().cast("array<int>")) for phrase, _ in PHRASES]
        told = F.concat(*[told_of(w, width) for width in widths])
        some = F.arrays_overlap(w, F.array(*[F.lit(x) for x in rare]))
        none = F.array().cast("array<struct<width:int,block:int,words:array<string>,size:int>>")
        return F.struct(F.size(w).cast("long").alias("n_words"), F.array(*spots).alias("spots"), F.when(some, told).otherwise(none).alias("blocks"))

    # the array of words is bound once, by a one-element transform
    read = docs.select("doc_id", F.element_at(F.transform(F.array(words), look), 1).alias("x")).select("doc_id", F.monotonically_increasing_id().alias("row"), "x.*")
    read = written(read, "license-words")

    ranks = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    blocks = read.select("row", F.explode("blocks").alias("b")).select("row", "b.width", "b.block", F.array_sort(F.transform("b.words", lambda w: F.struct(F.element_at(ranks, w).alias("rank"), w.alias("word")))).alias("ordered"), "b.size")
    tokens = blocks.select("row", "width", "block", "ordered", "size", F.posexplode("ordered").alias("at", "t")).select("row", "width", "block", "ordered", "size", "at", F.col("t.word").alias("word"))
    index = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{w}', {width}, {nr}, {at}, {share}, array({', '.join(repr(x) for x in all_)}))" for nr, width, all_, share, pre in plans for at, w in enumerate(pre)) + " AS t(word, width, template, place, share, whole)")
    # the index has one row a prefix word of the fixed templates
    met = tokens.join(F.broadcast(index), ["word", "width"]).filter(F.col("size") >= F.col("share"))
    behind = 1 + F.least(F.size("whole") - F.col("place") - 1, F.size("ordered") - F.col("at") - 1)
    first = met.groupBy("row", "block", "template").agg(F.min(F.struct("at", "place", "share", behind.alias("behind"), "whole", "ordered")).alias("m")).filter("m.behind >= m.share")
    shared = F.size(F.array_intersect(F.transform("m.ordered", lambda x: x["word"]), F.col("m.whole")))
    found = first.select("row", "template", "block", (shared / F.size("m.whole")).alias("containment"), shared.alias("n"), F.col("m.share").alias("share")).filter("n >= share")
    by_row = found.groupBy("row").agg(F.collect_list(F.struct("template", "block", "containment")).alias("found"))

    none = F.array().cast("array<struct<template:int,block:int,containment:double>>")
    rows = read.join(by_row, "row", "left").withColumn("found", F.coalesce("found", none))
    base = F.array_compact(F.array(*[F.when(F.size(F.get("spots", F.lit(i))) > 0, label) for i, (_, label) in enumerate(PHRASES)]))
    names = F.array(*[F.lit(label) for _, label in templates])
    more = F.transform("found", lambda x: F.get(names, x["template"]))
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["containment"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.flatten("spots").alias("starts"), F.array_sort(F.array_distinct(base)).alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(base, more))).alias("labels"), F.when(F.size(base) > 0, 1.0).otherwise(best).alias("score"), "found",
    )


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def digest_sql() -> str:
    """The digest in DuckDB SQL: every block against every template, without filters."""
    def starts(phrase: str) -> str:
        return "list_filter(range(0, len(words)), lambda i: " + " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split())) + ")"

    phrases = ", ".join(f"({starts(p)}) AS s{k}" for k, (p, _) in enumerate(PHRASES))
    every = "list_concat(" * (len(PHRASES) - 1) + "s0" + "".join(f", s{k})" for k in range(1, len(PHRASES)))
    base = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label FROM p WHERE len(s{k}) > 0" for k, (_, label) in enumerate(PHRASES))
    templates = ", ".join(f"(list_distinct(string_split('{t}', ' ')), '{label}')" for t, label in TEMPLATES)
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
p AS (SELECT *, {phrases} FROM w), q AS (SELECT *, {every} AS starts FROM p),
t AS (SELECT * FROM (VALUES {templates}) AS v(need, label)),
b AS (SELECT doc_id, words[i + 1:i + {BLOCK}] AS block FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words), 1), {STEP})) AS i FROM w)),
f AS (SELECT doc_id, label, max(len(list_intersect(block, need)) / CAST(len(need) AS DOUBLE)) AS share FROM b, t WHERE len(list_intersect(block, need)) * 100 >= {PERCENT} * len(need) GROUP BY doc_id, label),
l AS (SELECT doc_id, label FROM f UNION {base}), h AS ({base})
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word,
 coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM h WHERE h.doc_id = q.doc_id), '') AS base_labels, coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM l WHERE l.doc_id = q.doc_id), '') AS labels,
 CASE WHEN len(starts) > 0 THEN 1.0 ELSE coalesce((SELECT max(share) FROM f WHERE f.doc_id = q.doc_id), 0.0) END AS score FROM q"""
