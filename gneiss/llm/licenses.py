"""Operator 10 (DataFrame functions only): licence scan by exact set-similarity join.

Words are ASCII letters (lower-cased), digits and all non-ASCII characters.  A text block is a
window of 2*S words, one starting every S words, S the length of the longest template: every run
of S words lies within a block.  Template tokens are ordered by their document frequency in the
whole corpus, rarest first.  A block that holds at least `threshold` of a template's tokens must
hold one of the template's first n - ceil(threshold * n) + 1: blocks are joined by such tokens with
an index of the templates' prefixes (prefix filter), so a block meets only templates it shares one
with.  Pairs must have tokens enough (length filter), and enough left behind the first shared one in
both orders (positional filter); what passes is counted exactly.  The join's other side is as large
as the templates; of the corpus, read twice (once for the frequencies), only ids, counts and matches
are shuffled, to put a text's matches together.

A match tells its label if the block holds those words of the label that the template has ("mit" in
a notice of that name), and unless a template that shares `threshold` of its tokens does better in
the same block (a larger share, or as large a share of more tokens): so CC BY does not come with
CC BY-NC, while two licences side by side are both told.

Null and empty texts have no words, no labels and score 0.  Each row is scanned by itself, so ties,
repeated rows and other columns have no effect.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.base import if_small, pick

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases that the base scan counts, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Usual notices of public licences, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]


def split_words(text: str) -> list[str]:
    """Words of a template or phrase, as the scan takes them."""
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def words_of(text: Column) -> Column:
    """Words by splitting at what parts them (cheaper than collecting matches); lower() is the same
    as folding A-Z where every character is one byte."""
    whole = F.coalesce(text, F.lit(""))
    folded = F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    return F.array_remove(F.split(folded, BREAK), "")


def frequencies(df: DataFrame, vocabulary: list[str], text_column: str = "text") -> dict[str, int]:
    """In how many texts each word of the (bounded) vocabulary occurs, over all rows."""
    found = df.select(F.explode(F.array_intersect(words_of(df[text_column]), _strings(vocabulary))).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _places(words: Column, n: Column, phrase: list[str]) -> Column:
    """Starts of consecutive occurrences of the phrase."""

    def here(i: Column) -> Column:
        fits = F.get(words, i) == F.lit(phrase[0])
        for k, w in enumerate(phrase[1:], 1):
            fits = fits & (F.get(words, i + F.lit(k)) == F.lit(w))
        return fits

    return F.when(n >= len(phrase), F.filter(F.sequence(F.lit(0), F.greatest(n - F.lit(len(phrase)), F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def _labelled(label: str):
    return lambda i: F.struct(i.cast("int").alias("start"), F.lit(label).alias("label"))


def scan(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = 0.8,
) -> DataFrame:
    """doc_id, n_words, places (array of start and label of each base phrase), matches (array of
    block start, label, overlap and containment for every block and template that meet the
    threshold, told: whether it tells its label), base_labels and labels (arrays)."""
    spark = df.sparkSession
    sets = [(label, list(dict.fromkeys(split_words(text)))) for label, text in templates]
    sets = [(label, tokens) for label, tokens in sets if tokens]
    stride = max([len(split_words(text)) for _, text in templates], default=1)
    vocabulary = sorted({w for _, tokens in sets for w in tokens})
    df_of = frequencies(df, vocabulary, text_column) if vocabulary else {}
    ranked = sorted(vocabulary, key=lambda w: (df_of.get(w, 0), w))
    index = prefix_index(sets, {w: i for i, w in enumerate(ranked)}, threshold)
    prefixes = _strings(sorted({entry["token"] for entry in index}))
    index = if_small(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(index)), f"array<struct<{', '.join(f'{n}: {k}' for n, k in INDEX.items())}>>"))))

    rows = pick(df, doc_id=id_column, text=text_column).withColumn("words", words_of(F.col("text")))
    words = F.col("words")
    rows = rows.select("doc_id", "words", F.size("words").alias("n_words"))

    # base phrases; the words are walked only where a phrase's rarest part can be
    starts: Column = F.array().cast("array<struct<start:int,label:string>>")
    for phrase, label in phrases.items():
        parts = split_words(phrase)
        holds = F.array_contains(words, max(parts, key=len)) & F.array_contains(words, parts[0])
        places = F.transform(_places(words, F.col("n_words"), parts), _labelled(label))
        starts = F.concat(starts, F.when(holds, places).otherwise(F.array().cast("array<struct<start:int,label:string>>")))

    # blocks with a prefix token, a row for each of these tokens; a row of nulls for texts without
    def block(start: Column) -> Column:
        tokens = F.array_intersect(_strings(ranked), F.slice(words, start + F.lit(1), F.lit(2 * stride)))  # in the global order
        return F.struct(start.cast("int").alias("start"), tokens.alias("tokens"))

    block_starts = F.sequence(F.lit(0), F.greatest(F.col("n_words") - F.lit(1), F.lit(0)), F.lit(stride))
    blocks = F.when(F.arrays_overlap(words, prefixes), F.transform(block_starts, block))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", starts.alias("places"), blocks.alias("blocks"))
    cut = rows.select("row", "doc_id", "n_words", "places", F.explode_outer("blocks").alias("block"))
    shared = F.explode_outer(F.array_intersect(F.col("block.tokens"), prefixes))
    joined = cut.select("row", "doc_id", "n_words", "places", "block", shared.alias("token")).join(index, "token", "left")

    held, tokens = F.col("block.tokens"), F.col("tokens")
    behind = lambda side: F.size(side) - F.array_position(side, F.col("token")).cast("int") + F.lit(1)
    first = F.get(F.array_intersect("prefix", held), F.lit(0)) == F.col("token")  # a pair is met by the rarest shared token
    overlap = F.size(F.array_intersect(tokens, held))
    passes = first & (F.size(held) >= F.col("need")) & (F.least(behind(tokens), behind(held)) >= F.col("need")) & (overlap >= F.col("need"))
    marked = F.size(F.array_intersect("marks", held)) == F.size("marks")
    match = F.struct(F.col("block.start").alias("start"), "label", overlap.alias("overlap"), (overlap / F.size(tokens)).alias("containment"), "t", "variants", marked.alias("marked"))
    found = joined.select("row", "doc_id", "n_words", "places", F.when(passes, match).alias("match"))
    rows = found.groupBy("row").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("n_words").alias("n_words"), F.any_value("places").alias("places"), F.array_sort(F.collect_list("match")).alias("found"))

    def told(m: Column) -> Column:
        def better(o: Column) -> Column:
            more = (o["containment"] > m["containment"]) | ((o["containment"] == m["containment"]) & (o["overlap"] > m["overlap"]))
            return (o["start"] == m["start"]) & o["marked"] & F.array_contains(m["variants"], o["t"]) & more

        return F.struct(m["start"].alias("start"), m["label"].alias("label"), m["overlap"].alias("overlap"), m["containment"].alias("containment"), (m["marked"] & ~F.exists("found", better)).alias("told"))

    rows = rows.select("doc_id", "n_words", "places", F.transform("found", told).alias("matches"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    own = F.transform(F.filter("matches", lambda m: m["told"]), lambda m: m["label"])
    return rows.select("*", base.alias("base_labels"), F.array_sort(F.array_distinct(F.concat(base, own))).alias("labels"))


INDEX = {"token": "string", "t": "int", "label": "string", "tokens": "array<string>", "prefix": "array<string>", "need": "int", "marks": "array<string>", "variants": "array<int>"}


def prefix_index(sets: list[tuple[str, list[str]]], rank: dict[str, int], threshold: float) -> list[dict]:
    """A row for each prefix token of each template: token, number and label of the template, its tokens
    in the global order, its prefix, how many must be shared, the words of the label among the tokens,
    and the templates that share `threshold` of its tokens."""
    out = []
    for t, (label, tokens) in enumerate(sets):
        tokens = sorted(tokens, key=rank.get)
        need = math.ceil(threshold * len(tokens) - 1e-9)
        prefix = tokens[: len(tokens) - need + 1]
        marks = [w for w in split_words(label) if w in tokens]
        variants = [o for o, (_, other) in enumerate(sets) if o != t and len(set(tokens) & set(other)) >= need]
        out += [dict(zip(INDEX, (token, t, label, tokens, prefix, need, marks, variants), strict=True)) for token in prefix]
    return out
