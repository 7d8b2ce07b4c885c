"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions alone.

A block is a run of SPAN consecutive lines of a text (all of them, if fewer), lines without a word left out, so that a notice wrapped at
a column and marked as a comment lies in one; its set are the words in it. A block of fewer lines holds no more words than the one around
it, so these blocks find all that shorter ones find. A template matches a block if the block holds at least the share `threshold`
of the template's words. The words of all templates are ordered by how often they stand in the corpus, the rarest first.
Then, for a template of n words of which a = ceil(threshold * n) must be there:

* prefix: a matching block holds one of the template's first n - a + 1 words;
* length: it holds at least a words of the templates' vocabulary;
* position: if the first shared word is the template's i-th and the block's j-th, at most 1 + min(n - i, m - j) words are shared.

An inverted list leads from each prefix word to the templates that have it in their prefix, so a block meets only those templates that
it shares one with. Pairs that pass the filters are verified by counting. Templates are configuration, so their tables are literals of the
plan; the corpus is read twice, once to count words and once to scan, and no row of it is shuffled or expanded into pairs.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitline.llm.common import carried

#: Characters of a word, as a class: all but ASCII signs. Upper-case letters belong to it, being lower-cased ones.
_IN = r"\x{30}-\x{39}\x{41}-\x{5A}\x{61}-\x{7A}\x{80}-\x{10FFFF}"
WORD = rf"([{_IN}]+)"

# fixed values: phrases that are always looked for, and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# fixed values: opening statements of well-known licenses and short statements that name one, by label
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-any-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-statement": "Released under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
#: Share of a template's words that a block must hold.
THRESHOLD = 0.85
#: Lines of a block: the longest statement, wrapped at 70 columns, from a line of its own or from within one.
SPAN = 4

def lowered(text: Column) -> Column:
    """Lower case as far as words of ASCII letters go: the one other character that becomes one of them, the Kelvin sign, is kept out."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b")))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(1))


def template_words(text: str) -> list[str]:
    return sorted(set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text))))


def vocabulary_counts(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the vocabulary stands in all texts. Only these words reach the shuffle, summed by each task."""
    each = docs.select(F.explode(words_of(lowered(F.col(f"`{text}`").cast("string")))).alias("word")).where(F.col("word").isin(vocabulary))
    found = each.groupBy("word").agg(F.count("*").alias("n")).collect()
    return {r["word"]: r["n"] for r in found}


class Templates:
    """Templates whose words are ordered by their counts in a corpus; `order` holds all words, the rarest first."""

    def __init__(self, texts: dict[str, str], counts: dict[str, int], threshold: float):
        rank = lambda w: (counts.get(w, 0), w)
        self.rows = []
        for label, text in sorted(texts.items()):
            words = sorted(template_words(text), key=rank)
            if words:
                need = max(1, math.ceil(threshold * len(words) - 1e-9))
                self.rows.append((label, words, words[: len(words) - need + 1], need))
        self.order = sorted({w for _, words, _, _ in self.rows for w in words}, key=rank)
        self.postings: dict[str, list[int]] = {}
        for at, (_, _, prefix, _) in enumerate(self.rows, 1):
            for w in prefix:
                self.postings.setdefault(w, []).append(at)
        self.prefix = sorted(self.postings)


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def block_matches(block: Column, templates: Templates) -> Column:
    """(label, share) of the templates that match a block, given its words of the vocabulary from the rarest on."""
    table = F.array(*[F.struct(F.lit(label).alias("label"), strings(words).alias("words"), F.lit(need).alias("need")) for label, words, _, need in templates.rows])
    lists = F.array(*[F.array(*[F.lit(i) for i in templates.postings[w]]) for w in templates.prefix])
    words_with_lists = strings(templates.prefix)

    def common(t: Column) -> Column:
        """A candidate with the words it shares with the block, in their common order."""
        return F.struct(t["label"].alias("label"), t["words"].alias("words"), t["need"].alias("need"), F.array_intersect(t["words"], block).alias("shared"))

    met = F.array_distinct(F.flatten(F.transform(F.array_intersect(words_with_lists, block), lambda w: F.element_at(lists, F.array_position(words_with_lists, w).cast("int")))))
    long_enough = F.filter(F.transform(met, lambda i: F.element_at(table, i)), lambda t: F.size(block) >= t["need"])
    # the first shared word is the rarest one, found without the rest
    room = lambda t: 1 + F.least(
        F.size(t["words"]) - F.array_position(t["words"], first_shared(t, block)), F.size(block) - F.array_position(block, first_shared(t, block))
    )
    placed = F.transform(F.filter(long_enough, lambda t: room(t) >= t["need"]), common)
    enough = F.filter(placed, lambda t: F.size(t["shared"]) >= t["need"])
    return F.transform(enough, lambda t: F.struct(t["label"].alias("label"), (F.size(t["shared"]) / F.size(t["words"])).alias("share")))


def first_shared(t: Column, block: Column) -> Column:
    return F.get(F.filter(t["words"], lambda w: F.array_contains(block, w)), 0)


def line_sets(text: Column, templates: Templates) -> Column:
    """Of each line with a word, its words of the templates, from the rarest on."""
    lines = F.filter(F.transform(F.split(text, "\n"), words_of), lambda words: F.size(words) > 0)
    return F.transform(lines, lambda words: F.array_intersect(strings(templates.order), words))


def template_matches(lines: Column, templates: Templates) -> Column:
    """All (label, share) of the blocks of a text's `line_sets`. Blocks without a prefix word go before anything else is compared."""
    prefix = strings(templates.prefix)
    block = lambda i: F.flatten(F.slice(lines, i, F.lit(SPAN)))
    starts = F.sequence(F.lit(1), F.greatest(F.size(lines) - (SPAN - 1), F.lit(1)))
    met = F.filter(starts, lambda i: F.arrays_overlap(block(i), prefix))
    # a block's words are put in order once, as the element that the next function takes
    ordered = F.transform(met, lambda i: F.array_intersect(strings(templates.order), block(i)))
    found = F.flatten(F.transform(ordered, lambda words: block_matches(words, templates)))
    return F.when(F.arrays_overlap(F.flatten(lines), prefix), found)


def phrase_pattern(phrase: str) -> str:
    """The phrase's words one after the other, whatever signs part them, in either case."""
    gap = r"[\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+"
    words = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in phrase.split()]
    return rf"{gap.join(words)}(?![{_IN}])"


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs as one struct `row`, with what stands in the whole text:

    `n_words`; `n_base`, `first_word`, `last_word`: places of the fixed phrases, and the smallest and largest word index at which
    one starts (null without any); `base_labels`, `labels`: distinct labels of the phrases, and of phrases and templates, sorted;
    `score`: the largest share of a template's words in a matching block, 0.0 without a match. A null text counts as empty. Repeated
    rows, null ids and columns of any name pass through inside `row`.
    """
    texts = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for t in texts.values() for w in template_words(t)})
    ordered = Templates(texts, vocabulary_counts(docs, text, vocabulary), threshold)
    match = "array<struct<label:string,share:double>>"
    none = F.array().cast(match)
    rows = docs.select(carried(docs), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    rows = rows.select("row", "t", words_of(lowered(F.col("t"))).alias("words"))
    if ordered.rows:
        # lines are parted only where the text holds a prefix word at all
        some = F.arrays_overlap("words", strings(ordered.prefix))
        rows = rows.select("row", "t", "words", F.when(some, line_sets(lowered(F.col("t")), ordered)).alias("lines"))
    found = F.coalesce(template_matches(F.col("lines"), ordered).cast(match), none) if ordered.rows else none

    before = rf"(?<![{_IN}])"
    counts, first, last, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        pattern = phrase_pattern(phrase)
        # the places are looked for only where all words of the phrase stand
        stands = reduce(and_, [F.array_contains("words", w) for w in phrase.split()])
        n = F.when(stands, F.regexp_count("t", F.lit(before + pattern))).otherwise(0)
        counts.append(n)
        index = lambda some: F.regexp_count(F.regexp_extract("t", f"(?s)^({some}){before}{pattern}", 1), F.lit(WORD))
        first.append(F.when(n > 0, index(".*?")))
        last.append(F.when(n > 0, index(".*")))
        labels.append(F.when(n > 0, F.lit(label)))
    base = rows.select(
        "row",
        F.size("words").cast("long").alias("n_words"),  # lower case parts words where the text does
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base"),
        found.alias("found"),
    )
    every = F.array_sort(F.array_distinct(F.concat("base", F.transform("found", lambda m: m["label"]))))
    return base.select(
        "row", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda m: m["share"])), F.lit(0.0)).alias("score"),
        "found",
    )
