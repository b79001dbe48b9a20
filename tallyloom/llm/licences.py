"""Licence scan: an exact set-similarity join of text blocks with licence templates, by DataFrame functions only.

A template is a set of words. Blocks are overlapping windows of a text's words, sized by the
template's class, so that every run of a class's length lies whole in one block. A block meets a
template if it holds at least PERCENT of the template's words. Words of all templates are ordered by
how often they stand in all texts, rarest first: a block that meets a template holds one of the
template's first words (prefix filter), holds enough template words at all (length filter), and after
the first shared word both have enough words left (positional filter). What passes is counted exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.kit import marked, named, settled, written

#: Percent of a template's words that a block must hold.
PERCENT = 90
#: Words of the smallest blocks; others are larger by powers of two.
SMALLEST = 16

# The phrases of the base scan.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices and first sentences of published licences, by label.
NOTICES = [
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Runs of letters, digits and characters beyond ASCII, with A-Z in lower case. A null text has none."""
    plain = F.coalesce(text, F.lit(""))
    # The general lower case is faster, and the same where all is ASCII.
    small = F.when(F.length(plain) == F.octet_length(plain), F.lower(plain)).otherwise(F.translate(plain, _UPPER, _LOWER))
    return F.array_remove(F.split(small, _SEPARATORS), "")


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    #: Words of a block: twice the words of the notice, or more.
    span: int
    #: Words of the template that a block must hold.
    least: int


def templates_of(notices: list[tuple[str, str]], percent: int = PERCENT) -> list[Template]:
    """Templates, each with its words once, in the notice's order."""
    if not 0 < percent <= 100:
        raise ValueError("the threshold is a percentage above 0")
    out = []
    for label, text in notices:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_UPPER, _LOWER)))
        if not words:
            raise ValueError(f"the notice of {label} has no word")
        once, span = tuple(dict.fromkeys(words)), SMALLEST
        while span < 2 * len(words):
            span *= 2
        out.append(Template(label, once, span, -(-percent * len(once) // 100)))
    return out


def word_order(texts: DataFrame, templates: list[Template]) -> list[str]:
    """The templates' words, rarest in all texts (rows with `words`) first; ties by the word. As many rows as templates have words come to the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = texts.select(F.explode(F.filter("words", lambda w: w.isin(vocabulary))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    count = {r.word: r.n for r in found.collect()}
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def prefix_of(template: Template, rank: dict[str, int]) -> list[int]:
    """Ranks of the words of which a block that meets the template must hold one: all but least - 1, rarest first."""
    return sorted(rank[w] for w in template.words)[: len(template.words) - template.least + 1]


_BLOCKS = "array<struct<span: int, block: int, tokens: array<int>>>"


def _of_span(words: Column, span: int, own: list[Template], rank: dict[str, int]) -> Column:
    """The candidate blocks of one class of templates; see `blocks_of`."""
    half, least = span // 2, min(t.least for t in own)
    known = sorted({w for t in own for w in t.words}, key=rank.__getitem__)
    ranks = {r for t in own for r in prefix_of(t, rank)}
    first = [w for w in known if rank[w] in ranks]
    by_rank = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(rank[w]).alias("r")) for w in known])
    held = lambda i: F.array_distinct(F.filter(F.slice(words, i * half + 1, span), lambda w: w.isin(known)))
    last = F.greatest(F.ceil(F.size(words) / half).cast("int") - 2, F.lit(0))
    every = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("block"), held(i).alias("held")))
    kept = F.filter(every, lambda b: (F.size(b["held"]) >= least) & F.exists(b["held"], lambda w: w.isin(first)))
    tokens = lambda b: F.transform(F.filter(by_rank, lambda k: F.array_contains(b["held"], k["w"])), lambda k: k["r"])
    told = F.transform(kept, lambda b: F.struct(F.lit(span).alias("span"), b["block"].alias("block"), tokens(b).alias("tokens")))
    return F.when(F.exists(words, lambda w: w.isin(first)), told).otherwise(F.array().cast(_BLOCKS))


def blocks_of(words: Column, templates: list[Template], order: list[str]) -> Column:
    """Of the words of a text, its candidate blocks (span, block, tokens): those that hold a first word of a template of their class, and as many template words as one of them needs. Tokens are ranks in the order, sorted."""
    rank = {w: i for i, w in enumerate(order)}
    spans = sorted({t.span for t in templates})
    return F.concat(*[_of_span(words, span, [t for t in templates if t.span == span], rank) for span in spans])


def matched(texts: DataFrame, templates: list[Template], order: list[str]) -> DataFrame:
    """Of texts (key, blocks), every block that meets a template: (key, span, block, template, overlap, score). `template` is the place in `templates`, `score` the part of its words that the block holds.

    Both sides of the join are single words: of blocks, exploded, and of templates, of which there
    are fewer than the words of the notices given, and which are broadcast.
    """
    rank = {w: i for i, w in enumerate(order)}
    index = [(t.span, r, i, at, len(t.words), t.least) for i, t in enumerate(templates) for at, r in enumerate(prefix_of(t, rank))]
    index = texts.sparkSession.createDataFrame(index, "span int, token int, template int, at_t int, size_t int, least int")
    each = texts.select("key", F.explode("blocks").alias("b")).select("key", "b.*").select("key", "span", "block", "tokens", F.posexplode("tokens").alias("at_b", "token"))
    met = each.join(F.broadcast(index), ["span", "token"])
    left = lambda at, size: size - F.col(at)
    met = met.filter((F.size("tokens") >= F.col("least")) & (F.least(left("at_b", F.size("tokens")), left("at_t", F.col("size_t"))) >= F.col("least")))
    ranks = F.element_at(F.array(*[F.array(*[F.lit(r) for r in sorted(rank[w] for w in t.words)]) for t in templates]), F.col("template") + 1)
    met = met.withColumn("shared", F.array_intersect("tokens", ranks))
    # Each pair is kept at its first shared word.
    met = met.filter((F.element_at("shared", 1) == F.col("token")) & (F.size("shared") >= F.col("least")))
    return met.select("key", "span", "block", "template", F.size("shared").alias("overlap"), (F.size("shared") / F.col("size_t")).alias("score"))


def told_by(matches: DataFrame, templates: list[Template]) -> DataFrame:
    """(key, named, best) of matches: the labels of the notices met, and the best score. A notice whose words are all part of another's that the text meets names nothing, as the other one does (BY in BY-NC)."""
    inside = F.array(*[F.array(*[F.lit(k) for k, u in enumerate(templates) if set(t.words) < set(u.words)]).cast("array<int>") for t in templates])
    label = F.array(*[F.lit(t.label) for t in templates])
    rows = matches.groupBy("key").agg(F.collect_set("template").alias("met"), F.max("score").alias("best"))  # as many as there are templates
    own = F.filter("met", lambda t: F.size(F.array_intersect(F.element_at(inside, t + 1), F.col("met"))) == 0)
    return rows.select("key", F.transform(own, lambda t: F.element_at(label, t + 1)).alias("named"), "best")


def phrase_places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand one after the other, from 0."""
    own = phrase.split(" ")
    here = lambda i: reduce(and_, [F.get(words, i + k) == w for k, w in enumerate(own)])
    there = reduce(and_, [F.array_contains(words, w) for w in own], F.size(words) >= len(own))
    return F.when(there, F.filter(F.sequence(F.lit(0), F.size(words) - len(own)), here)).otherwise(F.array().cast("array<int>"))


def scanned(df: DataFrame, templates: list[Template], text: str = "text", phrases: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """All rows as (key, columns of keep, n_words, places by phrase, named, best), and all matches of blocks; see `matched` and `told_by`.

    Texts are read twice: for the order of words, and for phrases and candidate blocks, which are
    written with a number for each row. Null texts have no words; named and best are null without
    a match. Rows that repeat have keys of their own.
    """
    phrases = PHRASES if phrases is None else phrases
    words = words_of(named(text))
    order = word_order(df.select(words.alias("words")), templates)
    own = [named(c) for c in keep]
    rows = df.select(F.monotonically_increasing_id().alias("key"), *own, words.alias("words"))
    rows, _ = written(rows.select("key", *own, F.size("words").alias("n_words"), F.array(*[phrase_places(F.col("words"), p) for p in phrases]).alias("places"), blocks_of(F.col("words"), templates, order).alias("blocks")))
    matches, _ = written(matched(rows, templates, order))
    return rows.drop("blocks").join(told_by(matches, templates), "key", "left"), matches


def op12_license_scan(documents: DataFrame) -> DataFrame:
    """Words, phrases and licences of every document; see `scanned`.

    A null or empty text has no words, no labels and score 0; very long texts are scanned whole,
    block by block. A label of the base scan counts as a score of 1. Repeated rows each give a row;
    ties play no part. An empty table gives no rows. Other columns of the table are not looked at.
    """
    mark = marked()
    rows, _ = scanned(documents, templates_of(NOTICES), keep=("doc_id",))
    found = F.flatten("places")
    base = F.flatten(F.array(*[F.when(F.size(F.col("places")[k]) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for k, label in enumerate(PHRASES.values())]))
    told = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    rows = rows.withColumn("base", base).withColumn("named", F.coalesce("named", F.array().cast("array<string>")))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    out = rows.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.size(found).cast("long").alias("n_base"), F.array_min(found).cast("long").alias("first_word"), F.array_max(found).cast("long").alias("last_word"), told(F.col("base")).alias("base_labels"), told(F.concat("base", "named")).alias("labels"), score.alias("score"))
    return settled(out, mark)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '" + _UPPER + "', '" + _LOWER + "'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TEMPLATES = templates_of(NOTICES)
_TABLE = ", ".join(f"({i}, '{t.label}', {t.span}, {t.least}, {list(t.words)!r}, {[k for k, u in enumerate(_TEMPLATES) if set(t.words) < set(u.words)]}::INT[])" for i, t in enumerate(_TEMPLATES))
_PLACES = " UNION ALL ".join("SELECT id, '{}' AS label, i FROM p WHERE {}".format(label, " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split(" "), 1))) for phrase, label in PHRASES.items())
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS w FROM documents),
t(t, label, span, least, words, inside) AS (VALUES {_TABLE}),
p AS (SELECT id, w, unnest(range(0, len(w))) AS i FROM d),
h AS ({_PLACES}),
b AS (SELECT id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY id),
s AS (SELECT DISTINCT span FROM t),
k AS (SELECT id, span, list_distinct(w[k * span // 2 + 1:k * span // 2 + span]) AS held FROM (SELECT id, w, span, unnest(range(0, greatest((len(w) + span // 2 - 1) // (span // 2) - 1, 1))) AS k FROM d, s WHERE len(w) > 0)),
m AS (SELECT id, t, label, inside, max(len(list_intersect(held, words))::DOUBLE / len(words)) AS score FROM k JOIN t USING (span) WHERE len(list_intersect(held, words)) >= least GROUP BY ALL),
a AS (SELECT id, list(t) AS met, max(score) AS best FROM m GROUP BY id),
l AS (SELECT id, label FROM m JOIN a USING (id) WHERE len(list_intersect(inside, met)) = 0 UNION SELECT id, label FROM h),
g AS (SELECT id, string_agg(label, ',' ORDER BY label) AS labels FROM l GROUP BY id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0) END AS score
FROM d LEFT JOIN b USING (id) LEFT JOIN a USING (id) LEFT JOIN g USING (id)
"""
