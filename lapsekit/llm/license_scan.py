"""Licence notices by a positional index of their rare words.

Column expressions only. Document frequencies over all texts rank the words of
the templates; a template is indexed by its rarest words, as many as are sure
to leave two in any text that covers it. Every place of such a word in a text
is looked up; two of them that agree on where a template would start propose
it there, and the share of its words that stand in place, and its mandatory
phrases, decide. A text is read once to count and once to search, and each
place is looked at a fixed number of times, so a text of very many notices
takes time in proportion.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lapsekit.llm.arrays import let

#: What separates words: ASCII characters other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    """A notice, and the phrases of it without which it isn't one."""

    label: str
    text: str
    phrases: tuple[str, ...]


# Wordings of common notices.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted", "free of charge"),
    ),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        ("free software", "gnu general public license"),
    ),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided "
        "that the following conditions are met",
        ("source and binary forms", "with or without modification"),
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("source code form", "mozilla public license"),
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at",
        ("apache license version 2 0", "in compliance with the license"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("with or without fee", "hereby granted"),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held "
        "liable for any damages arising from the use of this software",
        ("authors be held liable",),
    ),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    Template(
        "cc0-1.0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        ("waived all copyright", "neighboring rights"),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software", "public domain"),
    ),
)
# Words too ordinary to be indexed.
COMMON = frozenset(
    "a an and any are as be by can code for form forms free in into is it met of on or that the this to use v with "
    "without you".split()
)

#: Words by which a notice may be shifted inside, and the share of its weight that must stand in place.
DRIFT, COVERAGE = 8, 0.75


def _indexed(text: str) -> list[tuple[str, int]]:
    return [(w, i) for i, w in enumerate(text.split()) if w not in COMMON]


def _words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BETWEEN), "")


def _sql_words(words: list[str]) -> str:
    return f"array({', '.join(repr(w) for w in words)})"


def _phrase_starts(phrase: str) -> str:
    """SQL of the positions at which the words of a phrase stand consecutively in ``words``."""
    parts = phrase.split()
    here = " AND ".join(f"get(words, i + {k}) = '{w}'" for k, w in enumerate(parts))
    none = "CAST(array() AS array<int>)"
    return f"if(array_contains(words, '{parts[-1]}'), filter(sequence(0, size(words)), i -> {here}), {none})"


def rarity(df: DataFrame, text: str, templates: tuple[Template, ...]) -> dict[str, float]:
    """Inverse document frequency of every template word over all texts; a row per word reaches the driver."""
    vocabulary = sorted({w for t in templates for w, _ in _indexed(t.text)})
    own = F.array_intersect(_words(F.col(text)), F.array(*map(F.lit, vocabulary)))
    # The empty word stands in every text, to count them.
    counted = df.select(F.explode(F.concat(F.array(F.lit("")), own)).alias("word")).groupBy("word").count().collect()
    counts = {row["word"]: row["count"] for row in counted}
    total = counts.get("", 0)
    return {w: round(math.log((total + 1) / max(counts.get(w, 0), 1)) + 1, 6) for w in vocabulary}


def anchors(template: Template, idf: dict[str, float]) -> list[tuple[str, int]]:
    """The places of the template by which it is looked up.

    They are those of its rarest words, so many that without the weightiest of
    them they still weigh more than a text may lack: whoever covers the
    template has two different ones of them in place.
    """
    weight: dict[str, float] = {}
    for w, _ in _indexed(template.text):
        weight[w] = weight.get(w, 0.0) + idf[w]
    lacking, chosen = (1 - COVERAGE) * sum(weight.values()), []
    for w in sorted(weight, key=lambda w: (-idf[w], w)):
        chosen.append(w)
        if sum(weight[c] for c in chosen) - max(weight[c] for c in chosen) > lacking:
            break
    return [(w, at) for w, at in _indexed(template.text) if w in chosen]


def _window(start: str, at: int, more: int = 0) -> str:
    """SQL of the words around a place of a template that starts at ``start``, as far as it may be shifted."""
    low = f"greatest({start} + {at - DRIFT}, 0)"
    return f"slice(words, {low} + 1, greatest({start} + {at + DRIFT + 1 + more} - {low}, 0))"


def _judged(template: Template, start: str, idf: dict[str, float]) -> str:
    """SQL of (label, coverage) of a template proposed at ``start``; null if it isn't there."""
    placed = _indexed(template.text)
    total = sum(idf[w] for w, _ in placed)
    share = " + ".join(f"if(array_contains({_window(start, at)}, '{w}'), {idf[w]}D, 0D)" for w, at in placed)
    phrases = " AND ".join(
        f"contains(concat(' ', array_join({_window(start, _find(template.text, p), len(p.split()) - 1)}, ' '), ' '), ' {p} ')"
        for p in template.phrases
    )
    covered = let(f"({share}) / {total}D", "covered", (
        f"if(covered >= {COVERAGE}D, named_struct('label', '{template.label}', 'coverage', round(least(covered, 1D), 6)), NULL)"
    ))
    return f"if({phrases}, {covered}, NULL)"


def _found(templates: tuple[Template, ...], idf: dict[str, float]) -> str:
    """SQL of the distinct (label, coverage) of the templates found in ``words``."""
    postings: dict[str, list[str]] = {}
    for i, template in enumerate(templates):
        for w, at in anchors(template, idf):
            postings.setdefault(w, []).append(f"named_struct('t', {i}, 'at', {at})")
    index = "map(" + ", ".join(f"'{w}', array({', '.join(own)})" for w, own in sorted(postings.items())) + ")"
    hits = "filter(transform(words, (w, i) -> named_struct('word', w, 'at', i)), h -> array_contains(own, h.word))"
    votes = (
        f"array_sort(flatten(transform({hits}, h -> transform(element_at({index}, h.word),"
        " p -> named_struct('t', p.t, 'start', h.at - p.at, 'word', h.word)))))"
    )
    # In the order of template and start, two different words that agree stand side by side somewhere.
    follows = f"get(votes, i + 1).t = v.t AND get(votes, i + 1).start - v.start <= {DRIFT} AND get(votes, i + 1).word <> v.word"
    proposed = f"filter(votes, (v, i) -> {follows})"
    cases = " ".join(f"WHEN {i} THEN {_judged(t, 'c.start', idf)}" for i, t in enumerate(templates))
    decided = f"array_distinct(filter(transform({proposed}, c -> CASE c.t {cases} END), d -> d IS NOT NULL))"
    none = "CAST(array() AS array<struct<label:string,coverage:double>>)"
    own = f"array_intersect(words, {_sql_words(sorted(postings))})"
    found = f"if(size(own) > 1, {let(votes, 'votes', decided)}, {none})"
    return let(own, "own", f"CAST({found} AS array<struct<label:string,coverage:double>>)")


def _find(text: str, phrase: str) -> int:
    words, wanted = text.split(), phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted)


def scan_licenses(
    df: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES
) -> DataFrame:
    """Per row: key, n_words, ``base`` (label, starts), ``found`` (label, coverage) of the templates.

    Words are compared after lower-casing A-Z. Null and empty texts have no
    words and no licence. Repeated rows stay repeated and count each; an empty
    table gives no row. Other columns are left out.
    """
    idf = rarity(df, text, templates)
    words = df.select(F.col(key).alias("key"), _words(F.col(text)).alias("words"))
    base = ", ".join(f"named_struct('label', '{label}', 'starts', {_phrase_starts(phrase)})" for phrase, label in BASE.items())
    return words.select(
        F.col("key").alias(key), F.size("words").cast("bigint").alias("n_words"), F.expr(f"array({base})").alias("base"),
        F.expr(_found(templates, idf)).alias("found"),
    )


def license_digest(df: DataFrame) -> DataFrame:
    """Places and labels of the base phrases, all labels, and a score.

    ``score``: the best coverage of a template, one half for a base phrase
    without one, else 0. Rows are as those of ``scan_licenses``.
    """
    scanned = scan_licenses(df.select("doc_id", "text"))
    starts = F.flatten(F.transform("base", lambda b: b["starts"]))
    labels = F.transform(F.filter("base", lambda b: F.size(b["starts"]) > 0), lambda b: b["label"])
    own = F.transform("found", lambda f: f["label"])
    best = F.array_max(F.transform("found", lambda f: f["coverage"]))
    return scanned.select(
        "doc_id", "n_words",
        F.size(starts).cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, own))), ",").alias("labels"),
        F.coalesce(best, F.when(F.size(starts) > 0, 0.5).otherwise(0.0)).alias("score"),
    )
