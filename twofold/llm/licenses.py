"""Licence scan: a trained classifier of paragraphs, confirmed against templates.

A paragraph is a line with a word; its features are distinct lower-cased words
and pairs of neighbouring words. A multinomial logistic regression over licence
families and an unknown class is fitted to the templates, to shortened templates,
to sentences that only mention licences, and to a bounded sample of the corpus'
own paragraphs, with an L1 penalty that leaves few features. The unknown class
is calibrated on the other half of that sample. A predicted family holds if the
paragraph also has enough of the words of one of the family's templates.

Notices wrapped over several lines are looked for in windows of ``SPAN`` lines near
a word that licences have. There a family holds if it beats the unknown class and
the window has enough of the word pairs of one of its templates: pairs keep the
order of words, so that words scattered over the lines confirm nothing. A declared
SPDX expression names its families by itself.

Fitting is arithmetic on a few hundred short rows; scoring is column expressions
over each document's array of paragraphs, without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_PARAGRAPHS = 2_000
TEMPLATE_SHARE = 0.7
FALSE_RATE = 0.001
UNKNOWN = "unknown"
SPAN = 16  # lines of a window
TAIL = 48  # words of a window's first line, from its end
WINDOW_WORDS = 240
SLACK = 6  # words a notice may have besides its template's
NEAR = 6  # lines from a notice's first one within which it has a word of ANCHOR
ANCHOR = r"licen[cs]|redistribut|permission|accompanying|mozilla|extent|waived"

# Customary licence statements by family.
TEMPLATES = {
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY 4.0.",
    ),
    "cc0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "epl": (
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
# Families of SPDX ids, by how an id begins.
SPDX = {
    "agpl-": "agpl",
    "apache-": "apache",
    "bsd-": "bsd",
    "0bsd": "bsd",
    "cc-": "cc",
    "cc0-": "cc0",
    "epl-": "epl",
    "gpl-": "gpl",
    "isc": "isc",
    "lgpl-": "lgpl",
    "mit": "mit",
    "mpl-": "mpl",
}
MENTIONS = (
    "All rights reserved.",
    "The driver must show a license to the officer.",
    "She has a license to teach and works with the public.",
    "The general version of this work is free.",
    "Released under the old name in the spring.",
    "The software is under test in the free version.",
    "It is a work of the public foundation.",
    "Use of the file is a matter of general permission.",
    "This work was released by the foundation, version one.",
)
_TOKEN = r"[a-z0-9.\-]+"
_DECLARED = r"spdx-license-identifier:[\x20\x09(]*([a-z0-9.+\-]+(?:[\x20\x09()]+(?:and|or|with)[\x20\x09()]+[a-z0-9.+\-]+)*)"


def tokens(paragraph: str) -> list[str]:
    """Lower-cased words of letters, digits, points and hyphens, without points at the end."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), paragraph)
    return [t for t in (w.rstrip(".") for w in re.findall(_TOKEN, lower)) if t]


def ngrams(words: list[str]) -> list[str]:
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})


@dataclass
class LicenseModel:
    """Families in order, unknown last; per n-gram a weight for each; biases."""

    classes: list[str]
    weights: dict[str, list[float]]
    bias: list[float]

    def logits(self, grams: list[str]) -> list[float]:
        return [b + sum(self.weights[g][k] for g in grams if g in self.weights) for k, b in enumerate(self.bias)]


def fit_rows(rows: list[tuple[list[str], int]], classes: list[str], rounds: int = 600, rate: float = 0.5, l1: float = 2.5e-4) -> LicenseModel:
    """Proximal gradient descent on (n-grams, class) rows, each class with the same total weight."""
    k = len(classes)
    counts = [max(1, sum(y == c for _, y in rows)) for c in range(k)]
    known = sorted({g for grams, y in rows if y < k - 1 for g in grams})
    place = {g: i for i, g in enumerate(known)}
    x, target, share = np.zeros((len(rows), len(known))), np.zeros((len(rows), k)), np.zeros((len(rows), 1))
    for i, (grams, y) in enumerate(rows):
        x[i, [place[g] for g in grams if g in place]] = 1
        target[i, y], share[i] = 1, 1 / (k * counts[y])
    w, b = np.zeros((len(known), k)), np.zeros(k)
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - target) * share
        b -= rate * d.sum(0)
        w -= rate * (x.T @ d)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0.0)
    return LicenseModel(classes, {g: w[i].tolist() for g, i in place.items() if w[i].any()}, b.tolist())


def paragraph_array(text: Column) -> Column:
    """Lines of a text that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _token_array(paragraph: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(_lower(paragraph), F.lit(_TOKEN), F.lit(0)), lambda w: F.rtrim(w, F.lit("."))), lambda w: w != "")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _texts(values) -> Column:
    return F.array(*map(F.lit, values))


def _templates() -> list[tuple[str, list[str], int]]:
    """Family, distinct word pairs and number of words of each template."""
    found = []
    for family in sorted(TEMPLATES):
        for words in map(tokens, TEMPLATES[family]):
            found.append((family, sorted({f"{a} {b}" for a, b in zip(words, words[1:])}), len(words)))
    return [x for x in found if len(x[1]) > 1]


def _declared(line: Column) -> Column:
    """Families of the SPDX expression that a line declares, if any."""
    parts = F.split(F.regexp_extract(_lower(line), _DECLARED, 1), r"[\x20\x09()]+")
    family = lambda x: F.coalesce(*[F.when(x.startswith(k), F.lit(v)) for k, v in SPDX.items()])
    return F.array_distinct(F.filter(F.transform(parts, family), lambda x: x.isNotNull()))


def _window_shares(words: Column, near: Column) -> Column:
    """Per line, the share of each template's word pairs in a notice that starts there; null away from ANCHOR."""
    templates = F.array(*[F.struct(_texts(t).alias("pairs"), F.lit(n + SLACK).alias("most")) for _, t, n in _templates()])

    def shares(first: Column, number: Column) -> Column:
        head = F.slice(first, F.greatest(F.size(first) - (TAIL - 1), F.lit(1)), TAIL)
        rest = F.slice(F.flatten(F.slice(words, number + 2, SPAN - 1)), 1, WINDOW_WORDS)
        return _let(F.concat(head, rest), lambda seq: _let(_pairs(seq), lambda pairs: F.transform(templates, lambda t: share(pairs, F.size(head), t))))

    def share(pairs: Column, own: Column, t: Column) -> Column:
        def held(x: Column) -> Column:
            return F.size(F.array_intersect(x, t["pairs"])) / F.size(t["pairs"]).cast("double")

        def judged(cut: Column, at: Column) -> Column:
            whole = held(cut)
            later = held(F.slice(cut, F.greatest(own - at + 2, F.lit(1)), t["most"]))
            return F.when((whole >= TEMPLATE_SHARE) & (whole > later), whole).otherwise(F.lit(0.0))

        def starting(at: Column) -> Column:
            return F.when(at > 0, _let(F.slice(pairs, F.greatest(at, F.lit(1)), t["most"]), lambda cut: judged(cut, at))).otherwise(F.lit(0.0))

        start = F.array_position(F.transform(F.slice(pairs, 1, own), lambda x: F.array_contains(t["pairs"], x)), True)
        return _let(start.cast("int"), starting)

    return F.transform(words, lambda w, i: F.when(F.exists(F.slice(near, i + 1, NEAR), lambda x: x) & (F.size(w) > 0), shares(w, i)))


def _pairs(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def fit_licenses(docs: DataFrame, sample: int = SAMPLE_PARAGRAPHS) -> LicenseModel:
    """Fit on the templates, the mentions and about ``sample`` paragraphs of the corpus.

    Sampled paragraphs that hold most of a template's words are left out: they are
    no examples of unknown text. The sample goes by a hash of the text.
    """
    classes = [*sorted(TEMPLATES), UNKNOWN]
    total = docs.count()
    share = min(1_000_000, 1 + sample * 1_000_000 // max(total, 1))
    chosen = (
        docs.select("text")
        .where(F.pmod(F.xxhash64("text", F.lit("licences")), F.lit(1_000_000)) < share)
        .select(F.md5(F.col("text").cast("binary")).alias("key"), paragraph_array(F.col("text")).alias("p"))
        .where(F.size("p") > 0)
        .select("key", F.element_at("p", F.pmod(F.xxhash64("key"), F.size("p")).cast("int") + 1).alias("p"))
        .select("key", F.slice(_token_array(F.col("p")), 1, 2_000).alias("words"))
    )
    plain = [ngrams(list(r["words"])) for r in sorted(chosen.collect(), key=lambda r: r["key"])]
    whole = [set(tokens(t)) for ts in TEMPLATES.values() for t in ts]
    plain = [g for g in plain if all(len(t & set(g)) < TEMPLATE_SHARE * len(t) for t in whole)]
    rows: list[tuple[list[str], int]] = []
    for c, family in enumerate(classes[:-1]):
        for t in TEMPLATES[family]:
            words = tokens(t)
            cut = max(3, (3 * len(words)) // 4)
            rows += [(ngrams(words), c), (ngrams(words[:cut]), c), (ngrams(words[-cut:]), c)]
    unknown = len(classes) - 1
    rows += [(ngrams(tokens(m)), unknown) for m in MENTIONS]
    rows += [(g, unknown) for g in plain[::2][:400]]
    model = fit_rows(rows, classes)
    # Raise the unknown class until at most FALSE_RATE of the paragraphs kept apart are taken for a licence.
    excess = sorted((max(z[:-1]) - z[-1] for z in map(model.logits, plain[1::2])), reverse=True)
    if excess:
        model.bias[-1] += max(0.0, excess[int(FALSE_RATE * len(excess))] + 1e-6)
    return model


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """(doc_id, n_paragraphs, n_licenses, families, licenses) of each row of ``docs``.

    ``licenses`` lists paragraph number (from 0), family, probability and template
    share of paragraphs whose predicted family a template confirms, and of those
    where a notice starts that is wrapped over up to ``SPAN`` paragraphs (its share
    is that of word pairs); a declared SPDX id has probability and share 1.
    ``families`` names them in order. Families without a template are not found.
    Of two wrapped notices made from the same template that touch each other, the
    one with the smaller share may be taken for the end of the other.
    Null and empty texts have no paragraphs and no licences.
    Repeated rows and rows without doc_id are scanned like any other; only doc_id
    and text are read. An empty table gives an empty table.
    """
    model = model or fit_licenses(docs)
    classes = model.classes
    kept = {t for ts in TEMPLATES.values() for x in ts for t in tokens(x)}
    vocabulary = sorted({*model.weights, *kept})
    zero = [0.0] * len(classes)
    table = F.create_map(*[c for g in sorted(model.weights) for c in (F.lit(g), F.array(*map(F.lit, model.weights[g])))])
    spare = F.array(*map(F.lit, zero))

    def from_words(words: Column) -> Column:
        hits = F.array_distinct(F.filter(F.concat(words, _pairs(words)), lambda g: g.isin(vocabulary)))
        return F.when(F.size(words) > 0, hits).otherwise(F.array().cast("array<string>"))

    def logits(hits: Column) -> Column:
        return F.aggregate(
            hits,
            F.array(*map(F.lit, model.bias)),
            lambda acc, g: F.zip_with(acc, F.coalesce(F.element_at(table, g), spare), lambda a, b: a + b),
        )

    def judge(paragraph: Column, number: Column) -> Column:

        def from_hits(hits: Column) -> Column:
            return F.when(F.size(hits) > 1, _let(logits(hits), lambda z: verdict(hits, z)))

        def verdict(hits: Column, z: Column) -> Column:
            top = F.array_max(z)
            best = F.array_position(z, top).cast("int")
            odds = F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
            shares = [
                F.greatest(F.lit(0.0), *[F.size(F.array_intersect(hits, F.array(*map(F.lit, t)))) / F.lit(float(len(t))) for t in (sorted(set(tokens(x))) for x in TEMPLATES[c])])
                for c in classes[:-1]
            ]
            share = F.coalesce(*[F.when(best == i + 1, s) for i, s in enumerate(shares)], F.lit(0.0))
            family = F.element_at(F.array(*map(F.lit, classes)), best)
            return F.struct(
                number.cast("long").alias("paragraph"),
                family.alias("family"),
                (F.lit(1.0) / odds).alias("probability"),
                share.alias("template_share"),
            )

        return _let(_let(_token_array(paragraph), from_words), from_hits)

    templates = _templates()
    place = _texts([classes.index(f) + 1 for f, _, _ in templates])
    names = _texts([f for f, _, _ in templates])

    def notices(lines: Column) -> Column:
        """Per line, the notices that start there: template, family, probability and share."""

        def of_words(words: Column) -> Column:
            near = F.transform(lines, lambda x: _lower(x).rlike(ANCHOR))
            return _let(_window_shares(words, near), lambda shares: F.transform(words, lambda w, i: starts(words, shares, i)))

        def starts(words: Column, shares: Column, i: Column) -> Column:
            def at(k: Column, t: Column) -> Column:
                return F.coalesce(F.get(F.get(shares, k), t), F.lit(0.0))

            own = F.transform(F.sequence(F.lit(0), F.lit(len(templates) - 1)), lambda t: F.struct(t.alias("template"), at(i, t).alias("share"), at(i - 1, t).alias("before"), at(i + 1, t).alias("after")))
            first = F.filter(own, lambda x: (x["share"] > 0) & (x["share"] > x["before"]) & (x["share"] >= x["after"]))
            window = F.slice(F.flatten(F.slice(words, i + 1, SPAN)), 1, WINDOW_WORDS)
            judged = F.when(
                F.get(shares, i).isNotNull() & (F.size(first) > 0),
                _let(_let(_let(window, from_words), logits), lambda z: beats(first, z)),
            )
            return F.coalesce(judged, F.array().cast("array<struct<template:int,family:string,probability:double,share:double>>"))

        def beats(first: Column, z: Column) -> Column:
            top = F.array_max(z)
            odds = F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
            logit = lambda x: F.element_at(z, F.element_at(place, x["template"] + 1))
            known = F.filter(first, lambda x: logit(x) > F.element_at(z, len(classes)))
            best = F.array_max(F.transform(known, lambda x: x["share"]))
            # Texts of related families share most pairs: the best share tells them apart.
            return F.transform(
                F.filter(known, lambda x: x["share"] == best),
                lambda x: F.struct(x["template"].alias("template"), F.element_at(names, x["template"] + 1).alias("family"), (F.exp(logit(x) - top) / odds).alias("probability"), x["share"].alias("share")),
            )

        words = F.transform(lines, lambda x: F.filter(_token_array(x), lambda w: w.rlike("[a-z0-9]")))
        return F.when(F.exists(lines, lambda x: _lower(x).rlike(ANCHOR)), _let(words, of_words))

    def of_line(line: Column, number: Column, wrapped: Column) -> Column:
        """Licences of one line: judged by itself, declared, or starting there; one for each family."""
        found = lambda x: x.isNotNull() & (x["family"] != UNKNOWN) & (x["template_share"] >= TEMPLATE_SHARE)
        own = F.filter(F.array(judge(line, number)), found)
        entry = lambda family, p, share: F.struct(number.cast("long").alias("paragraph"), family.alias("family"), p.alias("probability"), share.alias("template_share"))
        declared = F.when(_lower(line).contains("spdx-license-identifier"), F.transform(_declared(line), lambda f: entry(f, F.lit(1.0), F.lit(1.0))))
        starting = F.transform(F.get(wrapped, number), lambda x: entry(x["family"], x["probability"], x["share"]))

        def merged(found: Column) -> Column:
            return F.filter(found, lambda x, i: ~F.exists(F.slice(found, 1, i), lambda y: y["family"] == x["family"]))

        nothing = F.array().cast("array<struct<paragraph:bigint,family:string,probability:double,template_share:double>>")
        return _let(F.concat(*[F.coalesce(x, nothing) for x in (declared, own, starting)]), merged)

    def scanned(lines: Column) -> Column:
        return _let(notices(lines), lambda wrapped: F.flatten(F.transform(lines, lambda x, i: of_line(x, i, wrapped))))

    paragraphs = paragraph_array(F.col("text"))
    rows = docs.select("doc_id", F.size(paragraphs).cast("long").alias("n_paragraphs"), _let(paragraphs, scanned).alias("licenses"))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"]))), ",")
    return rows.select("doc_id", "n_paragraphs", F.size("licenses").cast("long").alias("n_licenses"), families.alias("families"), "licenses")
