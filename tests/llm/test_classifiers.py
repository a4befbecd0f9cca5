import random
import textwrap
import zlib

from twofold.llm.language import FOLDS, HELD_OUT, language_predictions
from twofold.llm.licenses import TEMPLATES, fit_licenses, scan_licenses
from twofold.llm.toxicity import fit_machine, term_ids, toxicity_scores


def fold(doc, n):
    return zlib.crc32(str(doc).encode()) % n


def tongue(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_language_of_held_out_rows(spark, table):
    rng = random.Random(1)
    sets = {"aa": "abcdefghij", "bb": "abcdefklmn", "cc": "abcdefopqé"}
    rows = [(i, tongue(rng, sets[k], rng.randint(10, 60)), k) for i, k in enumerate(list(sets) * 120)]
    odd = [(9001, None, "aa"), (9002, "", "bb"), (9003, "123 --", "cc"), (None, rows[0][1], None), (9004, "ab " * 20_000, None)]
    got = language_predictions(table(rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    held = [(d, k) for d, _, k in rows if fold(d, FOLDS) == HELD_OUT]
    assert all(by[d].held_out for d, _ in held) and not by[None].held_out
    assert sum(by[d].lang_pred == k for d, k in held) >= 0.97 * len(held)
    assert [by[d].lang_pred for d in (9001, 9002, 9003)] == ["und"] * 3 and by[9004].lang_pred in sets
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_tables_without_labels(spark, table):
    assert {r.lang_pred for r in language_predictions(table([(1, "abc"), (2, None)])).collect()} == {"und"}
    assert language_predictions(table([(1, "a", "aa")]).where("doc_id > 1")).count() == 0


def test_toxicity_of_held_out_rows(spark, table, small_dir):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(2500):
        toxic = rng.random() < 0.2
        text = tongue(rng, "abcdefghijklmnopqrstuvw", rng.randint(20, 80)).split()
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["moron", "idiot"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    labels += [(1, 1, None), (None, 0, 1)]
    odd = [(9001, None), (9002, ""), (None, "moron"), (9003, "idiot " * 20_000)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity_scores(table(rows + odd), marks).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    held = [(d, t) for d, _, t in labels[:2500] if fold(d, 4) == 2]
    assert all(by[d].held_out for d, _ in held)
    assert sum(by[d].predicted == t for d, t in held) >= 0.95 * len(held)
    assert by[9001].predicted == by[9002].predicted == 0 and by[9003].predicted == 1
    assert toxicity_scores(table(rows).where("doc_id > 9999"), marks).count() == 0
    assert {r.predicted for r in toxicity_scores(table(rows[:5]), marks.where("doc_id > 9999")).collect()} == {0}


def test_pairs_count_beyond_single_terms():
    rng = random.Random(4)
    rows = []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"n{rng.randrange(30)}" for _ in range(5)] + ["clown"] * a + ["group"] * b
        rows.append((term_ids(" ".join(words)), int(a and b), 1.0))
    model = fit_machine(rows)
    both, one, other = (model.logit(term_ids(t)) for t in ("clown group", "clown", "group"))
    assert both > 0 > max(one, other) and model.factors[term_ids("clown")[0]] @ model.factors[term_ids("group")[0]] > 0


def test_licences_are_found_and_plain_text_is_not(spark, table):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(200):
        lines = [tongue(rng, "abcdefghilmnorst", rng.randint(3, 30)) for _ in range(rng.randint(0, 5))]
        family = rng.choice([*TEMPLATES, None, None])
        if family:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(TEMPLATES[family]))
        rows.append((i, "\n".join(lines)))
        want[i] = family or ""
    rows += [(9001, None), (9002, ""), (9003, " \n\t\n"), (None, TEMPLATES["mit"][0]), (9004, "license " * 30_000), (9005, "She has a license to work in the general public office.")]
    docs = table(rows)
    got = {r.doc_id: r for r in scan_licenses(docs, fit_licenses(docs)).collect()}
    assert {d: got[d].families for d in want} == want
    assert [got[d].n_paragraphs for d in (9001, 9002, 9003)] == [0, 0, 0]
    assert got[None].families == "mit" and got[9004].families == got[9005].families == ""
    assert scan_licenses(docs.where("doc_id > 99999")).count() == 0


NOTICES = {
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
    "apache": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def test_wrapped_notices_and_declared_ids_are_found(spark, table):
    rng, rows, want = random.Random(5), [], {}
    for i in range(120):
        rows.append((i, "\n".join(tongue(rng, "abcdefghilmnorst", rng.randint(3, 30)) for _ in range(4))))
        want[i] = ("", 0)
    for family, notice in NOTICES.items():
        for width in (30, 50, 80):
            for mark in ("", "# ", " * ", "// ", "-- "):
                lines = [mark + x for x in textwrap.wrap(notice, width)]
                before = [mark + "Copyright 2020 the authors of this file", mark]
                rows.append((len(rows), "\n".join(before + lines + [mark, "int main of the program", "return 0"])))
                want[len(rows) - 1] = (family, 1)
    for name, family in (("BSD-2-Clause", "bsd"), ("GPL-2.0-only", "gpl"), ("LGPL-3.0-or-later", "lgpl"), ("MPL-2.0", "mpl"), ("0BSD", "bsd"), ("(MIT OR Apache-2.0)", "apache,mit"), ("ISC", "isc"), ("GPL-2.0+", "gpl")):
        rows.append((len(rows), f"// SPDX-License-Identifier: {name}\nint x"))
        want[len(rows) - 1] = (family, 1 + family.count(","))
    rows.append((len(rows), "\n".join([*textwrap.wrap(NOTICES["mit"], 60), "", *textwrap.wrap(NOTICES["apache"], 60), *textwrap.wrap(NOTICES["mit"], 60)])))
    want[len(rows) - 1] = ("apache,mit", 3)
    scattered = NOTICES["gpl"].split()
    rng.shuffle(scattered)
    rows.append((len(rows), "\n".join(textwrap.wrap(" ".join(scattered), 40))))
    want[len(rows) - 1] = ("", 0)
    docs = table(rows)
    got = {r.doc_id: (r.families, r.n_licenses) for r in scan_licenses(docs, fit_licenses(docs)).collect()}
    assert {d: (got[d], w, rows[d][1]) for d, w in want.items() if got[d] != w} == {}
