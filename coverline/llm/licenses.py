"""Operator 5: licence notices in whole texts, in DataFrame functions only.

A paragraph is a run of lines without a line that holds no words; within it a notice is one line, or consecutive lines over
which it is wrapped. A notice is turned into its distinct one- to three-word runs. A sparse logistic regression over these
runs gives each family a probability, with a class for none of them. It is trained here on notices made by rule, each
opening with each name of a licence, on the licences' own headers, on the same openings before things that are no known
licence, on openings and headers that stop before the name, and on sentences that only talk about licences. A temperature is
fitted on openings, unknown licences and sentences that were not trained on, so that probabilities are honest.

A prediction counts only if it is confirmed against templates, the names and headers of its family: one must have enough of
its runs in the notice, and be there in full or to a larger part than every template of the other families. That needs a
pair of words: of a template of n words at most n of 3n - 3 runs are single words, under 0.6 from three words on, and one of
two words must be there in full. So lines without a pair of words of some template are unknown without being scored.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: What each licence is called.
NAMES: dict[str, tuple[str, ...]] = {
    "agpl-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPL-3.0"),
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "bsd-2-clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "bsd-3-clause": ("BSD 3-Clause License", "New BSD License", "BSD License", "BSD-3-Clause"),
    "bsl-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"),
    "cc-by-4.0": ("Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0", "CC BY 4.0"),
    "cc-by-nc-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 4.0"),
    "cc-by-sa-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 4.0"),
    "cc0-1.0": ("CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "CC0 1.0"),
    "epl-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "EPL-2.0"),
    "gpl-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GNU GPL v2", "GPL-2.0"),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GNU GPL v3", "GPL-3.0"),
    "isc": ("ISC License", "Internet Systems Consortium License"),
    "lgpl-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL version 2.1", "GNU LGPL v2.1", "LGPL-2.1"),
    "lgpl-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL version 3", "GNU LGPL v3", "LGPL-3.0"),
    "mit": ("MIT License", "The MIT License", "MIT Licence"),
    "mpl-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL-2.0"),
    "ofl-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "OFL-1.1"),
    "unlicense": ("The Unlicense",),
    "zlib": ("zlib License", "zlib/libpng License"),
}
#: Headers that licences ask for, or the sentence their texts begin with.
HEADERS: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",),
    "bsd-2-clause": (),
    "bsd-3-clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "cc0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
}
#: The header that four licences share but for their name and version.
COMMON = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
COMMON_OF = {"agpl-3.0": ("program", "Affero General Public License", "3"), "gpl-2.0": ("program", "General Public License", "2"), "gpl-3.0": ("program", "General Public License", "3"), "lgpl-2.1": ("library", "Lesser General Public License", "2.1"), "lgpl-3.0": ("library", "Lesser General Public License", "3")}
#: Openings, before a name: to train on, and to fit the temperature on.
OPENINGS = ("Licensed under {}.", "Released under {}.", "Distributed under the terms of {}.", "This work is licensed under {}.", "This project is free software under {}.", "SPDX-License-Identifier: {}", "{}", "Copyright by the authors, {}, see the file.", "You can redistribute it under {}.", "The code is covered by {}.")
OPENINGS_HELD = ("Made available under {}.", "You may copy and share it under {}.", "Use of this source is governed by {}.", "All our files are subject to {}.", "License: {}")
#: What stands in the place of a name without being one: to train on, and to fit the temperature on.
NO_NAMES = ("a commercial license", "the same license", "the terms of service", "an agreement with the publisher", "the public license of the city", "the Artistic License 2.0", "the Open Software License 3.0", "the PostgreSQL License", "the GNU Free Documentation License", "the law of the state", "version 3 of the contract", "no license", "a Creative Commons license", "the Microsoft Public License", "the old software license", "GNU General Public License", "General Public License", "the terms of the GNU project", "Creative Commons", "license version 2.0", "Public License 2.0")
NO_NAMES_HELD = ("a special license", "the Sleepycat License", "the Eiffel Forum License 2.0", "the Academic Free License 3.0", "an order of the court", "the rules of the house", "the Python License 2.0", "the European Union Public License 1.2", "a site license for 3 users")
#: Sentences that only talk about licences: to train on, and to fit the temperature on.
OTHERS = (
    "All rights reserved.", "Copyright of the photograph is held by the museum.", "She is a licensed driver and nurse.", "The licence fee was raised by the council.", "Permission to enter was refused at the gate.",
    "The restaurant lost its license to serve alcohol.", "A version of this story appeared in the public press.", "The general public may visit under the new terms.", "Under the law a warranty covers the engine.",
    "The apache helicopter landed at the base.", "Students of the mit visited the software company.", "You may license this image from our agency.", "The software is sold without warranty.", "The foundation is free to modify its terms.",
    "He will boost the economy in version 2.0 of his plan.", "The eclipse was seen by the public.", "The mozilla foundation published its report.", "Use of the creative commons by artists is growing.", "The work is in the public domain.", "Version 3 of the software was released on Monday.",
)
OTHERS_HELD = (
    "The museum holds copyright in all the pictures.", "He was granted a licence to sell wine.", "The use of the public park is free of charge.", "Permission of the owner is required by law.", "The terms of the contract were made public by the company.",
    "The free software movement began in the eighties.", "A copy of the license hangs in the shop.", "The attribution of the painting is in doubt.", "Version 2.0 of the program is free.", "The new license plates are blue.",
)
WORD = r"[a-z0-9]+"
ANCHOR = r"(?i)licen[sc]|copyright|permission|redistribut|creative commons|public domain|\bcc0\b|\bcc[ -]by|free software"
ACCEPT, SHARED, LEAST_SHARED = 0.5, 0.6, 3
#: Steps of training, and the weight below which a run is left out of the model.
STEPS, DECAY, SMALL, FOLDS = 200, 2e-3, 0.02, 2


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def runs(text: str | list[str]) -> list[str]:
    found = words(text) if isinstance(text, str) else text
    return sorted({" ".join(found[i : i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)})


def headers(family: str) -> tuple[str, ...]:
    common = (COMMON.format(*COMMON_OF[family]),) if family in COMMON_OF else ()
    return HEADERS.get(family, ()) + common


def templates(family: str) -> list[list[str]]:
    """The runs of each name of at least two words and of each header."""
    return [r for r in map(runs, (*NAMES[family], *headers(family))) if len(r) >= LEAST_SHARED]


#: Words of which a pair says nothing of a licence.
PLAIN = frozenset("a all and any are as at be by for from in is it may no not of on or that the this to under will with you your".split(" "))


@functools.cache
def pairs() -> list[str]:
    """Pairs of words of templates by which a line is worth scoring. Pairs of plain words alone are not: together with all
    single words they never make up the share of a template that a confirmation needs."""
    plain = lambda run: set(run.split(" ")) <= PLAIN
    for f in NAMES:
        for t in templates(f):
            if sum(" " not in r or plain(r) for r in t) >= max(LEAST_SHARED, SHARED * len(t)):
                raise ValueError(f"a template of {f} can be confirmed without a pair that tells")
    return sorted({r for f in NAMES for t in templates(f) for r in t if r.count(" ") == 1 and not plain(r)})


def longest() -> int:
    """Words of the longest template."""
    return max(len(words(t)) for f in NAMES for t in (*NAMES[f], *headers(f)))


def said(opening: str, name: str) -> str:
    """Names take an article in a sentence, but for short ones and those that have one."""
    bare = opening.startswith(("SPDX", "License:", "{}")) or name.lower().startswith(("the ", "cc", "a ", "an ", "no ")) or " " not in name
    return opening.format(name if bare else f"the {name}")


def made(openings: tuple[str, ...], no_names: tuple[str, ...], others: tuple[str, ...], names: dict[str, tuple[str, ...]] = NAMES) -> list[tuple[str, str]]:
    """(family, notice) by rule: every opening with every name, and what is of no family."""
    found = [(f, said(o, n)) for f, known in names.items() for n in known for o in openings]
    found += [(UNKNOWN, said(o, n)) for n in no_names for o in openings] + [(UNKNOWN, o.format("")) for o in openings if o != "{}"]
    return found + [(UNKNOWN, t) for t in others]


def shown(names: dict[str, tuple[str, ...]] = NAMES) -> list[tuple[str, str]]:
    """What is trained on: notices by rule, headers, and headers that stop before their family shows."""
    found = made(OPENINGS, NO_NAMES, OTHERS, names)
    for f in names:
        for t in headers(f):
            found += [(f, t)] * 4
            parts = t.split(" ")
            found += [(UNKNOWN, " ".join(parts[:k])) for k in (5, 9, 13, 17) if f in COMMON_OF and k < len(parts)]
            found += [(UNKNOWN, " ".join(parts[-k:])) for k in (7, 11) if f in COMMON_OF]
    return found


def folds() -> list[tuple[dict[str, tuple[str, ...]], list[tuple[str, str]]]]:
    """For each fold the names that a model is trained on, and notices to measure it by: names it has not seen, of families
    it has seen and of families it has not, which are unknown to it."""
    out = []
    for fold in range(FOLDS):
        left_out = [f for k, f in enumerate(sorted(NAMES)) if k % (2 * FOLDS) == 2 * fold + 1]
        seen = {f: tuple(n for k, n in enumerate(names) if k % FOLDS != fold or len(names) == 1) for f, names in NAMES.items() if f not in left_out}
        asked = {f: tuple(n for n in NAMES[f] if n not in names) for f, names in seen.items()}
        unknown = tuple(n for f in left_out for n in NAMES[f]) + NO_NAMES_HELD
        out.append((seen, made(OPENINGS_HELD, unknown, OTHERS_HELD, asked)))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def trained(rows: list[tuple[str, str]], classes: list[str]) -> dict[str, list[float]]:
    """A weight of each run for each class, by gradient steps; runs that tell nothing shrink to zero and are left out."""
    found = [runs(t) for _, t in rows]
    vocabulary = sorted({r for x in found for r in x})
    number = {r: k for k, r in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for k, r in enumerate(found):
        x[k, [number[v] for v in r]] = 1 / max(1, len(r)) ** 0.5
    y = np.zeros((len(rows), len(classes)), np.float32)
    y[np.arange(len(rows)), [classes.index(f) for f, _ in rows]] = 1
    # a class weighs as the root of its number of rows
    weight = (1 / y.sum(axis=0)[y.argmax(axis=1)]) ** 0.5
    weight /= weight.mean()
    w = np.zeros((len(vocabulary), len(classes)), np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        g = x.T @ ((_softmax(x @ w) - y) * weight[:, None]) / len(rows) + DECAY / 10 * w
        first += 0.1 * (g - first)
        second += 0.001 * (g * g - second)
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - 0.1 * DECAY, 0)
    return {r: [round(float(v), 4) for v in w[k]] for k, r in enumerate(vocabulary) if np.abs(w[k]).max() > SMALL}


@functools.cache
def model() -> tuple[list[str], dict[str, list[float]], float]:
    """Classes, a weight of each run for each class, and the temperature."""
    classes = [*sorted(NAMES), UNKNOWN]
    z, at = [], []
    for names, asked in folds():
        weights = trained(shown(names), classes)
        z += [odds(runs(t), weights, len(classes)) for _, t in asked]
        at += [classes.index(f) for f, _ in asked]
    tempered = {t: _softmax(np.array(z) / t) for t in (round(0.2 + 0.05 * k, 2) for k in range(100))}
    cost = {t: -np.log(p[np.arange(len(at)), at] + 1e-9).mean() for t, p in tempered.items()}
    return classes, trained(shown(), classes), min(cost, key=cost.get)


def odds(found: list[str], weights: dict[str, list[float]], classes: int) -> list[float]:
    used = [weights[r] for r in found if r in weights]
    return [sum(v[k] for v in used) / max(1, len(used)) ** 0.5 for k in range(classes)]


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _constant(value, kind: str) -> Column:
    # one constant each, where thousands of literals would weigh on the plan
    return F.from_json(F.lit(json.dumps(value)), kind)


def _words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(f"({WORD})"), F.lit(1))


def _pairs(found: Column) -> Column:
    n = F.greatest(F.size(found) - 1, F.lit(0))
    return F.zip_with(F.slice(found, 1, n), F.slice(found, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def _runs(found: Column) -> Column:
    n = F.greatest(F.size(found) - 2, F.lit(0))
    three = lambda pairs: F.zip_with(F.slice(pairs, 1, n), F.slice(found, 3, n), lambda a, b: F.concat_ws(" ", a, b))
    return _let(_pairs(found), lambda pairs: F.array_distinct(F.concat(found, pairs, three(pairs))))


def _judged(words: Column) -> Column:
    """Class, probability, and the runs shared with the nearest template of that class: 0 where it is not confirmed."""
    classes, weight, temperature = model()
    known = sorted(weight)
    vocabulary = _constant(known, "array<string>")
    table = _constant({r: weight[r] for r in known}, "map<string,array<double>>")
    listed = _constant([templates(f) for f in classes[:-1]], "array<array<array<string>>>")
    zero = F.array(*(F.lit(0.0) for _ in classes))

    def decide(found: Column) -> Column:
        return _let(F.array_intersect(found, vocabulary), lambda used: F.struct(summed(used).alias("odds"), found.alias("runs")))

    def summed(used: Column) -> Column:
        total = F.aggregate(used, zero, lambda acc, r: F.zip_with(acc, F.element_at(table, r), lambda a, b: a + b))
        scale = F.sqrt(F.greatest(F.size(used), F.lit(1)).cast("double")) * temperature
        return _let(total, lambda total: F.transform(total, lambda t: F.exp((t - F.array_max(total)) / scale)))

    def choose(x: Column) -> Column:
        share = F.transform(x.odds, lambda o: o / F.aggregate(x.odds, F.lit(0.0), lambda a, b: a + b))
        best = F.array_max(F.transform(share, lambda p, i: F.struct(p.alias("p"), (-i).alias("k"))))
        return F.struct((-best.k).alias("k"), best.p.alias("p"), x.runs.alias("runs"))

    def confirm(x: Column) -> Column:
        part = lambda t: F.size(F.array_intersect(x.runs, t))

        def shared(t: Column) -> Column:
            enough = lambda n: F.when((n >= LEAST_SHARED) & (n >= SHARED * F.size(t)), n).otherwise(0)
            return _let(part(t), lambda n: F.struct(enough(n).alias("n"), (n / F.size(t)).alias("part")))

        def agreed(near: Column) -> Column:
            """The nearest template of the family, if one is there in full or to a larger part than any other family's."""
            most = F.array_max(F.transform(near, lambda s: s["n"]))
            own = F.array_max(F.transform(F.filter(near, lambda s: s["n"] > 0), lambda s: s.part))
            rival = F.array_max(F.transform(listed, lambda family, k: F.when(k == x.k, 0.0).otherwise(F.array_max(F.transform(family, lambda t: part(t) / F.size(t))))))
            return F.when((most > 0) & ((own >= 1) | (own > rival)), most).otherwise(0)

        near = F.when((x.p >= ACCEPT) & (x.k < len(classes) - 1), _let(F.transform(F.get(listed, x.k), shared), agreed))
        return F.struct(x.k.alias("k"), x.p.alias("p"), F.coalesce(near, F.lit(0)).alias("shared"))

    return _let(_let(_let(_runs(words), decide), choose), confirm)


def _wrapped(words: Column, hot: Column, single: Column) -> Column:
    """Notices over several lines: (first, last, judged), each sharing more with its notice than its lines do on their own.

    A window starts and ends in a line with a pair of words of some template, holds no line without words, and goes on until
    it has as many words as the longest template, however narrow its lines.
    """
    span = lambda rows, i, j: F.slice(rows, i + 1, j - i + 1)
    begins = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(hot, i))

    def inside(i: Column, j: Column) -> Column:
        return F.get(hot, j) & ~F.exists(span(words, i, j), lambda w: F.size(w) == 0) & (F.aggregate(span(words, i, j - 1), F.lit(0), lambda n, w: n + F.size(w)) < longest())

    def from_line(i: Column) -> Column:
        last = F.least(i + longest(), F.size(words) - 1)
        ends = F.when(last > i, F.filter(F.sequence(i + 1, last), lambda j: inside(i, j))).otherwise(F.array().cast("array<int>"))
        return F.transform(ends, lambda j: F.struct(i.alias("first"), j.alias("last"), _judged(F.flatten(span(words, i, j))).alias("x")))

    def better(w: Column) -> Column:
        return w.x.shared > F.aggregate(span(single, w["first"], w["last"]), F.lit(0), lambda n, x: n + F.coalesce(x.shared, F.lit(0)))

    found = F.filter(F.flatten(F.transform(begins, from_line)), better)

    # of windows that overlap, the one that shares most, then the earlier and shorter one
    def choose(kept: Column, w: Column) -> Column:
        held = F.get(kept, F.size(kept) - 1)
        apart = F.coalesce(w["first"] > held["last"], F.lit(True))
        rest = F.when(apart, kept).otherwise(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        return F.when(apart | (w.x.shared > held.x.shared), F.concat(rest, F.array(w))).otherwise(kept)

    return _let(found, lambda found: F.aggregate(found, F.slice(found, 1, 0), choose))


def with_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with found: an array of (line, family, probability), in order, for paragraphs with a licence word or a known family."""
    classes, _, _ = model()
    names = F.array(*(F.lit(c) for c in classes))
    telling = _constant(pairs(), "array<string>")

    def with_lines(lines: Column) -> Column:
        return _let(F.transform(lines, _words), lambda words: with_words(lines, words))

    def with_words(lines: Column, words: Column) -> Column:
        def near(w: Column, i: Column) -> Column:
            before, after = F.get(words, i - 1), F.get(words, i + 1)
            edge = lambda side, at: F.coalesce(F.slice(side, at, 1), F.array().cast("array<string>"))
            last = F.when(F.size(before) > 0, F.slice(before, -1, 1))
            return F.coalesce(F.arrays_overlap(_pairs(F.concat(F.coalesce(last, F.array().cast("array<string>")), w, edge(after, 1))), telling), F.lit(False))

        return _let(F.transform(words, near), lambda hot: with_hot(lines, words, hot))

    def with_hot(lines: Column, words: Column, hot: Column) -> Column:
        single = F.transform(words, lambda w, i: F.when(F.get(hot, i) | F.get(lines, i).rlike(ANCHOR), _judged(w)))
        return _let(single, lambda single: _let(_wrapped(words, hot, single), lambda over: listed(lines, single, over)))

    def listed(lines: Column, single: Column, over: Column) -> Column:
        entry = lambda line, last, x: F.struct(line.alias("line"), last.alias("last"), F.when(x.shared > 0, F.get(names, x.k)).otherwise(UNKNOWN).alias("family"), x.p.alias("probability"))
        held = F.filter(F.transform(single, lambda x, i: entry(i, i, x)), lambda e: e.probability.isNotNull() & ((e.family != UNKNOWN) | F.get(lines, e.line).rlike(ANCHOR)))
        alone = lambda held: F.filter(held, lambda e: ~F.exists(over, lambda w: e.line.between(w["first"], w["last"])))
        rows = _let(held, lambda held: F.concat(alone(held), F.transform(over, lambda w: entry(w["first"], w["last"], w.x))))
        return F.transform(F.array_sort(rows), lambda e: F.struct(e.line, e.family, e.probability))

    return docs.withColumn("found", _let(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), with_lines))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, n_licenses, families, spans.

    n_paragraphs counts paragraphs with a licence word or of a known family, a notice wrapped over lines once; n_licenses
    counts those of a known family; families are distinct, in order; spans are family:line (from 0), the first line of
    wrapped notices. ``docs`` needs doc_id and text; other columns are not read. A null or empty
    text has none. Repeated rows give repeated results.
    """
    found = with_licenses(docs.select("doc_id", "text"))
    sure = F.filter("found", lambda x: x.family != UNKNOWN)
    return found.select(
        "doc_id", F.size("found").cast("long").alias("n_paragraphs"), F.size(sure).cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x.family))), ",").alias("families"),
        F.array_join(F.transform(sure, lambda x: F.concat_ws(":", x.family, x.line.cast("string"))), ",").alias("spans"),
    )
