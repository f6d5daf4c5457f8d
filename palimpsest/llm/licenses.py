"""License scans: a trained paragraph classifier, scored by Spark expressions.

A sparse logistic regression over word unigrams and bigrams tells licence
families apart.  It is trained on the driver from the templates below, from
windows of them, and, as ``unknown``, from near misses, from licences that are
no family here, and from a bounded sample of the corpus's own lines.  A
temperature calibrates its probabilities on templates and foreign licences that
the fit has not seen, each left out as a whole.  A prediction is confirmed by
comparing the paragraph with the family's templates, n-grams by how few families
have them: what names a licence counts more than what all licences say.

Scoring is native.  Most paragraphs are passed over by a regular expression that
follows from the weights: it looks for the words without which no n-grams that
are left can lift any family over ``unknown``, so it changes no result.  Of the
others the known n-grams are kept and those go where the sum of their weights
lifts no family over ``unknown``.  What is left is joined to the weights and
templates, whose number is bounded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

# Phrases of public licences, by SPDX family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is MIT licensed.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GPLv3.",
        "Licensed under the GPLv2 or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "AGPL": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain.",
    ],
    "proprietary": [
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    ],
}
#: Sentences with licence words that grant nothing.
NEAR_MISSES = (
    "He lost his driver's license and paid a fine.",
    "The restaurant has a license to serve wine.",
    "She is a licensed physician with a free practice.",
    "The public library is open to any person.",
    "Permission to enter is granted at the gate.",
    "The general asked the public for patience.",
    "The warranty covers parts for two years.",
    "A copy of the letter was distributed to all.",
    "Apache helicopters flew over the base.",
    "He studied at MIT and published a version of his work.",
    "The committee reserved all seats for the authors.",
)
#: Licences that are no family here, each a group of its own when the temperature is fitted.
FOREIGN = (
    "Licensed under the Eclipse Public License 2.0.",
    "Released under the zlib License.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This font is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the Artistic License 2.0.",
    "This file is subject to the Common Development and Distribution License.",
    "Licensed under the Academic Free License version 3.0.",
    "Released under the Microsoft Public License.",
    "This work is licensed under the Open Database License.",
)
UNKNOWN = "unknown"
#: Paragraphs of the corpus that stand for ``unknown``, at most, and documents they come from.
BACKGROUND, BACKGROUND_DOCS = 1000, 200
#: Characters of such a line; folds of the calibration.
LINE, FOLDS = (21, 2000), 4
LASSO, STEPS = 4e-4, 300
#: Least calibrated probability of a family, least agreement with a template.
CERTAIN, AGREE = 0.5, 0.6
#: A part of a template confirms from so many n-grams on.
PART = 8


def grams_of(text: str) -> list[str]:
    """The distinct word unigrams and bigrams of a text, lower case."""
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]))


def gram_list(text: Column) -> Column:
    """All word unigrams and bigrams of a text, lower case, as Spark expressions."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def both(own):
        most = F.greatest(F.size(own) - 1, F.lit(0))
        return F.concat(own, F.zip_with(F.slice(own, 1, most), F.slice(own, 2, most), lambda a, b: F.concat(a, F.lit(" "), b)))

    return let(words, both)


def gram_column(text: Column) -> Column:
    """The distinct ones, as ``grams_of``."""
    return F.array_distinct(gram_list(text))


def windows(text: str) -> list[str]:
    """The text, and its runs of half and of two thirds of its words."""
    words, out = text.split(), [text]
    for part in (len(words) // 2, 2 * len(words) // 3):
        if part >= 6:
            out += [" ".join(words[k : k + part]) for k in range(0, len(words) - part + 1, max(1, part // 3))]
    return out


@dataclass(frozen=True)
class Model:
    families: list[str]  # the last one is UNKNOWN
    bias: list[float]
    weights: dict[str, list[float]]
    temperature: float
    gate: list[str]  # a text without any of these words is unknown

    def scores(self, text: str) -> np.ndarray:
        total = np.array(self.bias)
        for g in grams_of(text):
            total = total + np.array(self.weights.get(g, 0.0))
        e = np.exp((total - total.max()) / self.temperature)
        return e / e.sum()


def _softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _gate(bias: np.ndarray, weights: dict[str, list[float]], common: dict[str, int]) -> list[str]:
    """Words of which a text has one if any family's score can be above that of UNKNOWN.

    N-grams are allowed without a word of the gate, those first whose rarest
    word is the most common in the background, as long as all of them together
    lift no family over UNKNOWN.  Of each other n-gram the rarest word is in the gate.
    """
    rarest = {g: min(g.split(), key=lambda w: (common.get(w, 0), -len(w), w)) for g in weights}
    by_word: dict[str, list[str]] = {}
    for g, w in rarest.items():
        by_word.setdefault(w, []).append(g)
    reach, out = np.array(bias[:-1]) - bias[-1], []
    for w in sorted(by_word, key=lambda w: (-common.get(w, 0), len(w), w)):
        more = sum(np.maximum(np.array(weights[g][:-1]) - weights[g][-1], 0) for g in by_word[w])
        if (reach + more < 0).all():
            reach = reach + more
        else:
            out.append(w)
    return sorted(out)


def _temperature(z: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least loss, found by thirds of a logarithmic scale; unknown
    texts together count as much as the others, however many there are."""
    unknown = truth == z.shape[1] - 1
    weight = np.where(unknown, 1 / max(1, unknown.sum()), 1 / max(1, (~unknown).sum()))
    loss = lambda c: -(weight * np.log(_softmax(z / np.exp(c))[np.arange(len(truth)), truth] + 1e-12)).sum()
    low, high = np.log(0.1), np.log(10.0)
    for _ in range(60):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(background: list[str]) -> Model:
    """Fit to the templates' windows and to what is unknown; every text's temperature counts by a fit without its group."""
    families = [*TEMPLATES, UNKNOWN]
    unknown = len(TEMPLATES)
    texts = [(w, k, f"{f}{j}") for k, f in enumerate(TEMPLATES) for j, t in enumerate(TEMPLATES[f]) for w in windows(t)]
    texts += [(t, unknown, t) for t in (*NEAR_MISSES, *FOREIGN, *background)]
    grams = [set(grams_of(t)) for t, _, _ in texts]
    vocabulary = sorted(set().union(*(g for g, (_, k, _) in zip(grams, texts, strict=True) if k < unknown)))
    column = {g: k for k, g in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(vocabulary)))
    for row, own in enumerate(grams):
        for g in own & column.keys():
            x[row, column[g]] = 1
    y = np.array([k for _, k, _ in texts])
    hot = np.eye(len(families))[y]
    weight = np.minimum((len(texts) / len(families)) / hot.sum(axis=0)[y], 20)

    def solve(rows):
        a, h, w = x[rows], hot[rows], weight[rows] / weight[rows].sum()
        beta, bias = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
        ahead, ahead_bias, t = beta, bias, 1.0
        step = 2 / (1 + np.linalg.norm(a * np.sqrt(w)[:, None], 2) ** 2)
        for _ in range(STEPS):
            error = (_softmax(a @ ahead + ahead_bias) - h) * w[:, None]
            new = ahead - step * (a.T @ error)
            new = np.sign(new) * np.maximum(np.abs(new) - step * LASSO, 0)
            new_bias = ahead_bias - step * error.sum(axis=0)
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            m = (t - 1) / t_new
            ahead, ahead_bias = new + m * (new - beta), new_bias + m * (new_bias - bias)
            beta, bias, t = new, new_bias, t_new
        return beta, bias

    # a group (a template with its windows, or one unknown text) is in one fold
    order = {g: k for k, g in enumerate(dict.fromkeys(g for _, _, g in texts))}
    fold = np.array([order[g] % FOLDS for _, _, g in texts])
    z = np.zeros((len(texts), len(families)))
    for k in range(FOLDS):
        beta, bias = solve(fold != k)
        z[fold == k] = x[fold == k] @ beta + bias
    # of a template whose words its family has nowhere else, the fit without it can know nothing
    counts, truth = gram_weights(), y.copy()
    for row, (own, (_, k, group)) in enumerate(zip(grams, texts, strict=True)):
        if k < unknown:
            rest = set().union(*(set(grams_of(t)) for j, t in enumerate(TEMPLATES[families[k]]) if f"{families[k]}{j}" != group))
            if sum(counts[g] for g in own & rest) < sum(counts.get(g, 1.0) for g in own) / 2:
                truth[row] = unknown
    temperature = _temperature(z, truth)
    beta, bias = solve(np.ones(len(texts), bool))
    common: dict[str, int] = {}
    for text in background:
        for w in set(grams_of(text)):
            common[w] = common.get(w, 0) + 1
    weights = {g: [float(v) for v in beta[k]] for g, k in column.items() if np.abs(beta[k]).max() > 1e-6}
    return Model(families, [float(b) for b in bias], weights, temperature, _gate(bias, weights, common))


def background_sample(docs: DataFrame) -> list[str]:
    """At most BACKGROUND paragraphs of at most BACKGROUND_DOCS documents picked by hash, without licence words."""
    # hashes are picked before any text moves, so copies count once and the texts of a corpus stay where they are
    texts = docs.select("text", F.xxhash64("text").alias("h")).filter(F.col("text").isNotNull())
    picked = texts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).orderBy("h").limit(BACKGROUND_DOCS).select("h")
    rows = texts.join(F.broadcast(picked), "h").groupBy("h").agg(F.min("text").alias("text"))
    lines = rows.select(F.explode(F.split("text", "\n")).alias("line")).filter(
        ~F.col("line").rlike(r"(?i)licen[cs]|copyright|permission|warrant|public domain|all rights") & F.length("line").between(*LINE)
    )
    rows = lines.distinct().orderBy(F.xxhash64("line"), "line").limit(BACKGROUND).collect()
    known = [set(grams_of(t)) for ts in TEMPLATES.values() for t in ts]

    def strange(line: str) -> bool:
        """Whether the line has less than a third of its n-grams from any one template."""
        own = set(grams_of(line))
        return all(3 * len(own & t) < len(own) for t in known)

    return sorted(x for x in (r["line"] for r in rows) if strange(x))


def gram_weights() -> dict[str, float]:
    """What each n-gram of the templates counts in a comparison: the reciprocal of the number of families that have it."""
    have: dict[str, set[str]] = {}
    for f, ts in TEMPLATES.items():
        for t in ts:
            for g in grams_of(t):
                have.setdefault(g, set()).add(f)
    return {g: 1 / len(fs) for g, fs in have.items()}


def _pattern(words: list[str]) -> str:
    """A pattern for any of the words in a lower-case text, branched by their first characters."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    branches = "|".join(f"{c}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for c, rest in sorted(by.items()))
    return rf"(?<![\p{{L}}\p{{N}}])(?:{branches})(?![\p{{L}}\p{{N}}])" if words else "(?!)"


def scan_paragraphs(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, body (a hash of the text), paragraph, lines, family, probability, agreement and
    confirmed of every paragraph that a family is predicted for.

    A paragraph is a line of the text (from 0), or with ``lines`` 2 that line and
    the next one, as notices may be wrapped.  ``agreement`` is the part of the
    best template's n-grams that the paragraph has or, from PART n-grams on, of
    the paragraph's that the template has, by their ``gram_weights``; n-grams of
    no template count 1.  Null and empty texts have no paragraphs.
    """
    spark = docs.sparkSession
    model = model or train(background_sample(docs))
    known = model.families[:-1]
    pattern = _pattern(model.gate)
    cut = F.split("text", "\n")
    pairs = F.zip_with(F.slice(cut, 1, F.size(cut) - 1), F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    lines = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .filter(F.lower("text").rlike(pattern))
        .select("doc_id", F.xxhash64("text").alias("body"), F.explode(F.array(F.struct(F.lit(1).alias("lines"), cut.alias("all")), F.struct(F.lit(2).alias("lines"), pairs.alias("all")))).alias("u"))
        .select("doc_id", "body", F.col("u.lines").alias("lines"), F.posexplode("u.all").alias("paragraph", "line"))
        .filter(F.lower("line").rlike(pattern))
    )
    counts = gram_weights()
    row = ["doc_id", "body", "lines", "paragraph", "n"]
    # the exact scores' signs, from the few known n-grams of a paragraph: below UNKNOWN for every family is no prediction
    hits = F.array_distinct(F.filter(gram_list(F.col("line")), lambda g: g.isin(list(counts))))
    above = {g: [w - ws[-1] for w in ws[:-1]] for g, ws in model.weights.items()}
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    # a map is searched key by key: one of maps, by the length and then by the n-gram
    by_length: dict[int, list] = {}
    for g, ws in above.items():
        by_length.setdefault(len(g), []).extend((F.lit(g), numbers(ws)))
    step = F.create_map(*[x for n, own in by_length.items() for x in (F.lit(n), F.create_map(*own))])
    none = numbers([0.0] * len(known))
    add = lambda total, g: F.zip_with(total, F.coalesce(step[F.length(g)][g], none), lambda x, y: x + y)
    ahead = F.aggregate("hits", numbers(b - model.bias[-1] for b in model.bias[:-1]), add)
    kept = lines.select("*", F.explode(F.array(hits)).alias("hits")).filter(F.exists(ahead, lambda x: x >= -1e-9))
    grams = kept.select("doc_id", "body", "lines", "paragraph", F.size(gram_column(F.col("line"))).alias("n"), "hits")
    each = grams.select(*row, F.explode("hits").alias("gram"))

    templates = [(k, f, grams_of(t)) for k, (f, t) in enumerate((f, t) for f in TEMPLATES for t in TEMPLATES[f])]
    # a row for each n-gram and class that it counts for: families first, then templates, then the known n-grams and what they count
    shift = len(model.families)
    some = shift + len(templates)
    rows = [(g, k, float(w)) for g, ws in model.weights.items() for k, w in enumerate(ws) if w]
    rows += [(g, shift + k, counts[g]) for k, _, own in templates for g in own]
    rows += [r for g, c in counts.items() for r in ((g, some, 1.0), (g, some + 1, c))]
    table = spark.createDataFrame(rows, "gram string, class int, value double")
    met = each.join(F.broadcast(table), "gram")  # bounded by the templates
    sums = met.groupBy(*row, "class").agg(F.sum("value").alias("value"))
    sums = sums.groupBy(*row).agg(F.map_from_entries(F.collect_list(F.struct("class", "value"))).alias("m"))
    at = lambda c: F.coalesce(F.col("m").getItem(c), F.lit(0.0))
    total = [F.exp((at(k) + model.bias[k]) / model.temperature) for k in range(shift)]
    whole = sum(total[1:], total[0])

    def agreement(family):
        out = F.lit(0.0)
        for k, f, own in templates:
            if f == family:
                part = F.when(F.col("n") >= PART, at(shift + k) / F.col("all")).otherwise(F.lit(0.0))
                out = F.greatest(out, at(shift + k) / sum(counts[g] for g in own), part)
        return out

    named = [F.struct(F.col("e")[k].alias("p"), F.lit(f).alias("family"), agreement(f).alias("agreement")) for k, f in enumerate(known)]
    scored = sums.select("*", F.array(*total).alias("t"), whole.alias("whole"), (F.col("n") - at(some) + at(some + 1)).alias("all"))
    scored = scored.select("*", F.transform("t", lambda x: x / F.col("whole")).alias("e"))
    scored = scored.select("doc_id", "body", "paragraph", "lines", F.array_max(F.array(*named)).alias("best"))
    return scored.filter(F.col("best.p") >= CERTAIN).select(
        "doc_id", "body", "paragraph", "lines", F.col("best.family").alias("family"), F.col("best.p").alias("probability"),
        F.col("best.agreement").alias("agreement"), (F.col("best.agreement") >= AGREE).alias("confirmed"),
    )


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for every row of ``docs``: doc_id, family, probability, agreement,
    paragraph and n_paragraphs of its surest licence paragraph.

    Only confirmed paragraphs count, and pairs of lines only in texts without a
    confirmed line; the likeliest is named, then the earliest.  Without one the
    family is ``unknown`` and the other columns are null or 0, as for null and
    empty texts.  Very long texts are scanned whole.  Rows that repeat a doc_id
    and text get the same result; an empty table gives an empty one.
    """
    key, body, same = fresh(docs.columns, "key", "body", "same")
    found = scan_paragraphs(docs, model).filter("confirmed")
    surest = F.max(F.struct((-F.col("lines")).alias("short"), "probability", "agreement", (-F.col("paragraph")).alias("back"), "family"))
    count = lambda k: F.sum((F.col("lines") == k).cast("int"))
    number = F.when(count(1) > 0, count(1)).otherwise(count(2)).cast("int")
    best = found.groupBy("doc_id", "body").agg(surest.alias("b"), number.alias("n_paragraphs"))
    best = best.select(F.col("doc_id").alias(key), F.col("body").alias(same), "b", "n_paragraphs")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias(body))
    out = rows.join(best, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(body) == F.col(same)), "left")
    return out.select(
        "doc_id",
        F.coalesce("b.family", F.lit(UNKNOWN)).alias("family"),
        F.col("b.probability").alias("probability"),
        F.col("b.agreement").alias("agreement"),
        (-F.col("b.back")).alias("paragraph"),
        F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"),
    )
