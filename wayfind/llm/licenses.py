"""Licence scans: a trained paragraph classifier confirmed by templates, in DataFrame operations only.

A paragraph is a run of lines that are not blank, read as one text, so a notice may be wrapped. Paragraphs that
hold a whole notice name their family; they, the notices, clauses of the licences' texts and a bounded sample of
other paragraphs train a multinomial logistic regression over word 1- to 3-grams, with ``unknown`` as the class of
everything else. Features are the n-grams of notices and clauses and those that recur in a family's labelled
paragraphs, without function words and n-grams that are common in other paragraphs; so a paragraph without any is
unknown by its constant alone and need not be scored. A temperature fitted on held-out rows calibrates the
probabilities. A prediction is confirmed if some stretch of the paragraph has enough of the word pairs of one of
the family's notices or clauses. A paragraph has a row for the likeliest family and, confirmed, for each further
family of which it holds a whole notice.

Defined cases: null and empty texts have no paragraphs; paragraphs without a feature give no row; paragraphs
that repeat with their id and number count once; ties go to the family first in the alphabet; an empty
corpus still trains on the notices and clauses; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import kept

UNKNOWN = "unknown"
#: Short notices and titles by family: fixed values.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "bsd-3-clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License", "BSD 3-Clause License"],
    "cc-by-4.0": ["Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0-1.0": ["CC0 1.0 Universal Public Domain Dedication", "Released under CC0 1.0"],
    "gpl-2.0": ["GNU General Public License, version 2", "under the terms of the GNU General Public License version 2"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3", "GNU General Public License version 3"],
    "lgpl-2.1": ["GNU Lesser General Public License, version 2.1", "Licensed under the GNU Lesser General Public License"],
    "mit": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"],
    "proprietary": ["All rights reserved", "No part of this work may be reproduced without the written permission of the publisher"],
}
#: Clauses of the licences' texts by family, each shorter than STRIDE words: fixed values.
_GPL_HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
_GPL_COPY = "You should have received a copy of the GNU General Public License along with this program"
_GPL_FREE = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
_CC_SHARE = "You are free to share, copy and redistribute the material in any medium or format"
_CC_CREDIT = "You must give appropriate credit, provide a link to the license, and indicate if changes were made"
CLAUSES = {
    "apache-2.0": ["you may not use this file except in compliance with the License", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "See the License for the specific language governing permissions and limitations under the License", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"],
    "bsd-3-clause": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"],
    "cc-by-4.0": [_CC_SHARE, _CC_CREDIT],
    "cc-by-nc-4.0": [_CC_SHARE, _CC_CREDIT, "You may not use the material for commercial purposes"],
    "cc-by-sa-4.0": [_CC_SHARE, _CC_CREDIT, "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original"],
    "cc0-1.0": ["The person who associated a work with this deed has dedicated the work to the public domain", "waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights"],
    "gpl-2.0": [_GPL_FREE, "either version 2 of the License, or (at your option) any later version", _GPL_HOPE, _GPL_COPY],
    "gpl-3.0": [_GPL_FREE, "either version 3 of the License, or (at your option) any later version", _GPL_HOPE, _GPL_COPY],
    "lgpl-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "either version 2.1 of the License, or (at your option) any later version", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "You should have received a copy of the GNU Lesser General Public License along with this library"],
    "mit": ["to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED", "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE"],
    "mpl-2.0": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "proprietary": ["Unauthorized copying of this file, via any medium, is strictly prohibited", "This software is proprietary and confidential", "may be reproduced, distributed, or transmitted in any form or by any means, without the prior written permission of the publisher"],
}
FAMILIES = sorted(TEMPLATES)
#: Function words that are no features on their own: fixed values.
_PLAIN = frozenset("a an and any are at by for form forms free from in is may no of on or part person subject terms the this to use version with without work you your copy all obtain source use public international general".split())
#: At most so many distinct paragraphs of each kind train.
MAX_FIT_ROWS = 2_000
#: A feature stands in at most this share of the other paragraphs.
COMMON = 0.001
#: Words in more than this share of the other paragraphs are function words as well.
FREQUENT = 0.02
#: An n-gram recurs in a family if so many of its labelled paragraphs, and this share of them, have it.
RECURS, RECURS_SHARE = 3, 0.05
CONFIRM_FROM = 0.6
GRAMS = 3
#: A paragraph's stretches overlap: every run of STRIDE words lies in one.
STRIDE = 40


def tokens_of(text: str) -> list[str]:
    return [x for x in re.split(r"[^a-z0-9]+", text.lower()) if x]


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)}


def _runs(words: Column, n: int) -> Column:
    joined = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))


def _grams(words: Column, least: int = 1, most: int = GRAMS) -> Column:
    return F.array_distinct(F.flatten(F.array(*(_runs(words, n) for n in range(least, most + 1)))))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, block): every run of lines that are not blank, with its number."""
    blocks = F.filter(F.split(F.col(text_col), r"\n\s*\n"), lambda x: x.rlike(r"\S"))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(blocks).alias("paragraph", "block"))


def with_cue(blocks: DataFrame, cues: set[str]) -> DataFrame:
    """Those paragraphs, with their words, that hold one of these words."""
    return blocks.withColumn("words", tokens(F.col("block"))).filter(F.arrays_overlap("words", F.array(*map(F.lit, sorted(cues))).cast("array<string>")))


def _key(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _holds(key: Column, text: str) -> Column:
    return key.contains(f" {' '.join(tokens_of(text))} ")


@dataclass
class Model:
    features: list[str]
    weights: np.ndarray  # features x classes
    constant: np.ndarray
    temperature: float
    cues: set[str] = field(default_factory=set)

    @property
    def classes(self) -> list[str]:
        return [*FAMILIES, UNKNOWN]


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(words, family): a bounded sample of the distinct paragraphs that hold a whole notice."""
    names = sorted(((t, f) for f in FAMILIES for t in TEMPLATES[f]), key=lambda x: -len(x[0]))
    # a text with a notice has the notice's longest word; cheaper than to take all texts apart
    cues = {max(tokens_of(t), key=len) for t, _ in names}
    low = F.lower(F.col(text_col))
    some = docs.filter(F.greatest(*(low.contains(c) for c in sorted(cues)), F.lit(False)))
    # kept, so that the key is made once a row and not once a notice
    weak = kept(with_cue(paragraphs(some, id_col, text_col), cues).select("words", _key(F.col("words")).alias("key")), "licence-cued")
    family = F.coalesce(*(F.when(_holds(F.col("key"), t), F.lit(f)) for t, f in names))
    found = kept(weak.select("words", family.alias("family"), F.xxhash64("key").alias("h")).filter("family is not null"), "licence-labelled")
    return _sample(found, "words", "family")


def _sample(rows: DataFrame, *columns: str) -> DataFrame:
    """Of the rows with distinct h, those with the smallest MAX_FIT_ROWS values of h."""
    last = rows.select("h").distinct().orderBy("h").limit(MAX_FIT_ROWS).agg(F.max("h")).first()[0]
    chosen = rows.filter(F.col("h") <= last) if last is not None else rows.limit(0)
    return kept(chosen.groupBy("h").agg(*(F.first(c).alias(c) for c in columns)), "licence-sample")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on the paragraphs of these texts, the notices and the clauses."""
    positive = _labelled(docs, id_col, text_col)
    hashed = paragraphs(docs, id_col, text_col).select("block", F.xxhash64("block").alias("h"))
    own = [c for f in FAMILIES for c in (*TEMPLATES[f], *CLAUSES[f])]
    other = _sample(hashed, "block").withColumn("words", tokens(F.col("block")))
    other = other.filter(~F.col("block").rlike("(?i)licen[cs]e|copyright|all rights reserved|public domain|permission"))
    # n-grams that recur in a family's paragraphs
    sizes = {r["family"]: r["n"] for r in positive.groupBy("family").agg(F.count(F.lit(1)).alias("n")).collect()}
    recurring = positive.select("family", F.explode(_grams(F.col("words"))).alias("gram")).groupBy("family", "gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= RECURS)
    least = F.coalesce(*(F.when(F.col("family") == f, F.lit(RECURS_SHARE * n)) for f, n in sizes.items()), F.lit(0.0))
    wanted = {g for t in own for g in grams_of(tokens_of(t))} | {r["gram"] for r in recurring.filter(F.col("n") >= least).select("gram").distinct().collect()}
    common: dict[str, int] = {}
    negative = []
    phrases = [f" {' '.join(tokens_of(t))} " for t in own]
    for r in other.select("words").toLocalIterator():
        key = f" {' '.join(r['words'])} "
        if any(t in key for t in phrases):
            continue
        g = wanted & grams_of(r["words"])
        negative.append(g)
        for x in g:
            common[x] = common.get(x, 0) + 1
    most = max(1, COMMON * len(negative))
    plain = _PLAIN | {g for g, n in common.items() if " " not in g and n > max(1, FREQUENT * len(negative))}
    features = sorted(g for g in wanted if common.get(g, 0) <= most and set(g.split()) - plain)
    known = set(features)
    told = [(known & grams_of(tokens_of(t)), FAMILIES.index(f)) for f in FAMILIES for t in (*TEMPLATES[f], *CLAUSES[f], " ".join(CLAUSES[f]))]
    rows = [(known & grams_of(r["words"]), FAMILIES.index(r["family"])) for r in positive.orderBy("h").toLocalIterator()]
    rows += [(known & g, len(FAMILIES)) for g in negative]
    rows += [({g}, len(FAMILIES)) for g in features if " " not in g]  # one licence word alone names no family
    model = _regression(features, told, rows)
    # a feature's rarest word: a paragraph without any of these has no feature
    model.cues = {min(g.split(), key=lambda w: (w in plain, common.get(w, 0), -len(w), w)) for g in features}
    return model


def _regression(features: list[str], told: list[tuple[set[str], int]], rows: list[tuple[set[str], int]]) -> Model:
    """Every fifth row, but none of those told, is held out for the temperature. Equal rows are one with a weight."""
    place = {f: k for k, f in enumerate(features)}
    weights: dict[tuple, int] = {}
    for i, (g, c) in enumerate([*told, *rows]):
        at = (tuple(sorted(place[f] for f in g)), c, i >= len(told) and (i - len(told)) % 5 == 4)
        weights[at] = weights.get(at, 0) + 1
    x = np.zeros((len(weights), len(features) + 1), np.float32)
    x[:, -1] = 1
    for i, (hit, _, _) in enumerate(weights):
        if hit:
            x[i, list(hit)] = 1 / math.sqrt(len(hit))
    y, held = np.array([c for _, c, _ in weights]), np.array([h for _, _, h in weights])
    n = np.array(list(weights.values()), np.float32)
    classes = len(FAMILIES) + 1
    target = np.eye(classes, dtype=np.float32)[y]
    share = n / np.maximum(np.bincount(y, weights=n, minlength=classes), 1)[y].astype(np.float32)
    share[y == classes - 1] *= 3
    w = np.zeros((x.shape[1], classes), np.float32)
    speed = np.zeros_like(w)
    a, t, s = x[~held], target[~held], share[~held][:, None]
    for _ in range(400):
        z = a @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = a.T @ ((p - t) * s) + 1e-3 * w
        speed = 0.9 * speed - 0.5 * grad
        w = w + speed
    z = x[held] @ w
    best, temperature = math.inf, 1.0
    for k in np.geomspace(0.25, 4, 25) if (y[held] < classes - 1).any() else ():
        q = z / k
        q = q - q.max(axis=1, keepdims=True)
        loss = -(q - np.log(np.exp(q).sum(axis=1, keepdims=True)))[np.arange(len(q)), y[held]] * share[held]
        if loss.sum() < best:
            best, temperature = loss.sum(), float(k)
    return Model(features, w[:-1].astype(float), w[-1].astype(float), temperature)


def _share(words: Column, family: Column) -> Column:
    """The largest share of the word pairs of one of the family's notices or clauses in a stretch of the words."""
    stretches = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(STRIDE)), lambda i: _runs(F.slice(words, i, 2 * STRIDE), 2))
    texts = {f: [sorted({" ".join(x) for x in zip(w, w[1:])}) for t in (*TEMPLATES[f], *CLAUSES[f]) if (w := tokens_of(t))] for f in FAMILIES}
    best = lambda f: lambda pairs: F.greatest(*(F.size(F.array_intersect(pairs, F.array(*map(F.lit, g)))) / len(g) for g in texts[f]), F.lit(0.0))
    return F.coalesce(*(F.when(family == f, F.array_max(F.transform(stretches, best(f)))) for f in FAMILIES), F.lit(0.0))


def classify(near: DataFrame, model: Model) -> DataFrame:
    """(doc_id, paragraph, family, probability, template_share, confirmed) of every paragraph with a feature.

    near: paragraphs with their words. They are written with a number of their own; n-grams carry that number alone and the
    words join again where a paragraph has a feature, so a long paragraph is not copied for each of its n-grams.
    """
    spark = near.sparkSession
    near = kept(near.withColumn("row", F.monotonically_increasing_id()), "licence-blocks")
    n = len(model.classes)
    weights = F.broadcast(spark.createDataFrame([(f, [float(v) for v in model.weights[k]]) for k, f in enumerate(model.features)], "gram string, w array<double>"))
    hits = near.select("row", F.explode(_grams(F.col("words"))).alias("gram")).join(weights, "gram")
    sums = hits.groupBy("row").agg(F.count(F.lit(1)).alias("hits"), *(F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(n)))
    sums = sums.join(near.select("row", "doc_id", "paragraph", "words", F.xxhash64("block").alias("h")), "row")
    logit = [(F.col(f"s{k}") / F.sqrt("hits") + float(model.constant[k])) / model.temperature for k in range(n)]
    scored = sums.withColumn("z", F.array(*logit))
    top = F.array_max("z")
    scored = scored.withColumn("total", F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - top)))
    likeliest = F.element_at(F.array(*map(F.lit, model.classes)), F.array_position("z", top).cast("int"))
    whole = [F.when(F.greatest(*(_holds(F.col("key"), t) for t in TEMPLATES[f]), F.lit(False)), F.lit(f)) for f in FAMILIES]
    named = scored.withColumn("key", _key(F.col("words"))).withColumn("named", F.array_compact(F.array(*whole)))
    # with a whole notice of some family, unknown is not the answer
    first = F.array(likeliest)
    each = F.when((likeliest == UNKNOWN) & (F.size("named") > 0), F.col("named")).otherwise(F.array_union(first, "named"))
    out = named.withColumn("family", F.explode(each))
    z = F.element_at("z", F.array_position(F.array(*map(F.lit, model.classes)), F.col("family")).cast("int"))
    out = out.withColumn("probability", F.exp(z - top) / F.col("total")).withColumn("template_share", _share(F.col("words"), F.col("family")))
    out = out.select("doc_id", "paragraph", "family", "probability", "template_share", ((F.col("family") != UNKNOWN) & (F.col("template_share") >= CONFIRM_FROM)).alias("confirmed"), "h")
    # paragraphs that repeat with id and number count once
    return out.dropDuplicates(["doc_id", "paragraph", "h", "family"]).drop("h")


def families(found: DataFrame) -> DataFrame:
    """(doc_id, families): the confirmed families of each document that has any."""
    return found.filter("confirmed").groupBy("doc_id").agg(F.array_sort(F.collect_set("family")).alias("families"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    model = fit(docs, id_col, text_col)
    return classify(with_cue(paragraphs(docs, id_col, text_col), model.cues), model)
