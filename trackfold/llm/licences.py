"""Licence families of paragraphs: sparse n-gram logistic regression, calibrated, confirmed by templates.

Only DataFrame functions and Spark's own learner are used.  A paragraph is the text between lines without a letter or
digit.  It is judged as a whole, so that a notice may be wrapped over lines; its sentences of several lines and its
lines are judged too, so that it may state several families.  The features are all word n-grams (one to three words).
The model is a multinomial regression with an L1 penalty over the families and an unknown class, fitted on variants of
the template notices and on near misses; a temperature and a threshold are chosen on variants that were held out.  A
predicted family is accepted if at least CONFIRM of a template's word trigrams are in the text.  That rule decides what
need not be scored: a text without any of the words of ``needed_words`` lacks too many trigrams of every template.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Share of a template's trigrams that a line, sentence or paragraph must hold.
CONFIRM = 0.6
#: What parts paragraphs (lines without a letter or digit, such as an empty comment line), and sentences.
BLANK = r"\n[^\p{L}\p{N}]*\n"
SENTENCE = r"(?<=[.!?;:])\s+(?=\p{Lu}|[^\p{L}\p{N}\s])"

# Notices by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "Released under the Apache License 2.0",
        "This project is licensed under the Apache-2.0 license",
        "SPDX-License-Identifier: Apache-2.0",
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License 2.0",
        "Apache License Version 2.0, January 2004",
        "License: Apache-2.0",
        "License: Apache 2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "MIT License",
        "The MIT License (MIT)",
        "License: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License version 2",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GNU GPL v3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "License: GNU General Public License v3.0",
        "GNU General Public License Version 3, 29 June 2007",
        "GNU General Public License Version 2, June 1991",
        "License: GPL",
        "License: GPLv3",
        "License: GPL-3.0",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 3",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "License: LGPL",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "GNU Affero General Public License Version 3, 19 November 2007",
        "License: AGPL",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License",
        "Released under the BSD license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Use of this source code is governed by a BSD-style license",
        "BSD 3-Clause License",
        "BSD 2-Clause License",
        "License: BSD",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0",
        "License: MPL-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC-SA 4.0",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "License: CC BY-NC 4.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier: CC-BY-4.0",
        "License: CC BY 4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "License: CC BY-SA 4.0",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain under the Unlicense",
        "Released under CC0 1.0 Universal",
        "SPDX-License-Identifier: Unlicense",
        "SPDX-License-Identifier: CC0-1.0",
        "License: Unlicense",
        "License: CC0",
    ],
    "proprietary": [
        "All rights reserved",
        "Copyright, all rights reserved, unauthorized copying is prohibited without prior written permission",
    ],
}
# Lines that speak of licences, or use their words, and state none.
NEAR_MISSES = [
    "You need a licence to drive a car in this country",
    "the driver's license was renewed last year",
    "Licensing fees rose again and the licensed shops closed",
    "The Apache helicopter landed near the village",
    "the Apache people of the south",
    "copyright law in the nineteenth century",
    "a discussion of copyright and of patents",
    "the House of Commons debated the creative arts",
    "creative writing for beginners",
    "Mozilla released a new browser",
    "the gnu is an antelope of Africa",
    "redistribution of wealth and income",
    "a search warrant was issued, the warranty had ended",
    "tickets are reserved for members with permission",
    "permission to land was refused",
    "which license should I choose for my project",
    "see the license for details",
    "read the license agreement before you sign",
    "the general public was not licensed to enter",
    "a noncommercial radio station",
    "version 2.0 of the program was released",
    "",
]


def words(text: Column) -> Column:
    """Lower-cased words of letters, digits, and inner hyphens and dots."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), 0)


#: Words too common, in some language, to be looked for.
COMMON = frozenset("the of and or to in is a by under this for with any all mit on at it be as not can you see are".split())


def needed_words() -> list[str]:
    """Words of which every text that can be confirmed has at least one.

    For each template so many words are taken that the trigrams without any of them are less than CONFIRM of all.
    """
    taken: list[str] = []
    for notice in (t for ts in TEMPLATES.values() for t in ts):
        grams = [g.split() for g in _notice_grams(notice)]
        left = [g for g in grams if not any(w in taken for w in g)]
        while len(left) >= CONFIRM * len(grams):
            every = {w for g in left for w in g}
            words_ = [w for w in every if w not in COMMON] or list(every)
            word = max(words_, key=lambda w: (sum(w in g for g in left), len(w), w))
            taken.append(word)
            left = [g for g in left if word not in g]
    # a word that holds another is found with it
    return sorted(w for w in taken if not any(v != w and v in w for v in taken))


def _may_state(text: Column) -> Column:
    """Whether a lower-cased text has one of the needed words; no text that can be confirmed fails this."""
    found = F.lit(False)
    for word in needed_words():
        found = found | F.contains(text, F.lit(word))
    return found


def line_grams(tokens: Column) -> Column:
    """Distinct words, word pairs and word trigrams of a line, which hold the grams of any notice in it."""

    def grams(n: int) -> Column:
        at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    return F.array_distinct(F.concat(grams(1), grams(2), grams(3)))


def training_rows() -> list[tuple[str, str, bool]]:
    """(family, line, held out): variants of all notices and near misses."""
    fronts = ["", "Copyright 2021 the authors. ", "* ", "This file is part of the project. ", "Note: ", "see below - "]
    backs = ["", ".", ". See LICENSE for details.", " and other terms apply", "!"]
    out = []
    for family, notices in [*TEMPLATES.items(), (UNKNOWN, NEAR_MISSES)]:
        for notice in notices:
            for a, front in enumerate(fronts):
                if family == UNKNOWN and "Copyright" in front:
                    front = "In the year 2021 "
                for b, back in enumerate(backs):
                    if family == UNKNOWN and "LICENSE" in back:
                        back = ". See below for details."
                    line = front + notice + back
                    out.append((family, line.upper() if (a + b) % 3 == 2 else line, (a * len(backs) + b) % 4 == 3))
    return out


@dataclass
class Classifier:
    """Weights as (n-gram, class, weight), intercepts by class, the temperature, and the least probability to accept."""

    classes: list[str]
    weights: list[tuple[str, int, float]]
    intercepts: list[float]
    temperature: float
    threshold: float


def train(spark: SparkSession) -> Classifier:
    """Fit on the training lines that are not held out; calibrate on the others."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    classes = [*sorted(TEMPLATES), UNKNOWN]
    lines = spark.createDataFrame([(float(classes.index(f)), line, held) for f, line, held in training_rows()], "label double, line string, held boolean").coalesce(1)
    lines = lines.withColumn("grams", line_grams(words(F.col("line")))).cache()
    vectorizer = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=8000, minDF=2.0, binary=True).fit(lines.where("NOT held"))
    model = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=0.001, maxIter=40, standardization=False).fit(vectorizer.transform(lines.where("NOT held")))
    matrix, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray().tolist()
    weights = [(g, k, float(matrix[k, j])) for j, g in enumerate(vectorizer.vocabulary) for k in range(len(classes)) if matrix[k, j] != 0]
    scored = model.transform(vectorizer.transform(lines.where("held"))).select("label", "rawPrediction").collect()  # the bounded training lines
    lines.unpersist()

    def shares(raw: list[float], t: float) -> list[float]:
        top = max(raw)
        e = [math.exp((x - top) / t) for x in raw]
        return [x / sum(e) for x in e]

    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: sum(-math.log(max(shares(list(r.rawPrediction), t)[int(r.label)], 1e-12)) for r in scored))
    strongest = max((max(shares(list(r.rawPrediction), temperature)[:-1]) for r in scored if classes[int(r.label)] == UNKNOWN), default=0.0)
    return Classifier(classes, weights, intercepts, temperature, max(0.5, min(0.9, strongest + 0.02)))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once (an expression in a lambda is worked out again for each element)."""
    return F.transform(F.array(value), use)[0]


def _judged(line: Column, model: Classifier) -> Column:
    """A line as struct of line, family (unknown if not sure), probability and template share."""
    return _let(words(line), lambda tokens: _let(line_grams(tokens), lambda own: _scored(line, own, model)))


def _scored(line: Column, own: Column, model: Classifier) -> Column:
    """``_judged`` by the line's own n-grams."""
    n = len(model.classes)
    table: dict[str, list[float]] = {}
    for gram, k, w in model.weights:
        table.setdefault(gram, [0.0] * n)[k] = w
    # the vocabulary is bounded (what the L1 penalty left of 8000 n-grams): literals, so nothing is joined
    weights = F.create_map(*[x for g, w in table.items() for x in (F.lit(g), F.array(*map(F.lit, w)))]) if table else F.create_map(F.lit(""), F.array(*[F.lit(0.0)] * n))
    start = F.array(*[F.lit(b) for b in model.intercepts])
    logits = F.aggregate(F.transform(F.array_intersect(own, F.array(*map(F.lit, table or [""]))), lambda g: weights[g]), start, lambda a, w: F.zip_with(a, w, lambda x, y: x + y))
    logits = F.transform(logits, lambda x: x / model.temperature)
    top = F.array_max(logits)
    chosen = F.transform(F.array(F.struct(logits.alias("l"), top.alias("top"))), lambda s: F.struct(F.array_position(s.l, s.top).cast("int").alias("k"), (1 / F.aggregate(s.l, F.lit(0.0), lambda a, x: a + F.exp(x - s.top))).alias("p")))[0]
    names = F.array(*[F.lit(c) for c in model.classes])
    notices = F.create_map(*[x for f, ts in TEMPLATES.items() for x in (F.lit(f), F.array(*[F.array(*map(F.lit, _notice_grams(t))) for t in ts]))])

    def final(c: Column) -> Column:
        family = F.element_at(names, c.k)
        share = F.coalesce(F.array_max(F.transform(notices[family], lambda t: F.size(F.array_intersect(t, own)) / F.size(t))), F.lit(0.0))
        sure = (family != UNKNOWN) & (c.p >= model.threshold) & (share >= CONFIRM)
        return F.struct(line.alias("line"), F.when(sure, family).otherwise(F.lit(UNKNOWN)).alias("family"), c.p.alias("probability"), share.alias("template_share"))

    return F.transform(F.array(chosen), final)[0]


def _found(paragraph: Column, model: Classifier) -> Column:
    """What is judged in a paragraph: its lines with a needed word; then each sentence of several lines that states a family none
    of the lines states; then the paragraph, if it states one that neither does.  Lines that state nothing are left out
    if they lie in such a sentence or paragraph."""

    def units(texts: Column, level: int) -> Column:
        return F.transform(texts, lambda t: F.struct(t.alias("text"), F.lit(level).alias("level")))

    several = lambda t: F.contains(t, F.lit("\n"))
    whole = F.btrim(paragraph, F.lit(" \t\r\n"))
    lines = F.filter(F.split(whole, "\n"), lambda t: _may_state(F.lower(t)))
    sentences = F.filter(F.split(whole, SENTENCE), lambda t: several(t) & _may_state(F.lower(t)))
    paragraphs = F.filter(F.array(whole), several)
    judged = F.transform(F.concat(units(lines, 0), units(sentences, 1), units(paragraphs, 2)), lambda u: F.struct(_judged(u.text, model).alias("found"), u.level.alias("level")))

    def stated(all_units: Column, level: int, besides: Column | None = None) -> Column:
        own = F.filter(all_units, lambda u: (u.level == level) & (u.found.family != UNKNOWN))
        own = F.transform(own, lambda u: u.found)
        return own if besides is None else F.filter(own, lambda f: ~F.array_contains(besides, f.family))

    def families(found: Column) -> Column:
        return F.transform(found, lambda f: f.family)

    # an array of one element stands for a named value: what is in it is worked out once
    by_line = F.transform(F.array(judged), lambda j: F.struct(j.alias("all"), families(stated(j, 0)).alias("own")))
    by_sentence = F.transform(by_line, lambda s: F.struct(s.all.alias("all"), s.own.alias("own"), stated(s.all, 1, s.own).alias("more")))
    by_paragraph = F.transform(by_sentence, lambda s: F.struct(s.all.alias("all"), s.more.alias("more"), stated(s.all, 2, F.concat(s.own, families(s.more))).alias("rest")))

    def kept(s: Column) -> Column:
        own = F.transform(F.filter(s.all, lambda u: u.level == 0), lambda u: u.found)
        own = F.filter(own, lambda f: (f.family != UNKNOWN) | ((F.size(s.rest) == 0) & ~F.exists(s.more, lambda m: F.contains(m.line, f.line))))
        return F.concat(own, s.more, s.rest)

    return F.flatten(F.transform(by_paragraph, kept))


def with_licences(docs: DataFrame, model: Classifier, text: str = "text", name: str = "licences") -> DataFrame:
    """``docs`` with an array of its lines that hold a needed word, and of its sentences and paragraphs of several lines that
    state a family which their lines do not: the text, family, calibrated probability, template share.

    Null and empty texts have none, and an empty table gives an empty one; the column ``name`` is replaced, all others stay; nothing is shuffled, so repeated
    rows are judged one by one and texts of any length as a whole.
    """
    own = F.col(text)
    paragraphs = F.when(_may_state(F.lower(own)), F.filter(F.split(own, BLANK), lambda x: _may_state(F.lower(x)))).otherwise(F.array().cast("array<string>"))
    keep = [F.col(f"`{c}`") for c in docs.columns if c != name]
    return docs.select(*keep, F.flatten(F.transform(paragraphs, lambda x: _found(x, model))).alias(name))


def licence_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: families (sorted, comma-joined), lines (or wrapped notices) that state one, other lines with a needed word, and the least probability of a stated one."""
    found = with_licences(docs.select(key, text), train(docs.sparkSession), text)
    stated = F.filter("licences", lambda x: x.family != UNKNOWN)
    return found.select(
        key,
        F.array_join(F.array_sort(F.array_distinct(F.transform(stated, lambda x: x.family))), ",").alias("families"),
        F.size(stated).cast("long").alias("n_stated"),
        (F.size("licences") - F.size(stated)).cast("long").alias("n_unknown"),
        F.array_min(F.transform(stated, lambda x: x.probability)).alias("probability"),
    )


def _notice_grams(text: str) -> list[str]:
    """A notice's word trigrams; of a shorter one, all its words as one gram."""
    w = re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower())
    return list(dict.fromkeys(" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))))
