"""Licence scan: a trained paragraph classifier, confirmed by template comparison. DataFrame functions only.

A softmax regression over hashed word 1- and 2-grams names the licence families of each paragraph (between blank lines, its lines joined), with
an explicit class for other text. It sees windows of WINDOW words, so that any template lies in one, and a paragraph's lines. It is trained here, by full-batch gradient descent inside a DataFrame expression, from statements made by rule
(frames x names) and opening paragraphs of well-known licences, against ordinary sentences. Its temperature, and the probability that a
family must reach, come from frames held out of training: the least probability that a right held-out statement gets, but 0.5 at least. A named family counts when
a template of it shares enough of its n-grams with the window; one window can have several, where each is confirmed by n-grams that the others'
templates don't have. A line of a longer paragraph counts alone when it has a whole template. Licence-like paragraphs without a family are `unknown`.

Everything happens inside a row, so there is no shuffle; the model (some hundred n-grams, a dozen families) is the only thing sent along.
Defined cases: null and empty texts have no paragraphs; a repeated paragraph counts each time; other languages come out as other text.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Families with their names, and opening sentences of their texts.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "MIT licence", "Expat License", "MIT"),
    "BSD": ("BSD License", "3-Clause BSD License", "BSD 2-Clause License", "New BSD License", "BSD-3-Clause"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache Software License"),
    "GPL": ("GNU General Public License, version 3", "GNU General Public License", "GNU GPL v2", "GPL-3.0-or-later", "GPLv3"),
    "LGPL": ("GNU Lesser General Public License", "GNU LGPL v2.1", "LGPL-3.0", "Lesser GPL"),
    "AGPL": ("GNU Affero General Public License", "AGPL-3.0", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"),
    "ISC": ("ISC License", "ISC licence"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "CC0": ("CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero"),
    "CC-BY": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "CC BY 3.0"),
    "CC-BY-SA": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-3.0"),
    "CC-BY-NC": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-SA 4.0", "CC BY-NC-ND 4.0"),
}
FRAMES = (
    "Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "Licensed under {}.", "License: {}", "SPDX-License-Identifier: {}",
    "This software is distributed under the terms of the {}.", "Available under the {}.", "The code is made available under the {} licence.", "Published under {}.",
    "You may use this file under the terms of the {}.", "Distributed under the {}. See the file LICENSE.",
)
#: Frames held out of training, by place.
HELD_OUT = (3, 7, 10)
OPENINGS: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "Apache-2.0": ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0": ("The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights to the work worldwide",),
}
OTHER = (
    "The driver showed a valid license to the officer at the gate.", "She was given permission to use the library on Sundays.", "All rights and duties of the members are listed below.", "Copyright law differs between countries.",
    "The software was released in spring and the file was made public.", "You may obtain a copy of the report at the front desk.", "This work is a study of rivers and of the people near them.", "The committee met under the terms of the treaty.",
    "The program is free for visitors and open to the general public.", "He distributed the leaflets under the bridge.", "Conditions of any kind were met with silence.", "The university of Massachusetts Institute of Technology lies in Cambridge.",
    "Apache helicopters flew over the town.", "The Mozilla of legend was a lizard.", "A version of the story was published in 2004.", "The creative commons of the village were open to all.", "An attribution of the painting is uncertain.", "",
)
FAMILIES = tuple(NAMES)
#: Words that alone say nothing about a licence.
COMMON = "the of to and a in is this that be are on at or for from with by as it an was you may not any all under use see file made code".split()
#: Different n-grams of the model that a window or line needs, to be scored: one alone is no evidence, as the German word "mit" shows.
LEAST_HITS = 2
#: Words of a window, over twice a template's; each starts half a window after the one before.
WINDOW = 60
#: n-grams of a template that can stand without the classifier, and words that join names.
OPENING, JOINING = 15, ("or", "and", "and/or")
EPOCHS, RATE, DECAY = 120, 4.0, 1e-4


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"), F.lit(0))


def grams(text: Column) -> Column:
    """Distinct hashes of a text's 1- and 2-grams."""
    return grams_of(words_of(text))


def _plain_grams(words: Column) -> Column:
    both = lambda w: F.concat(
        F.transform(w, lambda x: F.xxhash64(x)),
        F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))).otherwise(F.expr("cast(array() as array<bigint>)")),
    )
    return F.element_at(F.transform(F.array(words), both), 1)


def grams_of(words: Column) -> Column:
    return F.array_distinct(_plain_grams(words))


def statements() -> list[tuple[str, int, bool]]:
    """(text, class, held out); the last class is other text."""
    rows = [(frame.format(name), c, k in HELD_OUT) for c, f in enumerate(FAMILIES) for name in NAMES[f] for k, frame in enumerate(FRAMES)]
    rows += [(t, FAMILIES.index(f), False) for f, texts in OPENINGS.items() for t in texts]
    other = len(FAMILIES)
    rows += [(t, other, False) for t in OTHER]
    return rows + [(frame.format(n), other, k in HELD_OUT) for k, frame in enumerate(FRAMES) for n in ("table", "old bridge", "direction of the mayor", "common name")]


class Model:
    """What training leaves: n-gram hashes, a weight row for each, biases, the temperature, the probability bound, and templates."""

    def __init__(self, vocabulary: list[int], weights: list[list[float]], bias: list[float], heat: float, bound: float, templates: list[list[list[int]]]):
        self.vocabulary, self.weights, self.bias, self.heat, self.bound, self.templates = vocabulary, weights, bias, heat, bound, templates


def train(spark: SparkSession) -> Model:
    """Fit the model by DataFrame expressions. Its data are this module's few hundred statements."""
    rows = spark.createDataFrame(statements(), "text string, class int, held boolean").coalesce(1).withColumn("grams", grams(F.col("text")))
    skip = [r.h for r in spark.createDataFrame([(w,) for w in COMMON], "w string").select(F.xxhash64("w").alias("h")).collect()]
    found = rows.where("not held").select(F.explode("grams").alias("g"), "class").groupBy("g").agg(F.count("*").alias("n"), F.min("class").alias("c"))
    vocabulary = [r.g for r in found.where((F.col("n") > 1) & (F.col("c") < len(FAMILIES)) & ~F.col("g").isin(skip)).orderBy("g").collect()]
    features = F.transform(F.array(*map(F.lit, vocabulary)), lambda v: F.array_contains("grams", v).cast("double"))
    data = rows.where("not held").select(F.struct(features.alias("x"), "class").alias("e")).agg(F.collect_list("e").alias("data"))
    n_classes, n = len(FAMILIES) + 1, len(vocabulary)
    # One row a class (one against the rest, in parallel tasks): w <- w - rate * (mean slope * x + decay * w), EPOCHS times.
    classes = spark.range(0, n_classes, 1, min(n_classes, 8)).withColumnRenamed("id", "class")
    joined = classes.join(F.broadcast(data), F.lit(True))  # data: one row
    examples = F.transform("data", lambda e: F.struct(e["x"].alias("x"), (e["class"] == F.col("class")).cast("double").alias("y")))

    def epoch(w: Column, examples: Column) -> Column:
        sparse = F.transform(
            examples,
            lambda e: F.struct(
                e["on"].alias("on"),
                (1 / (1 + F.exp(-F.aggregate(e["on"], F.get(w, F.lit(n)), lambda a, i: a + F.get(w, i)))) - e["y"]).alias("s"),
            ),
        )
        dense = lambda s: F.transform(
            w,
            lambda x, i: x - RATE / F.size(s) * F.aggregate(F.get("by", i), F.lit(0.0), lambda a, k: a + F.get(s, k)) - RATE * DECAY * x,
        )
        return F.element_at(F.transform(F.array(F.transform(sparse, lambda e: e["s"])), dense), 1)

    on = F.transform(examples, lambda e: F.struct(F.filter(F.transform(e["x"], lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull()).alias("on"), e["y"].alias("y")))
    by = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda v: F.filter(F.transform("ex", lambda e, k: F.when((v == n) | F.array_contains(e["on"], v), k)), lambda k: k.isNotNull()))
    start = F.array_repeat(F.lit(0.0), n + 1)
    prepared = joined.select("class", on.alias("ex")).withColumn("by", by).repartition(min(n_classes, 8), "class")
    fitted = prepared.select("class", F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), start, lambda w, _: epoch(w, F.col("ex"))).alias("w")).orderBy("class").collect()
    by_gram = [[fitted[c].w[i] for c in range(n_classes)] for i in range(n)]
    bias = [fitted[c].w[n] for c in range(n_classes)]
    held = rows.where("held").select("class", F.transform(F.array_intersect("grams", F.array(*map(F.lit, vocabulary))), lambda g: F.array_position(F.array(*map(F.lit, vocabulary)), g)).alias("on")).collect()
    logits = [([bias[c] + sum(by_gram[int(i) - 1][c] for i in r.on) for c in range(n_classes)], r["class"]) for r in held]
    heat = min((sum(math.log(sum(math.exp((z - v[y]) / t) for z in v)) for v, y in logits), t) for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0))[1]
    right = [1 / sum(math.exp((z - v[y]) / heat) for z in v) for v, y in logits if y < len(FAMILIES) and v[y] == max(v)]
    templates: list[list[list[int]]] = [[] for _ in FAMILIES]
    named = [(n, c) for c, f in enumerate(FAMILIES) for n in (*NAMES[f], *OPENINGS.get(f, ()))]
    for r in spark.createDataFrame(named, "text string, class int").coalesce(1).select("class", grams(F.col("text")).alias("g")).collect():
        templates[r["class"]].append(sorted(r.g))
    return Model(vocabulary, by_gram, bias, heat, max(0.5, min(right, default=0.5)), templates)


@lru_cache(maxsize=2)
def trained(spark: SparkSession) -> Model:
    return train(spark)


#: Share of a template's n-grams that a paragraph must have to confirm it.
CONFIRM = 0.6


def _probabilities(m: Model, hits: Column) -> Column:
    table = F.map_from_arrays(F.array(*map(F.lit, m.vocabulary)), F.array(*[F.array(*map(F.lit, w)) for w in m.weights]))
    total = F.aggregate(hits, F.array(*map(F.lit, m.bias)), lambda a, g: F.zip_with(a, F.element_at(table, g), lambda x, y: x + y))
    shifted = lambda z: F.transform(z, lambda x: F.exp((x - F.array_max(z)) / m.heat))
    shares = lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))
    let = lambda v, f: F.element_at(F.transform(F.array(v), f), 1)
    return let(let(total, shifted), shares)


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """key, n_paragraphs, families (sorted distinct), n_confirmed, n_unknown, and findings (place of the paragraph, family or unknown, probability, confirmed)."""
    m = model or trained(docs.sparkSession)
    let = lambda v, f: F.element_at(F.transform(F.array(v), f), 1)
    filled = lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != ""
    vocabulary = F.array(*map(F.lit, m.vocabulary))
    templates = F.array(*[F.array(*[F.array(*map(F.lit, t)) for t in ts]) for ts in m.templates])
    no_template = F.expr("cast(array() as array<array<bigint>>)")
    longer = lambda n: F.array(*[F.array(*[F.array(*map(F.lit, t)) for t in ts if len(t) >= n]) if any(len(t) >= n for t in ts) else no_template for ts in m.templates])
    openings, phrases = longer(OPENING), longer(2)
    families = F.array(*map(F.lit, FAMILIES))
    # A one-word name beside another family's needs a word that joins it to the rest: "MIT or ...", "MIT/GPLv3".
    single = [[n.lower() for n in NAMES[f] if " " not in n] for f in FAMILIES]
    joins = lambda n: [(n, w) for w in JOINING] + [(w, n) for w in JOINING] + [p for o in sum(single, []) if o != n for p in ((n, o), (o, n))]
    joined = F.array(*[F.array(F.lit(0).cast("long"), *[F.xxhash64(F.lit(a), F.lit(b)) for n in ns for a, b in joins(n)]) for ns in single])
    paragraphs = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\n[ \t\r\f]*\n"), filled)

    def units(p: Column, k: Column) -> Column:
        """A paragraph's windows and, if it has several, lines, where they can have LEAST_HITS n-grams of the model.

        The paragraph's n-grams are hashed once, and those of the model are few; the starts of these tell the windows.
        """
        unit = lambda words, line: F.struct(k.alias("place"), words.alias("words"), line.alias("line"))
        none = F.expr("cast(array() as array<struct<place:int,words:array<string>,line:boolean>>)")
        starts = lambda n: F.sequence(F.lit(0), F.greatest(n - WINDOW // 2 - 1, F.lit(0)), F.lit(WINDOW // 2))
        within = lambda at, a: F.size(F.filter(at, lambda i: (i >= a) & (i < a + WINDOW))) >= LEAST_HITS
        lines = let(F.filter(F.split(p, "\n"), filled), lambda x: F.when(F.size(x) > 1, F.transform(x, lambda y: unit(words_of(y), F.lit(True)))).otherwise(none))

        def found(words: Column, hashes: Column) -> Column:
            n = F.size(words)  # the first n hashes are those of the words, the others those of the pairs
            marks = lambda d: F.filter(F.transform(hashes, lambda g, i: F.when(F.array_contains(d, g), F.when(i < n, i).otherwise(i - n))), lambda i: i.isNotNull())
            windows = lambda at: F.transform(F.filter(starts(n), lambda a: within(at, a)), lambda a: unit(F.slice(words, a + 1, F.lit(WINDOW)), F.lit(False)))
            return let(F.array_intersect(vocabulary, hashes), lambda d: F.when(F.size(d) >= LEAST_HITS, F.concat(let(marks(d), windows), lines)).otherwise(none))

        return let(words_of(p), lambda w: let(_plain_grams(w), lambda h: found(w, h)))

    def share(family: Column, held: Column, of: Column = templates) -> Column:
        """The largest share of a template of the family among the n-grams held."""
        return F.coalesce(F.array_max(F.transform(F.get(of, family), lambda t: F.size(F.array_intersect(t, held)) / F.size(t))), F.lit(0.0))

    def findings(p: Column) -> Column:
        """(place, family, probability, share, line) of every confirmed family of a unit, or one without a family if it is licence-like."""
        able = F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(FAMILIES) - 1)), lambda c: F.struct(c.alias("c"), share(c, p["grams"]).alias("share"))), lambda x: x["share"] >= CONFIRM)

        def named(prob: Column) -> Column:
            def judged(able: Column) -> Column:
                def sure(x: Column) -> Column:
                    rest = F.array_except(p["grams"], F.flatten(F.get(templates, x["c"])))
                    others = lambda r: F.transform(F.filter(able, lambda y: (y["c"] != x["c"]) & (share(y["c"], r) >= CONFIRM)), lambda y: y["c"])
                    own = F.get(prob, x["c"])

                    def over(apart: Column) -> Column:
                        mass = F.aggregate(apart, F.lit(0.0), lambda a, c: a + F.get(prob, c))
                        rival = F.array_max(F.transform(prob, lambda v, c: F.when(F.array_contains(apart, c) | (c == x["c"]), 0.0).otherwise(v)))
                        stands = (own >= m.bound) | (share(x["c"], p["grams"], phrases) == 1) | F.arrays_overlap(F.get(joined, x["c"]), p["grams"])
                        return (own >= m.bound * (1 - mass)) & (own >= rival) & stands

                    # A long template that doesn't owe its n-grams to a better one needs no classifier.
                    better = F.flatten(F.transform(F.filter(able, lambda y: (y["c"] != x["c"]) & (y["share"] > x["share"])), lambda y: F.flatten(F.get(templates, y["c"]))))
                    return (share(x["c"], F.array_except(p["grams"], better), openings) >= CONFIRM) | let(let(rest, others), over)

                return F.transform(F.filter(able, sure), lambda x: F.struct(p["place"].alias("place"), F.get(families, x["c"]).alias("family"), F.get(prob, x["c"]).alias("probability"), x["share"].alias("share"), p["line"].alias("line")))

            best = F.array_position(prob, F.array_max(prob)) - 1
            none = F.struct(p["place"].alias("place"), F.lit(None).cast("string").alias("family"), F.array_max(prob).alias("probability"), F.lit(0.0).alias("share"), p["line"].alias("line"))
            return let(let(able, judged), lambda found: F.when((F.size(found) > 0) | (best >= len(FAMILIES)), found).otherwise(F.array(none)))

        return let(_probabilities(m, p["hits"]), named)

    scored = F.filter(
        F.transform(F.flatten(F.transform("__paragraphs", units)), lambda u: let(grams_of(u["words"]), lambda g: F.struct(u["place"].alias("place"), u["line"].alias("line"), g.alias("grams"), F.array_intersect(g, vocabulary).alias("hits")))),
        lambda p: F.size(p["hits"]) >= LEAST_HITS,
    )
    rows = docs.select(F.col(key), paragraphs.alias("__paragraphs")).select(key, F.size("__paragraphs").cast("long").alias("n_paragraphs"), scored.alias("__p"))
    rows = rows.select(key, "n_paragraphs", F.flatten(F.transform("__p", findings)).alias("__f"))
    sure = F.filter("__f", lambda f: f["family"].isNotNull() & (~f["line"] | (f["share"] == 1)))
    rows = rows.select(key, "n_paragraphs", "__f", sure.alias("__sure"))
    # Of a paragraph, each family once, and one unknown if it has no family; both with the largest probability.
    best = lambda fs, same: F.round(F.array_max(F.transform(F.filter(fs, same), lambda f: f["probability"])), 6)
    finding = lambda place, family, probability, confirmed: F.struct(place.alias("place"), family.alias("family"), probability.alias("probability"), F.lit(confirmed).alias("confirmed"))
    known = F.transform(
        F.array_distinct(F.transform("__sure", lambda f: F.struct(f["place"].alias("place"), f["family"].alias("family")))),
        lambda x: finding(x["place"], x["family"], best("__sure", lambda f: (f["place"] == x["place"]) & (f["family"] == x["family"])), True),
    )
    places = lambda fs: F.array_distinct(F.transform(fs, lambda f: f["place"]))
    unknown = F.transform(F.array_except(places(F.col("__f")), places(F.col("__sure"))), lambda k: finding(k, F.lit("unknown"), best("__f", lambda f: f["place"] == k), False))
    return rows.select(key, "n_paragraphs", F.array_sort(F.concat(known, unknown)).alias("findings")).select(
        key,
        "n_paragraphs",
        F.array_sort(F.array_distinct(F.transform(F.filter("findings", lambda f: f["confirmed"]), lambda f: f["family"]))).alias("families"),
        F.size(F.filter("findings", lambda f: f["confirmed"])).cast("long").alias("n_confirmed"),
        F.size(F.filter("findings", lambda f: ~f["confirmed"])).cast("long").alias("n_unknown"),
        "findings",
    )
