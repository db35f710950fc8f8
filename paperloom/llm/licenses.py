"""Licence scans: a trained paragraph classifier over sparse word n-grams, confirmed by templates.

A paragraph is a line of a text, or a span of consecutive lines over which a notice is
wrapped: lines that reach a template's share of shingles together and none alone
(``reach()`` words may lie between the first line and the last). Its words (letters, digits and dots, lower case) give
n-grams of one to three words; a multinomial logistic regression over the n-grams of the
training paragraphs scores each licence family and a class ``unknown``, whose paragraphs
speak of licences without granting one. The scores are calibrated by one temperature,
fitted on paragraphs that training didn't see. A family stands only if its probability
reaches ``SURE`` and a template of it has at least ``SHARED`` of its three-word shingles in
the paragraph; otherwise the paragraph is unknown, or without a licence.

Everything over documents is built-in expressions. A document is looked at closely only
if it has a cue, a word without which no template can reach SHARED (``cues`` proves it),
so most texts cost a few substring searches; lines with a cue are stored, and each
distinct one is scored once.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import reused, stored

SURE = 0.5
SHARED = 0.6
UNKNOWN = "unknown"
MOST_GRAMS = 3
ROUNDS = 600
PENALTY = 3e-4
MILLION = 1_000_000

#: Notices by family, in words of their public texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl-3.0": ("This program is free software: you can redistribute it under the terms of the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU AGPL v3."),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD License.", "Licensed under the 3-Clause BSD License.", "Licensed under the 2-Clause BSD License."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under a Creative Commons Attribution License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0": ("Licensed under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation.", "Licensed under the GNU GPL v3.", "Licensed under the GNU General Public License, version 2."),
    "isc": ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License."),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU LGPL v3."),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "SPDX-License-Identifier: MIT"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."),
    "proprietary": ("All rights reserved.", "Copyright 2024 the authors. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
}

#: Paragraphs that speak like licences and grant none.
NO_LICENCE = (
    "The driver showed a valid license to the officer.",
    "Her license was renewed in the spring and released in June.",
    "He studied computer science at MIT and works under a public contract.",
    "The version released under the old name was 2.0 and later 3.",
    "Some rights of the public are reserved by law.",
    "All seats are reserved and all rights belong to others.",
    "The Apache helicopter flew under the bridge.",
    "The general public was free to use the library.",
    "Terms and conditions are subject to change without notice.",
    "The restaurant is licensed to sell wine under state law.",
    "This work is the first of its kind and this file is large.",
    "A creative common room with attribution to the artist.",
    "Permission to enter is granted to any person with a copy of the ticket.",
    "The software is used for any purpose and the source is public.",
    "The license plate was under the car.",
    "Mozilla and the Free Software Foundation met in public.",
    "A license agreement may be required, ask the author.",
    "Distribution of the paper is limited, see the copyright office.",
    "The fishing license costs 4.0 dollars, version 2 costs 3.",
    "You may not use this door except in an emergency.",
)

#: Words that deny what follows them.
DENIALS = (("not",), ("is", "not"), ("was", "never"), ("never",), ("no", "longer"), ("are", "not"), ("nothing", "here", "is"))
#: Words of a notice before which a denial stands.
GRANTING = ("licensed", "released", "permitted", "granted", "dedicated")

_WORD = "[a-z0-9.]*[a-z0-9]"


def words_of(paragraph: str) -> list[str]:
    return re.findall(_WORD, paragraph.lower())


def grams_of(words: list[str], most: int = MOST_GRAMS) -> list[str]:
    return [" ".join(words[k : k + n]) for n in range(1, most + 1) for k in range(len(words) - n + 1)]


def shingles_of(words: list[str]) -> list[str]:
    """Three-word shingles; of fewer words, the whole."""
    return [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []


def _examples() -> list[tuple[str, list[str]]]:
    """Labelled paragraphs: each template, alone, in a sentence, and with a word lost or added; denied; and paragraphs without a licence."""
    strange = ("zuon", "thea", "elle", "ing")
    found = []
    for family, texts in [*TEMPLATES.items(), (UNKNOWN, NO_LICENCE)]:
        for text in texts:
            words = words_of(text)
            found += [(family, words), (family, [*strange[:2], *words]), (family, [*words, *strange[2:]])]
            found += [(family, [*words[:k], *words[k + 1 :]]) for k in range(0, len(words), 4) if len(words) > 4]
            found += [(family, [*words[:k], strange[k % 4], *words[k:]]) for k in range(1, len(words), 5)]
    # a denied notice grants nothing
    for words in (words_of(t) for texts in TEMPLATES.values() for t in texts):
        at = next((k for k, w in enumerate(words) if w in GRANTING), None)
        if at is not None:
            head = words[: max(0, at - 1)] if at and words[at - 1] in ("is", "are") else words[:at]
            found += [(UNKNOWN, [*head, *denial, *words[at:]]) for denial in DENIALS]
            found += [(UNKNOWN, ["is", "it", *words, "or", "not"])]
    # fragments of templates too short to tell, and no words at all
    found += [(UNKNOWN, [w]) for texts in TEMPLATES.values() for t in texts for w in words_of(t)[:: max(1, len(words_of(t)) // 4)]]
    # a changed template may be another family's template, which it then doesn't teach
    whole = {tuple(words_of(t)): family for family, texts in TEMPLATES.items() for t in texts}
    found = [(family, words) for family, words in found if whole.get(tuple(words), family) == family]
    return [*found, *[(UNKNOWN, [])] * 5]


@dataclass
class Model:
    """weights: n-gram to a weight for each of families; bias: for each of families."""

    families: list[str]
    weights: dict[str, np.ndarray]
    bias: np.ndarray
    temperature: float

    def probabilities(self, paragraph: str) -> np.ndarray:
        """What the expressions compute, for one paragraph."""
        none = np.zeros(len(self.families))
        logits = self.bias + sum((self.weights.get(g, none) for g in set(grams_of(words_of(paragraph)))), none)
        e = np.exp((logits - logits.max()) / self.temperature)
        return e / e.sum()


@lru_cache(maxsize=1)
def train() -> Model:
    """Full-batch gradient descent with momentum and a quadratic penalty; every fifth changed example is held out for the temperature, whole templates never."""
    examples = _examples()
    families = [*sorted(TEMPLATES), UNKNOWN]
    whole = {tuple(words_of(t)) for texts in [*TEMPLATES.values(), NO_LICENCE] for t in texts}
    held_at = {k for k, (_, words) in enumerate(examples) if not k % 5 and tuple(words) not in whole}
    train_on = [x for k, x in enumerate(examples) if k not in held_at]
    held = [examples[k] for k in sorted(held_at)]
    names = sorted({g for _, words in train_on for g in grams_of(words)})
    place = {g: k for k, g in enumerate(names)}

    def matrix(rows: list[tuple[str, list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(families)))
        for k, (family, words) in enumerate(rows):
            x[k, [place[g] for g in grams_of(words) if g in place]] = 1
            y[k, families.index(family)] = 1
        return x, y

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    (x, y), (hx, hy) = matrix(train_on), matrix(held)
    w, b = np.zeros((len(names), len(families))), np.zeros(len(families))
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    balance = (1 / (y.sum(axis=0) + 1))[y.argmax(axis=1)][:, None]
    balance /= balance.mean()
    for _ in range(ROUNDS):
        g = balance * (softmax(x @ w + b) - y) / len(x)
        vw, vb = 0.9 * vw - 2 * (x.T @ g + PENALTY * w), 0.9 * vb - 2 * g.sum(axis=0)
        w, b = w + vw, b + vb
    loss = lambda t: -np.log(np.maximum((softmax((hx @ w + b) / t) * hy).sum(axis=1), 1e-12)).mean()
    temperature = min((k / 20 for k in range(4, 61)), key=loss)
    w = np.round(w, 6)
    return Model(families, {g: w[k] for k, g in enumerate(names) if np.abs(w[k]).max() >= 1e-3}, np.round(b, 6), temperature)


@lru_cache(maxsize=1)
def cues() -> tuple[str, ...]:
    """Words such that of each template, the shingles without any of them are less than SHARED of all: no paragraph without a cue is confirmed.

    Chosen greedily: long, frequent in templates.
    """
    rows = [shingles_of(words_of(t)) for texts in TEMPLATES.values() for t in texts]
    chosen: list[str] = []
    free = lambda row: [x for x in (s.split() for s in row) if not set(x) & set(chosen)]
    while left := [f for row in rows if len(f := free(row)) >= SHARED * len(row)]:
        count = Counter(w for f in left for w in {w for s in f for w in s})
        count = {w: n for w, n in count.items() if len(w) >= 6} or count
        chosen.append(max(count, key=lambda w: (count[w], len(w), w)))
    return tuple(chosen)


def reach() -> int:
    """Words of the longest template, and half as many that a changed notice may have more."""
    return max(len(words_of(t)) for texts in TEMPLATES.values() for t in texts) * 3 // 2


def _lines(text: Column) -> Column:
    """array of (cue, words): the lines of a text."""
    return F.transform(F.split(F.lower(text), r"\r?\n"), lambda line: F.struct(_has_cue(line).alias("cue"), F.regexp_extract_all(line, F.lit(f"({_WORD})"), F.lit(1)).alias("words")))


def _hits(held: DataFrame) -> DataFrame:
    """(row, p, first, last, shingle, template, n): the templates' shingles in the words of held (row, lines), with their place and lines."""
    words = held.select("row", F.flatten(F.transform("lines", lambda x: x["words"])).alias("w"), F.flatten(F.transform("lines", lambda x, k: F.array_repeat(k, F.size(x["words"])))).alias("at"))
    places = F.when(F.size("w") >= 3, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>"))
    each = words.select("row", "w", "at", F.explode(places).alias("p"))
    each = each.select("row", "p", F.col("at")[F.col("p")].alias("first"), F.col("at")[F.col("p") + 2].alias("last"), F.concat_ws(" ", F.col("w")[F.col("p")], F.col("w")[F.col("p") + 1], F.col("w")[F.col("p") + 2]).alias("shingle"))
    return each.join(_shingles(held.sparkSession).select("shingle", "template", "n"), "shingle")


def _spans(held: DataFrame) -> DataFrame:
    """(row, k, e): lines k to e (from 0) of held (row, lines) over which a notice may be wrapped.

    A span starts in the line in which a shingle of some template starts and ends in one in
    which one ends, and the template's shingles between reach SHARED. Lines that reach it
    by themselves are not counted: they are paragraphs of their own. Only texts with such a
    template, and only its few shingles, come this far.
    """
    most = reach()
    hits = reused(_hits(held))
    own = hits.filter("first = last").groupBy("row", "template", "first", "n").agg(F.count_distinct("shingle").alias("met"))
    alone = own.filter(F.col("met") >= SHARED * F.col("n")).select("row", "template", "first", F.col("first").alias("last"))
    rest = hits.join(alone, ["row", "template", "first", "last"], "left_anti")
    found = rest.groupBy("row", "template", "n").agg(F.count_distinct("shingle").alias("met"), F.array_sort(F.collect_list(F.struct("p", "first", "last", "shingle"))).alias("all"))
    found = found.filter(F.col("met") >= SHARED * F.col("n"))
    within = lambda h: F.filter("all", lambda g: (g["p"] >= h["p"]) & (g["p"] < h["p"] + 3 * most))
    enough = lambda some, g: F.size(F.array_distinct(F.transform(F.filter(some, lambda x: x["p"] <= g["p"]), lambda x: x["shingle"]))) >= SHARED * F.col("n")

    def from_(h: Column) -> Column:
        near = within(h)
        return F.transform(F.filter(near, lambda g: (g["last"] > h["first"]) & enough(near, g)), lambda g: F.struct(h["first"].alias("k"), g["last"].alias("e")))

    return found.select("row", F.explode(F.flatten(F.transform("all", from_))).alias("s")).select("row", "s.k", "s.e").distinct()


def paragraphs(held: DataFrame) -> DataFrame:
    """(row, nth, lines, words) of held (row, lines): the lines that have a cue, and the spans over which a notice may be wrapped.

    A span has no blank line, and under reach() words lie between its first line and its
    last. Of its first line only the last reach() words count, and of its last line the
    first, as more is no part of a notice that is wrapped there.
    """
    most = reach()
    single = held.select("row", F.posexplode("lines").alias("nth", "x")).filter("x.cue").select("row", "nth", F.lit(1).alias("lines"), "x.words")
    rows = held.join(_spans(held), "row").withColumn("x", F.slice("lines", F.col("k") + 1, F.col("e") - F.col("k") + 1))
    between = F.transform(F.slice("x", F.lit(2), F.size("x") - 2), lambda y: y["words"])
    fits = ~F.exists("x", lambda y: F.size(y["words"]) == 0) & (F.size(F.flatten(between)) < most)
    first, last = F.element_at("x", 1)["words"], F.element_at("x", -1)["words"]
    whole = F.concat(F.slice(first, F.greatest(F.lit(1), F.size(first) - most + 1), F.lit(most)), F.flatten(between), F.slice(last, 1, most))
    return single.union(rows.filter(fits).select("row", "k", F.size("x"), whole))


def _has_cue(lowered: Column) -> Column:
    found = F.lit(False)
    for cue in cues():
        found = found | lowered.contains(cue)
    return found


def _each(words: Column, n: int) -> Column:
    """n-grams of words, space-joined, in order."""
    none = F.array().cast("array<string>")
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda k: F.array_join(F.slice(words, k, n), " "))).otherwise(none)


def _weights(spark: SparkSession, model: Model) -> DataFrame:
    """gram and its weights in millionths, a column w0, w1, ... for each family; as many rows as the templates have n-grams."""
    rows = [(g, *np.rint(w * MILLION).astype(int).tolist()) for g, w in sorted(model.weights.items())]
    return F.broadcast(spark.createDataFrame(rows, "gram string, " + ", ".join(f"w{k} long" for k in range(len(model.families)))))


def _shingles(spark: SparkSession) -> DataFrame:
    """shingle, family, template, n (shingles of the template)."""
    rows = [(s, family, f"{family}/{k}", len(set(shingles_of(words_of(t))))) for family, some in sorted(TEMPLATES.items()) for k, t in enumerate(some) for s in sorted(set(shingles_of(words_of(t))))]
    return F.broadcast(spark.createDataFrame(rows, "shingle string, family string, template string, n int"))


def scored(lines: DataFrame) -> DataFrame:
    """(key, family, probability, template, shared) for each distinct line of lines (key, words), one row a key.

    The n-grams of a line meet the model in a broadcast join on the n-gram, and their
    weights are summed as integers, so sums don't depend on their order.
    """
    spark, model = lines.sparkSession, train()
    n = len(model.families)
    grams = F.array_distinct(F.concat(*[_each(F.col("words"), k) for k in range(1, MOST_GRAMS + 1)]))
    met = lines.select("key", F.explode(grams).alias("gram")).join(_weights(spark, model), "gram")
    sums = met.groupBy("key").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(n)])
    own = F.when(F.size("words") < 3, F.array(F.array_join("words", " "))).otherwise(F.array_distinct(_each(F.col("words"), 3)))
    shares = lines.select("key", F.explode(own).alias("shingle")).join(_shingles(spark), "shingle")
    shares = shares.groupBy("key", "family", "template", "n").agg(F.count("*").alias("met"))
    shares = shares.select("key", F.struct((F.col("met") / F.col("n")).alias("shared"), "family", "template").alias("s"))
    best = shares.groupBy("key").agg(F.max("s").alias("top"), F.collect_set(F.when(F.col("s.shared") >= SHARED, F.col("s.family"))).alias("agreed"))
    rows = lines.select("key").join(sums, "key", "left").join(best, "key", "left")
    logits = F.array(*[(F.coalesce(f"w{k}", F.lit(0)) + int(round(b * MILLION))) / MILLION / model.temperature for k, b in enumerate(model.bias.tolist())])
    rows = rows.select("key", "top", "agreed", logits.alias("logits"))
    rows = rows.withColumn("raised", F.transform("logits", lambda x: F.exp(x - F.array_max("logits"))))
    total = F.aggregate("raised", F.lit(0.0), lambda x, y: x + y)
    first = F.array_position("logits", F.array_max("logits")).cast("int")
    rows = rows.select("key", "top", "agreed", F.element_at(F.array(*map(F.lit, model.families)), first).alias("said"), (1 / total).alias("sure"), (F.element_at("raised", n) / total).alias("unsure"))
    stands = (F.col("said") != UNKNOWN) & (F.col("sure") >= SURE) & F.coalesce(F.array_contains("agreed", F.col("said")), F.lit(False))
    return rows.select(
        "key",
        F.when(stands, F.col("said")).otherwise(UNKNOWN).alias("family"),
        F.round(F.when(stands, F.col("sure")).otherwise(F.col("unsure")), 9).alias("probability"),
        F.col("top.template").alias("template"),
        F.coalesce("top.shared", F.lit(0.0)).alias("shared"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """A row for each paragraph with a cue: doc_id, paragraph (its first line, from 0), family, probability, template, shared.

    Each line with a cue has a row. A span of lines has one, which is then its first
    line's row, if a licence stands in it, no line of it stands alone for that family nor
    its first line for any, no span within it has the same family by as large a share,
    and it lies within no such span of a larger share; of those from one line the one of
    the largest share counts, then the shortest. family is the licence that stands, or ``unknown``; probability is its own.
    template is the template that shares most of its shingles with the paragraph, of all
    families (null if none shares any), and shared that share. Equal paragraphs are scored
    once. Null and empty texts give no rows; rows that repeat a doc_id are each scanned;
    other columns are not read. A very long line is one paragraph, scored over all of its
    distinct n-grams.
    """
    held = docs.filter(_has_cue(F.lower("text"))).select("doc_id", F.monotonically_increasing_id().alias("row"), _lines(F.col("text")).alias("lines"))
    held = stored(held, "cued")
    rows = paragraphs(held.select("row", "lines")).join(held.select("doc_id", "row"), "row")
    rows = reused(rows.select("doc_id", "row", F.col("nth").alias("paragraph"), "lines", F.md5(F.array_join("words", " ")).alias("key"), "words"))
    lines = rows.groupBy("key").agg(F.first("words").alias("words"))
    found = rows.select("doc_id", "row", "paragraph", "lines", "key").join(scored(lines), "key").drop("key")
    found = found.filter((F.col("lines") == 1) | (F.col("family") != UNKNOWN))
    unit = F.struct("doc_id", "paragraph", "lines", "family", "probability", "template", "shared")
    units = found.groupBy("row").agg(F.collect_list(unit).alias("all"))
    none = lambda some, f: ~F.exists(some, f)
    within = lambda x, y: (x["paragraph"] >= y["paragraph"]) & (x["paragraph"] + x["lines"] <= y["paragraph"] + y["lines"])
    units = units.withColumn("alone", F.filter("all", lambda u: (u["lines"] == 1) & (u["family"] != UNKNOWN)))
    units = units.withColumn("spans", F.filter("all", lambda s: (s["lines"] > 1) & none(F.col("alone"), lambda u: within(u, s) & ((u["family"] == s["family"]) | (u["paragraph"] == s["paragraph"])))))
    units = units.withColumn("least", F.filter("spans", lambda s: none(F.col("spans"), lambda u: (u["lines"] < s["lines"]) & within(u, s) & (u["family"] == s["family"]) & (u["shared"] >= s["shared"]))))
    units = units.withColumn("whole", F.filter("least", lambda s: none(F.col("least"), lambda u: within(s, u) & (u["shared"] > s["shared"]))))
    units = units.withColumn("kept", F.filter("whole", lambda s: none(F.col("whole"), lambda u: (u["paragraph"] == s["paragraph"]) & (u["lines"] < s["lines"]) & (u["shared"] == s["shared"]))))
    rest = F.filter("all", lambda u: (u["lines"] == 1) & none(F.col("kept"), lambda s: s["paragraph"] == u["paragraph"]))
    kept = units.select(F.explode(F.concat("kept", rest)).alias("x"))
    return kept.select("x.doc_id", "x.paragraph", "x.family", "x.probability", "x.template", "x.shared")


def expected(text: str | None) -> list[tuple[int, str]]:
    """(paragraph, family) as scan gives them, in plain Python."""
    lines, most = [(line, words_of(line)) for line in re.split(r"\r?\n", (text or "").lower())], reach()
    cue = [any(c in line for c in cues()) for line, _ in lines]

    def judged(words: list[str]) -> tuple[str, float]:
        """The family, and the largest share of any template."""
        model, own = train(), set(shingles_of(words))
        p = model.probabilities(" ".join(words))
        family = model.families[int(p.argmax())]
        shares = {f: max(len(own & set(t)) / len(set(t)) for t in (shingles_of(words_of(x)) for x in some)) for f, some in TEMPLATES.items()}
        return family if family != UNKNOWN and p.max() >= SURE and shares[family] >= SHARED else UNKNOWN, max(shares.values())

    alone = {k: judged(words)[0] for k, (_, words) in enumerate(lines) if cue[k]}
    flat = [(w, k) for k, (_, words) in enumerate(lines) for w in words]
    places: set[tuple[int, int]] = set()  # first and last lines over which some template's shingles reach SHARED
    for template in (set(shingles_of(words_of(x))) for some in TEMPLATES.values() for x in some):
        need = SHARED * len(template)
        ends = lambda p: (flat[p][1], flat[p + 2][1])
        hits = [(p, *ends(p), s) for p in range(len(flat) - 2) if (s := " ".join(w for w, _ in flat[p : p + 3])) in template]
        whole = {k for k in range(len(lines)) if len({s for _, f, e, s in hits if f == e == k}) >= need}
        hits = [h for h in hits if not (h[1] == h[2] and h[1] in whole)]
        for p, first, _, _ in hits:
            places.update((first, e) for q, _, e, _ in hits if p <= q < p + 3 * most and e > first and len({s for r, _, _, s in hits if p <= r <= q}) >= need)
    spans: list[tuple[int, int, str, float]] = []  # first line, line after the last, family, share
    for k, e in sorted(places):
        between = [w for _, words in lines[k + 1 : e] for w in words]
        if all(words for _, words in lines[k : e + 1]) and len(between) < most:
            spans.append((k, e + 1, *judged([*lines[k][1][-most:], *between, *lines[e][1][:most]])))
    stands = {k: f for k, f in alone.items() if f != UNKNOWN}
    spans = [s for s in spans if s[2] != UNKNOWN and s[0] not in stands and s[2] not in [stands.get(k) for k in range(*s[:2])]]
    within = lambda x, y: x[:2] != y[:2] and y[0] <= x[0] and x[1] <= y[1]
    least = [s for s in spans if not any(within(u, s) and u[2] == s[2] and u[3] >= s[3] for u in spans)]
    whole = [s for s in least if not any(within(s, u) and u[3] > s[3] for u in least)]
    kept = [s for s in whole if not any(u[0] == s[0] and u[1] < s[1] and u[3] == s[3] for u in whole)]
    return sorted([(s[0], s[2]) for s in kept] + [x for x in alone.items() if x[0] not in {s[0] for s in kept}])
