"""Licence scan: trained paragraph classifier with template confirmation. [native]

Method.  A paragraph is a line, or two or three lines that follow each other (a
wrapped notice), as a sparse set of word 1- and 2-grams.  A multinomial logistic
regression, trained on paragraphs made from notices of each licence family and
on paragraphs of an unknown class (ordinary words, licence words out of order,
and notices that name another licence), gives family probabilities; its
temperature is calibrated on paragraphs held out.  A prediction is confirmed by
comparison with the family's templates: the share of a template's 2-grams that
the paragraph holds, each weighted by how few families have it, and the words
that name the licence, which weigh as much as all the rest.  So what all notices
say ("licensed under the", "license identifier") confirms nothing.

Training is small and fixed (no corpus) and runs on the driver in numpy; the
weights enter the plan as constants.  Scoring is built-in expressions in one
narrow pass.  Lines without any word of the model can't begin or end a
paragraph: the biases alone say unknown, so nothing is lost by that.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.stopwords import STOP_WORDS

UNKNOWN = "unknown"
#: Notices of each family (short excerpts and customary one-line forms).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "you may not use this file except in compliance with the License", "Released under the Apache 2.0 license", "SPDX-License-Identifier: Apache-2.0"),
    "mit": ("Released under the MIT License", "This project is licensed under the terms of the MIT license", "Permission is hereby granted, free of charge, to any person", "SPDX-License-Identifier: MIT", "Distributed under the MIT License"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License", "either version 2 of the License, or any later version", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPL version 2", "SPDX-License-Identifier: GPL-2.0-only"),
    "lgpl": ("under the terms of the GNU Lesser General Public License", "Licensed under the LGPL version 2.1", "SPDX-License-Identifier: LGPL-3.0"),
    "agpl": ("under the terms of the GNU Affero General Public License", "Licensed under the AGPL version 3", "SPDX-License-Identifier: AGPL-3.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification", "Licensed under the BSD 3-Clause License", "Released under the 2-clause BSD license", "SPDX-License-Identifier: BSD-3-Clause"),
    "mpl-2.0": ("subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the MPL 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "cc-by": ("Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International Public License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC-SA 4.0"),
    "cc0": ("To the extent possible under law, the author has waived all copyright", "Released into the public domain under CC0 1.0", "Licensed under CC0 1.0 Universal"),
    "unlicense": ("This is free and unencumbered software released into the public domain", "Released under the Unlicense"),
    "isc": ("Licensed under the ISC License", "SPDX-License-Identifier: ISC"),
    "proprietary": ("All rights reserved. Unauthorized copying of this file is strictly prohibited", "Proprietary and confidential. All rights reserved", "This software is proprietary and may not be redistributed without permission"),
}
#: Words that name a licence.
NAMES = frozenset("apache mit gnu gpl lgpl agpl lesser affero bsd mozilla mpl cc by sa nc creative commons attribution sharealike noncommercial cc0 isc unlicense".split())
#: Lines that a wrapped notice may take.
MOST_LINES = 3
LEAST_PROBABILITY, LEAST_TEMPLATE = 0.5, 0.6
EXAMPLES, EPOCHS, L2 = 90, 250, 1e-4

_TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}.]*"
_PY_TOKEN = re.compile(r"[^\W_](?:[^\W_]|\.)*")


def py_tokens(text: str) -> list[str]:
    return [t.rstrip(".") for t in _PY_TOKEN.findall(text.lower())]


_STOP = {w for words in STOP_WORDS.values() for w in words}


def py_grams(text: str) -> list[str]:
    t = py_tokens(text)
    return sorted({*t, *(f"{a} {b}" for a, b in zip(t, t[1:], strict=False))})


def template_weights() -> dict[str, list[list[tuple[str, float]]]]:
    """Per family and template: its 2-grams, by the logarithm of how few families have them, and its naming words."""
    pairs = {f: [[g for g in py_grams(t) if " " in g] for t in ts] for f, ts in TEMPLATES.items()}
    have = Counter(g for ts in pairs.values() for g in {g for t in ts for g in t})
    out: dict[str, list[list[tuple[str, float]]]] = {f: [] for f in TEMPLATES}
    for f, ts in TEMPLATES.items():
        for text, grams in zip(ts, pairs[f], strict=True):
            rows = [(g, round(math.log((len(TEMPLATES) + 1) / have[g]), 4)) for g in grams]
            names = sorted(NAMES & set(py_tokens(text)))
            out[f].append(rows + [(w, round(sum(x for _, x in rows) / len(names), 4)) for w in names])
    return out


def other_licence(rng: random.Random, notice: str) -> str | None:
    """A notice with the words that name its licence, and numbers, replaced by invented ones; None if nothing names it."""
    name = lambda: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") + rng.choice(["", "l", "n", "x", "ps"]) for _ in range(rng.randint(1, 3)))
    if not NAMES & set(py_tokens(notice)):
        return None
    number = lambda: f"{rng.randint(1, 4)}.{rng.randint(0, 5)}"
    swap = lambda w: name() if w.lower() in NAMES else number() if w[:1].isdigit() and rng.random() < 0.5 else w
    return re.sub(r"[A-Za-z0-9.]+", lambda m: swap(m[0]), notice)


def examples(seed: int) -> list[tuple[str, str]]:
    """Labelled paragraphs: notices with edits and company, and paragraphs of the unknown class."""
    rng = random.Random(seed)
    ordinary = [w for words in STOP_WORDS.values() for w in words] + "project library file author work text version release data table note example source code page book".split()
    licence_words = sorted({w for ts in TEMPLATES.values() for t in ts for w in py_tokens(t)})
    filler = lambda n: " ".join(rng.choice(ordinary) for _ in range(n))
    beside = lambda text, k: (f"{filler(rng.randint(0, 8) if k % 2 else 0)} {text} {filler(rng.randint(0, 8) if k % 3 else 0)}")
    out = []
    for family, notices in TEMPLATES.items():
        for k in range(EXAMPLES):
            notice = notices[k % len(notices)]
            words = notice.split()
            if k >= len(notices) and len(words) > 5:
                words = [w for w in words if rng.random() > 0.06]
            out.append((family, beside(" ".join(words), k)))
            other = other_licence(rng, notice)
            if other:
                out.append((UNKNOWN, beside(other, k)))
    for k in range(EXAMPLES * 8):
        if k % 2:
            out.append((UNKNOWN, filler(rng.randint(3, 40))))
        else:
            words = [rng.choice(licence_words) if rng.random() < 0.35 else rng.choice(ordinary) for _ in range(rng.randint(4, 30))]
            out.append((UNKNOWN, " ".join(words)))
    for words in ("the license", "a driving licence", "permission to enter", "copyright law", "the license plate of the car", "licensed premises", "with permission of the author", "public domain", "software license agreement", "general public"):
        out += [(UNKNOWN, f"{filler(rng.randint(0, 6))} {words} {filler(rng.randint(1, 8))}") for _ in range(EXAMPLES // 3)]
    return out


class Model:
    """Classes, weights per gram, biases (both divided by the calibrated temperature)."""

    def __init__(self):
        self.classes = [*TEMPLATES, UNKNOWN]
        train, held = examples(1), examples(2)
        # a pair of stop words is no gram, so every gram holds a word that is one
        grams = sorted({g for ts in TEMPLATES.values() for t in ts for g in py_grams(t) if not set(g.split()) <= _STOP})
        self.number = {g: i for i, g in enumerate(grams)}
        x, y = self.matrix(train)
        w, b = np.zeros((len(grams), len(self.classes))), np.zeros(len(self.classes))
        mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
        for t in range(1, EPOCHS + 1):
            g = (self.softmax(x @ w + b) - y) / len(x)
            gw, gb = x.T @ g + L2 * w, g.sum(0)
            mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
            step = 0.1 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
            w -= step * mw / (np.sqrt(vw) + 1e-8)
            b -= step * mb / (np.sqrt(vb) + 1e-8)
        hx, hy = self.matrix(held)
        z = hx @ w + b
        loss = lambda t: -np.mean(np.log(np.maximum((self.softmax(z / t) * hy).sum(1), 1e-12)))
        self.temperature = float(min((loss(t), t) for t in np.geomspace(0.3, 4, 40))[1])
        self.w, self.b = np.round(w / self.temperature, 4), np.round(b / self.temperature, 4)
        if self.b.argmax() != len(TEMPLATES):
            raise ValueError("the biases alone must say unknown")
        self.held_out_accuracy = float(((hx @ self.w + self.b).argmax(1) == hy.argmax(1)).mean())

    def any_gram(self) -> str:
        """Regular expression that every lower-case line with a word of the model matches; common beginnings of words are tried once."""

        def tree(words: list[str]) -> str:
            heads = sorted({w[0] for w in words if w})
            branches = [re.escape(h) + tree([w[1:] for w in words if w[:1] == h]) for h in heads]
            if not branches:
                return ""
            inner = branches[0] if len(branches) == 1 and "" not in words else f"(?:{'|'.join(branches)})"
            return f"{inner}?" if "" in words else inner

        words = sorted({w for g in self.number for w in g.split()} - _STOP)
        return rf"(?<![\p{{L}}\p{{N}}]){tree(words)}(?![\p{{L}}\p{{N}}])"

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def matrix(self, rows: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.zeros((len(rows), len(self.number))), np.zeros((len(rows), len(self.classes)))
        for i, (family, text) in enumerate(rows):
            y[i, self.classes.index(family)] = 1
            for g in py_grams(text):
                if g in self.number:
                    x[i, self.number[g]] = 1
        return x, y

    def predict(self, text: str) -> tuple[str, float]:
        """The same scoring in Python, for tests."""
        at = [self.number[g] for g in py_grams(text) if g in self.number]
        p = self.softmax(self.w[at].sum(0) + self.b)
        return self.classes[int(p.argmax())], float(p.max())

    def share(self, text: str, family: str) -> float:
        held = set(py_grams(text))
        return max(sum(w for g, w in t if g in held) / max(1e-9, sum(w for _, w in t)) for t in template_weights()[family])


_model: list[Model] = []


def model() -> Model:
    if not _model:
        _model.append(Model())
    return _model[0]


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per licence notice: id, first line (from 0), lines, family, probability, template share, confirmed.

    Of notices found within each other the one of fewest lines is given.  Blank
    lines end a paragraph.  Null and empty texts have no paragraphs; null ids and
    repeated rows pass through; an empty table gives no rows; other columns are
    not read.
    """
    m = model()
    word = m.any_gram()
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).filter(F.lower("text").rlike(word))

    def windows(lines: Column, has: Column, i: Column) -> Column:
        """Paragraphs that begin in a line and end in one that has a word of the model too, without a blank line between."""
        ends = [F.lit(True), *(F.coalesce(F.get(has, i + n - 1), F.lit(False)) for n in range(2, MOST_LINES + 1))]
        filled = [F.lit(True), *(F.forall(F.slice(lines, i + 2, F.lit(n - 2)), lambda x: x.rlike(r"\S")) if n > 2 else F.lit(True) for n in range(2, MOST_LINES + 1))]
        every = [F.when(e & f, F.struct(i.alias("line"), F.lit(n).alias("n"), F.concat_ws(" ", F.slice(lines, i + 1, F.lit(n))).alias("paragraph"))) for n, (e, f) in enumerate(zip(ends, filled, strict=True), 1)]
        return F.filter(F.array(*every), lambda w: w.isNotNull())

    weights = F.from_json(F.lit(json.dumps({g: m.w[i].tolist() for g, i in m.number.items()}, ensure_ascii=False)), "map<string,array<double>>")
    bias = F.array(*[F.lit(float(b)) for b in m.b])
    vocabulary = sorted(m.number)
    per_family = template_weights()
    templates = F.from_json(F.lit(json.dumps([[[{"g": g, "w": w} for g, w in t] for t in per_family[f]] for f in TEMPLATES])), "array<array<array<struct<g:string,w:double>>>>")
    total = lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["w"])

    def judged(text: Column) -> Column:
        """Struct of the best class, its probability and the template share."""
        tokens = F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"({_TOKEN})"), F.lit(1)), lambda t: F.rtrim(t, F.lit(".")))
        pairs = lambda t: F.when(F.size(t) > 1, F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.concat_ws(" ", t[i - 1], t[i]))).otherwise(F.array().cast("array<string>"))
        # only the model's grams and templates' matter, and all of the latter are among them or pairs of stop words
        grams = let(tokens, lambda t: F.array_distinct(F.concat(t, pairs(t))))
        logits = lambda gs: F.aggregate(F.filter(gs, lambda g: g.isin(vocabulary)), bias, lambda acc, g: F.zip_with(acc, weights[g], lambda a, b: a + b))
        best = lambda z: let(F.array_max(z), lambda top: F.struct((F.array_position(z, top) - 1).cast("int").alias("k"), (1 / F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("p")))
        share = lambda gs, k: F.array_max(F.transform(F.get(templates, k), lambda t: total(F.filter(t, lambda x: F.array_contains(gs, x["g"]))) / F.greatest(total(t), F.lit(1e-9))))
        return let(grams, lambda gs: let(let(logits(gs), best), lambda b: F.struct(b["k"].alias("k"), b["p"].alias("p"), F.when((b["k"] < len(TEMPLATES)) & (b["p"] >= LEAST_PROBABILITY), share(gs, b["k"])).alias("share"))))

    def found_at(lines: Column, has: Column, i: Column) -> Column:
        """Notices that begin in a line."""
        scored = F.transform(windows(lines, has, i), lambda w: F.struct(w["line"].alias("line"), w["n"].alias("n"), judged(w["paragraph"]).alias("best")))
        return F.filter(scored, lambda w: w["best"]["share"].isNotNull())

    def found_in(lines: Column) -> Column:
        # lines and flags are lambda variables: the optimizer would compute columns anew for every line
        def flagged(has: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(has, i))
            return F.transform(first, lambda i: found_at(lines, has, i))

        return let(F.transform(lines, lambda x: F.lower(x).rlike(word)), flagged)

    found = source.select("doc_id", let(F.split("text", "\n"), found_in).alias("found"))
    inside = lambda o, w: (o["n"] < w["n"]) & (o["line"] >= w["line"]) & (o["line"] + o["n"] <= w["line"] + w["n"])

    def alone(found: Column) -> Column:
        """What has no other notice inside of it; one inside begins in the next lines with a word of the model at most."""
        none = F.slice(F.get(found, F.lit(0)), 1, 0)
        near = lambda ws, k: F.flatten(F.array(ws, *(F.coalesce(F.get(found, k + j), none) for j in range(1, MOST_LINES))))
        return F.flatten(F.transform(found, lambda ws, k: F.filter(ws, lambda w: ~F.exists(near(ws, k), lambda o: inside(o, w)))))

    rows = found.select("doc_id", F.explode(let(F.col("found"), alone)).alias("w"))
    family = F.get(F.array(*[F.lit(f) for f in TEMPLATES]), F.col("w.best.k"))
    share = F.col("w.best.share")
    return rows.select(
        "doc_id", F.col("w.line").cast("long").alias("paragraph"), F.col("w.n").alias("n_lines"), family.alias("family"), F.round("w.best.p", 4).alias("probability"), F.round(share, 4).alias("template_share"), (share >= LEAST_TEMPLATE).alias("confirmed")
    )
