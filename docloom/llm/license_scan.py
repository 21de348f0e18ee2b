"""License scans: a trained paragraph classifier confirmed by templates.

Paragraphs are blocks between blank lines, or else their lines, or else the sentences of those. Sparse word n-gram logistic regressions, one for each licence family, are
trained on the families' notices with words dropped or added, against paragraphs of the corpus. Scores are calibrated to
probabilities on paragraphs kept out of training. A prediction counts if the paragraph also shares most of its words with one
of the family's notices, or holds most of a long one. What is no family's, but names a licence and is one by a regression over
all families together, has the class unknown; that one is calibrated on families that its training didn't have.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.html_extract import STOP_WORDS
from docloom.llm.ordinal import Sparse
from docloom.llm.samples import least_hashes

#: Short notices by licence family.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is distributed under the Apache 2.0 license.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL v3.",
    ],
    "LGPL": ["Licensed under the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-or-later", "This library is free software under the terms of the GNU Lesser General Public License"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Public domain": ["This work has been released into the public domain.", "This is free and unencumbered software released into the public domain.", "Licensed under CC0 1.0 Universal."],
    "Proprietary": ["All rights reserved.", "No part of this work may be reproduced without written permission of the copyright holder.", "Confidential and proprietary."],
}
FAMILIES = list(NOTICES)
#: Bounds of the corpus paragraphs that training takes as examples of no licence, and of the documents that they come from.
MAX_DOCUMENTS, MAX_PARAGRAPHS = 1500, 20_000
VARIANTS = 60
#: Least calibrated probability of a family, and least share of words with a notice.
KNOWN_FROM, CONFIRM_FROM = 0.5, 0.6
#: The class of licences of no family, its least calibrated probability and least words (counted at hyphens too), and in how many parts families are kept out to calibrate it.
UNKNOWN, UNKNOWN_FROM, UNKNOWN_WORDS, FOLDS = "unknown", 0.9, 3, 3
NGRAM = 3
#: Words from which on a notice is long: a paragraph that has most of its trigrams holds it.
LONG_NOTICE = 10

_WORD = re.compile(r"\w+(?:[.-]\w+)*").findall
_BLANK_LINES = re.compile(r"\n[^\S\n]*\n\s*")
_SENTENCE = re.compile(r"(?<=[.!?;])(?<!\bv\.)\s+")
#: A text of unknown licence names one.
_NAMES_LICENCE = re.compile(r"\blicen[cs]es?\b|\blicen[cs]ed under\b|\bspdx-license", re.IGNORECASE).search


def paragraphs(text: str | None) -> list[list[str]]:
    """Lines, each with its sentences after it if it has several."""
    out = []
    for line in (text or "").split("\n"):
        if line:
            parts = _SENTENCE.split(line)
            out.append([line] if len(parts) == 1 else [line, *parts])
    return out


def words(text: str) -> list[str]:
    return _WORD(text.lower())


@dataclass
class Model:
    #: Word n-grams to their number, weights by number and family, biases; calibration slope and offset by family.
    names: dict[tuple[str, ...], int]
    weights: np.ndarray
    bias: np.ndarray
    slope: np.ndarray
    offset: np.ndarray
    #: The regression over all families together: weights, bias, slope, offset.
    any_family: tuple[np.ndarray, float, float, float]

    def numbers(self, ws: list[str]) -> list[int]:
        """The known n-grams. A longer one is known only if its words are."""
        get, found, run = self.names.get, [], []
        for w in ws:
            n = get((w,))
            if n is None:
                run = []
                continue
            found.append(n)
            run = [*run[-(NGRAM - 1) :], w]
            found += [m for k in range(2, len(run) + 1) if (m := get(tuple(run[-k:]))) is not None]
        return found

    def probabilities(self, ws: list[str]) -> np.ndarray:
        found = self.numbers(ws)
        raw = self.weights[found].sum(0) / np.sqrt(max(1, len(ws))) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -40, 40)))

    def licence(self, ws: list[str]) -> float:
        """The probability that these are words of a licence notice, of whatever family."""
        weights, bias, slope, offset = self.any_family
        raw = weights[self.numbers(ws)].sum() / np.sqrt(max(1, len(ws))) + bias
        return float(1 / (1 + np.exp(-np.clip(slope * raw + offset, -40, 40))))


def _logistic(x: Sparse, scale: np.ndarray, y: np.ndarray, features: int, ridge: float, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam steps; row i's features have the value ``scale[i]``."""
    theta = np.zeros(features + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(theta[:-1]) * scale + theta[-1], -40, 40)))
        e = (p - y) * weight
        g = np.concatenate((x.back(e * scale, features) + ridge * theta[:-1], [e.sum()]))
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _calibrated(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of probabilities: a regression of one feature, the raw score."""
    slope, offset = _logistic(Sparse(np.arange(len(raw) + 1), np.zeros(len(raw), np.int64)), raw, y, 1, 1e-3)
    return float(slope[0]), offset


def _any_family(found: list[list[int]], scale: np.ndarray, label: np.ndarray, features: int) -> tuple[np.ndarray, float, float, float]:
    """Licence or not, calibrated on families and other paragraphs that the training for it didn't have."""
    of = lambda rows: Sparse.of([found[i] for i in np.flatnonzero(rows)])
    part = np.where(label >= 0, label, np.arange(len(label))) % FOLDS
    raw = np.zeros(len(label))
    for k in range(FOLDS):
        w, b = _logistic(of(part != k), scale[part != k], label[part != k] >= 0, features, 1e-4)
        raw[part == k] = of(part == k).dot(w) * scale[part == k] + b
    return *_logistic(Sparse.of(found), scale, label >= 0, features, 1e-4), *_calibrated(raw, label >= 0)


def train(corpus_paragraphs: list[str], seed: int = 7) -> Model:
    """Fit on variants of the notices against corpus paragraphs; a third of both is kept out for calibration."""
    rng = random.Random(seed)
    other = [ws for p in corpus_paragraphs if (ws := words(p)) and not _like_notice(ws)]
    plain = sorted({w for ws in other for w in ws}) or ["x"]
    names: dict[tuple[str, ...], int] = {}
    for notices in NOTICES.values():
        for notice in notices:
            ws = words(notice)
            for k in range(1, NGRAM + 1):
                for i in range(len(ws) - k + 1):
                    names.setdefault(tuple(ws[i : i + k]), len(names))
    rows: list[tuple[list[str], int]] = [(ws, -1) for ws in other]
    for f, family in enumerate(FAMILIES):
        for notice in NOTICES[family]:
            ws = words(notice)
            for _ in range(VARIANTS):
                kept = [w for w in ws if rng.random() > 0.08] or ws
                extra = [rng.choice(plain) for _ in range(rng.choice((0, 0, 0, 1, 2, 4)))]
                at = rng.choice((0, len(kept)))
                rows.append((kept[:at] + extra + kept[at:], f))
            # Parts of a notice that other texts have too are no licence.
            rows += [(ws[i : i + 2], -1) for i in range(len(ws) - 1) if len(ws) > 6]
    model = Model(names, np.zeros((len(names), len(FAMILIES))), np.zeros(len(FAMILIES)), np.ones(len(FAMILIES)), np.zeros(len(FAMILIES)), (np.zeros(len(names)), -40.0, 1.0, 0.0))
    rng.shuffle(rows)
    found = [model.numbers(ws) for ws, _ in rows]
    scale = np.array([1 / np.sqrt(max(1, len(ws))) for ws, _ in rows])
    label = np.array([f for _, f in rows])
    out = np.arange(len(rows)) % 3 == 0
    x = Sparse.of([found[i] for i in np.flatnonzero(~out)])
    held = Sparse.of([found[i] for i in np.flatnonzero(out)])
    for f in range(len(FAMILIES)):
        w, b = _logistic(x, scale[~out], label[~out] == f, len(names), 1e-4)
        raw = held.dot(w) * scale[out] + b
        model.weights[:, f], model.bias[f] = w, b
        model.slope[f], model.offset[f] = _calibrated(raw, label[out] == f)
    model.any_family = _any_family(found, scale, label, len(names))
    return model


def _grams(ws: list[str]) -> frozenset[tuple[str, ...]]:
    return frozenset(zip(ws, ws[1:], ws[2:]))


def _name(notice: str) -> tuple[frozenset[tuple[str, ...]], frozenset[str]]:
    """What names the licence in a notice: the words and pairs of words of its capitalised runs, and the words with digits among them.

    The first word of a sentence isn't a name for its capital alone, nor are words that sentences of licences begin with.
    """
    runs: list[list[str]] = [[]]
    for k, raw in enumerate(re.findall(r"[\w.-]+|[:;,()]", notice)):
        ws = words(raw)
        if ws and (raw[0].isupper() and (k or raw.isupper()) or raw[0].isdigit() or any(c.isdigit() for c in raw)) and ws[0] not in _COMMON:
            runs[-1] += ws
        elif raw not in "(),":
            runs.append([])
    parts = {tuple(r[i : i + n]) for r in runs for n in (1, 2) for i in range(len(r) - n + 1)}
    return frozenset(p for p in parts if not any(c.isdigit() for w in p for c in w)), frozenset(w for r in runs for w in r if any(c.isdigit() for c in w))


#: Words with capitals in notices that don't name a licence.
_COMMON = frozenset(["license", "licence", "licensed", "version", "v", "this", "permission", "redistribution", "all", "no", "confidential", "released", "spdx-license-identifier", "source", "code", "form", "international"])


def _templates() -> dict[str, list[tuple]]:
    """For each notice its words, the trigrams of a long one, the parts of its name that no other family's notices have, and its version."""
    named = {f: [_name(n) for n in NOTICES[f]] for f in FAMILIES}
    out = {}
    for f in FAMILIES:
        others = frozenset().union(*(parts for g in FAMILIES if g != f for parts, _ in named[g]))
        rows = []
        for notice, (parts, version) in zip(NOTICES[f], named[f]):
            ws = words(notice)
            rows.append((frozenset(ws), _grams(ws) if len(ws) >= LONG_NOTICE else None, parts - others, version))
        out[f] = rows
    return out


_TEMPLATES = _templates()


def _same_name(ws: list[str], own: frozenset[str], name: frozenset[tuple[str, ...]], version: frozenset[str]) -> bool:
    """Whether the paragraph has what names the notice's licence, and no other version in place of its version."""
    if name:
        pairs = {*zip(ws, ws[1:])}
        if not all(p[0] in own if len(p) == 1 else p in pairs for p in name):
            return False
    return not version or bool(version & own) or not any(c.isdigit() for w in own for c in w)


def confirmation(ws: list[str], family: str) -> float:
    """The best match with one of the family's notices whose distinctive name the paragraph has.

    That is the share of words that both have or, as a paragraph may go on after a notice, the share of a long notice's
    word trigrams that the paragraph has. What has another name, or another version, is no match however many of the other words it has.
    """
    own, grams = frozenset(ws), None
    best = 0.0
    for template, parts, name, version in _TEMPLATES[family]:
        if not own or not _same_name(ws, own, name, version):
            continue
        best = max(best, len(own & template) / len(own | template))
        if parts and len(ws) > len(template):
            grams = _grams(ws) if grams is None else grams
            best = max(best, len(grams & parts) / len(parts))
    return best


def _cues() -> list[str]:
    """Words of which any confirmed paragraph has one.

    It lacks at most the share 1 - CONFIRM_FROM of a notice's words (a missing word costs a trigram at least), so of one word more than that share it has one.
    """
    found = set()
    for notices in NOTICES.values():
        for ws in ({*words(n)} for n in notices):
            if not ws & found or len(ws & found) <= (1 - CONFIRM_FROM) * len(ws):
                found.update(sorted(ws, key=lambda w: (w in STOP_WORDS, -len(w), w))[: int((1 - CONFIRM_FROM) * len(ws)) + 1])
    return sorted(found)


def _like_notice(ws: list[str]) -> bool:
    return any(confirmation(ws, f) >= CONFIRM_FROM for f in FAMILIES)


_CUES = _cues()


def _may_be_notice(text: str) -> bool:
    """Whether the text has one of the words that all notices have some of."""
    low = text.lower()
    return any(cue in low for cue in _CUES)


def _judge(model: Model, paragraph: str) -> tuple[str, str, float, float] | None:
    if not _may_be_notice(paragraph):
        return None
    ws = words(paragraph)
    # Without a known word the score is the bias alone, which is unknown.
    if len(ws) < 2 or not any((w,) in model.names for w in ws):
        return None
    chances = model.probabilities(ws)
    best = int(chances.argmax())
    if chances[best] < KNOWN_FROM or (sure := confirmation(ws, FAMILIES[best])) < CONFIRM_FROM:
        return None
    return paragraph, FAMILIES[best], float(chances[best]), sure


def _unknown(model: Model, text: str) -> list[tuple[str, str, float, float]]:
    """The sentences that are licence notices, but of no family."""
    out = []
    for sentence in _SENTENCE.split(text) if _NAMES_LICENCE(text) else ():
        ws = words(sentence)
        if not _NAMES_LICENCE(sentence) or sum(1 + w.count("-") for w in ws) < UNKNOWN_WORDS:
            continue
        if (chance := model.licence(ws)) >= UNKNOWN_FROM:
            out.append((sentence, UNKNOWN, chance, max(confirmation(ws, f) for f in FAMILIES)))
    return out


def classify(model: Model, text: str | None) -> list[tuple[str, str, float, float]]:
    """(paragraph, family, probability, confirmation) of the paragraphs that are licence notices, or else of their lines, or else of their sentences that are.

    Where a paragraph has no family's notice, its sentences, and else those of its lines without one, may be of the class unknown.
    """
    out = []
    if not text or not _may_be_notice(text):
        return out
    for block in _BLANK_LINES.split(text):
        if not _may_be_notice(block):
            continue
        lines = paragraphs(block)
        if len(lines) > 1 and (found := _judge(model, " ".join(block.split()))):
            out.append(found)
            continue
        judged = []
        for line, *sentences in lines:
            whole = _judge(model, line)
            judged.append([whole] if whole else [*filter(None, (_judge(model, s) for s in sentences))])
        if any(judged):
            out += [r for (line, *_), found in zip(lines, judged) for r in found or _unknown(model, line)]
        else:
            out += _unknown(model, " ".join(block.split()) if len(lines) > 1 else block)
    return out


def _scan(model: Model):
    kind = pa.list_(pa.struct([("paragraph", pa.string()), ("family", pa.string()), ("probability", pa.float64()), ("confirmation", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [classify(model, t.as_py()) for t in b.column(b.num_columns - 1)]
            dicts = [[dict(zip(("paragraph", "family", "probability", "confirmation"), r)) for r in found] for found in rows]
            yield pa.record_batch([*b.columns[:-1], pa.array(dicts, kind)], names=[*b.schema.names[:-1], "notices"])

    return run


def training_paragraphs(docs: DataFrame) -> list[str]:
    """At most MAX_PARAGRAPHS lines of MAX_DOCUMENTS documents."""
    ids = least_hashes(docs.select("doc_id").where("doc_id is not null"), MAX_DOCUMENTS, F.xxhash64("doc_id"), "doc_id").distinct()
    some = docs.join(F.broadcast(ids), "doc_id").select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return [r.line for r in some.orderBy(F.xxhash64("line"), "line").limit(MAX_PARAGRAPHS).collect()]


def scan_licenses(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, families (sorted, comma-joined), n_notices and notices (paragraph, family, probability, confirmation) for each row.

    A notice of no family that the model knows has the family ``unknown``.
    Null and empty texts have none. Whole texts are read, every paragraph of any length; repeated rows are scanned
    alike; an empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {kind}, notices array<struct<paragraph:string,family:string,probability:double,confirmation:double>>"
    found = rows.mapInArrow(_scan(model), schema)
    return found.select("doc_id", F.array_join(F.array_sort(F.array_distinct("notices.family")), ",").alias("families"), F.size("notices").cast("long").alias("n_notices"), "notices")
