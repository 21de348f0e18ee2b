import random
import re

import pytest

from docloom.llm import license_scan


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "version", "work", "under", "this", "".join(rng.choices("abcdefg", k=5))])
    return license_scan.train([" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(2000)])


@pytest.mark.parametrize("family", license_scan.FAMILIES)
def test_notices_are_found(model, family):
    for notice in license_scan.NOTICES[family]:
        found = license_scan.classify(model, f"some words before\n{notice}\nand after")
        assert [f[1] for f in found] == [family], notice


def test_held_out_variants_and_unknowns(model):
    known = {
        "Licensed under the Apache License version 2.0": "Apache-2.0", "Code released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License version 3.": "GPL-3.0", "LICENSED UNDER CC BY-NC 4.0": "CC-BY-NC",
    }
    for text, family in known.items():
        assert [f[1] for f in license_scan.classify(model, text)] == [family], text
    for text in ["This work is about the general public.", "the of this version under", "Permission slips are due", "", None, "The MIT campus", "Licensed driver wanted under 40"]:
        assert license_scan.classify(model, text) == []


UNKNOWN = [
    "Licensed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: Zlib", "Released under the Artistic License 2.0.", "Licensed under the European Union Public Licence v. 1.2", "Licensed under EUPL 1.2.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "This font is licensed under the SIL Open Font License, Version 1.1.",
]
NO_LICENCE = ["Licensed driver wanted under 40", "A fishing license is required in this county.", "The driver lost his license after the accident.", "License plates are sold here.", "A license", "My licence and the car"]


def test_licences_of_no_family_are_unknown(model):
    for text in UNKNOWN:
        assert [(f[0], f[1]) for f in license_scan.classify(model, f"some words before\n\n{text}\n\nand after")] == [(text, "unknown")], text
    for text in NO_LICENCE:
        assert license_scan.classify(model, f"some words before.\n{text}") == [], text
    both = license_scan.classify(model, f"Released under the MIT License.\nmore words. {UNKNOWN[0]} and after")
    assert [f[1] for f in both] == ["MIT", "unknown"]
    wrapped = license_scan.classify(model, "some words before\n\n" + UNKNOWN[0].replace(" Software", "\nSoftware"))
    assert [(f[0], f[1]) for f in wrapped] == [(UNKNOWN[0], "unknown")]


@pytest.mark.parametrize("left_out", license_scan.FAMILIES)
def test_notices_without_their_templates_are_of_no_other_family(model, left_out, monkeypatch):
    monkeypatch.setattr(license_scan, "_TEMPLATES", license_scan._TEMPLATES | {left_out: []})
    for notice in license_scan.NOTICES[left_out]:
        assert {f[1] for f in license_scan.classify(model, notice)} <= {"unknown"}, notice


def test_operator(spark, model):
    notice = "Licensed under CC BY-NC 4.0."
    rows = [(1, f"a b c\n{notice}", "x"), (2, f"The words. {notice} More words here.", "x"), (3, None, "x"), (4, "", "x"), (5, "the of " * 30_000, "x"), (None, "Released under the MIT License.", "x"), (1, f"a b c\n{notice}", "x")]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, families string"), model).collect()
    assert sorted((str(r.doc_id), r.families, r.n_notices) for r in got) == sorted([("1", "CC-BY-NC", 1)] * 2 + [("2", "CC-BY-NC", 1), ("3", "", 0), ("4", "", 0), ("5", "", 0), ("None", "MIT", 1)])
    assert license_scan.scan_licenses(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_training_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "MAX_PARAGRAPHS", 5)
    docs = spark.createDataFrame([(i, f"line {i}\n\nother {i}") for i in range(20)], "doc_id long, text string")
    assert len(license_scan.training_paragraphs(docs)) == 5
    monkeypatch.setattr(license_scan, "MAX_DOCUMENTS", 2)
    monkeypatch.setattr(license_scan, "MAX_PARAGRAPHS", 50)
    assert len(license_scan.training_paragraphs(docs)) == 4


FULL = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:""",
}


@pytest.mark.parametrize("family", FULL)
def test_wrapped_paragraphs_of_full_licences(model, family):
    for text in (FULL[family], FULL[family].replace("\n", " ")):
        assert {f[1] for f in license_scan.classify(model, f"the of version words\n\n{text}\n\nother words of this")} == {family}


def test_cues_lose_no_notice(model, monkeypatch):
    rng = random.Random(8)
    texts = []
    for notices in license_scan.NOTICES.values():
        for notice in notices:
            ws = notice.split()
            texts += [" ".join(w for w in ws if rng.random() > 0.25) for _ in range(20)]
    with_cues = [license_scan.classify(model, t) for t in texts]
    monkeypatch.setattr(license_scan, "_may_be_notice", lambda text: True)
    assert with_cues == [license_scan.classify(model, t) for t in texts] and sum(map(bool, with_cues)) > 300


#: Sentences of licences of no family, whose other words are those of a family's notices.
OTHER_NAMES = {
    "EPL": ["Licensed under the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, version 2.0"],
    "ISC": ["Released under the ISC License.", "Licensed under the ISC license."],
    "Zlib": ["Released under the Zlib License.", "Licensed under the zlib license."],
    "AGPL": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL v3."],
    "Artistic": ["This project is distributed under the Artistic 2.0 license."],
    "MPL-1.1": ["Licensed under the Mozilla Public License 1.1."],
    "Apache-1.1": ["Licensed under the Apache License, Version 1.1."],
    "CC-BY-ND": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."],
}


@pytest.mark.parametrize("name", OTHER_NAMES)
def test_other_names_are_of_no_family(model, name):
    """The confusion of held-out names: all of them come out unknown, none as the family that they share words with."""
    for text in OTHER_NAMES[name]:
        assert [f[1] for f in license_scan.classify(model, text)] == ["unknown"], text


def plain_families(model, text):
    """Families by trying every block, line and sentence against every template, without cues or an order of tries that saves work."""
    found = set()
    for block in re.split(r"\n[^\S\n]*\n\s*", text or ""):
        tries = [[" ".join(block.split())]] if "\n" in block else []
        for candidates in [*tries, *[[line, *license_scan._SENTENCE.split(line)] for line in block.split("\n")]]:
            for c in candidates:
                ws = license_scan.words(c)
                if len(ws) < 2 or not any((w,) in model.names for w in ws):
                    continue
                chances = dict(zip(license_scan.FAMILIES, model.probabilities(ws)))
                best = max(chances, key=chances.get)
                if chances[best] >= license_scan.KNOWN_FROM and license_scan.confirmation(ws, best) >= license_scan.CONFIRM_FROM:
                    found.add(best)
                    break
            else:
                continue
            if candidates in tries:
                break
    return found


def test_families_are_those_of_the_plain_way(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r.families for r in license_scan.scan_licenses(spark.createDataFrame(docs), model).collect()}
    for r in docs:
        assert {f for f in found[r.doc_id].split(",") if f and f != "unknown"} == plain_families(model, r.text), r.doc_id
    assert sum(bool(f) for f in found.values()) > 2
