"""Licence scans against a plain version that works on lists of words and compares all pairs of detections."""

from __future__ import annotations

import random
import re

import pytest

from basinflow.llm import licenses
from basinflow.llm.license_rules import BASE, CONFIDENCE, RULES
from basinflow.llm.queries import QUERIES
from tests import parity
from tests.llm import fixtures as fx

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PATTERNS = [re.compile(f"(?<= )(?:{r.pattern})(?= )") for r in RULES]


def brute(text):
    words = WORD.findall(fx.lower(text or ""))
    base = []
    for label, phrase in BASE:
        p = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    joined = " " + " ".join(words) + " "
    starts = {0: 0}
    at = 0
    for i, w in enumerate(words):
        at += 1
        starts[at] = i
        at += len(w)
    found = []
    if "licen" in joined or any(k in joined for r in RULES for k in r.keywords):
        for n, (rule, pattern) in enumerate(zip(RULES, PATTERNS)):
            if not all(k in joined for k in rule.keywords):
                continue
            for m in pattern.finditer(joined):
                found.append((starts[m.start()], starts[m.start()] + len(m[0].split()), rule.priority, n))

    def hides(b, a):
        if b == a or not (b[0] <= a[0] and b[1] >= a[1] and b[2] >= a[2]):
            return False
        return b[:3] != a[:3] or b[3] < a[3]

    kept = sorted(a for a in found if not any(hides(b, a) for b in found))
    labels = {RULES[k[3]].label for k in kept} | {label for _, label in base}
    score = max([CONFIDENCE[k[2]] for k in kept] + [licenses.BASE_CONFIDENCE[label] for _, label in base], default=0.0)
    places = [i for i, _ in base]
    return (
        len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score,
        sorted((RULES[k[3]].label, k[0], k[1]) for k in kept),
    )


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: sorted((d.label, d.first_word, d.stop_word) for d in r.found) for r in licenses.scan_licenses(df).collect()}
    return [got[i] for i in range(len(texts))]


STATED = [
    ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
    ("GNU General Public License version 2 or any later version", {"gpl-2.0-or-later"}),
    ("under the GNU Lesser General Public License, version 2.1", {"lgpl-2.1"}),
    ("GNU Affero General Public License v3", {"agpl-3.0"}),
    ("Released under the MIT License.", {"mit"}),
    ("Er kam mit der Bahn und mit Lizenz.", set()),
    ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}),
    ("Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa-4.0"}),
    ("All rights reserved. Alle Rechte vorbehalten. Tous droits réservés.", {"reserved"}),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", {"0bsd"}),
    ("Ce livre est dans le domaine public", {"public-domain"}),
    ("The license plate was new; a gpl of words, a bsd.", set()),
]


def test_statements(spark):
    for (text, want), got in zip(STATED, scan(spark, [t for t, _ in STATED])):
        assert {label for label, _, _ in got} == want, text


def test_hundreds_of_rules_all_compile_and_have_keywords():
    assert len(RULES) > 300 and len({r.pattern for r in RULES}) > 300
    for r in RULES:
        assert licenses.compiled(r.pattern) and r.priority in CONFIDENCE and all(k == k.lower() and k for k in r.keywords)


def test_random_texts_against_brute_force(spark):
    rng = random.Random(4)
    parts = [t for t, _ in STATED] + ["CC BY", "cc by-sa 3.0", "general public license", "ALL RIGHTS RESERVED", "version 2", "or later", "é", "mit", " ", "-", "\n", "v3", "the", "gnu", "gpl", "license"]
    texts = [rng.choice(" -\n.").join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(150)] + [None, "", " \n ", "cc by " * 3000 + "x"]
    for text, got in zip(texts, scan(spark, texts)):
        assert got == brute(text)[-1], text


def test_odd_rows(spark):
    rows = fx.odd_documents(spark)
    got = sorted(((r.doc_id, r.n_words, len(r.found)) for r in licenses.scan_licenses(fx.frame(spark, rows)).collect()), key=str)
    assert got == sorted(((r[0], brute(r[1])[0], len(brute(r[1])[-1])) for r in rows), key=str)
    assert licenses.scan_licenses(fx.frame(spark, [])).count() == 0


@pytest.mark.parametrize("folder", [parity.DATA, "/root/testdata/sf0.01"])
def test_registered_query(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op13_license_scan"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute(texts[r.doc_id])[:-1]
    assert any(r.n_base for r in rows) and any(r.labels and not r.base_labels for r in rows)
