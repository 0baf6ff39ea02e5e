"""License rules against brute force, and what they say of notices."""

import random
import re

import pytest

from vectrail.llm import licenses
from vectrail.llm.license_rules import PHRASES
from vectrail.llm.queries import op11_license_rules

DOCS = "doc_id long, text string, id string, detections string, score string"  # the last three clash with names used inside
SCANNER = licenses.Scanner(licenses.signature_rules())


def scan(text):
    return SCANNER.scan(licenses.words(text))


def labels(text):
    return {d.label for d in scan(text) if d.label}


def brute(text):
    """All matches of all rules, ungated; of overlapping ones those that no better kept one contains."""
    ws = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    line = " ".join(ws)
    found = []
    for i, rule in enumerate(SCANNER.rules):
        if rule.always:
            need = rule.keyword.split(" ")
            spans = [(k, k + len(need) - 1) for k in range(len(ws)) if ws[k : k + len(need)] == need]
        else:
            spans = [(line[: m.start()].count(" "), line[: m.end()].count(" ")) for m in re.finditer(f"(?<![^ ])(?:{rule.pattern})(?![^ ])", line)]
        found += [(rule.priority, a - b, i, a, b, rule.always) for a, b in spans]
    kept = []
    for d in sorted(found):
        if d[5] or not any(k[3] <= d[3] and d[4] <= k[4] for k in kept):
            kept.append(d)
    return sorted((d[3], d[4], d[2]) for d in kept)


NOTICES = [
    ("Released under the MIT License.", {"mit"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc-4.0"}),
    ("Licensed under the Apache License, Version 2.0.", {"apache", "apache-2.0"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3"}),
    ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2.0-or-later"}),
    ("see https://creativecommons.org/licenses/by-sa/4.0/ there", {"cc-by-sa-4.0"}),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", {"bsd-2-clause"}),
    ("It is not licensed under the Mozilla Public License.", set()),
    ("It is not licensed under the MIT License.", {"mit"}),  # phrases always stay
    ("under the terms of the GNU Lesser General Public License", {"lgpl"}),
    ("my driver's license number", set()),
    ("GNU\nGeneral\n  Public * License", {"gpl"}),
    ("gnu general public licenses", {"gpl"}),
    ("MIT licenseé", set()),
    ("plain words about nothing", set()),
]


@pytest.mark.parametrize("text, want", NOTICES)
def test_labels(text, want):
    assert labels(text) == want


def test_rules_are_many_and_their_keywords_gate_nothing_away():
    assert len(SCANNER.rules) > 200
    for rule in SCANNER.rules:
        assert re.search(rf"(?<![a-z0-9]){rule.keyword}(?![a-z0-9])", rule.pattern.replace("\\ ", " ")), rule
        assert "{v}" not in rule.label or "(?P<v>" in rule.pattern


def pieces():
    """Notices, and texts made from the rules' own words."""
    rng = random.Random(5)
    plain = [re.sub(r"\(\?P<v>([0-9 ]+).*", r"\1", re.sub(r"\(\?:([^()|]*)\)\??", r"\1", r.pattern)).replace("[cs]", "s") for r in SCANNER.rules]
    plain = [re.sub(r"[^a-z0-9 ]", "", p) for p in plain] + [t for t, _ in NOTICES]
    return [" ".join(rng.choice(plain) for _ in range(rng.randint(1, 5))) for _ in range(250)]


def test_scan_equals_brute_force():
    hits = 0
    for text in [*pieces(), None, "", "  ", "cc by cc by", "cc cc by by"]:
        got = [(d.first_word, d.last_word, d.rule) for d in scan(text)]
        assert got == brute(text)
        hits += len(got)
    assert hits > 250


def test_operator_and_query(spark, tmp_path):
    texts = [t for t, _ in NOTICES] + [None, "", "...", "x " * 200_000 + "apache license", *pieces()[:40], "cc by", "cc by"]
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(texts)] + [(None, "mit license", "", "", "")], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op11_license_rules(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts) + 1
    for i, text in [*enumerate(texts), (None, "mit license")]:
        r, at, said = rows[i], [], set()
        ws = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]
        for phrase, label in PHRASES:
            need = phrase.split(" ")
            here = [k for k in range(len(ws)) if ws[k : k + len(need)] == need]
            at += here
            said |= {label} if here else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(ws), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted(said))
        assert r.labels == ",".join(sorted(labels(text) | said)) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels)
    assert licenses.scan_licenses(docs.where("false")).count() == 0
