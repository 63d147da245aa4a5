import re
from itertools import product
from re import _parser

from corvine.llm import license_scan
from corvine.llm.license_rules import BASE, RULES
from corvine.llm.license_scan import SHORT, SHORT_WORDS, STEMS, scan_licenses


def brute(text):
    """The contract and the method, plainly, one document at a time."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    norm = " " + " ".join(words) + " "
    base = [(label, 99, i, i + len(p.split())) for label, p in BASE for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    found = set(base)
    for r in RULES:
        for m in re.finditer(f"(?<= ){r.pattern}(?= )", norm):
            s = len(norm[:m.start()].split())
            found.add((r.label, r.priority, s, s + len(m[0].split())))
    kept = [d for d in found if d[1] == 99 or not any(
        e[0] != d[0] and ((e[2] <= d[2] and e[3] >= d[3] and e[3] - e[2] > d[3] - d[2]) or (e[2] < d[3] and d[2] < e[3] and e[1] > d[1])) for e in found)]
    starts = [b[2] for b in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b[0] for b in base})),
            ",".join(sorted({d[0] for d in kept})), max((min(d[1], 10) / 10 for d in kept), default=0.0))


CASES = [
    None, "", "no words here?", "Released UNDER the MIT-License. And under the mit license!", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3 or (at your option) any later version.",
    "CC BY-NC 4.0 and CC-BY-SA 3.0; Creative Commons Attribution 4.0 International License", "All rights reserved. (c) Copyright 2011 2012 X",
    "ümit license accordée sous the mit licensé", "under the mit\x00license cc by nc", "SPDX-License-Identifier: MIT\n" * 3,
    "under the mit license " * 400, "wörter " * 3000 + "under the mit license", "3-clause BSD license", "GPLv2", "(LGPLv3)", "asl 2.0", "BSD-2-Clause", "epl v2.0 or MPL 1.1", "aslant basl", "same terms as Perl itself", "cc by", "x.cc-by-nd 2.0 y", "CC0", "\x00", "...", "a", "é", "...a!b...", "may not be used to train AI models",
]


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(CASES)], "doc_id long, text string, detections string, norm string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in scan_licenses(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(CASES)}


def test_suppression_beyond_near_detections(spark, monkeypatch):
    texts = [t for t in CASES if t] + ["GNU General Public License version 3 " * 50 + "Creative Commons Attribution NonCommercial 4.0 International License " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for near in (0, 1):
        monkeypatch.setattr(license_scan, "NEAR", near)
        got = {r.doc_id: (r.base_labels, r.labels, r.score) for r in scan_licenses(df).collect()}
        assert got == {i: brute(t)[4:] for i, t in enumerate(texts)}


def test_documents_and_repeats(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(3))
    got = [
        (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in scan_licenses(docs).collect()]
    want = [(r.doc_id, *brute(r.text)) for r in docs.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_pattern_holds_its_keyword_and_a_stem():
    assert len(RULES) >= 200
    for r in RULES:
        re.compile(r.pattern)


def shortest(parsed):
    """Texts of a pattern, one for each choice of alternatives, without what is optional."""
    parts = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            parts.append([chr(arg[0][1]) if str(arg[0][0]) == "LITERAL" else "1"])
        elif name == "BRANCH":
            parts.append([x for b in arg[1] for x in shortest(b)])
        elif name == "SUBPATTERN":
            parts.append(shortest(arg[3]))
        elif name == "MAX_REPEAT":
            parts.append([x * arg[0] for x in shortest(arg[2])] if arg[0] else [""])
        else:
            assert name == "ASSERT_NOT", name
    return ["".join(x) for x in product(*parts)]


def test_every_pattern_passes_the_gate():
    for r in RULES:
        for t in shortest(_parser.parse(r.pattern)):
            assert re.fullmatch(r.pattern, t) and f" {r.keyword}" in f" {t}", (r, t)
            assert any(x in t for x in STEMS) or (any(x in t for x in SHORT) and re.search(SHORT_WORDS, t)), (r, t)


def test_mit_0_without_any_other_stem(spark):
    texts = ["MIT-0", "MIT No Attribution", "(mit  no-attribution)", "x MIT 0", "mit 01", "mit no", "limit 0", "mit 0x", "mit not attribution"]
    got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: brute(t)[5:] for i, t in enumerate(texts)} and [got[i] for i in range(4)] == [("mit-0", 0.7)] * 4
