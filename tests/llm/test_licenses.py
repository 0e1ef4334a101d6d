"""Whole license texts, tables of many sentences and a plain loop over every sentence and place."""

import random
import re
import textwrap

import pytest
from graphloom.llm import licenses

SENTENCE = {i: s for i, s in licenses.SENTENCES[::-1]}
HEADERS = {
    "GPL-2.0-or-later": ["gpl2-free", "gpl-hope"],
    "LGPL-2.1-or-later": ["lgpl21-free", "lgpl-hope"],
    "AGPL-3.0-or-later": ["agpl3-free", "gpl-hope"],
    "Unlicense": ["unlicense-free", "unlicense-use"],
}
MIT_FILE = """MIT License

Copyright (c) 2021 Some Body

{mit-grant}

{mit-notice}

{mit-warranty} IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
ISC_FILE = """ISC License

Copyright (c) 2019, Some Body <some@body.org>

{isc-grant}

{isc-warranty} IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANYTHING.
"""


def filled(form, width):
    parts = [form.format(**SENTENCE)] if "{" in form else [form]
    return "\n\n".join(textwrap.fill(p, width, break_on_hyphens=False) for p in "".join(parts).split("\n\n"))


def found(spark, texts, **more):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [r for r in sorted(licenses.recognise(rows, **more).collect(), key=lambda r: r.doc_id)]


def test_whole_files_headers_and_identifier_lines(spark):
    texts, want = [], []
    for width in (40, 72, 200):
        texts += [filled(MIT_FILE, width), filled(ISC_FILE, width)]
        want += [["MIT"], ["ISC"]]
        for name, ids in HEADERS.items():
            texts.append("/*\n" + textwrap.indent(textwrap.fill("  ".join(SENTENCE[i] for i in ids), width, break_on_hyphens=False), " * ") + "\n */\nint main;")
            want.append([name])
    for name in licenses.SPDX:
        texts.append(f"#!/bin/sh\n# SPDX-License-Identifier: {name}\n\necho x\n")
        want.append([name])
    bsd = [SENTENCE[i] for i in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")]
    texts += [" ".join(bsd), " ".join(bsd[:3]), "the mit license is long", None, "", "SPDX-License-Identifier: MIT OR Apache-2.0"]
    want += [["BSD-3-Clause"], ["BSD-2-Clause"], [], [], [], []]
    assert [list(r.licenses) for r in found(spark, texts)] == want


def plain(text, sentences, rules, gap):
    """Every known sentence is held against every place; no lookup by words."""
    words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", (text or "").lower())]
    text = (text or "").lower()
    between = [text[a[2] : b[1]] for a, b in zip(words, words[1:])]
    marked = [bool(re.search(r"[.!?;:]\s", g)) for g in between]
    broken = [True, *(m or "\n" in g for m, g in zip(marked, between)), True]
    known = [(re.findall(r"[^\W_]+", s.lower()), i) for i, s in sentences]

    def at(i, last=False):
        fits = [(len(w), name) for w, name in known if [x[0] for x in words[i : i + len(w)]] == w and all(g.count("\n") < 2 for g in between[i : i + len(w) - 1])]
        return max((f for f in fits if broken[i + f[0]] or (not last and at(i + f[0], True))), default=None)

    out, number, i, open_sentence, after = [], 0, 0, False, False
    while i < len(words):
        hit = at(i) if broken[i] or after else None
        if open_sentence and (hit or marked[i - 1] or between[i - 1].count("\n") > 1):
            number, open_sentence = number + 1, False
        if hit:
            out.append((number, hit[1]))
            number, after, i = number + 1, True, i + hit[0]
        else:
            open_sentence, after, i = True, False, i + 1
    names = set()
    for name, ids in rules:
        ways = [[p] for p, x in out if x == ids[0]]
        for want in ids[1:]:
            ways = [w + [p] for w in ways for p, x in out if x == want and 0 < p - w[-1] <= gap + 1]
        if ways:
            names.add((name, tuple(ids)))
    least = {n for n, ids in names if not any(len(b) > len(ids) and re.search(r"\|(?:.*\|)?".join(map(re.escape, ids)), "|".join(b)) for _, b in names)}
    return ",".join(f"{n}:{x}" for n, x in out), sorted(least)


def test_equals_a_plain_loop(spark):
    draw = random.Random(5)
    words = ["aa", "bb", "cc", "dd"]
    sentences = [(f"s{i}", " ".join(draw.choice(words) for _ in range(draw.randint(1, 5)))) for i in range(12)]
    sentences = [(i, s) for n, (i, s) in enumerate(sentences) if s not in [x for _, x in sentences[:n]]]
    names = [i for i, _ in sentences]
    rules = [(f"r{i}", draw.choices(names, k=draw.randint(1, 3))) for i in range(12)]
    marks = [" ", " ", " ", "\n", ". ", "; ", "\n\n", "-", ".", "\r\n# "]
    texts = ["".join(x for _ in range(draw.randint(0, 60)) for x in (draw.choice([*words, draw.choice(sentences)[1]]), draw.choice(marks))) for _ in range(400)]
    got = found(spark, texts, sentences=sentences, rules=rules, gap=1)
    want = [plain(t, sentences, rules, 1) for t in texts]
    assert [(r.sentence_ids, list(r.licenses)) for r in got] == want
    assert sum(bool(names) for _, names in want) > 50


def test_thousands_of_sentences_and_the_bound_of_the_tables(spark):
    many = [(f"x{i}", f"Sentence number {i} of a long list") for i in range(5_000)]
    rules = [(f"R{i}", [f"x{i}", f"x{i + 1}"]) for i in range(0, 4_998, 2)]
    got = found(spark, [f"{many[40][1]}. Something else. {many[41][1]}.", f"{many[41][1]}. {many[40][1]}."], sentences=many, rules=rules)
    assert [list(r.licenses) for r in got] == [["R40"], []] and got[0].sentence_ids == "0:x40,2:x41"
    with pytest.raises(ValueError, match="bytes"):
        licenses.recognise(spark.createDataFrame([(1, "x")], "doc_id long, text string"), sentences=[("big", "word " * 14_000_000)])
