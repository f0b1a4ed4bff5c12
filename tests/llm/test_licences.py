"""Licence scan against alignment at every place."""

import random

import numpy as np

from ebbtide.llm import licences
from ebbtide.llm.common import table


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, licence string, coverage int")


def test_matches_edits_and_spans(spark):
    mit, gpl = licences.NOTICES["MIT"].text, licences.NOTICES["GPL-3.0-header"].text
    edited = gpl.replace("free software", "libre software").replace("either version 3", "version 3")
    rows = [
        (1, f"Prose. {mit}"), (2, f"Zoë 🙂 — {mit.upper()} more"), (3, "Released under the license."), (4, f"{mit}\n{mit}"), (5, edited),
        (6, None), (7, ""), (None, mit), (8, mit), (8, mit), (9, "word " * 30_000 + gpl), (10, "released, UNDER: the; mit\nlicense"), (11, "under the MIT"),
    ]
    got = licences.scan(frame(spark, rows), licences.NOTICES).collect()
    found = sorted((str(r["doc_id"]), r["licence"], r["span_start"], r["span_end"]) for r in got)
    texts = {str(d): t for d, t in rows}
    assert [f[:2] for f in found if f[0] not in ("5", "9")] == [("1", "MIT"), ("10", "MIT"), ("2", "MIT"), ("4", "MIT"), ("4", "MIT"), ("8", "MIT"), ("8", "MIT"), ("None", "MIT")]
    assert {f[1] for f in found if f[0] in ("5", "9")} == {"GPL-3.0-header"}
    for d, name, p, q in found:
        if name == "MIT":
            assert licences.words(texts[d][p:q].encode()) == licences.words(mit.encode())
    assert [0.8 <= r["coverage"] < 1 for r in got if r["doc_id"] == 5] == [True]


def test_short_notices_are_aligned_and_their_names_decide(spark):
    rows = [
        (1, "Licensed under the MIT License"), (2, "Licensed under the Apache License, Version 2.0"), (3, "Licensed under the Apache License, Version 1.1"), (4, "Released under the ISC License"),
        (5, "This work is licensed under the GNU General Public License, version 2."), (6, "Licensed under the Apache software License, Version 2.0."), (7, "Licensed under CC BY-SA 4.0."), (8, "Licensed under the 3-clause BSD license"),
    ]
    got = {}
    for r in licences.scan(frame(spark, rows), licences.NOTICES).collect():
        got.setdefault(r["doc_id"], []).append((r["licence"], r["coverage"]))
    assert got == {1: [("MIT", 0.8)], 2: [("Apache-2.0", 1.0)], 4: [("ISC", 1.0)], 6: [("Apache-2.0", 1.0)], 8: [("BSD-3-Clause", 1.0)]}


def test_whole_texts_with_changes_are_covered(spark):
    whole = licences.whole_texts()
    assert {"MIT-text", "Apache-2.0-text", "GPL-3.0-text", "LGPL-2.1-text", "MPL-2.0-text", "BSD-3-Clause-text", "ISC-text", "CC0-1.0-text", "Unlicense-text"} <= set(whole)
    rng, rows = random.Random(5), []
    for k, (name, t) in enumerate(sorted(whole.items())):
        w = t.text.split()
        for _ in range(len(w) // 25):
            w[rng.randrange(len(w))] = "changed"
        rows.append((k, "An introduction of some words. " + " ".join(w) + " And an end."))
    got = {}
    for r in licences.scan(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], {})[r["licence"]] = (r["coverage"], r["span_start"], r["span_end"])
    for k, name in enumerate(sorted(whole)):
        share, first, end = got[k][name]
        assert 0.93 <= share < 1 and abs(first - 31) < 60 and abs(end - len(rows[k][1]) + 12) < 60


def plain_alignment(template, w, begin, band):
    """Equal words of the best alignment near a diagonal, cell by cell."""
    best, before = (0, 0), {}
    for i, word in enumerate(template):
        row = {}
        for j in range(begin + i - band, begin + i + band + 1):
            there = 0 <= j < len(w)
            diag, up, left = before.get(j - 1, (0, 0)), before.get(j, (0, 0)), row.get(j - 1, (0, 0))
            same = there and w[j] == word
            cell = max([(diag[0] + (3 if same else -2), diag[1] + same), (up[0] - 1, up[1]), (left[0] - 1, left[1])])
            row[j] = cell if cell[0] > 0 else (0, 0)
            if same:
                best = max(best, (row[j][1], row[j][0]))
        before = row
    return best[0]


def test_rows_of_cells_equal_single_cells():
    rng = random.Random(8)
    for _ in range(40):
        template = [rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(3, 30))]
        text = [rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(0, 60))]
        at = rng.randrange(len(text) + 1)
        text[at:at] = [x for x in template if rng.random() < 0.8]
        scanner = licences.Scanner({"t": " ".join(template)})
        coded = np.array([scanner.number.get(x.encode(), -1) for x in text], np.int32)
        begins = [at, 0, -3, len(text)]
        got = scanner.align("t", coded, begins)
        want = [plain_alignment(template, text, b, licences.BAND) for b in begins]
        assert [g[0] for g in got] == want


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_nothing_covered_is_missed_near_verbatim(spark, sf_dir):
    """Every place where a window of the template's length shares 90 % of its words in order is reported."""
    rng = random.Random(3)
    template = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(60):
        w = [rng.choice("abcdef") for _ in range(rng.randrange(0, 120))]
        part = list(template)
        for _ in range(rng.randrange(0, 5)):
            k = rng.randrange(len(part))
            rng.choice([lambda k=k: part.pop(k), lambda k=k: part.insert(k, "new"), lambda k=k: part.__setitem__(k, "other")])()
        at = rng.randrange(len(w) + 1)
        texts.append(" ".join(w[:at] + part + w[at:]))
    scanner = licences.Scanner({"t": " ".join(template)})
    for t in texts:
        share = lcs(template, t.split()) / len(template)
        found = scanner.scan(t.encode())
        assert len(found) == (share >= licences.COVERAGE) and all(abs(f[1] - share) < 1e-9 for f in found)


def test_notices_of_the_given_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = {(r["doc_id"], r["licence"]) for r in licences.scan(docs).collect()}
    short = {n: t.text for n, t in licences.NOTICES.items() if len(t.text) < 100}
    for r in docs.collect():
        for name, t in short.items():
            assert (t in r["text"]) <= ((r["doc_id"], name) in got)


def test_empty_inputs(spark):
    assert licences.scan(frame(spark, [])).collect() == []
    assert licences.scan(frame(spark, [(1, "x y z")]), {"none": "...", "blank": ""}).collect() == []
