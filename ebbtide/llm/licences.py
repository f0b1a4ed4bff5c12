"""Licence scan: winnowed fingerprints of templates pick candidates, banded alignment reports matched coverage and spans."""

from __future__ import annotations

import math
import pathlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import release, row_id


@dataclass(frozen=True)
class Template:
    """A text to look for, and the words of it that decide which licence it names: without all of them it is another."""

    text: str
    decisive: tuple[str, ...] = ()


#: Fixed wording of the usual short notices and headers: name -> text and the words that name licence and version.
NOTICES = {
    "AGPL-3.0-header": Template(
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("affero",)),
    "Apache-2.0": Template("Licensed under the Apache License, Version 2.0.", ("apache", "2", "0")),
    "Apache-2.0-header": Template(
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.", ("apache",)),
    "BSD-2-Clause": Template("Licensed under the 2-Clause BSD License.", ("2", "clause", "bsd")),
    "BSD-3-Clause": Template("Licensed under the 3-Clause BSD License.", ("3", "clause", "bsd")),
    "CC-BY-4.0": Template("This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative", "commons", "attribution", "4", "0")),
    "CC-BY-NC-4.0": Template("Licensed under CC BY-NC 4.0.", ("cc", "by", "nc", "4", "0")),
    "CC-BY-SA-4.0": Template("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative", "commons", "attribution", "sharealike", "4", "0")),
    "CC0-1.0": Template("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.", ("cc0",)),
    "GPL-2.0-header": Template(
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("gnu", "general", "2")),
    "GPL-3.0": Template("This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "3")),
    "GPL-3.0-header": Template(
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu", "general", "3")),
    "ISC": Template("Released under the ISC License.", ("isc",)),
    "LGPL-3.0-header": Template(
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", ("lesser", "3")),
    "MIT": Template("Released under the MIT License.", ("mit",)),
    "MPL-2.0": Template("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "2", "0")),
    "Unlicense": Template("This is free and unencumbered software released into the public domain.", ("unencumbered",)),
}
GRAM = 3
#: Grams of a template of which the least hash is kept: any GRAM + WINNOW - 1 equal words share a fingerprint.
WINNOW = 2
#: Words by which an alignment may leave the diagonal of its candidate.
BAND = 6
COVERAGE = 0.8
#: Share of a template's fingerprints, rounded up, that must lie near a diagonal for it to be aligned.
HITS = 0.1
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_PLAIN = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in bytes(range(256)).lower())


def whole_texts() -> dict[str, Template]:
    """Whole public licence texts, a file each beside this module; their names end in "-text"."""
    folder = pathlib.Path(__file__).with_name("licence_texts")
    return {f"{p.stem}-text": Template(p.read_text(encoding="utf-8")) for p in sorted(folder.glob("*.txt"))}


def templates() -> dict[str, Template]:
    """The notices and the whole texts. Read on the driver; the scanner made of them is what tasks get."""
    return NOTICES | whole_texts()


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and bytes beyond ASCII."""
    return text.translate(_PLAIN).split()


def winnow(grams: list[tuple], span: int = WINNOW) -> set[int]:
    """Places of the fingerprints kept: the least hash of every ``span`` grams in a row, the last on ties."""
    import xxhash

    h = [xxhash.xxh64_intdigest(b" ".join(g)) for g in grams]
    return {min(range(p, min(p + span, len(h))), key=lambda i: (h[i], -i)) for p in range(max(1, len(h) - span + 1))} if h else set()


class Scanner:
    """Inverted index of winnowed template grams, and alignment of candidates."""

    def __init__(self, listed: dict[str, Template | str], coverage: float = COVERAGE, band: int = BAND):
        known = {n: t if isinstance(t, Template) else Template(t) for n, t in sorted(listed.items())}
        self.templates = {n: words(t.text.encode()) for n, t in known.items()}
        self.coverage, self.band = coverage, band
        self.number: dict[bytes, int] = {}
        for w in self.templates.values():
            for x in w:
                self.number.setdefault(x, len(self.number))
        self.coded = {n: np.array([self.number[x] for x in w], np.int32) for n, w in self.templates.items()}
        self.decisive = {n: np.array([x.decode("latin-1") in t.decisive for x in self.templates[n]], bool) for n, t in known.items()}
        self.index: dict[tuple, list[tuple[str, int]]] = {}
        self.least: dict[str, int] = {}
        for name, w in self.templates.items():
            size = min(GRAM, len(w))
            grams = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] if w else []
            kept = winnow(grams)
            self.least[name] = max(1, math.ceil(HITS * len(kept)))
            for i in kept:
                self.index.setdefault(grams[i], []).append((name, i))
        self.sizes = sorted({len(g) for g in self.index})

    def candidates(self, w: list[bytes]) -> dict[str, list[int]]:
        """Per template the places where it would begin, by the grams of the text that are in the index: those with enough fingerprints within the band."""
        found: dict[str, list[tuple[int, int]]] = {}
        for size in self.sizes:
            for at, g in enumerate(zip(*[w[k:] for k in range(size)])):
                if g in self.index:
                    for name, i in self.index[g]:
                        found.setdefault(name, []).append((at - i, i))
        out = {}
        for name, met in found.items():
            begins = np.array(sorted(b for b, _ in set(met)))
            near = np.searchsorted(begins, begins + self.band, "right") - np.searchsorted(begins, begins - self.band, "left")
            kept = np.unique(begins[near >= self.least[name]])
            if len(kept):
                out[name] = kept.tolist()
        return out

    def align(self, name: str, coded: np.ndarray, begins: list[int]) -> list[tuple[int, int, int, int]]:
        """(equal words, decisive words, first word, word after the last) of the best local alignment near each diagonal.

        Equal words add one, a word left out or put in costs a third, an exchanged word two thirds. Cells further than the band
        from the diagonal are not looked at. All diagonals go through the template together, a row of cells for each.
        """
        template, decisive, band = self.coded[name], self.decisive[name], self.band
        width, n = 2 * band + 1, len(begins)
        start = np.array(begins) - band
        padded = np.concatenate((np.full(width, -2, np.int32), coded, np.full(len(template) + 2 * width, -2, np.int32)))
        shift = np.clip(start + width, 0, len(padded) - width)
        place = np.arange(width)
        # of every cell: score in thirds and, below it, equal words; equal words, decisive words, first word
        unit = len(template) + 1
        cell = np.zeros((4, n, width), np.int64)
        best = np.zeros((5, n), np.int64)  # order, equal, decisive, first, end
        size = 4 * (len(template) + width + 4)
        begin = np.array(begins)
        rows = np.arange(n)
        for i in range(len(template)):
            at = np.clip(shift + i, 0, len(padded) - width)
            same = padded[at[:, None] + place] == template[i]
            here = (start + i)[:, None] + place
            up = np.zeros_like(cell)
            up[:, :, :-1] = cell[:, :, 1:]
            diag = cell.copy()
            diag[3] = np.where(same & (diag[0] == 0), here, diag[3])
            diag[0] += np.where(same, 3 * unit + 1, -2 * unit)
            diag[1] += same
            diag[2] += same & decisive[i]
            up[0] -= unit
            base = np.where(up[0] > diag[0], up, diag)
            base *= base[0] >= unit
            # words put in: the running greatest of score and place, with all that belongs to it
            reach = base[0] + unit * place
            top = np.maximum.accumulate(reach, axis=1)
            from_ = np.maximum.accumulate(np.where(reach == top, place, 0), axis=1)
            cell = np.take_along_axis(base, np.broadcast_to(from_, base.shape), axis=2)
            cell[0] = top - unit * place
            cell *= cell[0] >= unit
            # most equal words, then score, then the beginning nearest to the diagonal
            order = np.where(same, (cell[1] * size + cell[0] // unit) * size - np.abs(cell[3] - begin[:, None]), -1)
            far = order.argmax(axis=1)
            better = order[rows, far] > best[0]
            now = np.stack([order[rows, far], cell[1][rows, far], cell[2][rows, far], cell[3][rows, far], here[rows, far] + 1])
            best = np.where(better, now, best)
        return [tuple(int(x) for x in best[1:, k]) for k in range(n)]

    def scan(self, text: bytes) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, equal words, first byte, byte after the last), in order of place.

        Of overlapping matches of one template the one with most equal words counts, then the first.
        """
        w = words(text)
        met = self.candidates(w)
        if not met:
            return []
        coded = np.fromiter((self.number.get(x, -1) for x in w), np.int32, len(w))
        spots, out = None, []
        for name, begins in met.items():
            taken: list[tuple[int, int]] = []
            needed = int(self.decisive[name].sum())
            found = [f for at in range(0, len(begins), 512) for f in self.align(name, coded, begins[at : at + 512])]
            for equal, decided, first, end in sorted(set(found), key=lambda f: (-f[0], f[2], f[3])):
                share = equal / len(self.templates[name])
                if share < self.coverage or decided < needed or any(first < q and p < end for p, q in taken):
                    continue
                taken.append((first, end))
                spots = spots or [m.span() for m in WORD.finditer(text.lower())]
                out.append((name, share, equal, spots[first][0], spots[end - 1][1]))
        return sorted(out, key=lambda m: (m[3], m[4], m[0]))


def scan(docs: DataFrame, listed: dict[str, Template | str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per match: _rid, doc_id, licence, coverage, n_words, span_start, span_end.

    ``coverage`` is the share of the template's words found equal and in order, ``n_words`` their number; the span is in
    code points of the text. Templates of any length count from ``coverage`` on, if the words that name licence and version are among
    the equal ones. By default they are :func:`templates`: the usual notices, and whole licence texts as "...-text". The index of the
    templates is a parameter, not corpus data, and goes to every task. Whole texts are scanned, very long ones too: their words are held
    together, alignments only near candidates. Null and empty texts, and templates without words, match nothing; repeated rows
    each give their matches. An empty table gives no rows; columns other than doc_id and text are not read.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(templates() if listed is None else listed, coverage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for k, cell in enumerate(b.column("text")):
                text = cell.as_py()
                for name, share, n, p, q in scanner.value.scan(text or b""):
                    first = len(text[:p].decode("utf-8", "replace"))
                    at.append(k)
                    found.append((name, share, n, first, first + len(text[p:q].decode("utf-8", "replace"))))
            cols = list(zip(*found, strict=True)) or [()] * 5
            place = pa.array(np.array(at, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("_rid").take(place), b.column("doc_id").take(place), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), *[pa.array(c, pa.int64()) for c in cols[2:]]],
                ["_rid", "doc_id", "licence", "coverage", "n_words", "span_start", "span_end"],
            )
        release()

    rows = row_id(docs.select("doc_id", F.col("text").cast("binary").alias("text")))
    return rows.mapInArrow(run, f"_rid long, doc_id {dict(docs.dtypes)['doc_id']}, licence string, coverage double, n_words long, span_start long, span_end long")
