"""License scan by conditional compression.

Lines with a cue, joined when at most ``NEAR`` lines apart, are the cores of the candidate blocks. A block is
its core and as many words before and after it as the longest template has, so a wrapped notice is whole
wherever its cue stands. The wording
of a block (lower-case words, so neither case nor line breaks count), in pieces of ``PIECE`` words that overlap by the
longest template, is compressed alone and with every template as a raw Zstandard dictionary. Templates that save
bytes are ranked by the bytes saved and confirmed in that order by their exact wording: the words of template and
piece are aligned, template words that are missing and foreign words within the aligned stretch are counted. The
verdict is "exact" without differences, "variant" up to ``VARIANT`` of the template's words. In a block without such a
template the best by differences of all that save is named as "unconfirmed", so unknown licenses can be looked at.

A match belongs to the blocks whose core it touches, and to the first of them if there are several.
One row for each template confirmed in a block, or one unconfirmed row; a matched word counts for one template, the
one with the least share of differences (the longer one of equals). Documents without a cue have no rows. Null and empty texts have no
blocks; repeated rows are scanned each for itself. Equal blocks of a task are compressed once (bounded
memory of ``REMEMBERED`` blocks). Empty input: empty result.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopscope.llm.common import text_rows

NEAR = 3
VARIANT = 0.15
REMEMBERED = 4096
PIECE = 512
LEVEL = 3
#: Every template holds a cue; a cue of several words may be wrapped.
CUE = (r"(?i)licen[cs]e|licenci|lizenz|copyright|\(c\)|spdx|all\W+rights\W+reserved|permission\W+is|permission\W+to\W+use|"
       r"redistribution\W+and\W+use|warrant|public\W+domain|creative\W+commons|\bCC[ -](?:BY|0)")

#: Wordings of common licenses and notices (fixed values).
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0"],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
        "SPDX-License-Identifier: MIT"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "CC0-1.0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights."],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": [
        "Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "All-Rights-Reserved": ["All rights reserved."],
}


_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def wording(text: str) -> list[str]:
    """Lower-case words and numbers, in order."""
    return _WORD.findall(text.lower())


#: Words that a block has before and after its core.
GROW = max(len(wording(t)) for texts in TEMPLATES.values() for t in texts)


def aligned(match: difflib.SequenceMatcher, n: int) -> tuple[int, int, list[int]]:
    """(template words that the block lacks, block words between the first and last matched word that the
    template lacks, places of the matched words) of a template of n words, in the run of matches with the fewest differences."""
    parts = [m for m in match.get_matching_blocks() if m.size]
    best = n, 0, 0, 0
    for i in range(len(parts)):
        same = 0
        for j in range(i, len(parts)):
            same += parts[j].size
            foreign = parts[j].b + parts[j].size - parts[i].b - same
            best = min(best, (n - same, foreign, i, j + 1), key=lambda x: (x[0] + x[1], x[0]))
    missing, foreign, i, j = best
    return missing, foreign, [k for m in parts[i:j] for k in range(m.b, m.b + m.size)]


def differences(template: list[str], block: list[str]) -> tuple[int, int]:
    """(template words that the block lacks, block words between the first and last matched word that the template lacks)."""
    return aligned(difflib.SequenceMatcher(None, template, block, autojunk=False), len(template))[:2]


class Scanner:
    def __init__(self):
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.templates = []
        for name, texts in TEMPLATES.items():
            for i, t in enumerate(texts):
                known = zstandard.ZstdCompressionDict(" ".join(wording(t)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(level=LEVEL)
                self.templates.append((name, i, wording(t), zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)))
        self.counts = [Counter(words) for _, _, words, _ in self.templates]
        self.found = lru_cache(REMEMBERED)(self._found)

    def ranked(self, words: list[str]) -> list[tuple[float, int]]:
        """(share saved, template) of every template, best first, for a piece's wording."""
        raw = " ".join(words).encode()
        plain = len(self.alone.compress(raw))
        out = [((plain - len(c.compress(raw))) / plain, k) for k, (_, _, _, c) in enumerate(self.templates)]
        return sorted(out, key=lambda x: (-x[0], x[1]))

    def scan(self, block: str) -> tuple[str, int, float, int, int, str]:
        return self.found(block, 0, len(block))[0][:6]

    def _best(self, words: list[str], ranking: list[tuple[float, int]]):
        """The confirmed template of the ranking with the least share of differences, the longest and then the
        best ranked of those: (key, template, share saved, missing, foreign, places)."""
        have, best = Counter(words), None
        match = difflib.SequenceMatcher(None, [], words, autojunk=False)
        for place, (saved, k) in enumerate(ranking):
            template = self.templates[k][2]
            n = len(template)
            # words that stand nowhere are missing in any alignment
            if n - sum(min(c, have[w]) for w, c in self.counts[k].items()) > VARIANT * n:
                continue
            match.set_seq1(template)
            missing, foreign, places = aligned(match, n)
            key = (missing + foreign) / n, -n, place
            if key[0] <= VARIANT and (best is None or key < best[0]):
                best = key, k, saved, missing, foreign, places
        return best

    def _found(self, block: str, a: int, b: int) -> list[tuple[str, int, float, int, int, str, int]]:
        """(license, template, share saved, missing, foreign, verdict, place of the first matched word) for the core block[a:b]."""
        at = [m.span() for m in _WORD.finditer(block)]
        words, out, unsure = [block[i:j].lower() for i, j in at], [], []
        for lo in range(0, len(words), PIECE):
            piece = words[lo:lo + PIECE + 2 * GROW]
            ranking = self.ranked(piece)
            saving = [x for x in ranking if x[0] > 0]
            while best := self._best(piece, saving):
                (share, *_), k, saved, missing, foreign, places = best
                for p in places:
                    piece[p] = ""  # matched once only
                if places[0] >= PIECE:
                    continue  # the next piece has it whole
                for p in places:
                    words[lo + p] = ""
                if any(a <= at[lo + p][0] < b for p in places):
                    name, i = self.templates[k][:2]
                    if (name, i) not in [x[:2] for x in out]:
                        out.append((name, i, saved, missing, foreign, "variant" if share else "exact", at[lo + places[0]][0]))
            if not out:
                for saved, k in saving or ranking[:1]:
                    name, i, template, _ = self.templates[k]
                    missing, foreign = differences(template, piece)
                    unsure.append((((missing + foreign) / len(template), -len(template), -saved, name, i), (name, i, saved, missing, foreign)))
        return out or [(*min(unsure)[1], "unconfirmed", a)]


_CUE = re.compile(CUE)


def blocks(text: str) -> list[tuple[int, int, str, int, int, int]]:
    """(first line, lines, text, start and end of the core in it, its place) of the candidate blocks."""
    cores: list[list[int]] = []
    for m in _CUE.finditer(text):
        i, j = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        j = len(text) if j < 0 else j
        if cores and (i < cores[-1][1] or text.count("\n", cores[-1][1], i) <= NEAR):
            cores[-1][1] = max(j, cores[-1][1])
        else:
            cores.append([i, j])
    out = []
    for i, j in cores:
        lo, n = i, 0
        while lo > 0 and n < GROW:
            line = text.rfind("\n", 0, lo - 1) + 1
            words = [m.start() for m in _WORD.finditer(text, line, lo)]
            lo = words[n - GROW] if n + len(words) > GROW else line
            n += len(words)
        hi, n = j, 0
        while hi < len(text) and n < GROW:
            line = text.find("\n", hi + 1)
            line = len(text) if line < 0 else line
            words = [m.end() for m in _WORD.finditer(text, hi, line)]
            hi = words[GROW - n - 1] if n + len(words) > GROW else line
            n += len(words)
        out.append((text.count("\n", 0, lo), text.count("\n", lo, hi) + 1, text[lo:hi], i - lo, j - lo, lo))
    return out


def _run(batches):
    scanner = Scanner()
    for b in batches:
        out = {k: [] for k in ("doc_id", "first_line", "n_lines", "license", "template", "saved", "n_missing", "n_foreign", "verdict", "block")}
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            seen = set()
            for first, lines, block, i, j, place in blocks(text):
                for *row, start in scanner.found(block, i, j):
                    match = row[0], row[1], place + start
                    if match not in seen:
                        seen.add(match)
                        for k, v in zip(out, (doc, first, lines, *row, block)):
                            out[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64(),
                                                           pa.int32(), pa.int32(), pa.string(), pa.string()))], names=list(out))


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, first_line, n_lines, license, template, saved, n_missing, n_foreign, verdict, block)."""
    return text_rows(docs).where(F.col("text").rlike(CUE)).mapInArrow(
        _run, "doc_id long, first_line int, n_lines int, license string, template int, saved double, n_missing int, "
              "n_foreign int, verdict string, block string")
