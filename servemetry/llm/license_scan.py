"""License notices in text by conditional compression.

Stretches of the paragraphs about a cue word that hold enough words of a template are compressed
alone and with each template as a raw dictionary. What the dictionary saves, as a share of
the size alone, ranks the templates. The best few are confirmed by a word-by-word
comparison, which also gives the exact differences. What a notice leaves of the paragraphs
is searched again.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Mapping
from difflib import SequenceMatcher
from functools import lru_cache

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_blocks

#: Wordings to look for (fixed values); notices, not whole licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the'
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable"
        " law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES"
        " OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        ' files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,'
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
        " with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "proprietary": "All rights reserved. No part of this work may be reproduced without written permission.",
    "reserved": "All rights reserved.",
}
#: A paragraph without any of these holds no notice.
CUES = ("licens", "licenc", "copyright", "rights", "permission", "permitted", "redistribut")
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


#: First and last (exclusive) word, missing words and added words.
Notice = tuple[int, int, list[str], list[str]]


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Lower-case words with start and end."""
    return [(m.group().lower(), *m.span()) for m in _WORD.finditer(text)]


def blocks(text: str, cues: tuple[str, ...]) -> list[tuple[int, int]]:
    """Start and end of the paragraphs with a cue: adjacent lines with words, so comment marks alone make no line.

    Paragraphs with cues that follow each other are one block, since long notices have several. So is the one
    before and behind them: a notice may begin or end in a paragraph without a cue.
    """
    paragraphs: list[list] = []
    at, open_ = 0, False
    for line in text.split("\n"):
        end = at + len(line)
        if not _WORD.search(line):
            open_ = False
        elif open_:
            paragraphs[-1][1] = end
        else:
            paragraphs.append([at, end])
            open_ = True
        at = end + 1
    cued = [any(c in text[a:b].lower() for c in cues) for a, b in paragraphs]
    out: list[tuple[int, int]] = []
    for n, (start, end) in enumerate(paragraphs):
        if any(cued[max(0, n - 1) : n + 2]):
            if n and out and out[-1][1] == paragraphs[n - 1][1]:
                start = out.pop()[0]
            out.append((start, end))
    return out


class Scanner:
    """Compressors of all templates, and the comparison of a paragraph with the best of them."""

    def __init__(self, templates: tuple[tuple[str, str], ...], level: int, tried: int, agreement: float):
        self.tried, self.agreement = tried, agreement
        self.words = {name: [w for w, _, _ in words_of(text)] for name, text in templates}
        plain = {"level": level, "write_checksum": False, "write_content_size": False}
        self.alone = zstandard.ZstdCompressor(**plain)
        self.given = {
            name: zstandard.ZstdCompressor(**plain, dict_data=zstandard.ZstdCompressionDict(" ".join(self.words[name]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for name, _ in templates
        }
        self.counts = {name: Counter(words) for name, words in self.words.items()}
        self.ranked = lru_cache(maxsize=4096)(self._ranked)
        self.scan = lru_cache(maxsize=4096)(self._scan)

    def saved(self, block: str, name: str) -> float:
        """Share of the compressed size that a template saves."""
        data = block.encode("utf-8", "surrogatepass")
        return 1 - len(self.given[name].compress(data)) / len(self.alone.compress(data))

    def _ranked(self, block: str) -> set[str]:
        """The `tried` templates that save most, if they save anything."""
        data = block.encode("utf-8", "surrogatepass")
        size = len(self.alone.compress(data))
        best = sorted((len(c.compress(data)), name) for name, c in self.given.items())[: self.tried]
        return {name for length, name in best if length < size}

    def _aligned(self, name: str, words: list[str], lo: int, hi: int) -> Notice | None:
        """The notice about the densest matching blocks among words lo to hi: the blocks in a row that agree best."""
        wanted = self.words[name]
        blocks = [b for b in SequenceMatcher(None, wanted, words[lo:hi], autojunk=False).get_matching_blocks() if b.size]
        best = None
        for n, begin in enumerate(blocks):
            matched = 0
            for block in blocks[n:]:
                matched += block.size
                span = block.b + block.size - begin.b
                agreement = matched / (len(wanted) + span - matched)
                if agreement >= self.agreement and (best is None or (agreement, matched) > best[0]):
                    best = (agreement, matched), lo + begin.b, lo + block.b + block.size
        if best is None:
            return None
        _, first, last = best
        steps = SequenceMatcher(None, wanted, words[first:last], autojunk=False).get_opcodes()
        missing = [w for kind, a, b, _, _ in steps if kind != "equal" for w in wanted[a:b]]
        added = [w for kind, _, _, a, b in steps if kind != "equal" for w in words[first:last][a:b]]
        if 1 - (len(missing) + len(added)) / (len(wanted) + len(added)) < self.agreement:
            return None
        return first, last, missing, added

    def occurrences(self, name: str, words: list[str], lo: int, hi: int) -> list[Notice]:
        """All notices of one template among words lo to hi, not overlapping.

        A notice has at least `need` words of the template within `width` words, so only windows with that many are compared.
        """
        wanted = self.words[name]
        need, width = math.ceil(self.agreement * len(wanted) - 1e-9), int(len(wanted) / self.agreement + 1e-9)
        hits = [n for n in range(lo, hi) if words[n] in self.counts[name]]
        out: list[Notice] = []
        while True:
            left, begin, held, found = dict(self.counts[name]), bisect_left(hits, lo), 0, None
            stop = begin
            while begin < len(hits):
                at = hits[begin]
                while stop < len(hits) and hits[stop] < at + width:
                    held += left[words[hits[stop]]] > 0
                    left[words[hits[stop]]] -= 1
                    stop += 1
                if held >= need and name in self.ranked(" ".join(words[at : at + width])):
                    found = self._aligned(name, words, at, min(hi, at + 2 * width))
                    if found:
                        break
                left[words[at]] += 1
                held -= left[words[at]] > 0
                begin += 1
            if found is None:
                return out
            if found[0] - at >= need:
                out += self.occurrences(name, words, at, found[0])
            out.append(found)
            lo = found[1]

    def _scan(self, paragraph: str) -> list[dict]:
        found = words_of(paragraph)
        words = [w for w, _, _ in found]
        waiting: list[tuple] = []
        seen: set[tuple[str, int, int]] = set()

        def look(name: str, lo: int, hi: int) -> None:
            for first, last, missing, added in self.occurrences(name, words, lo, hi):
                saved = self.saved(" ".join(words[first:last]), name)
                if saved > 0 and (name, first, last) not in seen:
                    seen.add((name, first, last))
                    agreed = len(self.words[name]) - 2 * len(missing) - len(added)
                    heapq.heappush(waiting, (-agreed, -len(self.words[name]), -saved, name, first, last, missing, added))

        for name in self.words:
            look(name, 0, len(words))
        firsts, lasts, out = [], [], []
        while waiting:
            _, _, saved, name, first, last, missing, added = heapq.heappop(waiting)
            at = bisect_right(lasts, first)
            if at < len(firsts) and firsts[at] < last:
                # What others left about this stretch may still hold a notice of the template.
                width = int(len(self.words[name]) / self.agreement + 1e-9)
                first, last = max(0, first - width), min(len(words), last + width)
                at = bisect_right(lasts, first)
                while first < last:
                    end = min(last, firsts[at]) if at < len(firsts) else last
                    look(name, first, end)
                    first = max(first, lasts[at]) if at < len(lasts) else last
                    at += 1
                continue
            firsts.insert(at, first)
            lasts.insert(at, last)
            out.append({
                "license": name, "start": found[first][1], "end": found[last - 1][2], "saved": -saved,
                "n_missing": len(missing), "n_added": len(added), "differences": " ".join([f"-{w}" for w in missing] + [f"+{w}" for w in added]),
            })
        return sorted(out, key=lambda n: n["start"])


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...], level: int, tried: int, agreement: float) -> Scanner:
    return Scanner(templates, level, tried, agreement)


_ROW = "doc_id {kind}, license string, start bigint, end bigint, saved double, n_missing bigint, n_added bigint, differences string"


def license_notices(
    docs: DataFrame, *, templates: Mapping[str, str] | None = None, cues: tuple[str, ...] = CUES, level: int = 9, tried: int = 3, agreement: float = 0.75,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per notice: doc_id, license, start, end (characters, exclusive), saved, n_missing, n_added, differences.

    Candidate blocks are paragraphs about a cue word, however their lines are wrapped or marked as comments. A block gives every stretch where at least `agreement`
    of the words agree with a template that is among the `tried` that save most there. Of overlapping ones the one with
    most agreeing less differing words stays, of equals the longer one, then the one that saves more. differences lists missing words with - and added ones with +. Null
    and empty texts have no notices; repeated rows are scanned each for itself. Nothing is shuffled.
    """
    fixed = tuple(sorted((templates or TEMPLATES).items()))

    def block(keys: list, texts: list) -> tuple:
        scanner = _scanner(fixed, level, tried, agreement)
        rows = []
        for key, text in zip(keys, texts, strict=True):
            if not text or not any(c in text.lower() for c in cues):
                continue
            for at, end in blocks(text, cues):
                rows.extend((key, n["license"], at + n["start"], at + n["end"], n["saved"], n["n_missing"], n["n_added"], n["differences"]) for n in scanner.scan(text[at:end]))
        return tuple(zip(*rows, strict=True)) if rows else ((),) * 8

    return map_blocks(docs, [id_col, text_col], block, _ROW.format(kind=docs.schema[id_col].dataType.simpleString()))


def licensed_documents(notices: DataFrame) -> DataFrame:
    """One row per document with notices: their number and the distinct licenses, in order."""
    return notices.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_notices"), F.array_sort(F.collect_set("license")).alias("licenses"))
