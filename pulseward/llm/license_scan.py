"""License scans by conditional compression.

A candidate block is a run of lines around license words. It is compressed alone and with every template as a raw zstandard
dictionary; the bytes a template saves rank the templates. In that order, a diff of words looks for a passage that confirms one:
which of the template's words a passage has in order, lacks, or has besides, against the template's own length. The first
confirmed passage is reported with its place, and what is left on both sides of it is ranked and compared again, so a block
can have several notices.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping
from difflib import SequenceMatcher

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseward.llm.common import map_blocks

#: Public license notices, by SPDX identifier; texts are fixed values.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "Copyright. All rights reserved.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}

#: A line with one of these is part of a candidate block.
CUES = r"(?i)licen[cs]|copyright|all rights reserved|creative commons|\bcc[ -]by\b|redistribut|warrant|permission (?:is|to use)|free software"
#: Lines without a cue that a block may span between two with one.
GAP = 3
#: Share of the template's words a block must have, in order, and of its own words that must be the template's.
CONFIRM_FOUND, CONFIRM_PURE = 0.9, 0.5
LEVEL = 3

_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
_CUE = re.compile(CUES)
#: Closing marks that belong to the passage before them.
_ENDS = ".,;:!?)\"'"


def candidate_blocks(text: str) -> list[tuple[int, int]]:
    """Character spans of runs of cue lines."""
    spans: list[list[int]] = []
    at, last, number = 0, -GAP - 2, 0
    for line in text.split("\n"):
        if _CUE.search(line):
            if number - last <= GAP + 1:
                spans[-1][1] = at + len(line)
            else:
                spans.append([at, at + len(line)])
            last = number
        at += len(line) + 1
        number += 1
    return [(a, b) for a, b in spans]


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class Scanner:
    """Templates as raw dictionaries, with a compressor each."""

    def __init__(self, templates: Mapping[str, str]):
        import zstandard

        options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.plain = zstandard.ZstdCompressor(**options)
        self.names = sorted(templates)
        self.words = {n: words(templates[n]) for n in self.names}
        self.given = {
            n: zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(templates[n].encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options
            )
            for n in self.names
        }

        self.counts = {n: Counter(w) for n, w in self.words.items()}
        self.saves = {n: max(1, a - b) for n in self.names for a, b in [self.sizes(templates[n], n)]}

    def sizes(self, piece: str, name: str) -> tuple[int, int]:
        """Compressed size of a text alone and given the template."""
        data = piece.encode("utf-8", "surrogatepass")
        return len(self.plain.compress(data)), len(self.given[name].compress(data))

    def passage(self, own: list[str], name: str) -> tuple[int, int, int, int, int] | None:
        """Where the words ``own`` fit the template best: (shared, missing, extra, first word, end), shared words being in order,
        extra ones between shared ones; None without a shared word.

        Confirmed passages come first, then those with the most shared words less extra ones. The words around each
        common run are compared anew, so that words far away do not stretch a passage.
        """
        want = self.words[name]
        best = None
        seen = set()
        for anchor in SequenceMatcher(None, own, want, autojunk=False).get_matching_blocks():
            low, high = max(0, anchor.a - anchor.b - len(want)), anchor.a - anchor.b + 2 * len(want)
            if not anchor.size or (low, high) in seen:
                continue
            seen.add((low, high))
            same = [m for m in SequenceMatcher(None, own[low:high], want, autojunk=False).get_matching_blocks() if m.size]
            for i in range(len(same)):
                shared = 0
                for m in same[i:]:
                    shared += m.size
                    start, end = low + same[i].a, low + m.a + m.size
                    found = shared, len(want) - shared, end - start - shared, start, end
                    key = self.confirms(*found[:3]), shared - found[2], -start
                    if best is None or key > best[0]:
                        best = key, found
        return best and best[1]

    @staticmethod
    def confirms(shared: int, missing: int, extra: int) -> bool:
        return shared >= CONFIRM_FOUND * (shared + missing) and shared >= CONFIRM_PURE * (shared + extra)

    def ranked(self, piece: str) -> list[tuple[int, str]]:
        """(bytes saved, template) of all templates, the largest reduction first, then by name."""
        data = piece.encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(data))
        return sorted(((alone - len(self.given[n].compress(data)), n) for n in self.names), key=lambda x: (-x[0], x[1]))

    def notices(self, block: str) -> list[dict]:
        """Rows of the block in order: each confirmed passage, and each piece around them that still has a license word, with
        the template that fits it best."""
        places = [m.span() for m in _WORD.finditer(block)]
        own = [block[a:b].lower() for a, b in places]
        out, todo = [], [(0, len(block), 0, len(own))]
        while todo:
            begin, stop, low, high = todo.pop()
            if not _CUE.search(block, begin, stop):
                continue
            order = self.ranked(block[begin:stop])
            here, found = Counter(own[low:high]), None
            for _, name in order:
                # What can be confirmed at all has so many of the template's words in any order.
                need = self.counts[name]
                if (need & here).total() >= CONFIRM_FOUND * need.total():
                    found = self.passage(own[low:high], name)
                    if found and self.confirms(*found[:3]):
                        break
                    found = None
            if found:
                shared, missing, extra, first, end = found
                a, b = places[low + first][0], places[low + end - 1][1]
                b += len(block[b:stop]) - len(block[b:stop].lstrip(_ENDS))
                out.append(self.row(block, a, b, name, shared, missing, extra))
                todo += [(begin, a, low, low + first), (b, stop, low + end, high)]
            else:
                out.append(self.unconfirmed(block, begin, stop, own[low:high], order))
        return sorted(out, key=lambda row: row["start"])

    def unconfirmed(self, block: str, begin: int, stop: int, own: list[str], order: list[tuple[int, str]]) -> dict:
        """Of the templates that save the largest shares of what they save on themselves, within a tenth, the one with the
        least share of words lacking or besides."""
        saved = {name: size / self.saves[name] for size, name in order}
        bound = max(saved.values()) - 0.1
        choices = []
        for name in self.names:
            if saved[name] >= bound:
                shared, missing, extra, *_ = self.passage(own, name) or (0, len(self.words[name]), 0)
                choices.append(((missing + extra) / max(1, shared + missing), -saved[name], name, shared, missing, extra))
        return self.row(block, begin, stop, *min(choices)[2:])

    def row(self, block: str, begin: int, stop: int, name: str, shared: int, missing: int, extra: int) -> dict:
        alone, given = self.sizes(block[begin:stop], name)
        return {
            "start": begin,
            "n_chars": stop - begin,
            "license": name,
            "size_alone": alone,
            "size_given": given,
            "reduction": max(0.0, 1 - given / alone),
            "words_shared": shared,
            "words_missing": missing,
            "words_extra": extra,
            "confirmed": self.confirms(shared, missing, extra),
            "exact": missing == 0 and extra == 0,
        }


_SCHEMA = (
    "doc_id long, block int, start int, n_chars int, license string, size_alone int, size_given int, reduction double, "
    "words_shared int, words_missing int, words_extra int, confirmed boolean, exact boolean"
)


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None) -> DataFrame:
    """One row per notice in the candidate blocks of every whole text: its block, place, template, sizes, word differences, and
    whether confirmed; a piece of a block with license words and no confirmed notice has a row with the nearest template.

    Null and empty texts and texts without license words have no row; repeated rows repeat theirs; ties go to the template
    first in the alphabet. Other columns are ignored.
    """
    chosen = dict(templates or TEMPLATES)
    state: list[Scanner] = []

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(Scanner(chosen))
        hit = pc.fill_null(pc.match_substring_regex(part.column("text"), CUES), False)
        part = part.filter(hit)
        rows = []
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
            for number, (a, b) in enumerate(candidate_blocks(text)):
                for row in state[0].notices(text[a:b]):
                    rows.append({"doc_id": doc_id, "block": number, **row, "start": a + row["start"]})
        return pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(_SCHEMA))
    return map_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _SCHEMA)
