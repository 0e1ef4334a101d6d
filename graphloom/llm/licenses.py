"""License scans by sentence rules.

Known sentences, compared word by word, give license-sentence identifiers; the sequence of
identifiers of a text is matched against rules, each an ordered list of identifiers of which at
most ``gap`` foreign sentences may stand between two.  A known sentence may be wrapped at any
width and may hold end marks.  Sentences are looked up by a hash of their words and rules by their
first identifier, so the work on a text hardly grows with the number of either.  One pass in Arrow
batches, no shuffle, no rows dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values: (identifier, sentence).
SENTENCES = [
    ("mit-name", "MIT License"), ("mit-ref", "Released under the MIT License"), ("mit-ref", "Licensed under the MIT License"), ("mit-ref", "This project is licensed under the MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apache-ref", "Licensed under the Apache License, Version 2.0"), ("apache-ref", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("apache-use", "you may not use this file except in compliance with the License."), ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-warranty", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl3-ref", "This work is licensed under the GNU General Public License, version 3"), ("gpl3-ref", "Licensed under the GNU General Public License, version 3"),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc-by-nc-ref", "Licensed under CC BY-NC 4.0"), ("cc-by-nc-ref", "Licensed under CC BY-NC 4.0."), ("cc-by-sa-ref", "Licensed under CC BY-SA 4.0"), ("cc-by-ref", "Licensed under CC BY 4.0"),
    ("cc-by-ref", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("cc0-ref", "This work is dedicated to the public domain under CC0 1.0"),
    ("mpl-ref", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."), ("rights", "All rights reserved."),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl2-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("lgpl21-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-hope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("unlicense-free", "This is free and unencumbered software released into the public domain."),
    ("unlicense-use", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("epl2-ref", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("boost-ref", "Distributed under the Boost Software License, Version 1.0."),
    ("zlib-warranty", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]
#: Fixed values: (license, ordered identifiers).
RULES = [
    ("MIT", ["mit-ref"]), ("MIT", ["mit-name", "mit-grant"]), ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]), ("Apache-2.0", ["apache-ref"]), ("Apache-2.0", ["apache-use", "apache-copy", "apache-warranty"]),
    ("GPL-3.0", ["gpl3-ref"]), ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]), ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]), ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"]), ("CC-BY-SA-4.0", ["cc-by-sa-ref"]), ("CC-BY-4.0", ["cc-by-ref"]), ("CC0-1.0", ["cc0-ref"]), ("MPL-2.0", ["mpl-ref"]), ("all-rights-reserved", ["rights"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]), ("GPL-2.0-only", ["gpl2-only"]), ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope"]), ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope"]), ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope"]),
    ("ISC", ["isc-grant", "isc-warranty"]), ("0BSD", ["0bsd-grant", "isc-warranty"]), ("Unlicense", ["unlicense-free", "unlicense-use"]), ("EPL-2.0", ["epl2-ref"]), ("BSL-1.0", ["boost-ref"]), ("Zlib", ["zlib-warranty", "zlib-grant"]),
]
#: Names of licenses in an identifier line.
SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
]
SENTENCES += [(f"spdx-{name}", f"SPDX-License-Identifier: {name}") for name in SPDX]
RULES += [(name, [f"spdx-{name}"]) for name in SPDX]
GAP = 2
#: The tables of sentences and rules are broadcast; larger ones are an error.
MAX_TABLE_BYTES = 64 << 20
WORD = re.compile(r"[^\W_]+")
#: End marks count before white space or at the end, as in ``v. 2.0.``, not inside ``2.0``.
END_MARK = re.compile(r"[.!?;:](?=\s|$)")


class Sentences:
    """Known sentences by their words, and rules by their first identifier."""

    def __init__(self, sentences: list, rules: list, gap: int):
        self.gap, self.known, lengths = gap, {}, {}
        for identifier, sentence in sorted(sentences):
            found = WORD.findall(sentence.lower())
            if found:
                self.known[" ".join(found)] = identifier
                lengths.setdefault(tuple(found[:2]), set()).add(len(found))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        self.firsts = {k[0] for k in self.lengths}
        self.rules = {}
        for name, ids in rules:
            if ids:
                self.rules.setdefault(ids[0], []).append((name, tuple(ids)))

    def _closing(self, words: list[str], breaks: list[int], i: int) -> int:
        """How many words the longest known sentence at word ``i`` has that ends there by itself; else 0."""
        for n in self._ways(words, breaks, i):
            if breaks[i + n]:
                return n
        return 0

    def _ways(self, words: list[str], breaks: list[int], i: int) -> Iterator[int]:
        lengths = {n for k in (tuple(words[i : i + 2]), (words[i],)) for n in self.lengths.get(k, ())}
        for n in sorted(lengths, reverse=True):
            if i + n <= len(words) and max(breaks[i + 1 : i + n], default=0) < 3 and " ".join(words[i : i + n]) in self.known:
                yield n

    def named(self, text: str) -> list[tuple[int, str]]:
        """``(sentences before it, identifier)`` of each known sentence, in order; the longest first, none overlapping."""
        text = text.lower()
        found = list(WORD.finditer(text))
        words = [m.group() for m in found]
        if self.firsts.isdisjoint(words):
            return []
        # what stands before each word and after the last: 0 nothing, 1 a line break, 2 an end mark, 3 a blank line
        ends = [0, *(m.end() for m in found)]
        starts = [*(m.start() for m in found), len(text)]
        breaks = [self._break(text, a, b) for a, b in zip(ends, starts)]
        breaks[0] = breaks[-1] = 3
        out, at, i, foreign, after = [], 0, 0, False, False
        while i < len(words):
            n = 0
            if (breaks[i] or after) and words[i] in self.firsts:
                n = next((n for n in self._ways(words, breaks, i) if breaks[i + n] or self._closing(words, breaks, i + n)), 0)
            if n:
                at += foreign
                out.append((at, self.known[" ".join(words[i : i + n])]))
                at, foreign, after = at + 1, False, True
                i += n
                continue
            if foreign and breaks[i] >= 2:
                at += 1
            foreign, after = True, False
            i += 1
        return out

    @staticmethod
    def _break(text: str, a: int, b: int) -> int:
        if b - a == 1 and text[a] == " ":
            return 0
        gap = text[a:b]
        if gap.count("\n") > 1:
            return 3
        return 2 if END_MARK.search(gap + text[b : b + 1]) else int("\n" in gap)

    def matches(self, named: list[tuple[int, str]]) -> list[tuple[str, tuple]]:
        """Rules whose identifiers occur in order, no two neighbours more than ``gap`` sentences apart.

        A rule whose identifiers another matching rule holds in the same order beside others says
        less than that rule and is left out.
        """
        out = []
        for first in sorted({identifier for _, identifier in named}):
            for name, ids in self.rules.get(first, ()):
                ends = [None] * len(ids)
                for at, identifier in named:
                    for k in range(len(ids) - 1, -1, -1):
                        if identifier == ids[k] and (k == 0 or (ends[k - 1] is not None and at - ends[k - 1] <= self.gap + 1)):
                            ends[k] = at
                    if ends[-1] is not None:
                        out.append((name, ids))
                        break
        return [(name, ids) for name, ids in out if not any(len(more) > len(ids) and _within(ids, more) for _, more in out)]


def _within(ids: tuple, more: tuple) -> bool:
    rest = iter(more)
    return all(i in rest for i in ids)


def recognise(docs: DataFrame, sentences: list = SENTENCES, rules: list = RULES, gap: int = GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, sentence_ids, licenses, n_matches)``, one row per row of ``docs``.

    ``sentence_ids``: identifiers of known sentences in order, as ``position:identifier``, the
    position being the number of sentences before it; ``licenses``: sorted names of the licenses
    of which a rule matches; ``n_matches``: how many rules match.  Sentences of the same words are
    equal whatever their signs, case and line breaks; a blank line ends a sentence.  Null and
    empty texts have none; null and repeated ids are carried row by row; other columns are
    ignored; an empty table gives an empty result.
    """
    size = sum(len(x.encode()) for pair in sentences for x in pair) + sum(len(x.encode()) for _, ids in rules for x in ids)
    if size > MAX_TABLE_BYTES:
        raise ValueError(f"sentences and rules take {size} bytes, more than {MAX_TABLE_BYTES}")
    shared = docs.sparkSession.sparkContext.broadcast((sentences, rules, gap))
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text"))
    found = [T.StructField("sentence_ids", T.StringType()), T.StructField("licenses", T.ArrayType(T.StringType())), T.StructField("n_matches", T.LongType())]
    schema = T.StructType([rows.schema[id_col], *found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Sentences(*shared.value)
        for batch in batches:
            ids, names, counts = [], [], []
            for text in batch.column(1):
                named = table.named(text.as_py() or "")
                matched = table.matches(named)
                ids.append(",".join(f"{at}:{identifier}" for at, identifier in named))
                names.append(sorted({name for name, _ in matched}))
                counts.append(len(matched))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.string()), pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)
