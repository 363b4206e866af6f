"""Licence scans by sentence rules.

A text is cut into sentences, once within its lines and once over paragraphs
whose lines are joined (wrapped notices). A sentence is normalised (lower case,
runs of other characters than letters and digits as one blank) and looked up
among the known licence sentences; a copyright notice ends with its sentence
and gives way to them. The sequence of their identifiers is then
matched against ordered rules, longest first: a rule matches consecutive
identifiers, copyright lines between them aside, no more than ``max_gap``
characters apart (None: any distance). A sentence serves one match. What a rule matches over a
wider gap only is no licence of the row, but stands in its column ``split``.

Every text is scanned whole. Null and empty texts have no matches; repeated
rows give equal rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_GAP = 400
COPYRIGHT = "copyright"

# Known licence sentences, as published, by identifier.
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-ref": "Released under the MIT License.",
    "mit-ref-2": "Licensed under the MIT License.",
    "mit-ref-3": "This project is licensed under the MIT License.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-ref": "Licensed under the BSD License.",
    "apache-head": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-ref": "Licensed under the Apache License, Version 2.0.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-ref-2": "Licensed under the GNU General Public License v3.0.",
    "lgpl-ref": "Licensed under the GNU Lesser General Public License, version 3.",
    "mpl-head": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0": "Released under CC0 1.0.",
    "reserved": "All rights reserved.",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "agpl-received": "You should have received a copy of the GNU Affero General Public License along with this program.",
    "agpl-ref": "Licensed under the GNU Affero General Public License v3.0.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "lgpl-received": "You should have received a copy of the GNU Lesser General Public License along with this library.",
    "epl2-head": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl1-head": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-ref": "Distributed under the Boost Software License, Version 1.0.",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "cc-by-nd": "Licensed under CC BY-ND 4.0.",
    "cc-by-nd-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-sa-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-nd-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc0-long": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
}

# Identifiers that may follow a licence tag in a source file.
TAGGED = ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
          "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only",
          "AGPL-3.0-or-later", "MPL-2.0", "EPL-1.0", "EPL-2.0", "Zlib", "BSL-1.0", "Unlicense", "WTFPL", "CC0-1.0", "CC-BY-4.0",
          "CC-BY-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0")
SENTENCES.update({f"tag-{name}": f"SPDX-License-Identifier: {name}" for name in TAGGED})

# Rules, a licence name and its sentences in order.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-ref",)), ("MIT", ("mit-ref-2",)), ("MIT", ("mit-ref-3",)),
    ("ISC", ("isc-grant", "isc-as-is")), ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-ref",)),
    ("Apache-2.0", ("apache-head", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-head", "apache-copy")), ("Apache-2.0", ("apache-head",)),
    ("Apache-2.0", ("apache-ref",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")), ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")), ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-3.0-only", ("gpl3-ref",)), ("GPL-3.0-only", ("gpl3-ref-2",)),
    ("LGPL-3.0-only", ("lgpl-ref",)),
    ("MPL-2.0", ("mpl-head", "mpl-copy")), ("MPL-2.0", ("mpl-head",)),
    ("Unlicense", ("unlicense",)),
    ("CC-BY-4.0", ("cc-by",)), ("CC-BY-4.0", ("cc-by-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)), ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC0-1.0", ("cc0",)),
    ("all-rights-reserved", ("reserved",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see", "gpl-received")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see", "gpl-received")),
    ("GPL-2.0-only", ("gpl2-only", "gpl-hope", "gpl-see", "gpl-received")),
    ("GPL-2.0-only", ("gpl2-only", "gpl-hope", "gpl-see")), ("GPL-2.0-only", ("gpl2-only",)),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope", "agpl-see", "agpl-received")),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope", "agpl-see")), ("AGPL-3.0-or-later", ("agpl-free",)),
    ("AGPL-3.0-only", ("agpl-ref",)),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-see", "lgpl-received")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-see")), ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope", "lgpl-see", "lgpl-received")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope", "lgpl-see")), ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("EPL-2.0", ("epl2-head",)), ("EPL-1.0", ("epl1-head",)),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant")), ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-ref",)), ("WTFPL", ("wtfpl",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)), ("CC-BY-ND-4.0", ("cc-by-nd-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa",)), ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-long",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd",)), ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-long",)),
    ("CC0-1.0", ("cc0-long",)),
    *((name, (f"tag-{name}",)) for name in TAGGED),
]

# Every known sentence holds one of these (tested), so a text without any has none.
ANCHORS = ("licen", "copyright", "rights reserved", "permission", "redistribut", "warrant", "public domain",
           "cc by", "cc0", "gnu ", "mpl ", "software")

_SENTENCE = re.compile(r"[^.!?:;\n]+(?:[.!?:;](?!\s|$)[^.!?:;\n]*)*[.!?:;]*")
_WRAPPED = re.compile(r"[^.!?:;]+(?:[.!?:;](?!\s|$)[^.!?:;]*)*[.!?:;]*")
_PARAGRAPH = re.compile(r"(?:[^\n]*\S[^\n]*\n?)+")
_OTHER = re.compile(r"[\W_]+")
_COPYRIGHT = re.compile(r"(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©)?[ \t]*[0-9]{4}"
                        r"(?:[^.!?:;\n]|[.!?:;](?!\s|$))*[.!?:;]*", re.I)


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


@lru_cache(maxsize=1)
def known() -> dict[tuple, list]:
    """Normalised sentences by identifier; a sentence with inner full stops or
    semicolons is known by the sequence of its pieces."""
    first: dict[str, list] = {}
    for name, s in SENTENCES.items():
        pieces = [p for p in (normalise(m.group()) for m in _WRAPPED.finditer(s)) if p]
        first.setdefault(pieces[0], []).append((pieces, name))
    for options in first.values():
        options.sort(key=lambda o: -len(o[0]))
    return first


def _identify(pieces: list[tuple[int, int, str]], out: set):
    table = known()
    for i, (a, _, s) in enumerate(pieces):
        for want, name in table.get(s, ()):
            if [p[2] for p in pieces[i: i + len(want)]] == want:
                out.add((a, pieces[i + len(want) - 1][1], name))
                break


def sentence_ids(text: str) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of every known sentence, by start; of two that
    overlap the longer stays. Copyright notices that overlap none are added."""
    low = text.lower()
    if not any(a in low for a in ANCHORS):
        return []
    out: set = set()
    lines = [(m.start(), m.end(), normalise(m.group())) for m in _SENTENCE.finditer(text)]
    _identify([p for p in lines if p[2]], out)
    for par in _PARAGRAPH.finditer(text):
        if "\n" in par.group().rstrip("\n"):
            got = [(par.start() + m.start(), par.start() + m.end(), normalise(m.group()))
                   for m in _WRAPPED.finditer(par.group())]
            _identify([p for p in got if p[2]], out)
    starts: list = []
    kept: list = []

    def keep(a, z, name):
        i = bisect_right(starts, a)
        if (not i or kept[i - 1][1] <= a) and (i == len(kept) or z <= kept[i][0]):
            starts.insert(i, a)
            kept.insert(i, (a, z, name))

    bare = {(z - len(text[a:z].lstrip()), z, name) for a, z, name in out}
    for s in sorted(bare, key=lambda s: (s[0] - s[1], s)):
        keep(*s)
    for m in _COPYRIGHT.finditer(text):
        keep(m.start(), m.end(), COPYRIGHT)
    return kept


@lru_cache(maxsize=1)
def rules_by_length() -> dict[int, dict[tuple, str]]:
    out: dict[int, dict] = {}
    for name, ids in RULES:
        out.setdefault(len(ids), {})[ids] = name
    return out


def split_matches(found: list, hits: list, max_gap: int | None = MAX_GAP) -> list[tuple[str, int, int]]:
    """Matches that only a wider gap between sentences would allow."""
    seq = [s for s in found if s[2] != COPYRIGHT]
    if max_gap is None or all(b[0] - a[1] <= max_gap for a, b in zip(seq, seq[1:])):
        return []
    return [m for m in match_rules(found, None) if m not in set(hits)]


def match_rules(found: list[tuple[int, int, str]], max_gap: int | None = MAX_GAP) -> list[tuple[str, int, int]]:
    """(licence, start, end) of the rule matches in a sequence of identifiers."""
    seq = [s for s in found if s[2] != COPYRIGHT]
    free = [True] * len(seq)
    out = []
    rules = rules_by_length()
    for length in sorted(rules, reverse=True):
        for i in range(len(seq) - length + 1):
            part = seq[i: i + length]
            if not all(free[i: i + length]):
                continue
            if max_gap is not None and any(b[0] - a[1] > max_gap for a, b in zip(part, part[1:])):
                continue
            name = rules[length].get(tuple(p[2] for p in part))
            if name:
                out.append((name, part[0][0], part[-1][1]))
                free[i: i + length] = [False] * length
    return sorted(out, key=lambda m: (m[1], m[2]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_gap: int | None = MAX_GAP) -> DataFrame:
    """doc_id, n_sentences, sentences (id:start:end), n_licences, licences
    (distinct names in order), matches and split matches (name:start:end) of every row."""
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("_text"))
    names = ["doc_id", "n_sentences", "sentences", "n_licences", "licences", "matches", "split"]

    def run(batches):
        for b in batches:
            out = [[] for _ in range(6)]
            for t in b.column("_text").to_pylist():
                found = sentence_ids(t or "")
                hits = match_rules(found, max_gap) if found else []
                labels = list(dict.fromkeys(h[0] for h in hits))
                row = (len(found), ",".join(f"{n}:{a}:{z}" for a, z, n in found), len(labels), ",".join(labels),
                       *(",".join(f"{n}:{a}:{z}" for n, a, z in m) for m in (hits, split_matches(found, hits, max_gap))))
                for col, v in zip(out, row):
                    col.append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id")] + [pa.array(c, t) for c, t in zip(out, types)], names)

    schema = (src.drop("_text").schema.add("n_sentences", "long").add("sentences", "string")
              .add("n_licences", "long").add("licences", "string").add("matches", "string").add("split", "string"))
    return src.mapInArrow(run, schema)
