"""License scans by patience alignment of texts with license notices.

Texts and templates are sequences of lower-cased alphanumeric words. A stretch of a text that holds
enough of a template's words, counted over the whole text at once, is aligned with the template:
words that occur once in both are anchors, the longest increasing run of anchors is kept, and the
gaps between anchors are aligned in the same way, gaps without anchors by their equal ends.
Coverage is the share of the template's words that are matched; a stretch counts from
``coverage`` on, if the words that tell the license (its name, NC, SA, ND, its version) are all matched
and no word of another variant stands between them. Where templates overlap in a text, the one with most matched words stays.

Texts stay in place: one pass with Arrow batches, no shuffle. The templates are a parameter of
bounded size.

Defined cases: null and empty texts hold no license; templates without words are left out; a
notice that stands in a text several times is reported as often; repeated rows each report
theirs; an empty table gives an empty table; rows with a null id keep it.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.llm.storage import bounded_batches
from docwarden.llm.tokens import NOT_ALPHANUMERIC, Words, pieces, words

#: Public license notices: fixed values.
NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
     "file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
     "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
     "language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met: 1. Redistributions of source code must "
     "retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
     "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
     "and the following disclaimer in the documentation and/or other materials provided with the "
     "distribution."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
     "International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
     "International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or "
     "neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the "
     "terms of the GNU General Public License as published by the Free Software Foundation, either "
     "version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
     "without fee is hereby granted, provided that the above copyright notice and this permission notice "
     "appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
     "and associated documentation files (the \"Software\"), to deal in the Software without "
     "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
     "Software is furnished to do so, subject to the following conditions: The above copyright notice "
     "and this permission notice shall be included in all copies or substantial portions of the "
     "Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
     "copy of the MPL was not distributed with this file, You can obtain one at "
     "http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met: 1. Redistributions of source code must "
     "retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
     "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
     "and the following disclaimer in the documentation and/or other materials provided with the "
     "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be "
     "used to endorse or promote products derived from this software without specific prior written "
     "permission."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 "
     "International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons "
     "Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons "
     "Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, Version 2.0."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the "
     "terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
     "version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the "
     "terms of the GNU General Public License as published by the Free Software Foundation; either "
     "version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the "
     "terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
     "version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the "
     "terms of the GNU Lesser General Public License as published by the Free Software Foundation, either "
     "version 3 of the License, or (at your option) any later version."),
    # heads of whole license texts
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND "
     "CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software "
     "Foundation, Inc."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software "
     "Foundation, Inc."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free "
     "Software Foundation, Inc."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free "
     "Software Foundation, Inc."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software "
     "Foundation, Inc."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual "
     "or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("BSD-4-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met: 1. Redistributions of source code must "
     "retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
     "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
     "and the following disclaimer in the documentation and/or other materials provided with the "
     "distribution. 3. All advertising materials mentioning features or use of this software must display "
     "the following acknowledgement: This product includes software developed by the organization. 4. "
     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission."),
    ("BSD-4-Clause", "Licensed under the BSD 4-Clause License."),
)
#: Public license identifiers, as they stand in SPDX tags: fixed values.
SPDX_IDS = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause "
    "BSD-3-Clause BSD-4-Clause BSL-1.0 CC0-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later "
    "GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 "
    "LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL Unlicense WTFPL Zlib").split()
#: Elements of Creative Commons licenses, with their names in notices.
CC_ELEMENTS = {"NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
CC_KINDS = ((), ("NC",), ("SA",), ("ND",), ("NC", "SA"), ("NC", "ND"))
#: Versions of Creative Commons licenses and what follows the version in a notice.
CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def _by_rule() -> tuple[tuple[str, str], ...]:
    """SPDX tags, and Creative Commons notices of every kind and version that are not listed above."""
    tags = list(SPDX_IDS)
    out = []
    for version, scope in CC_VERSIONS.items():
        for kind in CC_KINDS:
            name = "-".join(["CC-BY", *kind, version])
            tags.append(name)
            if version != "4.0":
                long = "-".join(["Attribution", *(CC_ELEMENTS[e] for e in kind)])
                out.append((name, f"Licensed under CC {'-'.join(['BY', *kind])} {version}."))
                out.append((name, f"This work is licensed under a Creative Commons {long} {version} {scope} License."))
    return (*out, *((name, f"SPDX-License-Identifier: {name}") for name in tags))


ALL_NOTICES = NOTICES + _by_rule()
#: Words that make a license another one where a notice has them and a template has not.
VARIANTS = frozenset("affero lesser library nc nd sa noncommercial noderivatives noderivs sharealike".split())
#: Words of a template that must be matched, whatever its coverage.
TELLING = VARIANTS | frozenset("advertising apache bsd by cc commons eclipse endorse gnu isc later mit mozilla promote".split())
#: Templates that name a version by a digit have one of these words.
VERSIONED = frozenset("bsd cc creative v version".split())
#: Words of a notice that only names its license.
SHORT = 12
#: Words of a text looked at for each word of a template.
STRETCH = 1.5


def _increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing run, by patience piles."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        if k == len(tops):
            tops.append(p)
            ends.append(i)
        else:
            tops[k], ends[k] = p, i
        back.append(ends[k - 1] if k else -1)
    run, i = [], ends[-1] if ends else -1
    while i >= 0:
        run.append(i)
        i = back[i]
    return run[::-1]


def _once(x: list, lo: int, hi: int) -> dict:
    places: dict = {}
    for i in range(lo, hi):
        places[x[i]] = -1 if x[i] in places else i
    return {w: i for w, i in places.items() if i >= 0}


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Matched places (text, template), increasing in both."""
    matched: list[tuple[int, int]] = []
    open_gaps = [(0, len(text), 0, len(template))]
    while open_gaps:
        a, b, c, d = open_gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a >= b or c >= d:
            continue
        own, theirs = _once(text, a, b), _once(template, c, d)
        anchors = sorted((i, own[w]) for w, i in theirs.items() if w in own)
        anchors = [anchors[k] for k in _increasing([t for _, t in anchors])]
        if not anchors:
            continue
        last_t, last_m = a, c
        for m, t in anchors:
            matched.append((t, m))
            open_gaps.append((last_t, t, last_m, m))
            last_t, last_m = t + 1, m + 1
        open_gaps.append((last_t, b, last_m, d))
    return sorted(matched)


def _telling(template: str) -> set[str]:
    """Words of a template that tell its license from others."""
    own = set(re.findall("[a-z0-9]+", template.lower()))
    if "spdx" in own:
        return own
    versions = {w for w in own if w in "123456789"} if own & VERSIONED else set()
    # list numbers of a text whose head names the version once
    return own & TELLING | (versions if len(versions) == 1 or "definitions" not in own else {"2"})


def _hashes(some) -> set[int]:
    return set(words(pa.array(sorted(some), pa.string()), NOT_ALPHANUMERIC).hashes.tolist())


class Templates:
    """Word hashes of the notices and which notices hold a word."""

    def __init__(self, notices, coverage: float):
        found = words(pa.array([t for _, t in notices], pa.string()), NOT_ALPHANUMERIC)
        self.coverage = coverage
        self.names, self.words = [], []
        for k, (name, _) in enumerate(notices):
            if len(found.of(k)):
                self.names.append(name)
                self.words.append(found.of(k).tolist())
        self.telling = [_hashes(_telling(t)) for k, (_, t) in enumerate(notices) if len(found.of(k))]
        self.variants = _hashes(VARIANTS)
        every = [np.unique(np.array(w, np.uint64)) for w in self.words]
        self.vocab = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.told = [np.isin(self.vocab, np.array(sorted(t), np.uint64)) for t in self.telling]
        self.holds = np.stack([np.isin(self.vocab, w) for w in every]) if every else np.zeros((0, 0), bool)

    def found_in(self, found: Words) -> list[tuple[int, int, int, int, int]]:
        """(row, template, first word, last word, matched words) of every notice, none overlapping."""
        if not len(self.vocab) or not len(found.hashes):
            return []
        at = np.minimum(np.searchsorted(self.vocab, found.hashes), len(self.vocab) - 1)
        hit = np.flatnonzero(self.vocab[at] == found.hashes)
        row = np.searchsorted(found.row_ptr, hit, "right") - 1
        seen = np.zeros(len(self.vocab), bool)
        seen[at[hit]] = True
        out = []
        for k, template in enumerate(self.words):
            if not seen[self.told[k]].all():
                continue
            own = self.holds[k][at[hit]]
            place, of = hit[own], row[own]
            need = max(1, int(np.ceil(self.coverage * len(template) - 1e-9)))
            if len(place) < need:
                continue
            wide = int(np.ceil(STRETCH * len(template))) + 1
            last = place[need - 1 :]
            start = place[: len(last)]
            ok = (last - start < wide) & (of[need - 1 :] == of[: len(last)])
            done = -1
            for p, r in zip(start[ok].tolist(), of[: len(last)][ok].tolist(), strict=True):
                if p <= done:
                    continue
                stop = min(p + wide, int(found.row_ptr[r + 1]))
                pairs = align(found.hashes[p:stop].tolist(), template)
                if len(pairs) < need:
                    continue
                # a stray word may have begun the stretch too early: look around what was found
                lo = max(done + 1, int(found.row_ptr[r]), p + pairs[0][0] - len(template))
                hi = min(int(found.row_ptr[r + 1]), p + pairs[-1][0] + len(template) + 1)
                around = align(found.hashes[lo:hi].tolist(), template)
                if len(around) > len(pairs):
                    p, pairs = lo, around
                if not self._tells(k, found.hashes[p:].__getitem__, pairs):
                    continue
                first, done = p + pairs[0][0], p + pairs[-1][0]
                out.append((r, k, first, done, len(pairs)))
        return self._apart(out, found)

    def _tells(self, k: int, word, pairs) -> bool:
        """Whether all telling words of a template are matched and no word of a variant stands between."""
        template = self.words[k]
        matched = {j for _, j in pairs}
        if not self.telling[k] <= {template[j] for j in matched}:
            return False
        # a tag stands in one piece, or the second license of an expression would count
        if set(template) == self.telling[k] and pairs[-1][0] - pairs[0][0] >= len(template):
            return False
        # in a short notice each of them counts, as both numbers of a version 1.1
        if len(template) <= SHORT and any(w in self.telling[k] and j not in matched for j, w in enumerate(template)):
            return False
        span = {int(word(i)) for i in range(pairs[0][0], pairs[-1][0])}
        return not (span & self.variants) - set(template)

    def _apart(self, spans, found: Words):
        kept: dict[int, list] = {}
        for s in sorted(spans, key=lambda s: (s[0], -s[4], -s[4] / len(self.words[s[1]]), s[2], s[1])):
            others = kept.setdefault(s[0], [])
            if all(s[3] < o[2] or s[2] > o[3] for o in others):
                others.append(s)
        flat = [s for others in kept.values() for s in others]
        return [(r, k, a - int(found.row_ptr[r]), b - int(found.row_ptr[r]), m) for r, k, a, b, m in sorted(flat)]


def _scan(notices, coverage: float):
    names = ["doc_id", "license", "coverage", "first_word", "last_word", "matched"]
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches):
        templates = Templates(notices, coverage)
        for batch in batches:
            for piece in pieces(batch, 1):
                spans = templates.found_in(words(piece.column(1), NOT_ALPHANUMERIC))
                if spans:
                    ids = piece.column(0).to_pylist()
                    rows = [(ids[r], templates.names[k], m / len(templates.words[k]), a, b, m) for r, k, a, b, m in spans]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def license_spans(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", coverage: float = 0.8,
    notices: tuple[tuple[str, str], ...] = ALL_NOTICES,
) -> DataFrame:
    """``doc_id, license, coverage, first_word, last_word, matched`` of every license notice."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return texts.mapInArrow(
        _scan(notices, coverage),
        "doc_id long, license string, coverage double, first_word long, last_word long, matched int")
