"""License scans by patience alignment.

Words that occur once in the template and once in a stretch of text are anchors; their longest
increasing subsequence is kept, and the gaps between anchors are aligned in the same way, ending
with common runs at their edges. Coverage is the share of the template's words that are aligned.
A stretch is looked at when it holds enough of a template's words close together, and it matches if
it also holds the template's decisive phrases (name, version) word by word. Of stretches that overlap
the one with the most aligned words stays, so a license is not taken for one that its text contains.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.words import raw, slices, word_hashes

#: Names of public licenses, as notices state them. Each is decisive: its words must stand together.
NAMES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License"], "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPL-3.0"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "BSD": ["BSD License"], "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause"], "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause"], "BSL-1.0": ["Boost Software License, Version 1.0", "BSL-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"], "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"], "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"], "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"], "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"], "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL-2.0"], "GPL": ["GPL License"], "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL version 2", "GPL-2.0", "GPLv2"], "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL version 3", "GPL-3.0", "GPLv3"],
    "ISC": ["ISC License"], "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL-2.1"], "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0"], "MIT": ["MIT License"], "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "Unlicense": ["Unlicense"], "WTFPL": ["Do What The Fuck You Want To Public License", "WTFPL"], "Zlib": ["zlib License"],
}
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program."
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Texts and notices of public licenses, and the phrases that are decisive in each.
TEXTS = [
    ("0BSD", _ISC.format(""), ["for any purpose with or without fee is hereby granted the software"]),
    ("AGPL-3.0", _GNU.format("Affero General Public License", "3"), ["GNU Affero General Public License", "version 3"]),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', ["Apache License, Version 2.0"]),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}", ["Redistribution and use in source and binary forms"]),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}", ["Redistribution and use in source and binary forms", "endorse or promote products derived from this software"]),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.', ["covered by this license"]),
    ("GPL-2.0", _GNU.format("General Public License", "2"), ["GNU General Public License", "version 2 of the License"]),
    ("GPL-3.0", _GNU.format("General Public License", "3"), ["GNU General Public License", "version 3 of the License"]),
    ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies"), ["provided that the above copyright notice and this permission notice appear in all copies"]),
    ("LGPL-2.1", _GNU.format("Lesser General Public License", "2.1"), ["GNU Lesser General Public License", "version 2.1"]),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", "3"), ["GNU Lesser General Public License", "version 3"]),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.', ["to deal in the Software without restriction"]),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _WARRANTY, ["to deal in the Software without restriction"]),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["Mozilla Public License, v. 2.0"]),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ["free and unencumbered software"]),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", ["The origin of this software must not be misrepresented"]),
]
TEMPLATES = [(name, f"{lead} under {'' if said.startswith('CC') else 'the '}{said}", [said]) for lead in ("Licensed", "Released") for name, all_said in NAMES.items() for said in all_said]
#: A file's header may name a license by its identifier alone, and a text begins with its name and a copyright line.
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}", [f"SPDX-License-Identifier: {name}"]) for name in NAMES]
TEMPLATES += [(name, f"{said} Copyright", [f"{said} Copyright"]) for name, all_said in NAMES.items() for said in all_said] + TEXTS
#: A notice behind one of these words says the contrary.
NEGATIONS = {"not", "never", "isn", "aren", "wasn", "cannot", "neither"}
#: A match covers at least this much of the template, within SPREAD times its words of text.
COVERAGE, SPREAD = 0.8, 2
#: Everything in ASCII but letters and digits separates words; A-Z are lower-cased.
_PLAIN = np.array([c if chr(c).isalnum() or c > 127 else 32 for c in range(256)], np.uint8)


_SEPARATE = {c: " " for c in range(128) if not chr(c).isalnum()}


def words_of(text: str) -> list[str]:
    lower = text.translate({c: chr(c + 32) for c in range(65, 91)})
    return [w for w in lower.translate(_SEPARATE).split(" ") if w]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence with increasing second members, by patience sorting."""
    tops, at, back = [], [], []
    for i, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        if pile == len(tops):
            tops.append(y)
            at.append(i)
        else:
            tops[pile], at[pile] = y, i
        back.append(at[pile - 1] if pile else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of equal words in a and b, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if once_b[b[j]] == 1}
        anchors = _increasing([(i, place[a[i]]) for i in range(a0, a1) if once_a[a[i]] == 1 and a[i] in place])
        out += anchors
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(x0 + 1, x1, y0 + 1, y1) for (x0, y0), (x1, y1) in zip(edges, edges[1:]) if x1 > x0 + 1 and y1 > y0 + 1]
    return sorted(out)


def _holds(words: list[str], phrase: list[str]) -> bool:
    """Do the words of a phrase stand together somewhere?"""
    n = len(phrase)
    return any(words[i] == phrase[0] and words[i : i + n] == phrase for i in range(len(words) - n + 1))


def _common(words: list[str], places: dict[str, int]) -> int:
    """Bits of the places of a template, given by a bit for each place of each of its words: as many are 0 as its longest common
    subsequence with some words is long."""
    rows = -1
    for w in words:
        if held := places.get(w, 0):
            met = rows & held
            rows = (rows + met) | (rows - met)
    return rows


def matches(words: list[str], template: list[str], phrases: list[list[str]], coverage: float = COVERAGE) -> list[tuple[int, int, int]]:
    """(aligned words, first word, end word) of every stretch, from the left, that has the coverage and the phrases and does not stand behind
    a negation. A stretch begins as late as its aligned words allow.

    No alignment has more words than the longest common subsequence, which bits tell quickly; where that lacks k words, no
    place is looked at before the window has taken in k more words of the template."""
    need, reach = int(np.ceil(coverage * len(template))), SPREAD * len(template)
    places: dict[str, int] = {}
    for j, w in enumerate(template):
        places[w] = places.get(w, 0) | 1 << j
    whole = (1 << len(template)) - 1
    hits = [i for i, w in enumerate(words) if w in places]
    out, i = [], 0
    while i + need <= len(hits):
        first = hits[i]
        until = bisect_left(hits, first + reach)
        if until - i < need:
            i += 1
            continue
        lacks = need - (len(template) - bin(_common(words[first : first + reach], places) & whole).count("1"))
        if lacks > 0:
            # The window must end behind the lacking hits at least.
            end = until + lacks - 1
            if end >= len(hits):
                break
            i = max(i + 1, bisect_left(hits, hits[end] - reach + 1))
            continue
        pairs = align(template, words[first : first + reach])
        if len(pairs) >= need:
            begin, end = first + pairs[0][1], first + pairs[-1][1] + 1
            for later in hits[bisect_left(hits, begin) + 1 :]:
                if end - later < need:
                    break
                closer = align(template, words[later:end])
                if len(closer) < len(pairs):
                    break
                begin, end, pairs = later + closer[0][1], later + closer[-1][1] + 1, closer
            if all(_holds(words[begin:end], p) for p in phrases):
                if not NEGATIONS & set(words[max(0, begin - 2) : begin]):
                    out.append((len(pairs), begin, end))
                i = bisect_left(hits, end)
                continue
        i += 1
    return out


def stretches(words: list[str], templates: list[tuple[str, list[str], list[list[str]]]], coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, end word) of all matches that overlap no better one, in order. Better is
    more aligned words, then more coverage, then the earlier template."""
    found = []
    for k, (name, template, phrases) in enumerate(templates):
        found += [(-n, -n / len(template), k, begin, end, name) for n, begin, end in matches(words, template, phrases, coverage)]
    kept: list[tuple] = []
    for f in sorted(found):
        if all(f[4] <= g[3] or f[3] >= g[4] for g in kept):
            kept.append(f)
    return [(name, -share, begin, end) for _, share, _, begin, end, name in sorted(kept, key=lambda f: f[3])]


def scan(docs: DataFrame, templates: list[tuple[str, str, list[str]]] = TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, coverage, first_word, end_word) of every notice of a license in every document.

    templates: (license, text, decisive phrases). Letters A-Z are lower-cased, words are runs of letters, digits
    and characters beyond ASCII. Null and empty texts match nothing, repeated rows give rows each, other columns
    are ignored, whatever their names; without templates the result is empty. Whole texts are read: documents
    that lack a word of a template's phrases, or hold too few of its words anywhere, are passed over by a bound
    on the coverage, which drops no match.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = [(name, words_of(t), [words_of(p) for p in phrases]) for name, t, phrases in templates if words_of(t)]
    vocabulary = sorted({w for _, t, phrases in texts for w in (*t, *(x for p in phrases for x in p))})
    hashes = word_hashes(*raw(pa.array([" ".join(vocabulary)])))[0] if vocabulary else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    weight = np.array([[t.count(vocabulary[k]) for _, t, _ in texts] for k in order], np.float32).reshape(len(order), len(texts))
    asked = np.array([[any(vocabulary[k] in p for p in phrases) for _, _, phrases in texts] for k in order], np.float32).reshape(len(order), len(texts))
    given = hashes[order], weight, asked, texts

    def rows(batches):
        known, weight, asked, texts = given
        least, all_asked = np.array([coverage * len(t) for _, t, _ in texts]), asked.sum(0)
        for b in batches:
            out = []
            data, offsets = raw(b.column(1))
            for first, last in slices(offsets) if len(known) else ():
                part = offsets[first : last + 1]
                words, bounds = word_hashes(_PLAIN[data[part[0] : part[-1]]], part - part[0])
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                hit = np.flatnonzero(known[at] == words)
                held = np.zeros((last - first, len(known)), np.float32)
                held[np.searchsorted(bounds, hit, "right") - 1, at[hit]] = 1
                may = (held @ weight >= least - 1e-3) & (held @ asked >= all_asked - 1e-3)
                for i in np.flatnonzero(may.any(1)):
                    found = stretches(words_of(b.column(1)[first + int(i)].as_py()), [texts[k] for k in np.flatnonzero(may[i])], coverage)
                    out += [(first + int(i), *f) for f in found]
            at, names, share, begin, end = zip(*out) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(share, pa.float64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
                names=["doc_id", "license", "coverage", "first_word", "end_word"],
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(rows, f"doc_id {kind}, license string, coverage double, first_word long, end_word long")
