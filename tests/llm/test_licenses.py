"""License notices by name, whole texts, several in one document, and alignment against brute force."""

import random

import pytest

from parley.llm import licenses

KNOWN = [(n, licenses.words_of(t), [licenses.words_of(p) for p in phrases]) for n, t, phrases in licenses.TEMPLATES]


def found(text):
    return [name for name, *_ in licenses.stretches(licenses.words_of(text), KNOWN)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Released under the BSD License.", ["BSD"]), ("Released under the GPL License.", ["GPL"]), ("Licensed under the Mozilla Public License, Version 2.0.", ["MPL-2.0"]), ("Licensed under CC BY-SA 4.0", ["CC-BY-SA-4.0"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]), ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("Licensed under the Apache License, Version 2.0. Text. Released under the MIT License. And again: licensed under the MIT License", ["Apache-2.0", "MIT", "MIT"]), ("Licensed under the MIT-like License", []),
        ("Licensed under the MIT License. Licensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]), ("SPDX-License-Identifier: MIT", ["MIT"]), ("// SPDX-License-Identifier: BSD-3-Clause\nint x;", ["BSD-3-Clause"]),
        ("MIT License\n\nCopyright (c) 2020 A. Person", ["MIT"]), ("it is not licensed under the MIT License", []), ("This isn't licensed under the MIT License. Released under the ISC License.", ["ISC"]), ("the license of MIT was released under", []),
    ],
)
def test_names(text, want):
    assert found(text) == want


@pytest.mark.parametrize("k", range(len(licenses.TEXTS)))
def test_each_text_with_a_fifth_of_its_other_words_changed(k):
    name, text, phrases = licenses.TEXTS[k]
    assert found(f"before it {text} after it") == [name]
    fixed = {w for p in phrases for w in licenses.words_of(p)}
    words, rng = licenses.words_of(text), random.Random(k)
    at = [i for i, w in enumerate(words) if w not in fixed]
    for i in rng.sample(at, min(len(at), len(words) // 10)):
        words[i] = f"changed{i}"
    assert found(" ".join(words)) == [name]


def longest(a, b):
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            size[i + 1][j + 1] = max(size[i][j + 1], size[i + 1][j], size[i][j] + (x == y))
    return size[-1][-1]


@pytest.mark.parametrize("seed", range(40))
def test_alignment(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 14))] for _ in range(2))
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:])) and len(pairs) <= longest(a, b)
    if len(set(a)) == len(a) and len(set(b)) == len(b):  # of words that occur once the alignment is the longest
        assert len(pairs) == longest(a, b)


def test_planted_notices_and_repeated_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    planted = ("Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.")
    want = {r.doc_id for r in docs.collect() if r.text and any(p in r.text for p in planted)}
    got = [r.doc_id for r in licenses.scan(docs.union(docs)).collect()]
    assert want and set(got) >= want and len(got) == 2 * len([r for r in licenses.scan(docs).collect()])
    assert set(got) - want == set() or len(set(got) - want) <= len(want) // 10
    clash = docs.selectExpr("doc_id", "text", "1 as license", "2 as coverage")
    assert licenses.scan(clash).count() == len(got) // 2 and licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs, []).count() == 0


def test_shuffled_words_end_soon_and_hide_nothing():
    """13,000 words of a license in random order, before, between and behind the license itself."""
    import time

    text = next(t for n, t, _ in licenses.TEXTS if n == "MIT")
    words, rng = licenses.words_of(text) * 160, random.Random(5)
    rng.shuffle(words)
    began = time.time()
    assert found(" ".join(words)) == [] and time.time() - began < 5
    part = words[:2_000]
    assert found(" ".join(part) + f" {text} " + " ".join(part[::-1])) == ["MIT"] and len(words) > 10_000


@pytest.mark.parametrize("seed", range(20))
def test_longest_common_subsequence_by_bits(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcdef") for _ in range(rng.randint(1, 30))] for _ in range(2))
    places = {}
    for j, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << j
    assert len(a) - bin(licenses._common(b, places) & ((1 << len(a)) - 1)).count("1") == longest(a, b)
