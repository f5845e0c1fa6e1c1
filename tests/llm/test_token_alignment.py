"""Aligned tokens against a plain version that compares all byte ranges."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from parley.llm import token_alignment as T
from parley.llm.registry import QUERIES

SCHEMA = "doc_id long, text string, row int, pairs string, n_a string, known int, b int"
ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "  two  spaces \n\n and\ttabs "), (6, "中文 and 😀 é é"), (7, "under▁score"), (8, "<|endoftext|> and <s> </s> <unk> <0x41>"), (9, "\u0000\u0001 ﻿"), (10, "ﬁ ½ 　 \xa0x"),
    (11, "antidisestablishmentarianism don't we'll"), (11, "antidisestablishmentarianism don't we'll"), (11, "other text"), (None, "no id"), (12, "x" * 3_000), (13, "it's " * 900 + "an end  with\n\nbreaks " * 200), (14, "▁"), (15, "a\r\nb"),
]


def merges():
    a = Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a


def test_ranks_give_the_ids_of_the_merges():
    """Over every code point, beside letters, digits, spaces and marks, and over random texts."""
    a, merged = T.sides()[0], merges()
    rng = np.random.default_rng(13)
    tokens = [bytes(a.data[a.offsets[i] : a.offsets[i + 1]]) for i in range(len(a.lengths))]
    texts = [f"x{chr(c)}y {chr(c)} 1{chr(c)}2  {chr(c)} .{chr(c)}." for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += [b"".join(tokens[k] for k in rng.integers(0, len(tokens), n)).decode(errors="ignore") for n in rng.integers(1, 9, 20_000)]
    texts += ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéüß'st ABC"), n)) for n in rng.integers(1, 60, 20_000)]
    for first in range(0, len(texts), 50_000):
        part = texts[first : first + 50_000]
        assert [e.ids for e in merged.encode_batch([f" {t}" for t in part], add_special_tokens=False)] == a.encode(part)


def plain(rows):
    a = merges()
    b = sentencepiece.SentencePieceProcessor(model_file=f"{T.TOKENIZERS}/{T.B_FILE}")
    printable = [c for c in range(256) if 33 <= c < 127 or 161 <= c < 173 or 174 <= c]
    letter = {chr(c): c for c in printable}
    letter |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in printable)}
    out, count = [], Counter()
    for i, text in rows:
        ids_a = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        in_a = [bytes(letter[c] for c in a.id_to_token(t)) for t in ids_a]
        in_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if not text or {b"".join(in_a), b"".join(in_b)} != {f" {text}".encode()}:
            out.append((i, [], [], [], []))
            continue
        end_a, end_b = np.cumsum([len(t) for t in in_a]).tolist(), np.cumsum([len(t) for t in in_b]).tolist()
        links, q = [], 0
        for p, end in enumerate(end_a):
            begin = end_a[p - 1] if p else 0
            while end_b[q] <= begin:
                q += 1
            r = q
            while r < len(end_b) and (end_b[r - 1] if r else 0) < end:
                links.append((ids_a[p], ids_b[r]))
                r += 1
        groups, x, y = [], 0, 0
        for end in sorted(set(end_a) & set(end_b)):
            u, v = end_a.index(end) + 1, end_b.index(end) + 1
            groups.append(",".join(map(str, ids_a[x:u])) + "|" + ",".join(map(str, ids_b[y:v])))
            x, y = u, v
        count.update(links)
        out.append((i, ids_a, ids_b, groups, links))
    most = {}
    for (_, y), c in count.items():
        most[y] = max(c, most.get(y, 0))
    return [
        (i, len(x), len(y), len(g), len(k), sum(count[p] == most[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, x, y, g, k in out
    ]


@pytest.mark.parametrize(("hot", "section"), [(T.HOT, T.SECTION), (50, 40), (1, 1)])
def test_odd_texts(spark, monkeypatch, hot, section):
    monkeypatch.setattr(T.sections, "__defaults__", (section,))
    docs = spark.createDataFrame([(i, t, 1, "x", "y", 2, 3) for i, t in ODD], SCHEMA)
    got = sorted(map(tuple, T.align(docs, hot=hot).collect()), key=str)
    assert got == sorted(plain(ODD), key=str)
    assert sum(r[1] > 0 for r in got) >= 12 and sum(r[1] == 0 for r in got) >= 4


def test_empty_table(spark):
    assert T.align(spark.createDataFrame([], "key string, body string"), "key", "body").count() == 0
    assert T.align(spark.createDataFrame([("k", None)], "key string, body string"), "key", "body").first()[1:] == (0, 0, 0, 0, 0, 0, "")


def test_sections_give_the_tokens_of_the_whole_text():
    a, b = T.sides()
    assert not [i for i in range(len(b.lengths)) if b" " in bytes(b.data[b.offsets[i] : b.offsets[i + 1]]).lstrip(b" ")]
    for text in [t for _, t in ODD if t] + ["a b  c d", "no-cuts" * 50]:
        for most in (1, 5, 30):
            parts = T.sections(text, most)
            assert " ".join(parts) == text
            for side in (a, b):
                assert sum(side.encode(parts), []) == side.encode([text])[0], (text, most)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = QUERIES["op13_token_alignment"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))
