"""Cutting documents by an automaton against plain string slices."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import fill_in_middle as M
from parley.llm.registry import QUERIES

rng = np.random.default_rng(11)
LETTERS = ["a", "é", "中", "😀", "<", "P", ">", "S", "\n", " ", "́"]
MIXED = ["".join(rng.choice(LETTERS, n)) for n in (1, 2, 3, 7, 50, 511, 512, 513, 2_000, 30_000)]
TEXTS = [None, "", "a", "😀", "<P>", "x<S>y", "tail <M>", "< P>", "<P", "<<P>", "P>", "中" * 5_000, "word " * 30_000, *MIXED, MIXED[-1].replace("<", "(")]
SCHEMA = "doc_id long, text string, n int, k string, digest int, h1 string, output string, own long"


def plain(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return i, n, "spm", lo, hi - lo, f"<S>{text[hi:]}<P>{text[:lo]}<M>{text[lo:hi]}"
    return i, n, "psm", lo, hi - lo, f"<P>{text[:lo]}<S>{text[hi:]}<M>{text[lo:hi]}"


@pytest.mark.parametrize(("giant", "chunk"), [(M.GIANT, M.CHUNK), (600, 500), (0, 7), (40, 1_000)])
def test_equals_slices(spark, giant, chunk):
    """Small and giant documents, chunks that end inside code points and sentinels, null and repeated ids, equal rows, clashing columns."""
    rows = [(i if i % 7 else None, t) for i, t in enumerate(TEXTS * (4 if chunk > 100 else 1))] + [(5, "again"), (5, "again"), (5, "another")]
    docs = spark.createDataFrame([(i, t, 0, "x", 0, "y", "z", 1) for i, t in rows], SCHEMA)
    if chunk == 7:
        docs, rows = docs.where("length(text) < 3000 or text is null"), [(i, t) for i, t in rows if len(t or "") < 3_000]
    found = M.fill_in_middle(docs, giant=giant, chunk=chunk)
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=str) == sorted((plain(i, t) for i, t in rows), key=str)
    back = found.select(M.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(r.t for r in back) == sorted(t or "" for _, t in rows)


def test_empty_table_and_names(spark):
    docs = spark.createDataFrame([], "key string, body string")
    assert M.fill_in_middle(docs, "key", "body").count() == 0
    got = M.fill_in_middle(spark.createDataFrame([("k", "text of it")], "key string, body string"), "key", "body", giant=2, chunk=3).first()
    assert tuple(got) == plain("k", "text of it")


def test_stretches_compose():
    """Cutting a string anywhere and composing what the parts do gives what the whole does."""
    a = M.AUTOMATON
    data = np.frombuffer("".join(MIXED).encode(), np.uint8)[:9_000]
    whole = a.summary(data)
    for cuts in ([1], [4_000], [3, 4, 5, 6, 8_999], list(range(0, 9_000, 611))):
        parts = [a.summary(p) for p in np.split(data, cuts)]
        for s in range(6):
            state, counts = s, [0, 0]
            for after, added in parts:
                counts = [c + added[k][state] for k, c in enumerate(counts)]
                state = after[state]
            assert state == whole[0][s] and counts == [whole[1][0][s], whole[1][1][s]]


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(*p[:5], sha(p[5]), sha(r.text)) for r in docs.collect() for p in [plain(r.doc_id, r.text)]]
    got = QUERIES["op12_fill_in_middle"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect())) == sorted(want)
