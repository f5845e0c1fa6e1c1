"""The subsequence kernel by brute force, landmarks of several families, and held-out accuracy by language."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from parley.llm import registry, toxicity

WORDS = ["idiot", "i.d.i.o.t", "idxiot", "idi", "aaaaaa", "ab", "", "achlichkeit", "achlichung", "éà中文字", "a-b-c-d", "xx..yy..zz"]


def brute(word):
    """Weights of all subsequences of three letters or digits within SPAN."""
    out = defaultdict(float)
    for i, j, k in combinations(range(len(word)), 3):
        if k - i < toxicity.SPAN and all(word[x].isalnum() for x in (i, j, k)):
            out[word[i], word[j], word[k]] += toxicity.DECAY ** (k - i + 1)
    return out


def test_kernel_by_brute_force():
    landmarks = ["idiot", "achlichkeit", "aaaa", "xyz"]
    told = [brute(w) for w in WORDS]
    marks = [brute(w) for w in landmarks]
    got = toxicity.Kernel(landmarks)(WORDS)
    for a, x in enumerate(told):
        for b, y in enumerate(marks):
            norm = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            value = sum(v * y.get(k, 0) for k, v in x.items()) / norm if norm else 0.0
            assert got[a, b] == pytest.approx(value**toxicity.SHARPEN if value >= toxicity.NEAR else 0.0, abs=1e-9)
    assert got[0, 0] == pytest.approx(1) and min(got[1, 0], got[2, 0]) > 0.04


def test_each_family_gets_landmarks():
    rare = [f"zork{x}" for x in ("el", "um", "ib", "ot", "ap", "ix")]
    words = ["trash", "moron"] + rare + ["table", "chair"]
    toxic, clean = np.array([200, 150] + [9] * 6 + [20, 22]), np.array([0, 0] + [0] * 6 + [300, 310])
    found = toxicity.choose_landmarks(words, toxic, clean, 500, 5000)
    assert {"trash", "moron"} <= set(found) and any(w in rare for w in found) and not {"table", "chair"} & set(found)


def test_held_out_recall_in_each_language(spark):
    folder = "/root/testdata/sf0.1"
    labels = registry.table(spark, folder, "labels").groupBy("doc_id").agg({"toxic": "max"}).withColumnRenamed("max(toxic)", "toxic")
    docs = registry.table(spark, folder, "documents").select("doc_id", "lang")
    rows = registry.op6_toxicity(spark, folder).where("held_out").join(labels, "doc_id").join(docs, "doc_id").collect()
    by = defaultdict(lambda: [[], []])
    for r in rows:
        by[r.lang][int(r.toxic)].append(r.predicted)
        by["all"][int(r.toxic)].append(r.predicted)
    assert len(rows) > 700 and np.mean(by["all"][1]) >= 0.9 and np.mean(by["all"][0]) <= 0.03
    for lang in ("de", "en", "es", "fr"):
        assert np.mean(by[lang][1]) >= 0.8 and np.mean(by[lang][0]) <= 0.1
