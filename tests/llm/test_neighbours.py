"""Recall of the neighbour search where a tenth of a block is verified, and odd tables."""

import numpy as np

from parley.llm import neighbours


def test_recall_on_a_block_of_20_000(spark):
    x = np.random.default_rng(4).standard_normal((20_000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, every=250).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = (r.rank, r.score)
    assert len(got) == 80 and all(len(g) == 20 for g in got.values())
    found = 0
    for q, g in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        best = np.argsort(-score)[:20]
        found += len(set(best.tolist()) & set(g))
        ranked = sorted(g, key=lambda i: g[i][0])
        assert np.allclose([g[i][1] for i in ranked], score[ranked]) and all(np.diff([g[i][1] for i in ranked]) <= 0)
    assert found >= 0.9 * 20 * len(got)


def test_the_usual_length_counts(spark):
    rows = [(0, [1.0, 0.0, 0.0], 1), (20, [1.0, 2.0], 1), (21, [3.0, 0.5], 1), (22, [-1.0, 1.0], 1), (22, [-1.0, 1.0], 1), (23, None, 1), (24, [0.0, 0.0], 1), (25, [float("nan"), 1.0], 1), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int")
    assert [tuple(r) for r in neighbours.nearest(df).orderBy("rank").collect()] == [(20, 1, 21, 4.0), (20, 2, 22, 1.0)]
    assert neighbours.nearest(df.limit(0)).count() == 0
