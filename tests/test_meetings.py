"""Folds and rules on meetings by hand-made cases and by plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import clusters, folds
from parley.operators import parts as M


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_assembly_carries_the_tail_over_swallowed_chunks(spark):
    rows = [(1, 0, "we begin with the plan"), (1, 1, "with the plan of the year"), (1, 2, " of the year "), (1, 3, "of the year and its end"), (1, 4, None), (1, 5, "short"), (2, 0, "of the year apart")]
    got = M.assembled(spark.createDataFrame(rows, "m int, turn int, text string"), "m", "turn", "text")
    assert rows_of(got, "m", "turn") == [(1, 0, "we begin with the plan"), (1, 1, "of the year"), (1, 3, "and its end"), (1, 5, "short"), (2, 0, "of the year apart")]


def plan(pauses, total):
    out, cursor = [], 0
    while cursor < total:
        near = [p for p in pauses if cursor + 8000 <= p <= cursor + 28000]
        end = total if total - cursor <= 28000 else min(near, key=lambda p: abs(p - cursor - 22000)) if near else cursor + 28000
        out.append((len(out), cursor, end))
        if end >= total:
            break
        cursor = max(cursor + 1, end - 1500)
    return out


def test_chunk_plan(spark):
    rng = np.random.default_rng(3)
    cases = [[5000], [28000], [28001], [100000], [7000, 20000, 24000, 40000, 90000]] + [sorted(set(rng.integers(1, 400_000, n).tolist())) for n in (3, 10, 60)]
    df = spark.createDataFrame([(k, p, c[-1]) for k, c in enumerate(cases) for p in c], "k int, at long, total long")
    want = [(k, *chunk) for k, c in enumerate(cases) for chunk in plan(c, c[-1])]
    assert rows_of(M.planned(df, "k"), "k", "idx") == want
    assert M.planned(df.limit(0), "k").count() == 0


def brute_linkage(d, most):
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        best = min((np.mean([d[i][j] for i in a for j in b]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y)
        if best[0] > most:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def test_clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 8))
    x = np.array([centres[k] + rng.normal(size=8) * 0.35 for k in rng.integers(0, 4, 40)])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = brute_linkage(1 - u @ u.T, 0.4)
    df = spark.createDataFrame([(7, i, v.tolist()) for i, v in enumerate(x)] + [(8, 0, [0.0, 0.0]), (8, 1, [1.0, 0.0]), (9, 0, None)], "m int, i int, v array<double>")
    got = clusters.speakers(df, "m", "i", "v").collect()
    groups = {}
    for r in got:
        groups.setdefault((r.m, r.speaker), set()).add(r.i)
    assert {frozenset(g) for (m, _), g in groups.items() if m == 7} == want
    first = {}
    for r in sorted((r for r in got if r.m == 7), key=lambda r: r.i):
        first.setdefault(r.speaker, len(first))
    assert all(k == v for k, v in first.items()) and sorted(r.speaker for r in got if r.m == 8) == [0, 1]
    assert max(r.speaker for r in clusters.speakers(df, "m", "i", "v", most=2).collect()) == 1


def test_segments(spark):
    rows = [(1, 0, "Hello ", 0, 10, "1"), (1, 1, "there", 10, 20, None), (1, 2, "<end>", 20, 21, "2"), (1, 3, "lost", None, 30, "2"), (1, 4, " Good day ", 30, 40, "2"), (1, 5, "ab", 40, 50, "1"), (1, 6, "", 50, 60, "3")]
    got = M.segments(spark.createDataFrame(rows, "m int, k int, text string, start_ms long, end_ms long, speaker string"), "m", ["k"])
    assert rows_of(got.select("speaker", "start_ms", "end_ms", "text"), "start_ms") == [("1", 0, 20, "Hello there"), ("2", 30, 40, "Good day")]


def test_accumulate(spark):
    rows = [(0, "a", "x", "one"), (1, "b", "x", "two"), (2, "c", "y", "three"), (3, "a", "y", "ONE"), (4, "d", "y", "four"), (5, "e", "x", " "), (6, "f", "z", "five"), (7, "c", "y", "3")]
    got = M.accumulated(spark.createDataFrame([(1, *r) for r in rows], "m int, turn int, chunk string, speaker string, text string"), "m", "turn")
    assert rows_of(got, "part") == [(1, 0, "y", ["a", "b"], "ONE two"), (1, 1, "y", ["c", "d"], "3 four"), (1, 2, "z", ["f"], "five")]


def test_throttle_and_collapse(spark):
    states = [(0, "a", 1.0, "x"), (1, "a", 1.5, "xy"), (2, "a", 2.5, "xyz"), (3, "a", 2.6, "x" * 40), (4, "a", 9.0, "x" * 40), (5, "b", 9.1, "x")]
    got = M.throttled(spark.createDataFrame([(1, *r) for r in states], "m int, turn long, speaker string, at double, text string"), "m")
    assert [r.turn for r in got.orderBy("turn").collect()] == [0, 2, 3, 5]
    shots = [
        (0, 1, "a", 0, 5, "ab", "x", ["p"]), (1, 1, "b", 0, 4, "abc ", "", ["p", "q"]), (2, 7, "b", 0, 9, "ab", None, [" q ", "r", ""]), (3, 7, "b", 0, 9, "zz", "t", None), (4, 8, "c", 0, 9, "zz", "t", None), (5, 8, "c", 1, 9, "", None, None),
        (6, None, None, 1, None, "a", None, None), (7, 0, "", 1, 3, "ab", None, None),
    ]
    schema = "m int, k int, speaker_id int, speaker string, start long, stop long, text string, translation string, ids array<string>"
    got = M.collapsed(spark.createDataFrame([(1, *r) for r in shots], schema), "m", ["k"])
    assert rows_of(got, "part") == [
        (1, 0, 7, "b", 0, 9, "abc ", "x", ["p", "q", "r"]), (1, 1, 7, "b", 0, 9, "zz", "t", []), (1, 2, 8, "c", 0, 9, "zz", "t", []), (1, 3, 8, "c", 1, 9, "", "", []), (1, 4, 0, None, 1, 3, "ab", "", []),
    ]


def cut(spark, rule, text):
    return spark.createDataFrame([(text,)], "t string").select(rule(F.col("t")).alias("p")).first().p


def test_packs_and_pieces(spark):
    packs, pieces = (lambda t: cut(spark, M.packs, t)), (lambda t: cut(spark, M.pieces, t))
    assert packs("a  b c") == ["a  b c"] and packs(None) == [""]
    words = [f"w{i}" for i in range(200)]
    text = " ".join(words[:30]) + ". " + " ".join(words[30:65]) + ", " + " ".join(words[65:])
    told = packs(text)
    assert " ".join(told) == text and [len(p.split()) for p in told] == [30, 35, 40, 40, 55]
    assert [len(p.split()) for p in packs(" ".join(words[:60]))] == [60] and [len(p.split()) for p in packs(" ".join(words[:61]))] == [40, 21]
    assert [len(p.split()) for p in packs(", ".join(words))] == [40] * 5 and [len(p.split()) for p in packs("a. " + " ".join(words[:40]) + ". b")] == [1, 40, 1]
    lines = [f"{i:04d} " + "x" * 95 for i in range(400)]
    told = pieces("\n".join(lines))
    assert told[0].split("\n") == lines[:149] and told[1].split("\n")[:9] == lines[140:149] and told[-1].endswith(lines[-1])
    assert pieces("") == [""] and pieces(None) == [""]
    # A last line of the lap's length or more is not repeated but counts; when the text ends at a cut, the lap comes once more.
    long = ["y" * 14_000, "z" * 1_500, "a", "b" * 13_490, "c"]
    assert pieces("\n".join(long)) == ["\n".join(long[:2]), "\n".join(long[2:])]
    assert pieces("y" * 15_000) == ["y" * 15_000] and pieces("y" * 14_990 + "\n" + "z" * 20) == ["y" * 14_990 + "\n" + "z" * 20, "z" * 20]


@pytest.mark.parametrize(
    ("rule", "cases"),
    [
        (lambda c: T.sentence_case(c), {"XIN Chào CÁC Bạn. tôi LÀ AI! ĐÂY": "XIN chào CÁC bạn. Tôi LÀ AI! ĐÂY", "hello World": "Hello world", "": ""}),
        (lambda c: T.upload_name(c), {"a/b.mp3": "a_b.mp3", "..": "upload.bin", None: "upload.bin", "x" * 300 + ".wav": "x" * 196 + ".wav", "café": "café"}),
        (lambda c: T.attachment_name(c), {"/tmp/a b.txt": "a b.txt", "a\x07\nb": "ab", None: "untitled", " ": "untitled"}),
        (lambda c: T.title_name(c, F.lit("m")), {'a / b:  c"': "a - b- c-", None: "m", " ": "m"}),
        (lambda c: T.suffix(c), {"a/b.MP3": ".mp3", ".bashrc": "", "x": ""}),
        (lambda c: T.clock(c.cast("double")), {"61.9": "1:01", "-1": "0:00", "NaN": "0:00", None: "0:00", "6001": "100:01"}),
        (lambda c: T.wordless(c).cast("string"), {"?! ,": "true", "é!": "false", "_": "false"}),
        (lambda c: T.minutes_title(c), {"x\n# **A** ": "**A**", "**Bold** rest": "Bold", "- item\nabcd": "abcd", "## 🎉 Party": "Party", "Tiêu đề: Họp": "Họp"}),
    ],
)
def test_rules(spark, rule, cases):
    df = spark.createDataFrame(list(enumerate(cases)), "i int, x string")
    assert [r.y for r in df.select("i", rule(F.col("x")).alias("y")).orderBy("i").collect()] == list(cases.values())


def test_a_fold_spans_batches_and_keys(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).selectExpr("id % 3 as k", "id", "id as ts", "cast(id as double) as value")
        got = folds.fold(df.withColumnRenamed("id", "event_id"), ["k"], ["event_id"], lambda: folds.Average(0.5), "k long, event_id long, average double").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i in range(100):
        want[i] = float(i) if i < 3 else 0.5 * want[i - 3] + 0.5 * i
    assert {r.event_id: r.average for r in got} == pytest.approx(want)


def test_switch(spark):
    rows = [(0, "a", 0.6, 0.0), (1, "b", 0.6, 0.0), (9, "b", 0.6, 0.0), (10, "b", 0.6, 0.0), (11, "a", 0.81, 0.16), (12, "c", 0.76, 0.09), (13, "a", 0.7, 0.5), (14, "c", 0.1, 0.0), (15, "a", 0.7, 0.5)]
    df = spark.createDataFrame([(1, i, float(at), s, x, g) for i, (at, s, x, g) in enumerate(rows)], "k int, event_id long, at double, speaker string, similarity double, lead double")
    assert [r.speaker for r in M.switched(df, "k").orderBy("event_id").collect()] == ["a", "a", "a", "b", "a", "c", "c", "c", "c"]


def test_voices(spark):
    rows = [[0.0, 0.0], [0.5, 0.0], [3.0, 0.0], [0.2, 0.1], [2.5, 0.1], [9.0, 9.0]]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(rows)], "k int, event_id long, features array<double>")
    assert rows_of(M.voices(df, "k", ["event_id"]).select("speaker", "is_new", "event_id"), "event_id") == [(0, True, 0), (0, False, 1), (1, True, 2), (0, False, 3), (1, False, 4), (2, True, 5)]


def test_parsed(spark):
    rows = [(1, '[{"text":"a","speaker":"X","speakerId":2},{"text":" "},{"text":"b","speaker_id":-4}]'), (2, "plain\ntext"), (3, "[no json"), (4, ""), (5, None)]
    got = M.parsed(spark.createDataFrame(rows, "k int, t string"), "k", "t")
    assert rows_of(got, "k", "part") == [(1, 0, "X", 2, "a"), (1, 2, "Speaker 1", 0, "b"), (2, 0, "Speaker 1", 0, "plain\ntext"), (3, 0, "Speaker 1", 0, "[no json")]


def test_sentence_groups(spark):
    groups = lambda t: cut(spark, M.sentence_groups, t)
    assert groups(None) == groups("  ") == [] and groups("no end") == ["no end"]
    assert groups("One. Two! rest") == ["One.", "Two! rest"] and groups("x" * 90 + ". rest") == ["x" * 90 + ".", "rest"]
    assert groups("One. " + "y" * 60) == ["One.", "y" * 60] and groups(" 一。 二 ") == ["一。 二"]
    told = groups(", ".join(["word" * 5] * 12))
    assert [len(t) for t in told] == [86, 86, 86] and ", ".join(told) == ", ".join(["word" * 5] * 12)
    assert groups("," * 130) == ["," * 130]


def test_endpoints(spark):
    ticks = [(t, 0.001 if 2400 <= t < 3000 or 4000 <= t < 5200 else 0.5) for t in range(0, 9600, 80)]
    df = spark.createDataFrame([(1, t, v) for t, v in ticks], "k int, at long, level double")
    assert rows_of(M.endpoints(df, "k"), "idx") == [(1, 0, 0, 2800), (1, 1, 2800, 4800), (1, 2, 4800, 8800), (1, 3, 8800, 9520)]


LARGE = 2**53 + 1


@pytest.mark.parametrize("batch", ["1", "3", "10000"])
def test_keys_stay_as_they_are(spark, batch):
    """Large and null keys, alone and beside each other in a batch; null is one meeting."""
    texts = ["we begin with the plan", "with the plan of the year", "of the year and its end"]
    rows = [(k, i, t) for k in (None, LARGE, LARGE + 1, -LARGE) for i, t in enumerate(texts)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "m long, turn int, text string")
        told = [(r.m, r.turn, r.text) for r in M.assembled(df, "m", "turn", "text").collect()]
        packs = [(r.m, r.text) for r in M.packed(df, "m", "text").collect()]
        average = M.averaged(df.selectExpr("m", "cast(turn as long) as event_id", "if(turn = 1, null, cast(turn as double)) as value"), "m", ["event_id"], 0.5).collect()
        floats = M.averaged(spark.sql("select * from values (double('nan'), 1L, 1D), (double('nan'), 2L, 3D), (null, 3L, 5D) t(m, event_id, value)"), "m", ["event_id"], 0.5).orderBy("event_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(k, i, t) for k in (None, LARGE, LARGE + 1, -LARGE) for i, t in enumerate(["we begin with the plan", "of the year", "and its end"])]
    assert sorted(told, key=str) == sorted(want, key=str)
    assert sorted(packs, key=str) == sorted([(k, t) for k, _, t in rows], key=str)
    assert sorted({(r.m, r.event_id, r.average) for r in average}, key=str) == sorted({(k, i, v) for k in (None, LARGE, LARGE + 1, -LARGE) for i, v in enumerate([0.0, 0.0, 1.0])}, key=str)
    assert [r.average for r in floats] == [1.0, 2.0, 5.0]


def test_keys_of_other_kinds(spark):
    df = spark.sql("select * from values (date'2026-01-01', 'a', 1L, 1D), (date'2026-01-01', 'b', 2L, 2D), (null, 'a', 3L, 3D) t(d, s, event_id, value)").withColumn("k", F.to_timestamp("d"))
    for key, kind in (("d", "date"), ("k", "timestamp"), ("s", "string")):
        got = folds.fold(df, [key], ["event_id"], folds.Average, f"{key} {kind}, event_id long, average double")
        assert sorted(map(str, got.select(key).collect())) == sorted(map(str, df.select(key).collect()))
    got = folds.fold(df, ["d", "s"], ["event_id"], folds.Average, "d date, s string, event_id long, average double")
    assert got.count() == 3


def test_token_stream(spark):
    token = lambda text, speaker=0, final=True, translation=False: (text, speaker, final, translation)
    events = [
        (1, [token("Hel", final=False)]), (2, [token("Hello "), token("there", final=False), token("<end>")]), (3, []), (4, None), (5, [token("Xin ", translation=True), token("chào", final=False, translation=True)]),
        (6, [token("all. ", 0), token("Good ", 1), token("day", 1, False)]), (7, [token("day", 1)]), (8, [token(" ", 2)]),
    ]
    df = spark.createDataFrame([(1, i, t) for i, t in events], "m int, event long, tokens array<struct<text:string,speaker:int,is_final:boolean,is_translation:boolean>>")
    got = sorted((r.event, {"flush": 0, "show": 1, "end": 2}[r.kind], r.chunk, r.speaker, r.text, r.translation) for r in M.shown(df, "m").collect())
    assert got == [
        (1, 1, 0, 0, "Hel", None), (2, 1, 0, 0, "Hello there", None), (5, 1, 0, 0, "Hello", "Xin chào"), (6, 0, 0, 0, "Hello", "Xin"), (6, 1, 1, 1, "all. Good day", None), (7, 1, 1, 1, "all. Good day", None),
        (8, 0, 1, 1, "all. Good day", None),
    ]


def test_edits(spark):
    edits = [("append", "lost", "a"), ("add", "one", "a"), ("replace", "ONE", "a"), ("append", "two", "b"), ("replace", "TWO", "c"), ("revert", None, None), ("append", "3", None), ("add", "x", None), ("revert", None, None), ("add", "y", "z"), ("append", None, "z")]
    df = spark.createDataFrame([(7, i, *e) for i, e in enumerate(edits)], "m int, i int, edit string, text string, chunk string")
    assert rows_of(M.edited(df, "m", "i"), "part") == [(7, 0, "ONE 3", ["a", "b"]), (7, 1, "y ", ["z"])]
    assert M.edited(df.where("i in (1, 5)"), "m", "i").count() == 0


def test_hold_and_vector_average(spark):
    rows = [(0.0, "a", 0.5, 0.9), (1.0, "a", 0.7, 0.7), (5.0, "b", 0.66, 0.63), (9.9, "b", 0.66, 0.63), (15.0, "b", 0.66, 0.63), (16.0, "b", 0.67, 0.61), (16.5, "b", 0.9, 0.1)]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "m int, event_id long, at double, speaker string, similarity double, own double")
    assert rows_of(M.held(df, "m").select("event_id", "speaker", "held"), "event_id") == [(0, None, False), (1, "a", False), (2, "a", True), (3, "a", True), (4, None, False), (5, None, False), (6, "b", False)]
    rows = [(None, None), ([1.0, 0.0], [None, 2.0]), (None, [4.0, None]), ([3.0, 2.0], [8.0, 4.0])]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "m int, event_id long, vector array<double>, stats array<double>")
    got = M.averaged_vectors(df, "m", ["event_id"], 0.5, 0.25).orderBy("event_id").collect()
    assert [(r.vector, r.stats) for r in got] == [(None, None), ([1.0, 0.0], [None, 2.0]), ([1.0, 0.0], [4.0, 2.0]), ([2.0, 1.0], [5.0, 2.5])]


def test_summaries_by_levels(spark):
    """Any number of levels, against repeated grouping of lists."""
    from parley.operators import transcript as P

    sizes = [1, 2, 3, 4, 5, 16, 17, 70]
    df = spark.createDataFrame([(n, i * 3, f"t{i}") for n in sizes for i in range(n)], "k int, i int, text string")
    want = {}
    for n in sizes:
        texts, levels = [f"t{i}" for i in range(n)], 0
        while len(texts) > 1:
            texts, levels = ["(" + "+".join(texts[i : i + 4]) + ")" for i in range(0, len(texts), 4)], levels + 1
        want[n] = (texts[0], levels)
    told = P.summarised(df, "k", "i", "text", lambda t: F.concat(F.lit("("), F.array_join(t, "+"), F.lit(")")))
    assert {r.k: (r.text, r.levels) for r in told.collect()} == want
    assert P.summarised(df.limit(0), "k", "i", "text", lambda t: F.get(t, F.lit(0))).count() == 0
