"""Live streams: speakers, results in place, ordered chunks, late translations, timed saves, work that is resumed."""

import datetime as dt
import itertools
import time
from collections import namedtuple

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import folds, resume
from parley.operators import speakers as S
from parley.streaming import live

CHUNK = "m long, chunk int, at double, seconds double, voice array<double>, pitch array<double>, frames int, mouth array<double>, mouth_frames int"
Chunk = namedtuple("Chunk", "m chunk at seconds voice pitch frames mouth mouth_frames")
LARGE = 2**53 + 1


def pitch(mean, spread=0.0):
    return [mean, 10.0, mean, mean - 20 - spread, mean + 20 + spread, 5.0, 0.1, 0.2]


def meeting(m, seed, n=60):
    """Chunks of three or four voices, some near each other, with pitches, mouths, gaps and some without a voice."""
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(4, 16))
    heads[1] = heads[0] + rng.normal(size=16) * 0.8
    tones, mouths = [110.0, 220.0, 150.0, 260.0], rng.normal(size=(4, 5))
    at, out = 0.0, []
    for i in range(n):
        k = int(rng.integers(0, 4)) if rng.random() < 0.4 or not out else k  # noqa: F821
        at += float(rng.choice([0.5, 2.0, 4.0, 12.0]))
        voice = None if rng.random() < 0.04 else (heads[k] + rng.normal(size=16) * rng.choice([0.2, 0.7, 1.2])).tolist()
        tone = None if rng.random() < 0.2 else pitch(tones[k] + float(rng.normal() * 15), float(rng.random() * 30))
        mouth = None if rng.random() < 0.3 else (mouths[k] / np.linalg.norm(mouths[k]) + rng.normal(size=5) * 0.1).tolist()
        out.append(Chunk(m, i, at, float(rng.choice([0.8, 3.0])), voice, tone, 0 if tone is None else int(rng.integers(3, 30)), mouth, 0 if mouth is None else int(rng.integers(3, 30))))
    return out


def plainly(rows, **of):
    rule = S.Speakers(**of)
    return [(r.m, *t) for r in rows for t in rule.step(r)]


def near(a, b):
    same = lambda x, y: x == y or (isinstance(x, float) and abs(x - y) < 1e-9)
    return len(a) == len(b) and all(len(p) == len(q) and all(map(same, p, q)) for p, q in zip(sorted(a, key=lambda r: (str(r[0]), r[1])), sorted(b, key=lambda r: (str(r[0]), r[1]))))


def said(rows, **of):
    return [(t[2], t[3]) for t in plainly(rows, **of)]


def chunks(*told):
    """(at, seconds, voice, mean pitch or None)"""
    return [Chunk(1, i, float(at), float(s), list(map(float, v)), None if f is None else pitch(f), 0 if f is None else 10, None, 0) for i, (at, s, v, f) in enumerate(told)]


def test_decisions():
    a, b, c = [1, 0, 0], [0, 1, 0], [0, 0, 1]
    assert said(chunks((0, 3, a, None), (1, 3, a, None))) == [(0, "first"), (0, "match")]
    # Far from all and clearly so: a new speaker at once. A doubtful one must come three times, within 20 seconds, like itself.
    assert said(chunks((0, 3, a, None), (9, 3, b, None))) == [(0, "first"), (1, "new")]
    # With one profile the lead is 1 only while no second is above 0, so 0.5 is clear; between two it is not.
    between = [0.52, 0.52, 0.67]
    rows = [(0, 3, a, None), (9, 3, b, None), (20, 3, between, None), (30, 3, between, None), (40, 3, between, None)]
    assert said(chunks(*rows)) == [(0, "first"), (1, "new"), (1, "pending"), (1, "pending"), (2, "new")]
    assert said(chunks(*rows), source="system")[-2:] == [(2, "new"), (2, "match")]
    late = [(0, 3, a, None), (9, 3, b, None), (20, 3, between, None), (41, 3, between, None), (50, 3, between, None)]
    assert [d for _, d in said(chunks(*late))] == ["first", "new", "pending", "pending", "pending"]
    # A short chunk soon after stays; all speakers taken: the best one.
    assert said(chunks(*rows[:2], (10, 1, between, None)))[-1] == (1, "short")
    assert said(chunks(*rows[:3]), most=2)[-1] == (0, "full")
    # Another known speaker: sure ones take over at once, doubtful ones wait for a second time within 5 seconds.
    doubtful = [0.74, 0.64, 0.2]
    rows = [(0, 3, a, None), (9, 3, b, None), (10, 3, doubtful, None)]
    assert said(chunks(*rows, (12, 3, doubtful, None)))[2:] == [(1, "hold"), (0, "match")]
    assert said(chunks(*rows, (16, 3, doubtful, None)))[2:] == [(1, "hold"), (1, "hold")]
    # Two that are equally near: the last one stays for five seconds, then the best one is taken.
    even = [0.7, 0.69, 0.18]
    assert said(chunks(*rows[:2], (12, 3, even, None), (20, 3, [0.7, 0.6, 0.3], None)))[2:] == [(1, "sticky"), (0, "weak")]
    # High and low voices of one sound are told apart at once.
    assert said(chunks((0, 3, a, 100.0), (9, 3, [0.6, 0.8, 0], 230.0))) == [(0, "first"), (1, "new")]
    assert said(chunks((0, 3, a, 100.0), (9, 3, [0.9, 0.44, 0], 230.0)))[1] == (0, "pending") and said(chunks((0, 3, a, 100.0), (9, 3, a, 230.0)))[1] == (0, "match")
    # No voice, or one of another length: nothing changes.
    odd = chunks((0, 3, a, None), (1, 3, [], None), (2, 3, [1], None))
    assert said(odd) == [(0, "first"), (0, "kept"), (0, "kept")] and said(odd[1:2]) == [(0, "kept")]


def test_confirmation():
    c = folds.Confirmation()
    assert c.allows(None, 1, 0.1, 0.0, 0.0) and c.allows(1, 1, 0.1, 0.0, 1.0) and c.allows(1, 2, 0.8, 0.15, 2.0) and c.allows(2, 1, 0.75, 0.08, 3.0)
    assert [c.allows(1, 2, 0.7, 0.0, t) for t in (10.0, 15.1, 20.0)] == [False, False, True]
    assert [c.allows(2, s, 0.7, 0.0, 21.0) for s in (1, 3, 1)] == [False, False, False]


def test_every_decision_occurs_and_batches_equal_the_plain_rule(spark):
    rows = [r for m, seed in ((1, 1), (2, 2), (LARGE, 3), (None, 4)) for r in meeting(m, seed)]
    want = [t for _, own in itertools.groupby(rows, key=lambda r: r.m) for t in plainly(list(own))]
    assert {t[3] for t in want} >= {"first", "match", "hold", "sticky", "weak", "full", "new", "pending", "kept"}
    got = [tuple(r) for r in S.classified(spark.createDataFrame(rows, CHUNK), "m").collect()]
    assert near(got, want)


def run(spark, job, tmp_path, name, mode="append"):
    out = str(tmp_path / f"out-{name}")
    job.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", str(tmp_path / f"at-{name}")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_speakers_as_a_stream_and_its_snapshot(spark, tmp_path):
    """Several batches, each run a restart of its own, give what the rule gives over all rows; then the profiles are read and scored against."""
    folder = str(tmp_path / "in")
    rows = [r for m, seed in ((1, 1), (LARGE, 3)) for r in meeting(m, seed)]
    for lo, hi in ((0, 7), (7, 31), (31, 60)):
        put(spark, [r for r in rows if lo <= r.chunk < hi], CHUNK, folder)
        got = run(spark, live.speakers(spark.readStream.schema(CHUNK).parquet(folder), "m"), tmp_path, "speakers")
    rules = {m: S.Speakers() for m in (1, LARGE)}
    want = [(r.m, *t) for r in rows for t in rules[r.m].step(r)]
    assert near([tuple(r) for r in got.collect()], want)
    profiles, sessions = live.snapshot(spark, str(tmp_path / "at-speakers"), "m")
    assert sorted((r.m, r.last) for r in sessions.collect()) == [(m, rules[m].last) for m in (1, LARGE)]
    probe = [c._replace(m=m, at=rules[m].last_at + i % 9) for m in (1, LARGE) for i, c in enumerate(meeting(m, 9))] + [meeting(5, 5)[0]]
    told = {(r.m, r.chunk): r for r in S.scored(spark.createDataFrame(probe, CHUNK), profiles, "m", sessions).collect()}
    assert len(told) == len(probe) and told[5, 0].speaker == 0 and told[5, 0].similarity is None
    for c in probe[:-1]:
        r, rule = told[c.m, c.chunk], rules[c.m]
        if c.voice is None:
            assert r.speaker == rule.last
            continue
        x = S.Sound.of(*c[4:])
        s = S.scores(x, rule.profiles, rule.last)
        k = int(s.similarity.argmax())
        second = max(np.delete(s.similarity, k), default=-1.0)
        signals = int(s.far_pitch[k]) + int(s.far_mouth[k]) + int(s.tone[k] >= S.TONE_SPLIT) if s.same[k] and not s.cross[k] else 0
        assert r.similarity == pytest.approx(float(s.similarity[k])) and r.lead == pytest.approx(float(s.similarity[k] - second) if second >= 0 else 1.0)
        assert r.threshold == pytest.approx(rule._threshold(s, k, c.at - rule.last_at <= S.RECENT, signals))
        sticks = c.at - rule.last_at <= S.RECENT and s.similarity[rule.last] >= r.threshold - S.WEAK_MARGIN
        assert r.speaker == (k if r.sure else rule.last if sticks else k)
    # The stream goes on from where it was.
    put(spark, [Chunk(1, 99, 1e4, 3.0, *rows[0][4:])], CHUNK, folder)
    again = run(spark, live.speakers(spark.readStream.schema(CHUNK).parquet(folder), "m"), tmp_path, "speakers")
    assert again.count() == len(rows) + 1


RESULT = "m long, seq int, chunk string, speaker string, text string"
RESULTS = [(1, 0, "a", "x", "on"), (1, 1, "a", "x", "one"), (1, 2, "b", "x", "two"), (1, 3, "c", "y", "th"), (1, 4, "a", "x", "ONE"), (1, 5, "c", "y", "three"), (1, 6, "d", "y", " "), (1, 7, "e", "y", "four"), (1, 8, "b", "z", "2"), (LARGE, 0, "a", "x", "other")]


def accumulated(rows):
    out = {}
    for m in {r[0] for r in rows}:
        rule = folds.Accumulate()
        for r in sorted(r for r in rows if r[0] == m):
            rule.step(namedtuple("R", "m turn chunk speaker text")(*r))
        out |= {(m, k): (speaker, ids, text) for k, speaker, ids, text in rule.end()}
    return out


def test_results_in_place(spark, tmp_path):
    """Interim and final results through a stream into a table: a batch written twice, and a restart, change nothing."""
    folder, store = str(tmp_path / "in"), live.Upserts(spark, str(tmp_path / "store"), ["m", "part"], "part_seq")
    batches = []

    def write(df, number):
        kept = df.withColumn("part_seq", F.col("part"))
        batches.append((number, [tuple(r) for r in kept.collect()], kept.schema))
        store.write(kept, number)

    for k in range(0, len(RESULTS), 3):
        put(spark, RESULTS[k : k + 3], RESULT, folder)
        job = live.parts(spark.readStream.schema(RESULT).parquet(folder), "m")
        job.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
        now = {(r.m, r.part): (r.speaker, r.chunks, r.text) for r in store.read().collect()}
        assert now == accumulated(RESULTS[: k + 3])
    assert len(batches) == 4
    for number, rows, schema in batches:
        store.write(spark.createDataFrame(rows, schema), number)
    assert {(r.m, r.part): (r.speaker, r.chunks, r.text) for r in store.read().collect()} == now
    small = store.compacted(str(tmp_path / "small"))
    assert sorted(map(str, small.read().drop("place").collect())) == sorted(map(str, store.read().drop("place").collect()))
    small.write(spark.createDataFrame([(1, 0, "x", ["a"], "new", 0)], batches[0][2]), 9)
    assert {r.text for r in small.read().where("m = 1 and part = 0").collect()} == {"new"}


def test_parts_beyond_the_bound_keep_their_text(spark, tmp_path):
    rows = [(1, i, f"c{i}", f"s{i // 2}", f"t{i}") for i in range(10)]
    folder = str(tmp_path / "in")
    put(spark, rows, RESULT, folder)
    job = lambda: live.parts(spark.readStream.schema(RESULT).parquet(folder), "m", bound=2)
    run(spark, job(), tmp_path, "bound")
    put(spark, [(1, 10, "c1", "s0", "late"), (1, 11, "c2", "s1", "all"), (1, 12, "c9", "s4", "nine")], RESULT, folder)
    told = {r.part: r.text for r in run(spark, job(), tmp_path, "bound").collect() if r.text not in ("t0 t1", "t2 t3", "t4 t5", "t6 t7", "t8 t9")}
    assert told == {0: "t0 t1 late", 1: "all", 4: "t8 nine"}


def test_timed_saves_come_without_further_input(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    put(spark, RESULTS[:4], RESULT, folder)
    job = live.parts(spark.readStream.schema(RESULT).parquet(folder), "m", flush=1.0)
    q = job.writeStream.foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while len(seen) < 2 and time.time() < until:
            time.sleep(0.2)
        assert sorted((r[0], r[1], r[4]) for r in seen) == [(1, 0, "one two"), (1, 1, "th")]
        put(spark, RESULTS[4:6], RESULT, folder)
        while len(seen) < 4 and time.time() < until:
            time.sleep(0.2)
        assert sorted((r[1], r[4]) for r in seen[2:]) == [(0, "ONE two"), (1, "three")]
    finally:
        q.stop()


STAMP = "m long, idx int, at timestamp, text string"


@pytest.mark.parametrize("arrival", [[0, 1, 2, 3, 4, 5], [5, 4, 3, 2, 1, 0], [2, 0, 5, 1, 4, 3], [3, 5, 4, 0, 2, 1]])
def test_chunks_in_order(spark, tmp_path, arrival):
    folder = str(tmp_path / "in")
    when = lambda s: dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    rows = [(m, i, when(i * 5), f"t{i}") for i in arrival for m in (1, LARGE)]
    for k in (0, 6):
        put(spark, rows[k : k + 6], STAMP, folder)
        job = live.ordered(spark.readStream.schema(STAMP).parquet(folder), "m", "at", "idx")
        run(spark, job, tmp_path, "ordered")
    put(spark, [(m, 9, when(500), "end") for m in (1, LARGE)], STAMP, folder)
    got = run(spark, live.ordered(spark.readStream.schema(STAMP).parquet(folder), "m", "at", "idx"), tmp_path, "ordered").collect()
    for m in (1, LARGE):
        assert [(r.idx, r.text) for r in sorted((r for r in got if r.m == m), key=lambda r: r.place)] == [(i, f"t{i}") for i in range(6)]


def test_late_translations(spark, tmp_path):
    """Translations before, with and long after their part; one whose part never comes goes to the last part by timer."""
    a, b = str(tmp_path / "parts"), str(tmp_path / "translations")
    A, B = "m long, seq int, part int, ids array<string>", "m long, seq int, chunk string, translation string"
    put(spark, [(1, 0, 0, ["c0", "c1"])], A, a)
    put(spark, [(1, 0, "c5", "before"), (1, 1, "c1", "with"), (2, 0, "x", "no part yet")], B, b)
    batches = {}  # a batch that is run again after a stop counts once
    seen = lambda: [r for n in sorted(batches) for r in batches[n]]
    read = lambda s, f: spark.readStream.schema(s).parquet(f)
    start = lambda: live.late_translations(read(A, a), read(B, b), "m", wait=3.0).writeStream.foreachBatch(lambda df, n: batches.update({n: [tuple(r) for r in df.collect()]})).option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="300 milliseconds").start()

    def wait(n):
        until = time.time() + 60
        while len(seen()) < n and time.time() < until:
            time.sleep(0.2)

    q = start()
    try:
        wait(1)
        assert seen() == [(1, 0, "c1", "with", True)]
        put(spark, [(1, 2, 3, ["c5"])], A, a)
        wait(2)
        assert seen()[1][:4] in ((1, 3, "c5", "before"), (1, 0, "c5", "before"))
    finally:
        q.stop()
    put(spark, [(1, 3, "c0", "much later"), (1, 4, "nowhere", "lost")], B, b)
    put(spark, [(2, 1, 0, ["y"])], A, a)
    q = start()
    try:
        wait(5)
    finally:
        q.stop()
    assert sorted(seen()[2:]) == [(1, 0, "c0", "much later", True), (1, 3, "nowhere", "lost", False), (2, 0, "x", "no part yet", False)]


def test_work_goes_on_where_it_was_broken_off(spark, tmp_path):
    plan = spark.createDataFrame([(m, i, f"chunk {i} of {m}") for m in (1, 2) for i in range(20)], "m int, idx int, source string")
    path, tried = str(tmp_path / "saved"), []

    def work(rows):
        tried.append(rows.count())
        if len(tried) == 4:
            raise RuntimeError("lost")
        return rows.select("m", "idx", F.when(F.col("idx") == 7, F.lit(" ")).otherwise(F.upper("source")).alias("text"))

    with pytest.raises(RuntimeError):
        resume.worked(plan, path, work, ["m", "idx"], waves=4)
    part = resume.partial_transcript(spark.read.parquet(path), "m", "idx")
    done = spark.read.parquet(path).where("trim(text) <> ''").count()
    assert 0 < done < 38 and part.count() == done and {r.speaker for r in part.collect()} == {"Speaker 1"}
    tried[:] = [0] * 9
    told = resume.worked(plan, path, work, ["m", "idx"], waves=4)
    assert sum(tried[9:]) == 40 - done  # blank results are tried again
    want = [(m, i, " " if i == 7 else f"CHUNK {i} OF {m}") for m in (1, 2) for i in range(20)]
    assert sorted(map(tuple, told.collect())) == want
    tried[:] = [0] * 9
    assert sorted(map(tuple, resume.worked(plan, path, work, ["m", "idx"], waves=4).collect())) == want and sum(tried[9:]) == 2
