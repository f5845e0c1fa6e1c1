"""Live meetings as streams: speakers told apart, results in place, chunks in order, late translations, timed saves.

Each operator keeps its state per meeting in the state store (RocksDB: spark.sql.streaming.stateStore.providerClass) and touches only
what a batch names, so a batch costs what it brings, not what the meeting holds. Rows of one meeting are one sequence and
meet in one task; meetings are spread over all tasks. Output rows repeat only if a batch is run again, with the same content.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from parley.operators.speakers import DECISION, Sound, Speakers, Waiting

_PROFILE = "id int, voice array<double>, stats array<double>, frames int, mouth array<double>, mouth_frames int, count int"
_SESSION = "last int, last_at double, waiting int, seen int, waited double, pending array<double>, heard int, pending_at double"


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _out(name: str, key: tuple, names: tuple, rows: list[tuple]) -> Iterator[Row]:
    """Rows of a key; Spark finds their values by name."""
    make = Row(name, *names)
    return (make(key[0], *r) for r in rows)


class _SpeakerState(StatefulProcessor):
    def __init__(self, key: str, most: int, source: str):
        self.key, self.most, self.source = key, most, source

    def init(self, handle) -> None:
        self.profiles, self.session = handle.getListState("profiles", _PROFILE), handle.getValueState("session", _SESSION)

    def _load(self) -> Speakers:
        held = sorted(self.profiles.get()) if self.profiles.exists() else []
        rule = Speakers(self.most, self.source, [Sound.of(*p[1:]) for p in held])
        if self.session.exists():
            rule.last, rule.last_at, waiting, seen, waited, pending, heard, at = self.session.get()
            rule.switch.waiting, rule.switch.seen, rule.switch.at = waiting, seen, waited
            rule.pending = Waiting(None if pending is None else Sound.of(pending, None, 0, None, 0).voice, heard, at)
        return rule

    def _save(self, rule: Speakers) -> None:
        self.profiles.put([(i, *p.row()) for i, p in enumerate(rule.profiles)])
        pending, switch = rule.pending, rule.switch
        self.session.update((rule.last, float(rule.last_at), switch.waiting, switch.seen, float(switch.at), None if pending.what is None else pending.what.tolist(), pending.seen, float(pending.at)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rule = self._load()
        told = [t for row in sorted(rows, key=lambda r: (r.at, r.chunk)) for t in rule.step(row)]
        if rule.profiles:
            self._save(rule)
        yield from _out(self.key, key, ("chunk", "speaker", "decision", "similarity", "lead", "threshold"), told)


def speakers(chunks: DataFrame, key: str, most: int = 4, source: str = "web") -> DataFrame:
    """key, chunk and the decision on each chunk of a stream (see operators.speakers); the profiles, the last speaker and what waits for
    confirmation outlive batches and restarts."""
    told = chunks.groupBy(key).transformWithState(_SpeakerState(key, max(2, min(most, 12)), source), f"{key} {_kind(chunks, key)}, chunk {_kind(chunks, 'chunk')}, {DECISION}", "append", "none")
    return told


def snapshot(spark: SparkSession, checkpoint: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(profiles, sessions) of a stream of speakers() as it stands, for operators.speakers.scored; the stream is not touched."""
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    own = F.col(f"key.{key}").alias(key)
    return state("profiles").select(own, "list_element.*"), state("session").select(own, "value.last", "value.last_at")


class _PartState(StatefulProcessor):
    def __init__(self, key: str, flush: float | None, bound: int):
        self.key, self.flush, self.bound = key, flush, bound

    def init(self, handle) -> None:
        self.handle = handle
        self.of = handle.getMapState("of", "chunk string", "part int")
        self.parts = handle.getMapState("parts", "part int", "speaker string, chunks array<string>, texts array<string>")
        self.dirty = handle.getMapState("dirty", "part int", "dirty boolean")
        self.meeting = handle.getValueState("meeting", "count int, whole int, waits boolean")

    def _take(self, row, count: int) -> int:
        """The part that a result goes to, and what becomes of it; the number of parts after it."""
        k = self.of.getValue((row.chunk,))[0] if self.of.containsKey((row.chunk,)) else None
        if k is None and count and self.parts.getValue((count - 1,))[0] == row.speaker:
            k = count - 1
        if k is None:
            k, chunks, texts = count, [], []
        else:
            _, chunks, texts = self.parts.getValue((k,))
            chunks, texts = list(chunks), list(texts)
        if row.chunk in chunks:
            texts[chunks.index(row.chunk)] = row.text
        else:
            chunks.append(row.chunk)
            texts.append(row.text)
            self.of.updateValue((row.chunk,), (k,))
        self.parts.updateValue((k,), (row.speaker, chunks, texts))
        self.dirty.updateValue((k,), (True,))
        return max(count, k + 1)

    def _flushed(self, count: int, whole: int) -> tuple[list[tuple], int]:
        """The parts that changed; those beyond the bound keep their text in one piece."""
        told = []
        for (k,) in sorted(self.dirty.keys()):
            speaker, chunks, texts = self.parts.getValue((k,))
            told.append((k, speaker, list(chunks), " ".join(t for t in texts if t)))
        self.dirty.clear()
        for k in range(whole, count - self.bound):
            speaker, chunks, texts = self.parts.getValue((k,))
            self.parts.updateValue((k,), (speaker, list(chunks), [" ".join(t for t in texts if t), *[""] * (len(chunks) - 1)]))
        return told, max(whole, count - self.bound)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        count, whole, waits = self.meeting.get() if self.meeting.exists() else (0, 0, False)
        told = []
        for row in sorted(rows, key=lambda r: r.seq):
            if (row.text or "").strip():
                count = self._take(row, count)
        if self.flush is None:
            told, whole = self._flushed(count, whole)
        elif not waits and count:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.flush * 1000))
            waits = True
        self.meeting.update((count, whole, waits))
        yield from _out(self.key, key, ("part", "speaker", "chunks", "text"), told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        count, whole, _ = self.meeting.get()
        told, whole = self._flushed(count, whole)
        self.meeting.update((count, whole, False))
        yield from _out(self.key, key, ("part", "speaker", "chunks", "text"), told)


def parts(results: DataFrame, key: str, flush: float | None = None, bound: int = 500) -> DataFrame:
    """key, part, speaker, chunks, text of the parts that change, whole as they stand, from a stream of results (key, seq, chunk, speaker, text):
    a result, interim or final, takes the place of an earlier one of its chunk (see folds.Accumulate). Without flush at each batch; else
    ``flush`` seconds after the first change, whether or not more comes. Of parts older than the last ``bound`` ones the single
    chunks' texts are let go: a later result of such a chunk is added behind, or, if it was the part's first chunk, takes
    the place of the whole."""
    mode = "none" if flush is None else "ProcessingTime"
    return results.groupBy(key).transformWithState(_PartState(key, flush, bound), f"{key} {_kind(results, key)}, part int, speaker string, chunks array<string>, text string", "append", mode)


class Upserts:
    """A table of the last row of each key, written batch by batch. A batch goes to a folder of its own number, so a batch that
    is run again changes nothing, and no batch rewrites what earlier ones wrote; readers see the latest row of each key,
    in the place where the key came first. compacted() writes the present state as one batch of another table."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str):
        self.spark, self.path, self.keys, self.order = spark, path, keys, order

    def write(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        values = F.struct(*[c for c in batch.columns if c not in self.keys])
        last = batch.groupBy(*self.keys).agg(F.max_by(values, self.order).alias("now"), F.min(self.order).alias("first"))
        last.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def _last(self) -> DataFrame:
        rows = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*")
        at = F.struct("batch", f"now.{self.order}")
        return rows.groupBy(*self.keys).agg(F.max_by("now", at).alias("now"), F.min(F.struct("batch", "first")).alias("place"), F.max("batch").alias("batch"))

    def read(self) -> DataFrame:
        """keys, all other columns, place (order it by that)."""
        return self._last().select(*self.keys, "now.*", "place")

    def compacted(self, path: str) -> Upserts:
        told = self._last()
        number = told.agg(F.max("batch")).first()[0]
        if number is not None:
            told.select(*self.keys, "now", F.col("place.first").alias("first")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        return Upserts(self.spark, path, self.keys, self.order)


#: The time of a row in ms, as Spark reads it.
_MILLIS = "ordered at ms"


class _Order(StatefulProcessor):
    def __init__(self, names: list[str], order: str):
        self.names, self.order = names, order

    def init(self, handle) -> None:
        self.handle = handle
        self.held, self.place = handle.getListState("held", "millis long, row binary"), handle.getValueState("place", "place long, timer long")

    def _released(self, upto: int) -> Iterator[Row]:
        held = list(self.held.get()) if self.held.exists() else []
        where = self.names.index(self.order)
        out = sorted((pickle.loads(row) for at, row in held if at <= upto), key=lambda r: r[where])
        rest = [(at, row) for at, row in held if at > upto]
        place, timer = self.place.get() if self.place.exists() else (0, -1)
        first = min((at for at, _ in rest), default=-1)
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        if first not in (timer, -1):
            self.handle.registerTimer(first)
        self.place.update((place + len(out), first))
        yield from (Row(*self.names, "place")(*r, place + i) for i, r in enumerate(out))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.held.appendList([(r[_MILLIS], pickle.dumps(tuple(r[c] for c in self.names))) for r in rows])
        yield from self._released(timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._released(timerValues.getCurrentWatermarkInMs())


def ordered(chunks: DataFrame, key: str, at: str, order: str, late: str = "30 seconds") -> DataFrame:
    """The rows of a stream with their place in the order of ``order``, which grows with ``at`` (a timestamp): a row is held until no earlier
    one can come, that is until the watermark, ``late`` behind the latest row, has passed it. Rows that come later still are dropped, as
    by any watermark. The buffer of a meeting holds the rows of ``late`` and of one batch."""
    out = StructType(list(chunks.schema.fields)).add("place", "long")
    timed = chunks.withWatermark(at, late).withColumn(_MILLIS, F.unix_millis(at))
    return timed.groupBy(key).transformWithState(_Order(chunks.columns, order), out, "append", "EventTime")


class _Translations(StatefulProcessor):
    def __init__(self, key: str, wait: float):
        self.key, self.wait = key, wait

    def init(self, handle) -> None:
        self.handle = handle
        self.of, self.last = handle.getMapState("of", "chunk string", "part int"), handle.getValueState("last", "part int")
        self.waiting = handle.getMapState("waiting", "chunk string, seq long", "translation string, until long")

    def _known(self, chunk: str) -> int | None:
        return self.of.getValue((chunk,))[0] if chunk is not None and self.of.containsKey((chunk,)) else None

    def _resolved(self, now: int) -> list[tuple]:
        """Waiting translations whose part has come, or that have waited long enough, if there is any part."""
        told, last = [], self.last.get()[0] if self.last.exists() else None
        for (chunk, seq), (text, until) in sorted(self.waiting.iterator()):
            part = self._known(chunk)
            if part is not None or (until <= now and last is not None):
                told.append((last if part is None else part, chunk, text, part is not None))
                self.waiting.removeKey((chunk, seq))
        return told

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, news = timerValues.getCurrentProcessingTimeInMs(), False
        for r in sorted(rows, key=lambda r: r.seq):
            if r.part is not None:
                for chunk in r.ids or []:
                    self.of.updateValue((chunk,), (r.part,))
                if not self.last.exists() or r.part > self.last.get()[0]:
                    self.last.update((r.part,))
            else:
                self.waiting.updateValue((r.chunk or "", r.seq), (r.translation, now + int(self.wait * 1000)))
                news = True
        told = self._resolved(now)
        if news and self.waiting.exists():
            self.handle.registerTimer(now + int(self.wait * 1000))
        yield from _out(self.key, key, ("part", "chunk", "translation", "by_chunk"), told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        told = self._resolved(now)
        if not told and self.waiting.exists():  # no part has come yet
            self.handle.registerTimer(now + max(1_000, int(self.wait * 1000)))
        yield from _out(self.key, key, ("part", "chunk", "translation", "by_chunk"), told)


def late_translations(parts: DataFrame, translations: DataFrame, key: str, wait: float = 60.0) -> DataFrame:
    """key, part, chunk, translation, by_chunk: each translation of a stream (key, seq, chunk, translation) with the part (of a stream key, seq, part,
    ids) that has its chunk, whichever of both comes first. One whose part does not come within ``wait`` seconds goes to the last part
    then known. A join of two streams would drop what is later than its watermarks; here nothing is dropped, however late, and
    the state holds the chunk ids of a meeting."""
    a = parts.select(key, "seq", F.col("part").cast("int").alias("part"), "ids", F.lit(None).cast("string").alias("chunk"), F.lit(None).cast("string").alias("translation"))
    b = translations.select(key, "seq", F.lit(None).cast("int").alias("part"), F.lit(None).cast("array<string>").alias("ids"), "chunk", "translation")
    return a.unionByName(b).groupBy(key).transformWithState(_Translations(key, wait), f"{key} {_kind(parts, key)}, part int, chunk string, translation string, by_chunk boolean", "append", "ProcessingTime")


