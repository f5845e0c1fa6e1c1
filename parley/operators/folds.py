"""Ordered folds over meetings: what a part becomes depends on all parts before it.

A fold deals rows out by key, sorts each partition by key and order, and streams it through a small
step function. A task holds the state of one key and one Arrow batch, however long a meeting is.
"""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are handed back at a time.
BATCH = 5_000


def as_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch as named tuples of plain values: whole numbers stay whole, nulls are None."""
    return map(namedtuple("Row", batch.schema.names)._make, zip(*(c.to_pylist() for c in batch.columns)))


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def fold(rows: DataFrame, keys: list[str], order: list[str], begin: Callable, schema: str) -> DataFrame:
    """Rows that the folds of all keys give. begin() makes a fold: an object with step(row), which yields
    rows for a row given as a named tuple, and end(), which yields the rest of its key's rows. Output rows
    are tuples without the keys, which come first in schema. Keys are carried as they are, however large;
    rows whose key is null are one meeting, as they are one group for groupBy, and so are those with NaN."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, told, state, out = None, None, None, []
        for batch in batches:
            for row in as_rows(batch):
                own = tuple(getattr(row, k) for k in keys)
                same = tuple("NaN" if x != x else x for x in own)
                if state is None or same != told:
                    if state is not None:
                        out += [key + tuple(r) for r in state.end()]
                    key, told, state = own, same, begin()
                out += [key + tuple(r) for r in state.step(row)]
                if len(out) >= BATCH:
                    yield as_batch(out, arrow)
                    out = []
        if state is not None:
            out += [key + tuple(r) for r in state.end()]
        yield as_batch(out, arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class _Fold:
    def step(self, row) -> Iterable[tuple]:
        return ()

    def end(self) -> Iterable[tuple]:
        return ()


def overlap(tail: str, text: str, least: int = 6, most: int = 120) -> int:
    """The length of the longest beginning of text, of least to most characters, that ends tail; else 0."""
    for k in range(min(len(tail), len(text), most), least - 1, -1):
        if tail.endswith(text[:k]):
            return k
    return 0


class Assembly(_Fold):
    """Chunk texts without what repeats the end of the last part given. Rows: order, text. Gives order, text;
    blank chunks and those that are all repetition give nothing, and the tail is carried over them. Texts are
    trimmed of the characters of blank, of all white space where it is None."""

    def __init__(self, keep: int = 120, blank: str | None = None):
        self.tail, self.keep, self.blank = "", keep, blank

    def step(self, row):
        text = (row.text or "").strip(self.blank)
        if text and (k := overlap(self.tail, text)):
            text = text[k:].lstrip(self.blank)
        if text:
            self.tail = text[-self.keep :]
            yield row.turn, text


class ChunkPlan(_Fold):
    """Chunks of a recording, cut at pauses. Rows: at (a pause in ms, ascending), total (the length in ms, also
    the last pause). Gives idx, start_ms, end_ms. A chunk ends at the pause nearest to target within least
    and most, the earlier of two equally near; without one at most. The next begins lap before its end."""

    def __init__(self, target: int = 22_000, most: int = 28_000, least: int = 8_000, lap: int = 1_500):
        self.target, self.most, self.least, self.lap = target, most, least, lap
        self.cursor, self.pauses, self.idx, self.total = 0, [], 0, 0

    def _cut(self):
        near = [p for p in self.pauses if self.cursor + self.least <= p <= self.cursor + self.most]
        end = min(near, key=lambda p: abs(p - self.cursor - self.target)) if near else self.cursor + self.most
        out = self.idx, self.cursor, end
        self.cursor, self.idx = max(self.cursor + 1, end - self.lap), self.idx + 1
        self.pauses = [p for p in self.pauses if p > self.cursor]
        return out

    def step(self, row):
        self.total = row.total
        self.pauses.append(row.at)
        while self.total - self.cursor > self.most and row.at > self.cursor + self.most:
            yield self._cut()

    def end(self):
        while self.total - self.cursor > self.most:
            yield self._cut()
        if self.total > self.cursor:
            yield self.idx, self.cursor, self.total


class Throttle(_Fold):
    """Which states of a growing text are sent on: those that differ from the last one sent and are the first,
    or longer by grown characters, or at least wait seconds later; another speaker begins anew. Rows: at
    (seconds), speaker, text. Gives at, text of what is sent."""

    def __init__(self, grown: int = 30, wait: float = 1.5):
        self.grown, self.wait, self.speaker, self.sent, self.at = grown, wait, None, "", None

    def step(self, row):
        if row.speaker != self.speaker:
            self.speaker, self.sent, self.at = row.speaker, "", None
        if row.text and row.text != self.sent and (self.at is None or len(row.text) - len(self.sent) >= self.grown or row.at - self.at >= self.wait):
            self.sent, self.at = row.text, row.at
            yield row.turn, row.text


class Accumulate(_Fold):
    """Parts from final results. A result whose chunk id a part has replaces that chunk's text, and the part takes
    its speaker; else it extends the last part, if that has the same speaker, or begins a new one. Rows: chunk,
    speaker, text. Gives part, speaker, chunks, text when the key ends; its state is one meeting's text."""

    def __init__(self):
        self.parts, self.of = [], {}

    def step(self, row):
        if not (row.text or "").strip():
            return ()
        part = self.of.get(row.chunk)
        if part is None and self.parts and self.parts[-1]["speaker"] == row.speaker:
            part = self.parts[-1]
        if part is None:
            part = {"speaker": row.speaker, "chunks": {}}
            self.parts.append(part)
        part["chunks"][row.chunk] = row.text
        part["speaker"] = row.speaker
        self.of[row.chunk] = part
        return ()

    def end(self):
        for i, part in enumerate(self.parts):
            yield i, part["speaker"], list(part["chunks"]), " ".join(t for t in part["chunks"].values() if t)


class Collapse(_Fold):
    """Snapshots of one part become one: a row joins the part before if the speaker, by number or by name, and the start agree and one's text
    begins with the other's. The longer text stays and the longer translation, of equal ones the later; the latest end stays, and
    all chunk ids, each where it came first. Rows: speaker_id, speaker, start, stop, text, translation, ids. Gives part and the same."""

    def __init__(self):
        self.last, self.part = None, 0

    def step(self, row):
        old = self.last
        ids = [i.strip() for i in row.ids or [] if i and i.strip()]
        now = [row.speaker_id or 0, row.speaker, row.start, row.stop, row.text or "", row.translation or "", list(dict.fromkeys(ids))]
        if old and old[2] == now[2] and (old[0] == now[0] or (old[1] and old[1] == now[1])):
            shorter, longer = sorted((old[4].strip(), now[4].strip()), key=len)
            if longer.startswith(shorter):
                text = now[4] if len(now[4].strip()) >= len(old[4].strip()) else old[4]
                translation = now[5] if len(now[5]) >= len(old[5]) else old[5]
                self.last = [now[0], now[1] or old[1], old[2], max(x for x in (old[3], now[3], 0) if x is not None), text, translation, list(dict.fromkeys(old[6] + ids))]
                return
        if old:
            yield self.part, *old
            self.part += 1
        self.last = now

    def end(self):
        if self.last:
            yield self.part, *self.last


class TokenStream(_Fold):
    """What a live transcript shows after each event of tokens. Final tokens stay, others stand behind them until the next event; the same for
    tokens of the translation. A final token of another speaker closes the chunk, which comes whole, and begins the next with all of
    the event's own. Rows: event, tokens (text, speaker from 0, is_final, is_translation). Gives event, kind (show, flush or end), chunk,
    speaker, text, translation; a row of a chunk takes the place of its earlier ones."""

    def __init__(self):
        self.said, self.translated, self.speaker, self.chunk, self.event = "", "", 0, 0, None

    def _row(self, kind: str, said: str, translated: str):
        if said.strip():
            yield self.event, kind, self.chunk, self.speaker, said.strip(), translated.strip() or None

    def step(self, row):
        self.event = row.event
        tokens = [t for t in row.tokens or [] if t["text"] not in (None, "", "<end>")]
        if not row.tokens:
            return
        text = lambda final, translation: "".join(t["text"] for t in tokens if bool(t["is_final"]) == final and bool(t["is_translation"]) == translation)
        speakers = [t["speaker"] or 0 for t in tokens if t["is_final"] and not t["is_translation"]]
        if self.said and any(s != self.speaker for s in speakers):
            yield from self._row("flush", self.said, self.translated)
            self.said, self.translated, self.chunk = "", "", self.chunk + 1
        self.said, self.translated = self.said + text(True, False), self.translated + text(True, True)
        self.speaker = speakers[-1] if speakers else self.speaker
        yield from self._row("show", self.said + text(False, False), self.translated + text(False, True))

    def end(self):
        yield from self._row("end", self.said, self.translated)


class Edits(_Fold):
    """Parts of a transcript under edits of the last one: *add* a part; *append* a text to it, which keeps the text before; *replace* what was
    appended last, or all, if nothing was; *revert* to the text before the last append, or take the part away, if there is none. Chunk
    ids go with the texts. Rows: edit, text, chunk. Gives part, text, ids when the key ends."""

    def __init__(self):
        self.parts = []

    def step(self, row):
        text = row.text or ""
        if row.edit == "add":
            self.parts.append({"text": text, "base": "", "ids": [row.chunk] if row.chunk else []})
        elif self.parts:
            last = self.parts[-1]
            if row.edit == "revert":
                if not last["base"]:
                    self.parts.pop()
                else:
                    last |= {"text": last["base"], "base": "", "ids": last["ids"][:-1] if len(last["ids"]) > 1 else last["ids"]}
                return ()
            if row.edit == "append":
                last |= {"base": last["text"], "text": f"{last['text']} {text}"}
            else:
                last["text"] = f"{last['base']} {text}" if last["base"] else text
            if row.chunk and row.chunk not in last["ids"]:
                last["ids"].append(row.chunk)
        return ()

    def end(self):
        for i, p in enumerate(self.parts):
            yield i, p["text"], p["ids"]


class Average(_Fold):
    """Exponential moving average, beginning with the first value. Rows: value. Gives order, value. A null value changes nothing."""

    def __init__(self, alpha: float = 0.1):
        self.alpha, self.now = alpha, None

    def step(self, row):
        if row.value is not None:
            self.now = row.value if self.now is None else (1 - self.alpha) * self.now + self.alpha * row.value
        yield row.event_id, self.now


class VectorAverage(_Fold):
    """Exponential moving average of vectors and of their statistics, beginning with the first row. Rows: vector, stats. Gives event_id, vector,
    stats. A null vector changes nothing; a statistic that only one of both has is taken from it."""

    def __init__(self, alpha: float = 0.1, stats_alpha: float = 0.12):
        self.alphas, self.now = (alpha, stats_alpha), [None, None]

    def step(self, row):
        blend = lambda old, new, a: old if new is None else new if old is None else (1 - a) * old + a * new
        for i, new in enumerate((row.vector, row.stats)):
            old = self.now[i]
            self.now[i] = old if new is None else list(new) if old is None else [blend(x, y, self.alphas[i]) for x, y in zip(old, new)]
        yield row.event_id, self.now[0], self.now[1]


class Confirmation:
    """May another speaker than the last one take over? At once if the similarity and the lead over the second are high (either of two
    pairs of bounds), else when the speaker comes ``hits`` times with no more than ``recent`` seconds between."""

    def __init__(self, hits: int = 2, recent: float = 5.0, sure: tuple = ((0.80, 0.15), (0.75, 0.08))):
        self.hits, self.recent, self.sure = hits, recent, sure
        self.clear()

    def clear(self) -> None:
        self.waiting, self.seen, self.at = None, 0, 0.0

    def allows(self, last, speaker, similarity: float, lead: float, at: float) -> bool:
        again = self.waiting == speaker and at - self.at <= self.recent
        self.seen = self.seen + 1 if again else 1
        if last is None or speaker == last or any(similarity >= s and lead >= g for s, g in self.sure) or (again and self.seen >= self.hits):
            self.clear()
            return True
        self.waiting, self.at = speaker, at
        return False


class Switch(_Fold):
    """Which speaker stands after each match (see Confirmation). Rows: at (seconds), speaker, similarity, lead. Gives at, speaker."""

    def __init__(self, **bounds):
        self.last, self.confirmation = None, Confirmation(**bounds)

    def step(self, row):
        if self.confirmation.allows(self.last, row.speaker, row.similarity, row.lead, row.at):
            self.last = row.speaker
        yield row.event_id, self.last


class Hold(_Fold):
    """The last speaker stays for a while: a row of at least ``least`` similarity is a match; else the last speaker is held if matched or held
    no more than ``recent`` seconds ago, with a similarity of its own (``own``) no more than ``weak`` below ``least`` and no more than
    ``margin`` below the best; else nobody speaks. Rows: at (seconds), speaker, similarity, own. Gives event_id, speaker, held."""

    def __init__(self, least: float = 0.68, recent: float = 5.0, weak: float = 0.06, margin: float = 0.04):
        self.least, self.recent, self.weak, self.margin = least, recent, weak, margin
        self.last, self.at = None, 0.0

    def step(self, row):
        match = row.similarity >= self.least
        held = not match and self.last is not None and row.at - self.at <= self.recent and row.own >= self.least - self.weak and row.similarity - row.own <= self.margin
        if match:
            self.last = row.speaker
        if match or held:
            self.at = row.at
        yield row.event_id, self.last if match or held else None, held


class Voices(_Fold):
    """Speakers of a session by their pitch alone, as they come: the nearest profile, if nearer than ``near``, takes
    the row and moves towards it; else the row begins a new one. Rows: event_id and features. Gives event_id, speaker,
    is_new. The state is one profile a speaker."""

    def __init__(self, near: float = 1.2, keep: float = 0.85):
        self.near, self.keep, self.profiles = near, keep, []

    def step(self, row):
        x = [float(v) for v in row.features]
        apart = [math.dist(x, p) for p in self.profiles]
        k = min(range(len(apart)), key=apart.__getitem__, default=None)
        new = k is None or apart[k] >= self.near
        if new:
            k = len(self.profiles)
            self.profiles.append(x)
        else:
            self.profiles[k] = [p * self.keep + v * (1 - self.keep) for p, v in zip(self.profiles[k], x)]
        yield row.event_id, k, new


class Endpoints(_Fold):
    """Chunks of a live recording. Rows: at (ms, ascending), level. A chunk ends at a tick of quiet that has lasted
    ``pause`` ms, if the chunk is ``least`` ms old, or when it is ``most`` ms old; the next begins there. Gives idx,
    start_ms, end_ms; the last chunk ends at the last tick."""

    def __init__(self, pause: int = 400, least: int = 2_000, most: int = 4_000, quiet: float = 0.015):
        self.pause, self.least, self.most, self.quiet = pause, least, most, quiet
        self.idx, self.start, self.since, self.last = 0, None, None, None

    def step(self, row):
        self.start = row.at if self.start is None else self.start
        self.since = (row.at if self.since is None else self.since) if row.level < self.quiet else None
        self.last, age = row.at, row.at - self.start
        if age >= self.most or (self.since is not None and row.at - self.since >= self.pause and age >= self.least):
            yield self.idx, self.start, row.at
            self.idx, self.start, self.since = self.idx + 1, row.at, None

    def end(self):
        if self.last is not None and self.last > self.start:
            yield self.idx, self.start, self.last
