"""Who speaks: chunks of a meeting told apart by voice, pitch and mouthprint, as they come.

``Speakers`` is the rule for one meeting, a fold over its chunks in order; it serves batches (``classified``) and streams
(``parley.streaming.speakers``). All profiles of a meeting, a dozen at most, are scored at once as arrays. ``scored`` is the read-only
side: the same scores as column expressions, for any number of chunks against given profiles, which change nothing.

A chunk has: at (seconds), seconds (its length), voice (array), pitch (array of STATS), frames (that the pitch rests on), mouth
(array) and mouth_frames. Null arrays mean that nothing was found. A chunk without a voice, or with one of another
length than the profiles', keeps the current speaker.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import folds
from parley.operators import vectors as V

STATS = ("mean", "std", "median", "p10", "p90", "delta_std", "energy", "zcr")
MEAN, MEDIAN, P10, P90, DELTA = 0, 2, 3, 4, 5

# Fixed values, as the reference has them.
MATCH, STRONG, AMBIGUOUS, LEAST_THRESHOLD = 0.68, 0.78, 0.08, 0.52
KNOWN_FROM, KNOWN_BONUS, YOUNG_BELOW, YOUNG_BONUS, LAST_BONUS, LOW_BONUS = 6, 0.02, 4, 0.06, 0.04, 0.04
RECENT, WEAK_MARGIN, STICKY_MARGIN, STICKY_LOW = 5.0, 0.06, 0.04, 0.04
PITCH_WIDTH, PITCH_FACTOR, PITCH_HIGH, PITCH_MOST, CROSS_PENALTY, CROSS_EXTRA, CROSS_STRONG = 120.0, 0.06, 1.8, 0.22, 0.06, 0.07, 0.85
TONE_LOW, TONE_SPLIT, SPLIT_EXTRA, FAR_MOUTH_EXTRA = 0.85, 0.05, 0.03, 0.05
MOUTH_FRAMES, MOUTH_CLOSE, MOUTH_FAR, MOUTH_BOOST, MOUTH_BOOST_LAST, MOUTH_SCALE, MOUTH_MOST = 6, 0.30, 0.65, 0.02, 1.2, 0.15, 0.08
MOUTH_MALE, MOUTH_FEMALE, MOUTH_LAST = 1.60, 1.40, 0.80
SURE_ONE, SURE_MORE = (0.04, 0.06), (0.10, 0.12)
NEW_HITS, NEW_SECONDS, NEW_WINDOW, NEW_SELF, NEW_SELF_FAR, NEW_KEEP, NEW_CLEAR, NEW_CLEAR_GAP, NEW_INSTANT = 3, 1.5, 20.0, 0.70, 0.04, 0.85, 0.12, 0.09, 0.08
LEARN_FROM, COUNT_MOST = 0.50, 1_000
#: How far a profile moves towards a chunk: voice, pitch, mouth; by what was decided.
PACE = {"match": (0.10, 0.12, 0.10), "sticky": (0.08, 0.10, 0.08), "weak": (0.08, 0.10, 0.08), "full": (0.08, 0.08, 0.06)}


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n >= V.SHORTEST else v


def _cosine(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=-1) * np.linalg.norm(v)
    return np.where(n < V.SHORTEST, 0.0, m @ v / np.where(n < V.SHORTEST, 1.0, n))


def _zone(f0: np.ndarray) -> np.ndarray:
    """-1 low, 1 high, 0 between, NaN unknown."""
    return np.where(np.isnan(f0), np.nan, np.where(f0 <= T.MALE, -1.0, np.where(f0 >= T.FEMALE, 1.0, 0.0)))


def blended(old: np.ndarray, new: np.ndarray, alpha: float) -> np.ndarray:
    """Statistics moved towards new ones; what only one of both knows is taken from it."""
    return np.where(np.isnan(new), old, np.where(np.isnan(old), new, old * (1 - alpha) + new * alpha))


@dataclass
class Sound:
    """What is known of a voice: a chunk's, or a profile's."""

    voice: np.ndarray
    stats: np.ndarray
    frames: int
    mouth: np.ndarray | None
    mouth_frames: int
    count: int = 1

    @classmethod
    def of(cls, voice, pitch, frames, mouth, mouth_frames, count: int = 1) -> Sound:
        number = lambda x: np.array([np.nan if y is None else y for y in x], float)
        return cls(number(voice), np.full(len(STATS), np.nan) if pitch is None else number(pitch), frames or 0, None if mouth is None else number(mouth), mouth_frames or 0, count)

    def row(self) -> tuple:
        return self.voice.tolist(), self.stats.tolist(), int(self.frames), None if self.mouth is None else self.mouth.tolist(), int(self.mouth_frames), int(self.count)

    def learn(self, new: Sound, pace: tuple[float, float, float]) -> None:
        self.voice = self.voice * (1 - pace[0]) + new.voice * pace[0]
        if not np.isnan(new.stats).all() and new.frames >= T.FRAMES:
            self.stats, self.frames = blended(self.stats, new.stats, pace[1]), min(COUNT_MOST, self.frames + new.frames)
        if new.mouth is not None and new.mouth_frames >= MOUTH_FRAMES:
            self.mouth, self.mouth_frames = (new.mouth, new.mouth_frames) if self.mouth is None else (_unit(self.mouth * (1 - pace[2]) + new.mouth * pace[2]), min(COUNT_MOST, self.mouth_frames + new.mouth_frames))


@dataclass
class Scores:
    """Of a chunk against each profile."""

    similarity: np.ndarray
    cross: np.ndarray
    same: np.ndarray
    tone: np.ndarray
    far_pitch: np.ndarray
    far_mouth: np.ndarray
    low: np.ndarray


def scores(x: Sound, profiles: list[Sound], last: int | None) -> Scores:
    stats, frames = np.stack([p.stats for p in profiles]), np.array([p.frames for p in profiles])
    f0, own = stats[:, MEAN], x.stats[MEAN]
    zone, own_zone, apart = _zone(f0), _zone(np.array(own)), np.abs(f0 - own)
    heard = ~np.isnan(f0) & ~np.isnan(own) & (frames >= T.FRAMES) & (x.frames >= T.FRAMES)
    same = (zone == own_zone) & (zone != 0)
    cross = heard & (zone * own_zone == -1) & (apart >= T.APART)
    one_between = heard & ((zone == 0) != (own_zone == 0))
    pitch = apart / PITCH_WIDTH * PITCH_FACTOR * np.where((f0 >= T.FEMALE) & (own >= T.FEMALE), PITCH_HIGH, 1.0)
    pitch = pitch + np.where(cross, CROSS_PENALTY, np.where(one_between, np.minimum(apart * T.SOFT, T.SOFT_MOST), 0.0))
    similarity = _cosine(np.stack([p.voice for p in profiles]), x.voice) - np.where(heard, np.minimum(pitch, PITCH_MOST), 0.0)
    known = np.nan_to_num(np.abs(np.stack([stats[:, MEDIAN] - x.stats[MEDIAN], stats[:, P90] - stats[:, P10] - (x.stats[P90] - x.stats[P10]), stats[:, DELTA] - x.stats[DELTA]])))
    tone = np.minimum((known.T / [T.TONE_MEDIAN, T.TONE_SPAN, T.TONE_DELTA]).sum(1) * T.TONE_FACTOR, T.TONE_MOST)
    tone = np.where(same & ~cross & (frames >= T.FRAMES) & (x.frames >= T.FRAMES), tone * np.where(zone == -1, TONE_LOW, 1.0), 0.0)
    far = x.mouth is not None and x.mouth_frames >= MOUTH_FRAMES
    mouth = np.array([np.linalg.norm(x.mouth - p.mouth) if far and p.mouth is not None and p.mouth_frames >= MOUTH_FRAMES else np.nan for p in profiles])
    is_last = np.arange(len(profiles)) == (-1 if last is None else last)
    scale = np.where(same & (zone == -1), MOUTH_MALE, np.where(same & (zone == 1), MOUTH_FEMALE, 1.0)) * np.where(is_last, MOUTH_LAST, 1.0)
    lost = np.minimum((mouth - MOUTH_FAR) * MOUTH_SCALE * scale, MOUTH_MOST)
    similarity = similarity - tone + np.where(mouth <= MOUTH_CLOSE, MOUTH_BOOST * np.where(is_last, MOUTH_BOOST_LAST, 1.0), np.where(mouth >= MOUTH_FAR, -lost, 0.0))
    far_pitch = heard & same & (apart >= np.where(zone == 1, T.FAR_FEMALE, T.FAR_MALE))
    return Scores(similarity, cross, same, tone, far_pitch, same & (mouth >= MOUTH_FAR), (f0 < T.FEMALE) & (own < T.FEMALE))


@dataclass
class Waiting:
    """A class that is not taken at once: what waits, how often it was seen, and when last."""

    what: object = None
    seen: int = 0
    at: float = 0.0


@dataclass
class Speakers(folds._Fold):
    """Gives chunk, speaker (from 0), decision, similarity, lead, threshold for each chunk; see the module for its rows.

    The decisions in their order: *first* and *new* begin a profile; *match* is a sure one, *hold* one of another speaker that waits to come
    again (``folds.Confirmation``); *sticky* stays with the last speaker, for RECENT seconds; *weak* takes the best; *full* too, as there are
    ``most`` speakers; *short* chunks and those that may be a *pending* new speaker stay with the last one."""

    most: int = 4
    source: str = "web"
    profiles: list[Sound] = field(default_factory=list)
    last: int | None = None
    last_at: float = 0.0
    switch: folds.Confirmation = field(default_factory=folds.Confirmation)
    pending: Waiting = field(default_factory=Waiting)

    def step(self, row):
        width = len(self.profiles[0].voice) if self.profiles else None
        if not row.voice or None in row.voice or (width and len(row.voice) != width):
            yield row.chunk, self.last or 0, "kept", None, None, None
            return
        x = Sound.of(row.voice, row.pitch, row.frames, row.mouth, row.mouth_frames)
        x.voice = _unit(x.voice)
        yield row.chunk, *self._told(x, row.at, row.seconds)

    def _told(self, x: Sound, at: float, seconds: float) -> tuple:
        if not self.profiles:
            return *self._begun(x, at, "first"), None, None, None
        s = scores(x, self.profiles, self.last)
        k = int(s.similarity.argmax())
        best, others = float(s.similarity[k]), np.delete(s.similarity, k)
        second = float(others.max(initial=-1.0))
        lead = best - second if second >= 0 else 1.0
        recent = self.last is not None and at - self.last_at <= RECENT
        signals = int(s.far_pitch[k]) + int(s.far_mouth[k]) + int(s.tone[k] >= TONE_SPLIT) if s.same[k] and not s.cross[k] else 0
        threshold = self._threshold(s, k, recent, signals)
        sure = SURE_MORE if signals >= 2 else SURE_ONE
        confident = best >= threshold and (lead >= AMBIGUOUS or best >= STRONG) and (not signals or (best >= STRONG + sure[0] and lead >= AMBIGUOUS + sure[1]))
        blocked = bool(s.cross[k]) and best < CROSS_STRONG
        bounds = best, lead, threshold
        if confident and not blocked:
            if not signals and not self.switch.allows(self.last, k, best, lead, at):
                return self.last, "hold", *bounds
            return self._learned(k, x, at, best, "match"), "match", *bounds
        if recent and not signals and self._sticks(s, best, threshold):
            return self._learned(self.last, x, at, best, "sticky"), "sticky", *bounds
        if not (s.cross[k] or s.far_pitch[k] or s.far_mouth[k] or signals) and best >= threshold - WEAK_MARGIN:
            return self._learned(k, x, at, best, "weak"), "weak", *bounds
        if len(self.profiles) >= self.most:
            return self._learned(k, x, at, best, "full"), "full", *bounds
        if recent and seconds < NEW_SECONDS:
            return self.last, "short", *bounds
        if not (blocked and best < threshold - NEW_INSTANT) and not self._confirmed(x, at, self._needed(s, k, best, lead, threshold, signals), bool(s.far_mouth[k])):
            return self.last, "pending", *bounds
        return *self._begun(x, at, "new"), *bounds

    def _threshold(self, s: Scores, k: int, recent: bool, signals: int) -> float:
        count = self.profiles[k].count
        bonus = KNOWN_BONUS if count >= KNOWN_FROM else YOUNG_BONUS if count < YOUNG_BELOW else 0.0
        told = MATCH - bonus - LAST_BONUS * (recent and self.last == k) - LOW_BONUS * bool(s.low[k]) + CROSS_EXTRA * bool(s.cross[k])
        return max(told, LEAST_THRESHOLD) + FAR_MOUTH_EXTRA * bool(s.far_mouth[k] and not s.cross[k]) + SPLIT_EXTRA * bool(signals)

    def _sticks(self, s: Scores, best: float, threshold: float) -> bool:
        i = self.last
        kept = float(s.similarity[i])
        return not (s.cross[i] or s.far_pitch[i] or s.far_mouth[i]) and kept >= threshold - WEAK_MARGIN and best - kept <= STICKY_MARGIN + STICKY_LOW * bool(s.low[i])

    def _needed(self, s: Scores, k: int, best: float, lead: float, threshold: float, signals: int) -> int:
        """How often a new speaker must be heard."""
        if signals or (best < threshold - NEW_CLEAR and lead >= NEW_CLEAR_GAP):
            return 1
        return NEW_HITS - 1 if self.source == "system" or s.far_pitch[k] or s.far_mouth[k] else NEW_HITS

    def _confirmed(self, x: Sound, at: float, needed: int, far_mouth: bool) -> bool:
        p = self.pending
        if p.what is not None and at - p.at <= NEW_WINDOW and float(_cosine(p.what, x.voice)) >= NEW_SELF - NEW_SELF_FAR * far_mouth:
            self.pending = Waiting(p.what * NEW_KEEP + x.voice * (1 - NEW_KEEP), p.seen + 1, at)
        else:
            self.pending = Waiting(x.voice, 1, at)
        return self.pending.seen >= needed

    def _begun(self, x: Sound, at: float, why: str) -> tuple[int, str]:
        self.profiles.append(x)
        return self._spoke(len(self.profiles) - 1, at), why

    def _learned(self, k: int, x: Sound, at: float, best: float, why: str) -> int:
        if best >= LEARN_FROM:
            self.profiles[k].learn(x, PACE[why])
        self.profiles[k].count += 1
        return self._spoke(k, at)

    def _spoke(self, k: int, at: float) -> int:
        self.last, self.last_at, self.pending = k, at, Waiting()
        self.switch.clear()
        return k


DECISION = "speaker int, decision string, similarity double, lead double, threshold double"


def classified(chunks: DataFrame, key: str, most: int = 4, source: str = "web") -> DataFrame:
    """key, chunk and the decision on each chunk of each meeting, in the order of at and chunk. most: speakers of a meeting, 2 to 12."""
    most = max(2, min(most, 12))
    kind = lambda c: chunks.schema[c].dataType.simpleString()
    return folds.fold(chunks, [key], ["at", "chunk"], lambda: Speakers(most, source), f"{key} {kind(key)}, chunk {kind('chunk')}, {DECISION}")


def scored(chunks: DataFrame, profiles: DataFrame, key: str, sessions: DataFrame | None = None) -> DataFrame:
    """key, chunk, speaker, similarity, lead, threshold, sure of each chunk against its meeting's profiles, which stay as they are: the best
    one if it is sure; else the last speaker (sessions: key, last, last_at), if recent and near enough; else the best.

    profiles: key, id, voice, stats, frames, mouth, mouth_frames, count. Those of one meeting, a dozen, are joined to its
    chunks as one array, so a chunk is scored within its row and nothing is shuffled by chunk. A chunk of a meeting without
    profiles has speaker 0 and nulls; one without a voice has the last speaker or 0."""
    heads = profiles.groupBy(F.col(key).alias("own")).agg(F.array_sort(F.collect_list(F.struct("id", "voice", "stats", "frames", "mouth", "mouth_frames", "count"))).alias("heads"))
    rows = chunks.join(heads, F.col(key).eqNullSafe(F.col("own")), "left").drop("own")
    if sessions is None:
        rows = rows.withColumn("last", F.lit(None).cast("int")).withColumn("last_at", F.lit(None).cast("double"))
    else:
        rows = rows.join(sessions.select(F.col(key).alias("own"), "last", "last_at"), F.col(key).eqNullSafe(F.col("own")), "left").drop("own")
    recent = F.coalesce(F.col("at") - F.col("last_at") <= RECENT, F.lit(False))
    rows = rows.withColumn("told", F.when(F.size("voice") > 0, F.array_sort(F.transform("heads", lambda p: _score(p, recent)))))
    one, two = F.get("told", F.lit(0)), F.get("told", F.lit(1))
    best, second = -one["minus"], F.coalesce(-two["minus"], F.lit(-1.0))
    lead = F.when(second >= 0, best - second).otherwise(1.0)
    sure = lambda by: (best >= STRONG + by[0]) & (lead >= AMBIGUOUS + by[1])
    confident = (best >= one["threshold"]) & ((lead >= AMBIGUOUS) | (best >= STRONG)) & ~(one["cross"] & (best < CROSS_STRONG))
    confident = confident & F.when(one["signals"] == 0, True).when(one["signals"] == 1, sure(SURE_ONE)).otherwise(sure(SURE_MORE))
    mine = F.get(F.filter("told", lambda s: s["id"] == F.col("last")), F.lit(0))
    sticks = recent & (-mine["minus"] >= one["threshold"] - WEAK_MARGIN)
    speaker = F.when(confident, one["id"]).when(F.coalesce(sticks, F.lit(False)), F.col("last")).otherwise(F.coalesce(one["id"], "last", F.lit(0)))
    return rows.select(key, "chunk", speaker.alias("speaker"), best.alias("similarity"), F.when(one.isNotNull(), lead).alias("lead"), one["threshold"].alias("threshold"), confident.alias("sure"))


def _score(p: Column, recent: Column) -> Column:
    """A profile's score, the nearest first: minus its similarity, id, and what its threshold depends on."""
    own = F.col("pitch")
    f0, mine, frames = F.nanvl(p["stats"][MEAN], F.lit(None)), F.nanvl(own[MEAN], F.lit(None)), F.least(p["frames"], F.col("frames"))
    zone, apart = T.pitch_zone(f0), F.abs(f0 - mine)
    heard = F.coalesce(apart.isNotNull() & (p["frames"] >= T.FRAMES) & (F.col("frames") >= T.FRAMES), F.lit(False))
    same = F.coalesce((zone == T.pitch_zone(mine)) & zone.isin("male", "female"), F.lit(False))
    cross = heard & T.cross_gender(f0, mine)
    pitch = apart / PITCH_WIDTH * PITCH_FACTOR * F.when((f0 >= T.FEMALE) & (mine >= T.FEMALE), PITCH_HIGH).otherwise(1.0) + F.when(cross, CROSS_PENALTY).otherwise(T.soft_penalty(f0, mine))
    gap = lambda i: F.coalesce(F.abs(F.nanvl(p["stats"][i], F.lit(None)) - F.nanvl(own[i], F.lit(None))), F.lit(0.0))
    span = F.abs((p["stats"][P90] - p["stats"][P10]) - (own[P90] - own[P10]))
    span = F.coalesce(F.nanvl(span, F.lit(None)), F.lit(0.0))
    tone = F.when(same & ~cross, F.coalesce(T.tone_penalty(gap(MEDIAN), span, gap(DELTA), frames), F.lit(0.0)) * F.when(zone == "male", TONE_LOW).otherwise(1.0)).otherwise(0.0)
    both = (p["mouth_frames"] >= MOUTH_FRAMES) & (F.col("mouth_frames") >= MOUTH_FRAMES)
    mouth = F.when(both, V.distance(F.col("mouth"), p["mouth"]))
    is_last = F.coalesce(p["id"] == F.col("last"), F.lit(False))
    scale = F.when(same & (zone == "male"), MOUTH_MALE).when(same & (zone == "female"), MOUTH_FEMALE).otherwise(1.0) * F.when(is_last, MOUTH_LAST).otherwise(1.0)
    by_mouth = F.when(mouth <= MOUTH_CLOSE, MOUTH_BOOST * F.when(is_last, MOUTH_BOOST_LAST).otherwise(1.0)).when(mouth >= MOUTH_FAR, -F.least((mouth - MOUTH_FAR) * MOUTH_SCALE * scale, F.lit(MOUTH_MOST))).otherwise(0.0)
    similarity = V.cosine(F.col("voice"), p["voice"]) - F.when(heard, F.least(pitch, F.lit(PITCH_MOST))).otherwise(0.0) - tone + by_mouth
    far_pitch, far_mouth = T.far_in_zone(mine, F.col("frames"), f0, p["frames"]), F.coalesce(same & (mouth >= MOUTH_FAR), F.lit(False))
    signals = F.when(same & ~cross, far_pitch.cast("int") + far_mouth.cast("int") + (tone >= TONE_SPLIT).cast("int")).otherwise(0)
    low = F.coalesce((f0 < T.FEMALE) & (mine < T.FEMALE), F.lit(False))
    when = lambda ok, amount: F.when(ok, amount).otherwise(0.0)
    bonus = F.when(p["count"] >= KNOWN_FROM, KNOWN_BONUS).when(p["count"] < YOUNG_BELOW, YOUNG_BONUS).otherwise(0.0)
    threshold = F.greatest(MATCH - bonus - when(recent & is_last, LAST_BONUS) - when(low, LOW_BONUS) + when(cross, CROSS_EXTRA), F.lit(LEAST_THRESHOLD)) + when(far_mouth & ~cross, FAR_MOUTH_EXTRA) + when(signals > 0, SPLIT_EXTRA)
    return F.struct((-similarity).alias("minus"), p["id"].alias("id"), threshold.alias("threshold"), signals.alias("signals"), cross.alias("cross"))
