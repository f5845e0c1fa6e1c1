"""Toxicity by a subsequence string kernel with Nyström landmarks and a linear support vector machine.

The kernel of two words counts their common subsequences of three letters, each weighted by
DECAY ** (the span it takes in a word), over spans of SPAN characters at most, normalised by the
words' own kernels. Characters other than letters and digits match nothing but widen spans, so
``i.d.i.o.t`` and ``idxiot`` stay near ``idiot``. Values below NEAR count as 0, the others are taken to
the power SHARPEN; a sentence's kernel with a landmark is the sum of its words' values.

Landmarks are chosen greedily: the word whose kernel neighbourhood tells most about the labels comes
first, then what its neighbourhood explains is taken off and the next one is chosen. So words of one
stem add up, and every family of insults gets landmarks, whatever its language and however rare it is.
The Nyström map K^(-1/2) turns kernel values into features of the support vector machine, which learns
from sentences: all of toxic documents that are near a landmark against all of clean documents. Equal
ones are counted, not repeated; each Newton step adds up its equations in tasks, and only their sum, of a
size that the landmarks bound, comes to the driver. A document's probability follows from its sentences' decision values: the highest, and their positive
sum, alone and against the document's length (a logistic fit on the labelled documents).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.scratch import Scratch

#: About so many labelled documents are learned from: the bound of the sample.
TRAIN_DOCS = 20_000
#: The rank of the Nyström map, and the words of the sample that landmarks are chosen from, by their gain.
LANDMARKS, CANDIDATES = 128, 1_500
#: The log-likelihood gain that a landmark's neighbourhood must have.
GAIN_LEAST = 10.0
DECAY, SPAN, SHARPEN, NEAR = 0.9, 7, 4, 0.45
#: The machine's cost of an error, its Newton steps at most, and the tasks that share the sample.
COST, STEPS, TASKS = 10.0, 50, 64
#: Words whose scores a task keeps at once; more are scored again.
CACHE = 200_000
#: Characters of texts whose words are scored together; a longer text stands alone.
CHARS = 400_000

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+|\s\|\s")
_SPACED = re.compile(r"(?<!\S)(?:\w[.\-_*]?\s){2,}\w[.,!?]*(?!\S)")


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence, lower-cased; letters spelled out one by one are one word."""
    if not text:
        return []
    text = text.lower()
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: "".join(m[0].split()), text)
    return [words for s in _SENTENCE.split(text) if s and (words := s.split())]


@cache
def _plain() -> np.ndarray:
    """Is a code point a letter or digit?"""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def _occurrences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence code, weight) of every subsequence of three letters within SPAN, repeated ones too."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
    plain = _plain()[codes]
    keys, owners, weights = [], [], []
    for b in range(2, SPAN):
        n = len(codes) - b
        if n <= 0:
            break
        ends = np.flatnonzero((of[:n] == of[b:]) & plain[:n] & plain[b:])
        outer, owner = (codes[ends] << np.uint64(42)) | codes[ends + b], of[ends]
        for a in range(1, b):
            inner = plain[ends + a]
            whole = inner.all()
            keys.append((outer if whole else outer[inner]) | (codes[(ends if whole else ends[inner]) + a] << np.uint64(21)))
            owners.append(owner if whole else owner[inner])
            weights.append(np.full(len(keys[-1]), DECAY ** (b + 1)))
    if not keys:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0)
    return np.concatenate(owners), np.concatenate(keys), np.concatenate(weights)


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with one row for each distinct subsequence of a word, its weights added."""
    owner, key, weight = _occurrences(words)
    if not len(key):
        return owner, key, weight
    order = np.lexsort((key, owner))
    key, owner, weight = key[order], owner[order], weight[order]
    at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))))
    return owner[at], key[at], np.add.reduceat(weight, at)


def _norms(words: list[str]) -> np.ndarray:
    owner, _, weight = _features(words)
    return np.sqrt(np.bincount(owner, weight**2, len(words)))


class Kernel:
    """Normalised kernels of words with the landmarks: below NEAR 0, else to the power SHARPEN."""

    BITS = 18

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        owner, key, weight = _features(landmarks)
        weight = weight / np.sqrt(np.bincount(owner, weight**2, len(landmarks)))[owner]
        order = np.argsort(key, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.keys, self.first = np.unique(key[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(key)))
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[self._place(self.keys)] = True

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def __call__(self, words: list[str]) -> np.ndarray:
        most = len(self.landmarks)
        out = np.zeros((len(words), most))
        if not words or not len(self.keys):
            return out
        owner, key, weight = _occurrences(words)
        # the squares of single occurrences bound a word's norm from below: most words are too far already by that
        least = np.sqrt(np.bincount(owner, weight**2, len(words)))
        hit = np.flatnonzero(self.seen[self._place(key)])
        at = np.minimum(np.searchsorted(self.keys, key[hit]), len(self.keys) - 1)
        same = self.keys[at] == key[hit]
        hit, at = hit[same], at[same]
        count = self.count[at]
        posted = np.repeat(self.first[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        pair = np.repeat(owner[hit].astype(np.int64) * most, count) + self.owner[posted]
        dot = np.bincount(pair, np.repeat(weight[hit], count) * self.weight[posted], len(words) * most).reshape(-1, most)
        near = np.flatnonzero(dot.max(1) >= NEAR * least * (1 - 1e-9))
        near = near[least[near] > 0]
        if len(near):
            found = dot[near] / _norms([words[k] for k in near])[:, None]
            out[near] = np.where(found < NEAR, 0, found) ** SHARPEN
        return out


class Scorer:
    """Decision values of sentences under weights for the landmarks; words are scored once while they are kept."""

    def __init__(self, kernel: Kernel, weights: np.ndarray):
        self.kernel, self.weights, self.known = kernel, weights, {}

    def words(self, wanted: set[str]) -> dict[str, float]:
        new = [w for w in wanted if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = list(wanted)
        for i in range(0, len(new), 2_000):
            part = new[i : i + 2_000]
            self.known.update(zip(part, (self.kernel(part) @ self.weights).tolist()))
        return self.known

    def sentences(self, texts: Iterable[str | None]) -> Iterator[list[tuple[float, list[str]]]]:
        """For each text its sentences and their decision values, in order."""
        held, chars = [], 0
        for text in texts:
            held.append(sentences(text))
            chars += len(text or "")
            if chars >= CHARS:
                yield from self._told(held)
                held, chars = [], 0
        yield from self._told(held)

    def _told(self, held: list[list[list[str]]]) -> Iterator[list[tuple[float, list[str]]]]:
        score = self.words({w for found in held for s in found for w in s}).__getitem__
        for found in held:
            yield [(sum(map(score, s)), s) for s in found]


def features(told: list[tuple[float, list[str]]]) -> tuple[float, float, float, float]:
    """What a document's probability follows from: the highest decision value of a sentence, the logarithm of
    the sum of positive ones, that of the number of words, and the sum to a number of words."""
    words = sum(len(s) for _, s in told)
    total = sum(v for v, _ in told if v > 0)
    return max([v for v, _ in told], default=0.0), math.log1p(total), math.log1p(words), total / (words + 20) * 20


def _fit_svm(vectors: DataFrame, root: np.ndarray, empty: int, cost: float) -> np.ndarray:
    """A linear support vector machine with squared hinge loss, by Newton steps on its active set. vectors: toxic, at, value (a sparse kernel
    row), n (how often it occurs); empty: rows of clean documents without any kernel value."""
    count = {bool(r.toxic): r.n for r in vectors.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    yes, no = count.get(True, 0), count.get(False, 0) + empty
    costs = {k: cost * (yes + no) / (2 * max(1, c)) for k, c in ((True, yes), (False, no))}
    size = len(root)
    ridge = np.diag([1.0] * size + [1e-6])
    w = np.zeros(size + 1)
    for step in range(STEPS):

        def added(batches, w=w):
            total = np.zeros((size + 1, size + 2))
            for batch in batches:
                toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
                n, lengths = batch.column("n").to_numpy(zero_copy_only=False), np.diff(batch.column("at").offsets.to_numpy())
                at, value = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "value"))
                ends = np.cumsum(lengths)
                for i in range(0, len(toxic), 5_000):
                    j = min(i + 5_000, len(toxic))
                    lo, hi = ends[i] - lengths[i], ends[j - 1]
                    x = np.zeros((j - i, size))
                    x[np.repeat(np.arange(j - i), lengths[i:j]), at[lo:hi]] = value[lo:hi]
                    z = np.hstack([x @ root, np.ones((j - i, 1))])
                    sign = np.where(toxic[i:j], 1.0, -1.0)
                    on = sign * (z @ w) < 1
                    z, share = z[on], (np.where(toxic[i:j], costs[True], costs[False]) * n[i:j])[on]
                    total[:, :-1] += (z * share[:, None]).T @ z
                    total[:, -1] += z.T @ (share * sign[on])
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

        total = sum(np.array(r.sums).reshape(size + 1, size + 2) for r in vectors.select("toxic", "at", "value", "n").mapInArrow(added, "sums array<double>").toLocalIterator())
        left, right = total[:, :-1] + ridge, total[:, -1].copy()
        if -w[-1] < 1:
            left[-1, -1] += costs[False] * empty
            right[-1] -= costs[False] * empty
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-9):
            break
        w = 0.5 * w + 0.5 * new if step > 20 else new
    return w[:-1]


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and, last, the constant of a logistic regression (Platt's smoothed labels), by Newton steps.

    The classes weigh the same, so that a probability of one half is the line between them."""
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    z = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y <= 0).sum())))
    ridge = 1e-2 * np.eye(z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (share * (t - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return w


def _gain(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Signed likelihood ratio: how far a rate in toxic sentences is above that in others (0: not above)."""
    rate = (toxic + clean) / (n_toxic + n_clean)
    gain = toxic * np.log((toxic + 0.5) / (rate * n_toxic + 0.5)) + clean * np.log((clean + 0.5) / (rate * n_clean + 0.5))
    return np.where(toxic * n_clean > clean * n_toxic, gain, 0.0)


def choose_landmarks(words: list[str], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, most: int = LANDMARKS) -> list[str]:
    """The words whose kernel neighbourhoods tell most about the labels, each after what those before explain."""
    told = np.unique(_features(words)[0]) if words else np.zeros(0, int)
    words, toxic, clean = [words[k] for k in told], toxic[told].astype(float), clean[told].astype(float)
    if not words:
        return []
    near = np.zeros((len(words), len(words)), np.float32)
    for i in range(0, len(words), 100):
        near[:, i : i + 100] = Kernel(words[i : i + 100])(words)
    out: list[int] = []
    while len(out) < most:
        gain = _gain(near @ toxic, near @ clean, n_toxic, n_clean)
        gain[out] = 0
        best = int(gain.argmax())
        if gain[best] < GAIN_LEAST:
            break
        out.append(best)
        toxic *= 1 - near[best]
        clean *= 1 - near[best]
    return [words[k] for k in out]


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS):
    """(landmarks, weight of each landmark's kernel, weights of the document's features): what score() needs.

    About train_docs rows with a label and a text are learned from, chosen by a hash of their id.
    With no row of either class the model gives every text a score near 0.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("toxic"))
    scratch = Scratch(spark)
    share = min(1.0, train_docs / max(1, rows.count()))
    sample = scratch.save(rows.where(F.pmod(F.xxhash64("id", F.lit(6)), F.lit(10**6)) < share * 10**6).select("text", "toxic").repartition(min(TASKS, spark.sparkContext.defaultParallelism)))

    # a sentence is one example however many documents share it, and clean if any of these is
    def told(frames):
        for f in frames:
            seen: dict[str, int] = {}
            for text, toxic in zip(f["text"], f["toxic"]):
                for s in sentences(text):
                    s = " ".join(s)
                    seen[s] = min(seen.get(s, 1), int(toxic > 0))
            yield pd.DataFrame(seen.items(), columns=["sentence", "toxic"])

    def counted(frames):
        for f in frames:
            seen: dict[str, list[int]] = {}
            for s, toxic in zip(f["sentence"], f["toxic"]):
                for w in {w.strip(".,;:!?\"'()") for w in s.split()}:
                    seen.setdefault(w, [0, 0])[int(toxic)] += 1
            yield pd.DataFrame([(w, c, t) for w, (c, t) in seen.items()], columns=["word", "clean", "toxic"])

    distinct = scratch.save(sample.mapInPandas(told, "sentence string, toxic int").groupBy("sentence").agg(F.min("toxic").alias("toxic")))
    n = {bool(r.toxic): r["count"] for r in distinct.groupBy("toxic").count().collect()}
    none = [], np.zeros(0), np.array([0.0, 0.0, 0.0, 0.0, -30.0])
    if len(n) < 2:
        scratch.drop(sample, distinct)
        return none
    words = distinct.mapInPandas(counted, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("length(word) > 2 and toxic > 0")
    rate = (F.col("clean") + F.col("toxic")) / (n[True] + n[False])
    gain = F.col("toxic") * F.log((F.col("toxic") + 0.5) / (rate * n[True] + 0.5)) + F.col("clean") * F.log((F.col("clean") + 0.5) / (rate * n[False] + 0.5))
    gain = F.when(F.col("toxic") * n[False] > F.col("clean") * n[True], gain).otherwise(0.0)
    best = words.withColumn("gain", gain).orderBy(F.desc("gain"), "word").limit(CANDIDATES).select("word", "clean", "toxic").toPandas()
    landmarks = choose_landmarks(best["word"].tolist(), best["toxic"].to_numpy(), best["clean"].to_numpy(), n[True], n[False])
    if not landmarks:
        scratch.drop(sample, distinct)
        return none
    kernel = Kernel(landmarks)
    given = spark.sparkContext.broadcast(kernel)

    # a row for each sentence near a landmark, with its kernel values that are not 0; one without values for a document's other sentences
    def kernels(batches):
        kernel = given.value
        scorer = Scorer(kernel, np.ones(len(kernel.landmarks)))
        for batch in batches:
            out, known = [], {}
            texts = (x.as_py() for x in batch.column("text"))
            for row, toxic, found in zip(batch.column("row").to_pylist(), batch.column("toxic").to_pylist(), scorer.sentences(texts)):
                words = sum(len(s) for _, s in found)
                close = [s for v, s in found if v > 0]
                new = sorted({w for s in close for w in s if w not in known and scorer.words({w})[w] > 0})
                known.update(zip(new, kernel(new)))
                if len(known) > CACHE // 10:
                    known = {w: known[w] for s in close for w in s if w in known}
                if len(found) > len(close) or not close:
                    out.append((row, toxic, words, None, None))
                for s in close:
                    k = sum(known[w] for w in s if w in known)
                    at = np.flatnonzero(k)
                    out.append((row, toxic, words, at.tolist(), k[at].tolist()))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64())))], ["row", "toxic", "words", "at", "value"])

    numbered = scratch.save(sample.withColumn("row", F.monotonically_increasing_id()))
    told = scratch.save(numbered.mapInArrow(kernels, "row long, toxic int, words long, at array<int>, value array<double>"))
    vectors = scratch.save(told.where("at is not null").groupBy((F.col("toxic") > 0).cast("int").alias("toxic"), "at", "value").agg(F.count("*").alias("n")).coalesce(TASKS))
    values, axes = np.linalg.eigh(kernel(kernel.landmarks))
    root = axes @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ axes.T
    weights = root @ _fit_svm(vectors, root, told.where("at is null and toxic <= 0 and words > 0").count(), COST)
    own = F.array(*map(F.lit, weights.tolist()))
    value = F.aggregate(F.zip_with("at", "value", lambda i, v: F.get(own, i) * v), F.lit(0.0), lambda s, x: s + x)
    value = F.when(F.col("at").isNull(), 0.0).otherwise(value)
    docs = told.select("row", "toxic", "words", value.alias("v")).groupBy("row").agg(F.max("toxic").alias("toxic"), F.max("words").alias("words"), F.max("v").alias("best"), F.sum(F.greatest("v", F.lit(0.0))).alias("total")).drop("row").toPandas()
    given.destroy()
    scratch.drop(sample, distinct, numbered, told, vectors)
    words, total = docs["words"].to_numpy(float), docs["total"].to_numpy()
    return landmarks, weights, _fit_logistic(np.stack([docs["best"].to_numpy(), np.log1p(total), np.log1p(words), total / (words + 20) * 20], 1), docs["toxic"].to_numpy() > 0)


def score_batch(texts: Iterable[str | None], scorer: Scorer, document: np.ndarray) -> np.ndarray:
    x = np.array([features(told) for told in scorer.sentences(texts)], float).reshape(-1, 4)
    return 1 / (1 + np.exp(-np.clip(x @ document[:-1] + document[-1], -30, 30)))


def _scorer(model) -> Scorer:
    return Scorer(Kernel(model[0]) if model[0] else (lambda words: np.zeros((len(words), 0))), model[1])


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row.

    Null, empty and wordless texts get the score of a text without any toxic word. Repeated rows
    get equal scores, one each; other columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches):
        scorer = _scorer(model)
        for batch in batches:
            texts = (x.as_py() for x in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_batch(texts, scorer, model[2]))], names=["doc_id", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(rows, f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score below the threshold, whole and in one pass."""
    at = docs.columns.index(text_col)

    def rows(batches):
        scorer = _scorer(model)
        for batch in batches:
            texts = (x.as_py() for x in batch.column(at))
            yield batch.filter(pa.array(score_batch(texts, scorer, model[2]) < threshold))

    return docs.mapInArrow(rows, docs.schema)
