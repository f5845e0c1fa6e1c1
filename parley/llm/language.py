"""Multilingual mixture inference.

Each language has a smoothed distribution over hashed character trigrams. A document is a mixture
of languages whose proportions expectation-maximisation fits to its trigrams; the set of languages
is the one of the highest penalised likelihood (a BIC penalty for each language), found by adding
languages in the order of their share in the full mixture.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents a language is learned from, about: the bound of the labelled sample.
TRAIN_DOCS = 5_000
BUCKETS, SMOOTHING = 1 << 16, 0.5
#: Expectation-maximisation ends for a document when no share moves by more; penalty for each language.
TOLERANCE, PENALTY = 1e-3, 1.0
SLICE_CHARS = 300_000


@cache
def _letters() -> np.ndarray:
    """Is a code point a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each distinct trigram, its bucket, its count), some whole texts at a
    time. Letters are lower-cased, a run of anything else is one space; three spaces are no trigram."""
    first = 0
    while first < len(texts):
        end, chars, parts = first, 0, []
        while end < len(texts) and (end == first or chars + len(texts[end] or "") <= SLICE_CHARS):
            parts.append(f" {(texts[end] or '').lower()} ")
            chars += len(parts[-1])
            end += 1
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
        rows = np.repeat(np.arange(end - first), [len(p) for p in parts])
        letter = _letters()[np.minimum(codes, 0x10FFFF)]
        codes = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
        kept = letter.copy()
        kept[1:] |= letter[:-1]  # the first space behind a letter stays
        kept[np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))] = True  # and the one before a text
        codes, rows, letter = codes[kept], rows[kept], letter[kept]
        if len(codes) > 2:
            h = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(32)
            same = (rows[:-2] == rows[2:]) & letter[1:-1]
            key, count = np.unique((rows[:-2][same].astype(np.int64) << 16) | (h[same] & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
            yield first, end, key >> 16, key & (BUCKETS - 1), count
        else:
            yield first, end, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = end


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", train_docs: int = TRAIN_DOCS, id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and log P(bucket | language) as an array of buckets by languages.

    About train_docs documents of each language are read, chosen by a hash of their id.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    share = F.least(F.lit(1.0), F.lit(float(train_docs)) / F.count("*")).alias("share")
    shares = rows.groupBy("lang").agg(share)
    sample = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(10**6)) < F.col("share") * 10**6)

    def counted(frames):
        total: dict[str, np.ndarray] = {}
        for f in frames:
            for lang, own in f.groupby("lang"):
                for _, _, _, bucket, count in trigrams(own["text"].tolist()):
                    total.setdefault(lang, np.zeros(BUCKETS))
                    total[lang] += np.bincount(bucket, count, BUCKETS)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": counts[at].astype(np.int64)})

    found = sample.select("lang", "text").mapInPandas(counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.full((BUCKETS, len(langs)), SMOOTHING)
    for k, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        counts[own["bucket"], k] += own["n"]
    return langs, np.log(counts / counts.sum(0)).astype(np.float32)


def _mixture(like: np.ndarray, count: np.ndarray, starts: np.ndarray, row: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages in each document, and the log-likelihood of its mixture
    (without the part that is the same for every mixture). Documents leave the rounds as they converge."""
    share = allowed / allowed.sum(1, keepdims=True)
    total = np.add.reduceat(count, starts)[:, None]
    live, x, c, at, of = np.arange(len(starts)), like, count, starts, row
    while len(live):
        own = share[live]
        mixed = x * own[of]
        new = np.add.reduceat(mixed * (c / mixed.sum(1))[:, None], at) / total[live]
        share[live] = new
        moves = np.abs(new - own).max(1) > TOLERANCE
        if not moves.any():
            break
        if moves.mean() < 0.7:
            kept, sizes = moves[of], np.diff(np.append(at, len(x)))[moves]
            live, x, c, at, of = live[moves], x[kept], c[kept], np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    return share, np.add.reduceat(np.log((like * share[row]).sum(1)) * count, starts)


def infer(texts: list[str | None], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents by languages; 0 outside the chosen set) and which documents have letters."""
    out, seen = np.zeros((len(texts), model.shape[1])), np.zeros(len(texts), bool)
    k = model.shape[1]
    for first, _, rows, bucket, count in trigrams(texts):
        if not len(rows) or not k:
            continue
        docs, starts = np.unique(rows, return_index=True)
        row = np.repeat(np.arange(len(docs)), np.diff(np.append(starts, len(rows))))
        logs = model[bucket]
        like = np.exp(logs - logs.max(1, keepdims=True))
        count = count.astype(np.float32)
        total = np.add.reduceat(count, starts)
        full, _ = _mixture(like, count, starts, row, np.ones((len(docs), k), np.float32))
        order = np.argsort(-full, 1, kind="stable")
        single = np.add.reduceat(np.log(np.maximum(like, 1e-30)) * count[:, None], starts)
        best, best_share = single.max(1), np.eye(k)[single.argmax(1)]
        best = best - PENALTY * np.log(total + 1) / 2
        # three languages are always tried; from then on a set grows while its likelihood does
        still = np.ones(len(docs), bool)
        for size in range(2, k + 1):
            own = still[row]
            if not still.any():
                break
            allowed = np.zeros((int(still.sum()), k), np.float32)
            np.put_along_axis(allowed, order[still][:, :size], 1, 1)
            parts = np.diff(np.append(starts, len(rows)))[still]
            share, fit = _mixture(like[own], count[own], np.cumsum(parts) - parts, np.repeat(np.arange(len(parts)), parts), allowed)
            fit = fit - PENALTY * (2 * size - 1) * np.log(total[still] + 1) / 2
            better, at = fit > best[still], np.flatnonzero(still)
            best[at[better]], best_share[at[better]] = fit[better], share[better]
            if size > 2:
                still[at[~better]] = False
        out[first + docs] = best_share
        seen[first + docs] = True
    return out, seen


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, mixture for every row: the language of the largest share, its share,
    and every language of the chosen set with its share, largest first.

    Null and empty texts and texts without a letter are ``und`` with score 0 and an empty mixture; so
    is everything if no language was learned. Ties go to the first language by code point. Repeated
    rows get equal results, one each; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches):
        langs, table = given.value
        for b in batches:
            share, seen = infer(b.column(1).to_pylist(), table)
            best = share.argmax(1) if len(langs) else np.zeros(len(b), int)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([langs[k] if s else "und" for k, s in zip(best, seen)], pa.string()),
                    pa.array(np.where(seen, share[np.arange(len(b)), best], 0.0).clip(0, 1) if len(langs) else np.zeros(len(b))),
                    pa.array([[{"lang": langs[k], "share": float(r[k])} for k in np.argsort(-r, kind="stable") if r[k] > 0] for r in share], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
                ],
                names=["doc_id", "lang_pred", "score", "mixture"],
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(rows, f"doc_id {kind}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")
