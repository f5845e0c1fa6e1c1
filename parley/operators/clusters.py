"""Speakers of a meeting by average-linkage clustering of its chunks' embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Chunks of the longest meeting that is recorded (4 hours), with room: a task holds its distances.
CHUNKS_MOST = 4_000


def average_linkage(distance: np.ndarray, most: float) -> np.ndarray:
    """Labels of rows: the two nearest clusters are merged while their mean distance is at most ``most``."""
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(len(d)), np.arange(len(d)), np.ones(len(d), bool)
    while alive.sum() > 1:
        a, b = divmod(int(d.argmin()), len(d))
        if d[a, b] > most:
            break
        a, b = min(a, b), max(a, b)
        mean = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = mean, mean
        d[b], d[:, b], d[a, a] = np.inf, np.inf, np.inf
        size[a] += size[b]
        alive[b] = False
        label[label == b] = a
    return label


def speakers(chunks: DataFrame, meeting: str, order: str, embedding: str, distance: float = 0.4, most: int = 10) -> DataFrame:
    """meeting, order, speaker of every chunk with an embedding: clusters by cosine distance, numbered from 0 by
    their first chunk; those beyond ``most`` count to the last number. A zero vector is at distance 1 from all.
    A meeting has at most CHUNKS_MOST chunks: more are an error, not cut off."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > CHUNKS_MOST:
            raise ValueError(f"a meeting of {len(frame)} chunks")
        frame = frame.sort_values(order)
        x = np.array([np.asarray(v, float) for v in frame[embedding]])
        norm = np.sqrt((x**2).sum(1))
        x = np.where(norm[:, None] < 1e-8, 0, x / np.maximum(norm, 1e-8)[:, None])
        label = average_linkage(1 - x @ x.T, distance)
        rank: dict[int, int] = {}
        number = [min(rank.setdefault(int(k), len(rank)), most - 1) for k in label]
        return pd.DataFrame({meeting: frame[meeting], order: frame[order], "speaker": number})

    kinds = {c: chunks.schema[c].dataType.simpleString() for c in (meeting, order)}
    return chunks.select(meeting, order, embedding).where(f"{embedding} is not null").groupBy(meeting).applyInPandas(run, f"{meeting} {kinds[meeting]}, {order} {kinds[order]}, speaker int")
