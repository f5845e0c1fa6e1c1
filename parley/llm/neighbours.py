"""Approximate nearest neighbours by query-aware collision counting.

Every vector is projected on M random lines, and each line keeps its projections as one sorted
array. A query opens a window around its own projection on every line; a vector inside it collides.
Vectors that collide on at least SHARE of the lines are verified by their exact inner product.
Where too few do, all windows grow by a factor (virtual rehashing) and are counted again. The counts
are made from the two ends of the sorted arrays outside the windows, which are the shorter part.

Largest inner product becomes smallest distance by one more dimension that brings all vectors to the
norm of the longest (Neyshabur and Srebro 2015).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.scratch import Scratch

LINES, SHARE, WIDTH, GROW = 128, 0.9, 1.0, 1.08
#: The windows grow until this share of a block and MANY times the neighbours asked for are verified.
VERIFIED, MANY = 0.1, 15
#: A block of vectors and a chunk of queries meet in one task, which builds the block's index; chunks are large,
#: so that blocks are copied and indexed seldom. Where that gives fewer tasks than cores, chunks are smaller.
BLOCK, CHUNK, CHUNK_LEAST, SEED = 16_384, 65_536, 256, 13


class Index:
    """Sorted projections of a block of vectors, none longer than ``longest``."""

    def __init__(self, vectors: np.ndarray, longest: float):
        self.vectors = vectors
        unit = vectors / longest
        lift = np.sqrt(np.maximum(0, 1 - (unit**2).sum(1)))
        self.lines = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, LINES))
        placed = (np.hstack([unit, lift[:, None]]) @ self.lines).T
        self.order = np.argsort(placed, 1).astype(np.int32)
        self.sorted = np.take_along_axis(placed, self.order, 1)
        self.level = 8

    def _near(self, at: np.ndarray, level: int) -> np.ndarray:
        """The vectors that collide with a query often enough at a level."""
        width = WIDTH * GROW**level
        n = len(self.vectors)
        ends = []
        for own, order, p in zip(self.sorted, self.order, at):
            ends += [order[: np.searchsorted(own, p - width)], order[np.searchsorted(own, p + width, "right") :]]
        missed = np.bincount(np.concatenate(ends), minlength=n)
        return np.flatnonzero(missed <= (1 - SHARE) * LINES)

    def candidates(self, query: np.ndarray, wanted: int) -> np.ndarray:
        n = len(self.vectors)
        least = min(n, int(np.ceil(max(MANY * wanted, VERIFIED * n))))
        at = np.append(query / np.sqrt((query**2).sum()), 0) @ self.lines
        found = self._near(at, self.level)
        while len(found) >= 2 * least and self.level > 0:  # the level follows the last query's, down while far more is found than needed
            lower = self._near(at, self.level - 1)
            if len(lower) < least:
                break
            self.level, found = self.level - 1, lower
        while len(found) < least:
            self.level += 1
            found = self._near(at, self.level)
        return found

    def search(self, query: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and inner products of the k best verified vectors but the query's own, ties to smaller ids."""
        at = self.candidates(query, k + 1)
        at = at[ids[at] != own]
        rough = self.vectors[at] @ query
        if len(at) > k:
            kept = rough >= np.partition(rough, -k)[-k] - 1e-9 * max(1.0, np.abs(rough).max())
            at = at[kept]
        exact = np.zeros(len(at))
        for j in range(len(query)):  # one order of summation for all, so that equal vectors tie
            exact += self.vectors[at, j] * query[j]
        best = np.lexsort((ids[at], -exact))[:k]
        return ids[at[best]], exact[best]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every`` the k vectors of the largest
    inner product found, of all but its own.

    Vectors that are null, empty, zero, of another length than most (of two equally frequent lengths the
    shorter counts), or hold a null or non-finite component take no part, nor do null ids. An id that repeats counts once, with its least
    vector. Fewer than k candidates give fewer rows, an empty table none; other columns are ignored.
    Tasks hold BLOCK vectors and CHUNK queries at most, whatever the table's size.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    rows = scratch.save(rows.groupBy("id").agg(F.min("v").alias("v")))
    lengths = rows.groupBy(F.size("v").alias("width")).agg(
        F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest"), F.sum((F.col("id") % every == 0).cast("long")).alias("asked")
    )
    usual = lengths.orderBy(F.desc("n"), "width").first()
    schema = "query_id long, vec_id long, score double"
    if not usual or not usual.asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n, longest, asked = usual
    rows = rows.where(F.size("v") == width)
    blocks = -(-n // BLOCK)
    chunks = max(-(-asked // CHUNK), min(-(-spark.sparkContext.defaultParallelism // blocks), -(-asked // CHUNK_LEAST)))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    base = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), numbers(chunks).alias("chunk"))
    asks = rows.where(F.col("id") % every == 0).select("id", "v", numbers(blocks).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"))
    longest = float(np.sqrt(longest))

    def search(block: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(block) and len(chunk):
            block = block.sort_values("id")
            ids, index = block["id"].to_numpy(), Index(np.stack(block["v"].to_list()), longest)
            for own, query in zip(chunk["id"], chunk["v"]):
                found, score = index.search(np.asarray(query), ids, own, k)
                out.append(pd.DataFrame({"query_id": own, "vec_id": found, "score": score}))
        return pd.concat(out)

    found = base.groupBy("block", "chunk").cogroup(asks.groupBy("block", "chunk")).applyInPandas(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
