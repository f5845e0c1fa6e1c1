"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets are filled in blocks of equally many words. The blocks go to the sources, and each
source's blocks to its shards, by the highest quotients votes / (2 * seats + 1). A shard orders
its documents by a seeded hash and takes its blocks from the front of that order, again from the
beginning when it comes to the end, so a document's words are taken as often as the quota says.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.scratch import Scratch

WEIGHTS = (5, 2, 1)
#: A document's words are taken this often at most.
REPEATS = 3
#: The mix is cut into about so many blocks; a source into so many shards at most, of about so many rows.
BLOCKS, SHARDS, ROWS = 1_000_000, 1_024, 256
#: Plans of at most so many sources, or sources and shards, are broadcast (100 MB at most).
BROADCAST_ROWS = 1_000_000


def apportion(votes, seats: int) -> np.ndarray:
    """Sainte-Laguë: one seat after another to the highest votes / (2 * seats + 1), ties to the first.

    The seats are first dealt by a divisor just too large and the rest by single quotients, which
    gives the same result as dealing every seat singly.
    """
    votes = np.asarray(votes, float)
    if not votes.sum():
        return np.zeros(len(votes), np.int64)
    low, high, got = 0.0, 2 * votes.max(), np.zeros(len(votes), np.int64)
    for _ in range(200):
        d = (low + high) / 2
        now = np.ceil(votes / d - 0.5).clip(0).astype(np.int64)  # the seats with quotients above d / 2
        if now.sum() > seats:
            low = d
            continue
        high, got = d, now
        if seats - got.sum() <= len(votes):
            break
    heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def targets(sizes: list[int], weights: list[float], cap: float = REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight, none above cap times its size; what is above goes to the
    others by weight, until none is above. Sizes of 0 have a target of 0."""
    total, full, out = float(sum(sizes)), set(), [0.0] * len(sizes)
    while True:
        left = total - sum(out[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        over = set()
        for i, w in enumerate(weights):
            if i not in full:
                out[i] = left * w / weight
                if out[i] > cap * sizes[i]:
                    over.add(i)
        if not over:
            return out
        for i in over:
            out[i] = float(cap * sizes[i])
        full |= over


def _few(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a table of so many slim rows, if these are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, carry: tuple = ()) -> DataFrame:
    """doc_id, size, source, source_size, target, taken for every row of docs, and the columns named in carry.

    size is the number of words of the whole text (null or empty text: 0, nothing taken); a null
    source is a source like others, the last one; sources of other types count as their strings. The driver sees one row a source and shard: a
    source has SHARDS shards at most. Repeated rows are documents of their own; other columns are
    ignored, whatever their names; an empty table gives an empty result. Reruns agree.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.save(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), *carry)
    )
    found = sorted(((r.source, int(r.size), r.rows) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    of = pd.DataFrame(found, columns=["source", "source_size", "rows"])
    of["target"] = targets(list(of["source_size"]), [weights[i % len(weights)] for i in range(len(of))]) if of["source_size"].sum() else 0.0
    of["shards"] = (of["rows"] // ROWS).clip(1, SHARDS)
    of["at"] = range(len(of))
    total = int(of["source_size"].sum())
    block = max(1, total // BLOCKS)
    of["blocks"] = apportion(of["target"], total // block) if total else 0
    plan = spark.createDataFrame(
        [(int(r.at), r.source if isinstance(r.source, str) else None, int(r.source_size), float(r.target), int(r.shards)) for r in of.itertuples()],
        "at int, source string, source_size long, target double, shards long",
    )
    placed = rows.withColumn("order", F.xxhash64("doc_id", "size", F.lit(seed))).join(_few(plan.withColumnRenamed("source", "of"), len(of)), F.col("source").eqNullSafe(F.col("of")))
    placed = placed.withColumn("shard", F.pmod(F.shiftrightunsigned("order", 20), F.col("shards")))

    held = placed.groupBy("at", "shard").agg(F.sum("size").alias("shard_size")).toPandas().sort_values(["at", "shard"]).reset_index(drop=True)
    quota = np.zeros(len(held), np.int64)
    for at, own in held.groupby("at"):
        words = int(of["blocks"][at]) * block
        sizes = own["shard_size"].to_numpy()
        got = np.minimum(apportion(sizes, int(of["blocks"][at])) * block, REPEATS * sizes)
        for i in range(len(got)):  # blocks that a full shard could not hold go to the next with room
            got[i] += min(words - int(got.sum()), REPEATS * int(sizes[i]) - int(got[i])) if words > got.sum() else 0
        quota[own.index] = got
    quotas = spark.createDataFrame([(int(a), int(s), int(z), int(q)) for a, s, z, q in zip(held["at"], held["shard"], held["shard_size"], quota)], "at int, shard long, shard_size long, quota long")
    order = Window.partitionBy("at", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("size").over(order) - F.col("size")
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0)
    return (
        placed.withColumn("before", before)
        .join(_few(quotas, len(held)), ["at", "shard"])
        .withColumn("rounds", rounds.cast("long"))
        .withColumn("rest", F.col("quota") - F.col("rounds") * F.col("shard_size"))
        .select(
            "doc_id", "size", "source", "source_size", "target",
            (F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before")))).cast("long").alias("taken"),
            *carry,
        )
    )
