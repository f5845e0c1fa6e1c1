"""Sharding by sampled splitters.

The key of a record is (CRC-32 of its text, hash of its id): equal texts are neighbours. Keys
are sampled with a chance in proportion to the record's bytes, quantiles of the sample become
splitters, and the ranges between them are measured exactly. A range of more than ``fat`` times
its fair share is subdivided by splitters of its own until none is left or it holds one key.
Runs of ranges then form the shards, by the law ``bytes``: shard sizes are near equal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from parley.llm.scratch import Scratch

#: Splitters a range, and the bounds of their number: the driver holds RANGES_MOST * PER_RANGE keys at most.
PER_RANGE, RANGES_LEAST, RANGES_MOST, ROWS_A_RANGE = 16, 512, 16_384, 256
LOW = 2**31


def _assigned(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    """rows with the number of its range: how many splitters are at or below the key."""
    kept = rows.select("doc_id", "size", "text_crc32", "key")
    schema = StructType([*kept.schema.fields, StructField("part", LongType())])
    cuts = kept.sparkSession.sparkContext.broadcast(splitters)

    def place(batches):
        for b in batches:
            part = np.searchsorted(cuts.value, b.column("key").to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int64))], names=[*b.schema.names, "part"])

    return kept.mapInArrow(place, schema)


def _splitters(sample: pd.DataFrame, n: int) -> np.ndarray:
    """n - 1 quantiles of sorted keys; a splitter inside a light group of equal texts goes to the
    group's beginning, so that only groups that span whole ranges are ever cut."""
    keys = np.sort(sample["key"].to_numpy(np.int64))
    if not len(keys) or n < 2:
        return np.zeros(0, np.int64)
    cuts = keys[(np.arange(1, n) * len(keys)) // n]
    groups, count = np.unique(cuts // LOW, return_counts=True)
    light = np.isin(cuts // LOW, groups[count == 1])
    return np.unique(np.where(light, cuts // LOW * LOW, cuts))


def shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, fat: float = 2.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    size is the text's UTF-8 bytes plus 1; a null text has size 1 and a null CRC and sorts as
    CRC 0. Other columns are ignored, whatever their names. Rows that repeat (same id and text)
    are kept, each with a slot of its own. An empty table gives an empty result. Slots run from 0
    without gaps in each shard, in the order of key, id and size; reruns agree.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.col("t")
    rows = scratch.save(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
        .select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
        .withColumn("key", F.coalesce("text_crc32", F.lit(0)) * LOW + F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(LOW)))
    )
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n = int(np.clip(count // ROWS_A_RANGE, RANGES_LEAST, RANGES_MOST))

    def sample(of: DataFrame, weight: int, keys: int) -> pd.DataFrame:
        chance = F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(10**9)) / 1e9
        return of.where(chance < F.col("size") * (keys / max(1, weight))).select("key").toPandas()

    cuts = _splitters(sample(rows, total, n * PER_RANGE), n)
    while True:
        placed = _assigned(rows, cuts)
        sizes = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")).toPandas().sort_values("part")
        wide = sizes[(sizes["bytes"] > fat * total / n) & (sizes["low"] < sizes["high"])]
        if not len(wide):
            break
        spans = sample(placed.where(F.col("part").isin([int(p) for p in wide["part"]])), int(wide["bytes"].sum()), PER_RANGE * max(n, len(wide)))
        own = np.searchsorted(cuts, spans["key"].to_numpy(np.int64), "right")
        more = [cuts]
        for p, size, low, high in wide[["part", "bytes", "low", "high"]].itertuples(index=False):
            inner = np.sort(spans["key"].to_numpy(np.int64)[own == p])
            pieces = int(np.ceil(size * n / max(1, total)))
            inner = inner[(np.arange(1, pieces) * len(inner)) // pieces] if len(inner) else np.zeros(0, np.int64)
            inner = inner[(inner > low) & (inner <= high)]
            more.append(inner if len(inner) else np.array([(int(low) + int(high) + 1) // 2]))
        cuts = np.unique(np.concatenate(more))

    middle = sizes["bytes"].cumsum() - sizes["bytes"] / 2
    sizes["shard"] = np.minimum((middle * n_shards // max(1, total)).astype(int), n_shards - 1) if len(sizes) else 0
    sizes["first"] = sizes.groupby("shard")["rows"].cumsum() - sizes["rows"] if len(sizes) else 0
    plan = spark.createDataFrame(
        [(int(p), int(s), int(f)) for p, s, f in sizes[["part", "shard", "first"]].itertuples(index=False)], "part long, shard int, first long"
    )
    order = Window.partitionBy("part").orderBy("key", "doc_id", "size")
    return (
        placed.withColumn("rank", F.row_number().over(order))
        .join(F.broadcast(plan), "part")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
        )
    )
