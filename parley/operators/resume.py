"""Work on chunks that survives being broken off: what is done is saved in waves, and only the rest is done again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import parts as M


def saved_rows(saved: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row a key of what is saved: a row with text goes before one without."""
    said = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(T.BLANK)) != ""
    values = F.struct(said.alias("said"), *[c for c in saved.columns if c not in keys])
    rows = saved.groupBy(*keys).agg(F.max(values).alias("v"))
    return rows.select(*[f"v.{c}" if c not in keys else c for c in saved.columns])


def pending(plan: DataFrame, saved: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The planned rows whose saved text is missing, null or blank: a blank result is tried again."""
    done = saved.where(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(T.BLANK)) != "").select(*keys)
    return plan.join(done, keys, "left_anti")


def worked(plan: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], keys: list[str], text: str = "text", waves: int = 8) -> DataFrame:
    """Saved results of work(planned rows) for all of the plan, one row a key. Planned rows are dealt into ``waves`` by their keys; each wave is one job
    over all executors, whose results are appended to path as soon as it ends. A task that is lost is run again by Spark; a run that is broken
    off keeps the waves that ended, and the next run does the rest: planned rows without saved text. path must be a folder that all share."""
    spark = plan.sparkSession
    nothing = work(plan.limit(0))
    nothing.write.mode("append").parquet(path)
    read = lambda: spark.read.schema(nothing.schema).parquet(path)
    wave = F.pmod(F.xxhash64(*keys), F.lit(waves))
    for k in range(waves):
        rest = pending(plan.where(wave == k), read(), keys, text)
        work(rest).write.mode("append").parquet(path)
    return saved_rows(read(), keys, text)


def partial_transcript(saved: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """key, order, speaker, text of what is saved so far, without laps: all by the first speaker, as nobody is told apart before the end."""
    said = saved_rows(saved, [key, order], text)
    return M.assembled(said, key, order, text).withColumn("speaker", F.lit("Speaker 1"))
