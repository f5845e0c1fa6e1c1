"""Job events as streams: windows and the latest state of each job."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The number of events and the sum of their values by type and window; works on batch and streaming input alike."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events"))


def latest(events: DataFrame) -> DataFrame:
    """Each session's last event."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("ts"))


def transitions(events: DataFrame, states: list[str], key: str = "user_id", state: str = "event_type", ends: list[str] | None = None) -> DataFrame:
    """Each job's events with the state before and whether the step is allowed: from nothing to any state, then only onwards in the order of
    states or to one of ends, and from an end nowhere. Without ends the last state is the only one."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    ends = states[-1:] if ends is None else ends
    place = lambda c: F.array_position(F.array(*map(F.lit, states)), c)
    told = events.withColumn("before", F.lag(state).over(w))
    onwards = F.col(state).isin(ends) | (place(F.col(state)) > place(F.col("before")))
    return told.select(key, "event_id", "before", state, (F.col("before").isNull() | (onwards & ~F.col("before").isin(ends))).alias("allowed"))


def throttled(results: DataFrame, grown: int = 30, wait: float = 1.5) -> DataFrame:
    """session, at, text of the interim results of a stream (session, speaker, at in seconds, text) that are sent on:
    the first of a speaker, and those that differ from the last one sent and are longer by grown characters or
    at least wait seconds later. The state of a session is its last text sent, its speaker and its time."""

    def step(key, frames, state: GroupState):
        speaker, sent, at = state.get if state.exists else (None, "", None)
        out = []
        for row in pd.concat(list(frames)).sort_values("at").itertuples(index=False):
            if row.speaker != speaker:
                speaker, sent, at = row.speaker, "", None
            if row.text and row.text != sent and (at is None or len(row.text) - len(sent) >= grown or row.at - at >= wait):
                sent, at = row.text, row.at
                out.append((key[0], row.at, row.text))
        state.update((speaker, sent, at))
        yield pd.DataFrame(out, columns=["session", "at", "text"])

    return results.groupBy("session").applyInPandasWithState(step, "session string, at double, text string", "speaker string, sent string, at double", "append", GroupStateTimeout.NoTimeout)
