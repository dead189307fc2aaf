"""Event transitions as a stream: each user's last event is state, each new event gives a transition."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "user_id long, i string, j string, ts timestamp"


def _advance(idle: int, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    last = state.get[0] if state.exists else None
    newest = 0
    for rows in batches:
        rows = rows.sort_values(["ts", "event_id"])
        newest = max(newest, int(rows["ts"].max().timestamp() * 1000)) if len(rows) else newest
        before = rows["event_type"].shift(1)
        if len(rows):
            before.iloc[0] = last
            last = rows["event_type"].iloc[-1]
        out = pd.DataFrame({"user_id": key[0], "i": before, "j": rows["event_type"], "ts": rows["ts"]})
        yield out[out["i"].notna()]
    if last is not None:
        state.update((last,))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle)


def transitions(events: DataFrame, late: str = "1 hour", idle_hours: float = 24 * 30) -> DataFrame:
    """(user_id, i, j, ts) of a stream of (event_id, ts, user_id, event_type); events of one micro-batch are put in order of time.

    An event that comes in a later micro-batch than its successor gives the transition in order of arrival. A user whose last event
    the watermark has passed by idle_hours is forgotten; its next event begins anew.
    """
    stream = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stream.groupBy("user_id").applyInPandasWithState(partial(_advance, int(idle_hours * 3_600_000)), _OUT, "last string", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n) of tumbling windows with a watermark."""
    stream = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stream.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream of the files of a folder, with the columns of a table."""
    return spark.readStream.schema(like.schema).parquet(path)
