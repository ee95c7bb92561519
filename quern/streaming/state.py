"""Keyed state over streams of events, each with the batch form that says the same.

The batch forms are windows over a key; the streams keep only what the rule
needs: a cursor, a turn, or the times inside the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR_MS = 3_600_000


def rate_limited(events: DataFrame, most: int, key: str = "session", window_ms: int = HOUR_MS) -> DataFrame:
    """Adds ``seen`` (events of the key in the window up to and with this one) and ``allowed``."""
    w = Window.partitionBy(key).orderBy("at").rangeBetween(-window_ms, 0)
    return events.withColumn("seen", F.count("*").over(w)).withColumn("allowed", F.col("seen") <= most)


def not_repeated(events: DataFrame, least_turns: int = 8) -> DataFrame:
    """Adds ``fresh``: whether an item was not shown to its session in the last turns."""
    last = F.lag("turn").over(Window.partitionBy("session", "id").orderBy("turn"))
    return events.withColumn("fresh", last.isNull() | (F.col("turn") - last >= least_turns))


def first_of_repeats(events: DataFrame, keys: list[str], ttl_ms: int) -> DataFrame:
    """Events whose key was not seen within the time before."""
    last = F.lag("at").over(Window.partitionBy(*keys).orderBy("at", "event_id"))
    return events.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("at") - F.col("_last") > ttl_ms)).drop("_last")


def deduplicated_stream(events: DataFrame, keys: list[str], time_col: str, ttl: str = "60 seconds") -> DataFrame:
    """The same on a stream: the first event of a key within the watermark."""
    return events.withWatermark(time_col, ttl).dropDuplicatesWithinWatermark(keys)


def window_counts(events: DataFrame, time_col: str, key: str, size: str = "24 hours", step: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Counts by key in sliding windows; on a stream with a watermark for late rows."""
    rows = events.withWatermark(time_col, late) if events.isStreaming else events
    return rows.groupBy(F.window(time_col, size, step).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def rate_limited_stream(events: DataFrame, most: int, key: str = "session", window_ms: int = HOUR_MS, late: str = "10 minutes") -> DataFrame:
    """``rate_limited`` on a stream of (key, at, in milliseconds); state: the times inside the window.

    Rows of one micro-batch are counted together, peers of one time with each
    other as in the batch form; rows come in order from batch to batch, and those
    behind the watermark are dropped. A key's state ends when the watermark has
    passed its window, so idle keys hold none, and a query over all files at hand ends.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = [key, "at", "seen", "allowed"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({c: [] for c in columns}).astype({"at": "int64", "seen": "int64", "allowed": "bool"})
            return
        new = np.sort(np.concatenate([pdf["at"].to_numpy(dtype=np.int64) for pdf in frames]))
        times = np.sort(np.concatenate((np.array(state.get[0] if state.exists else [], dtype=np.int64), new)))
        seen = np.searchsorted(times, new, side="right") - np.searchsorted(times, new - window_ms, side="left")
        kept = times[times >= times[-1] - window_ms]
        state.update((kept.tolist(),))
        state.setTimeoutTimestamp(max(int(times[-1]) + window_ms, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: [k[0]] * len(new), "at": new, "seen": seen, "allowed": seen <= most})

    kind = dict(events.dtypes)[key]
    timed = events.withColumn("_ts", F.timestamp_millis("at")).withWatermark("_ts", late)
    return timed.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, at bigint, seen bigint, allowed boolean", "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def capture_stream(messages: DataFrame, keep: int = 6) -> DataFrame:
    """Unseen messages of each session (session, seq, text) with the last ``keep`` texts; state: the cursor and those texts."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cursor, recent = (state.get[0], list(state.get[1])) if state.exists else (-1, [])
        rows = pd.concat(list(frames)).sort_values("seq").drop_duplicates("seq")
        out = []
        for r in rows[rows["seq"] > cursor].itertuples():
            recent = [*recent, r.text][-keep:]
            cursor = int(r.seq)
            out.append((k[0], cursor, r.text, "\n".join(recent)))
        state.update((cursor, recent))
        yield pd.DataFrame(out, columns=["session", "seq", "text", "recent"])

    return messages.groupBy("session").applyInPandasWithState(run, "session string, seq bigint, text string, recent string", "cursor bigint, recent array<string>", "append", GroupStateTimeout.NoTimeout)


def write_back(deltas: DataFrame, apply, checkpoint: str):
    """Sums access deltas (id, n, at) in each micro-batch and hands them to ``apply(batch)``; returns the running query."""

    def run(batch: DataFrame, _: int) -> None:
        apply(batch.groupBy("id").agg(F.sum("n").alias("n"), F.max("at").alias("at")))

    return deltas.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
