"""Timelines as streams: the latest chosen label carried forward, and detector windows gathered into sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def carry_forward_stream(frames: DataFrame) -> DataFrame:
    """Streamed frames (media_id long, timestamp double, label string, selected boolean) with the latest selected label so far."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        time, label = state.get if state.exists else (None, None)
        for pdf in batches:
            rows = []
            for t, x, chosen in pdf.sort_values("timestamp")[["timestamp", "label", "selected"]].itertuples(index=False):
                if chosen:
                    time, label = t, x
                rows.append((key[0], t, label, time))
            yield pd.DataFrame(rows, columns=["media_id", "timestamp", "label", "source_timestamp"])
        state.update((time, label))

    return frames.groupBy("media_id").applyInPandasWithState(step, "media_id long, timestamp double, label string, source_timestamp double", "time double, label string", "append", GroupStateTimeout.NoTimeout)


def sessions(windows: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of streamed windows (media_id, ts, score) by event time: count and best score, closed when the watermark passes."""
    return windows.withWatermark("ts", late).groupBy("media_id", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("windows"), F.max("score").alias("best")).select("media_id", "session.start", "session.end", "windows", "best")


def sliding(windows: DataFrame, size: str, hop: str, late: str) -> DataFrame:
    """Overlapping windows of streamed levels (media_id, ts, level): mean level."""
    return windows.withWatermark("ts", late).groupBy("media_id", F.window("ts", size, hop).alias("w")).agg(F.avg("level").alias("level")).select("media_id", "w.start", "w.end", "level")
