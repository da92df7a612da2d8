"""A detector's embedded windows against a prototype bank: scored windows, a score for every second, spans of strong windows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from framelore.operators import islands, series, vectors


class Detection(NamedTuple):
    windows: DataFrame
    timeline: DataFrame
    spans: DataFrame


def detect(windows: DataFrame, bank: DataFrame, durations: DataFrame, threshold: float, max_gap: float) -> Detection:
    """``windows``: media_id, win_no, start_sec, end_sec, center_sec, embedding; ``durations``: media_id, duration.

    The embeddings come to length 1 and are read once, for the scored windows; materialise those to use both other tables.
    """
    keys = ["media_id", "win_no", "start_sec", "end_sec", "center_sec"]
    own = windows.select(*keys, vectors.unit_row(windows["embedding"]).alias("embedding"))
    scored = vectors.prototype_scores(own, bank, keys)
    return Detection(scored, series.timeline_of_windows(scored, durations), islands.merge_windows(scored, threshold, max_gap))
