"""Streams whose rows have to be taken in order: each key's rows wait in state until the watermark has passed them.

Rows may come in any order within the watermark's delay, over as many micro-batches as they like; later ones are left out, as
Spark does with late rows. Rows of one key with the same event time and number are one row, the last that came. State is typed and
kept by the RocksDB provider, which ``spark.sql.streaming.stateStore.providerClass`` has to name; a restarted query goes on from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from framelore.operators.images import similarity

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Buffers rows by event time and hands them to ``step`` in order. ``waiting``: the schema of a buffered row."""

    waiting: str
    columns: list[str]
    number: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getMapState("waiting", "ms long, number double", self.waiting)
        self.start()

    def start(self) -> None:
        """Sets up the state of the rows already taken."""

    def step(self, key: tuple, row: tuple) -> Iterator[Row]:
        raise NotImplementedError

    def idle(self, key: tuple, watermark: int) -> Iterator[Row]:
        """What follows from the watermark alone, after all rows up to it."""
        yield from ()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        times = set()
        for r in rows:
            ms = int(r["ts"].timestamp() * 1000)
            self.buffer.updateValue((ms, float(r[self.number])), tuple(r[c] for c in self.columns))
            times.add(ms)
        for ms in times:
            self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        upto = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(tuple(k) for k in self.buffer.keys() if k[0] <= upto)  # noqa: SIM118
        for at in due:
            row = tuple(self.buffer.getValue(at))
            self.buffer.removeKey(at)
            yield from self.step(key, row)
        yield from self.idle(key, upto)

    def close(self) -> None:
        pass


class Gate(InOrder):
    """The gate of ``images.gate_images``; state: the last chosen frame."""

    waiting, columns, number = "timestamp double, grey array<float>", ["timestamp", "grey"], "timestamp"

    def __init__(self, width: int, threshold: float, longest_skip: float, disabled: bool) -> None:
        self.width, self.threshold, self.longest_skip, self.disabled = width, threshold, longest_skip, disabled

    def start(self) -> None:
        self.chosen = self.handle.getValueState("chosen", "timestamp double, grey array<float>")

    def step(self, key: tuple, row: tuple) -> Iterator[Row]:
        t, grey = row
        last = self.chosen.get() if self.chosen.exists() else None
        alike = change = None
        reason = "first_frame"
        if last is not None:
            a, b = (None if g is None else np.asarray(g, np.float32).reshape(-1, self.width) for g in (last[1], grey))
            alike = 0.0 if a is None or b is None or a.shape != b.shape else similarity(a, b)
            change = round(1 - alike, 6)
            reason = "disabled" if self.disabled else "change" if change >= self.threshold else "max_skip" if t - last[0] >= self.longest_skip else "propagated"
        if reason != "propagated":
            self.chosen.update((t, None if grey is None else list(grey)))
        yield Row(media_id=key[0], timestamp=t, similarity=None if alike is None else round(alike, 6), change_score=change, selected=reason != "propagated", reason=reason)


class Spans(InOrder):
    """Spans of ``islands.merge_windows``; state: the open span, which a timer closes once no window can join it."""

    waiting, columns, number = "start_sec double, end_sec double, center_sec double, score double, ms long", ["start_sec", "end_sec", "center_sec", "score", "ms"], "win_no"

    def __init__(self, threshold: float, max_gap: float) -> None:
        self.threshold, self.max_gap = threshold, max_gap

    def start(self) -> None:
        self.open = self.handle.getValueState("open", "start_sec double, end_sec double, peak_sec double, peak_prob double, until long")

    def _closed(self, key: tuple) -> Iterator[Row]:
        if self.open.exists():
            start, end, peak, best, _ = self.open.get()
            yield Row(media_id=key[0], start_sec=start, end_sec=end, peak_sec=peak, peak_prob=best)
            self.open.clear()

    def step(self, key: tuple, row: tuple) -> Iterator[Row]:
        start, end, center, score, ms = row
        if score is None or not score >= self.threshold:
            return
        if self.open.exists() and start - self.open.get()[1] > self.max_gap:
            yield from self._closed(key)
        first, _, peak, best, _ = self.open.get() if self.open.exists() else (start, end, center, score, 0)
        if score >= best:
            peak, best = center, score
        # Event time runs with media time: a window that joins starts at most this much later.
        until = ms + int((max(0.0, end - start) + self.max_gap) * 1000) + 1
        self.open.update((first, end, peak, best, until))
        self.handle.registerTimer(until)

    def idle(self, key: tuple, watermark: int) -> Iterator[Row]:
        if self.open.exists() and self.open.get()[4] <= watermark and not any(True for _ in self.buffer.keys()):  # noqa: SIM118
            yield from self._closed(key)


def gate_stream(frames: DataFrame, width: int, late: str, threshold: float = 0.08, longest_skip: float = 8.0, disabled: bool = False) -> DataFrame:
    """Streamed frames (media_id, ts, timestamp, grey) gated as ``images.gate_images`` gates a table: same columns, same values.

    ``ts`` is the event time, in the order of ``timestamp``; a frame is decided when the watermark, ``late`` behind, passes it.
    """
    keyed = frames.withWatermark("ts", late).groupBy("media_id")
    schema = "media_id long, timestamp double, similarity double, change_score double, selected boolean, reason string"
    return keyed.transformWithState(Gate(width, threshold, longest_skip, disabled), schema, "Append", "EventTime")


def spans_stream(windows: DataFrame, threshold: float, max_gap: float, late: str) -> DataFrame:
    """Spans of streamed windows (media_id, ts, win_no, start_sec, end_sec, center_sec, score): a gap is a window's start less the
    end of the one before, which no session window knows.

    ``ts`` is the event time, which runs as fast as ``start_sec``. A span comes out when a window begins the next, or when the
    watermark passes the last moment at which one could join. Windows that come later than ``late`` are left out.
    """
    timed = windows.withColumn("ms", (windows["ts"].cast("double") * 1000).cast("long"))
    keyed = timed.withWatermark("ts", late).groupBy("media_id")
    return keyed.transformWithState(Spans(threshold, max_gap), "media_id long, start_sec double, end_sec double, peak_sec double, peak_prob double", "Append", "EventTime")
