"""Running and rolling values of media of any length: a medium is cut into chunks of its order, and no task holds all of it.

A running value is a segmented scan: within each chunk rows are summed up by a window, each chunk has one summary, summaries are
carried from chunk to chunk, and what was carried in is applied to the chunk's rows. Summaries are as many as chunks, so their
window is small. A rolling value needs its neighbours only: rows near an edge are copied into the chunk beyond it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["media_id"]
CHUNK = "_chunk"


class Scan(NamedTuple):
    """A running value: ``kind`` is sum, max or last (the last that isn't null), over rows up to the own one or, if
    ``before``, the one before."""

    kind: str
    value: Column
    before: bool = False


_RUNNING = {"sum": F.sum, "max": F.max, "last": lambda v: F.last(v, ignorenulls=True)}


def _both(kind: str, carried: Column, own: Column) -> Column:
    if kind == "sum":
        return F.when(carried.isNull(), own).when(own.isNull(), carried).otherwise(carried + own)
    return F.greatest(carried, own) if kind == "max" else F.coalesce(own, carried)


def scan(df: DataFrame, scans: dict[str, Scan], order: list[str], size: float, keys: list[str] = KEYS) -> DataFrame:
    """Adds the running values by name. Chunks hold ``size`` units of the first order column, a number; rows that tie in
    ``order`` come in any order. Null keys are a group, a null order value comes first. Other columns stay as they are.
    """
    first = F.coalesce(F.floor(F.col(order[0]) / size), F.lit(-(2**62)))
    valued = df.withColumns({CHUNK: first, **{f"_{name}": s.value for name, s in scans.items()}})
    within = W.partitionBy(*keys, CHUNK).orderBy(*order)
    rows = {before: within.rowsBetween(W.unboundedPreceding, -1 if before else 0) for before in (False, True)}
    local = valued.withColumns({f"_own_{name}": _RUNNING[s.kind](f"_{name}").over(rows[s.before]) for name, s in scans.items()})
    at = F.struct(*order)
    summary = {"sum": F.sum, "max": F.max, "last": lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), at))}
    totals = valued.groupBy(*keys, CHUNK).agg(*[summary[s.kind](f"_{name}").alias(f"_{name}") for name, s in scans.items()])
    earlier = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col(CHUNK).alias("_key"), *[_RUNNING[s.kind](f"_{name}").over(earlier).alias(f"_in_{name}") for name, s in scans.items()])
    same = (F.col(CHUNK) == F.col("_key")) & F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    joined = local.join(carried, same)
    return joined.select(*df.columns, *[_both(s.kind, F.col(f"_in_{name}"), F.col(f"_own_{name}")).alias(name) for name, s in scans.items()])


def previous(df: DataFrame, columns: list[str], order: list[str], size: float, keys: list[str] = KEYS) -> DataFrame:
    """Adds a struct column previous of the row before; null at the first."""
    return scan(df, {"previous": Scan("last", F.struct(*columns), before=True)}, order, size, keys)


def islands(df: DataFrame, begins: Column, order: list[str], size: float, keys: list[str] = KEYS) -> DataFrame:
    """Numbers runs of rows, from 0, in a column island, as ``islands.islands`` does; ``begins`` may not look at other rows."""
    first = F.coalesce(begins, F.lit(False)).cast("long")
    return scan(df, {"island": Scan("sum", first)}, order, size, keys)


def merge_windows(windows: DataFrame, threshold: float, max_gap: float, size: float, keys: list[str] = KEYS) -> DataFrame:
    """``islands.merge_windows``, the chunks being of ``size`` window numbers."""
    strong = previous(windows.where((F.col("score") >= threshold) & ~F.isnan("score")), ["end_sec"], ["win_no"], size, keys)
    spans = islands(strong, F.col("start_sec") - F.col("previous.end_sec") > max_gap, ["win_no"], size, keys)
    best = F.struct("score", "win_no")
    return spans.groupBy(*keys, "island").agg(F.min_by("start_sec", "win_no").alias("start_sec"), F.max_by("end_sec", "win_no").alias("end_sec"), F.max_by("center_sec", best).alias("peak_sec"), F.max("score").alias("peak_prob"))


def merge_intervals(intervals: DataFrame, gap: float, size: float, keys: list[str] = KEYS) -> DataFrame:
    """``islands.merge_intervals``, the chunks being of ``size`` seconds."""
    order = ["start_sec", "end_sec"]
    reached = scan(intervals, {"reached": Scan("max", F.col("end_sec"), before=True)}, order, size, keys)
    runs = islands(reached, F.col("start_sec") - F.col("reached") > gap, order, size, keys)
    return runs.groupBy(*keys, "island").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"))


def runs(df: DataFrame, flag: str, order: str, size: float, keys: list[str] = KEYS) -> DataFrame:
    """``islands.runs``: first and last position of each run of rows whose flag holds."""
    numbered = islands(previous(df, [flag], [order], size, keys), F.col(flag) != F.col(f"previous.{flag}"), [order], size, keys)
    return numbered.where(flag).groupBy(*keys, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"))


def carry_forward(frames: DataFrame, selected: str, columns: list[str], size: float, keys: list[str] = KEYS, order: str = "timestamp") -> DataFrame:
    """``islands.carry_forward``: rows that aren't selected take ``columns`` from the latest selected row."""
    latest = Scan("last", F.when(F.col(selected), F.struct(order, *columns)))
    rest = [c for c in frames.columns if c not in columns]
    found = scan(frames, {"latest": latest}, [order], size, keys)
    return found.select(*rest, *[F.col(f"latest.{c}").alias(c) for c in columns], F.when(~F.col(selected), F.col(f"latest.{order}")).alias("source_timestamp"))


def with_halo(df: DataFrame, order: str, size: int, before: int, after: int) -> DataFrame:
    """Adds a chunk column and copies rows into the neighbouring chunks whose rolling values reach them; ``own`` marks the
    row that is no copy.

    ``order`` is a whole number that counts rows without a gap, as the seconds of a dense series do. Windows from ``before`` rows
    back to ``after`` rows ahead are then the same by chunk as by medium: use the medium's keys and the chunk as keys, and keep
    own rows only. ``size`` must be at least ``before`` and ``after``, so that copies go to neighbours alone.
    """
    if size < max(before, after, 1):
        raise ValueError("chunks must be at least as long as what a window reaches")
    chunk = F.floor(F.col(order) / size).cast("long")
    place = F.pmod(F.col(order), F.lit(size))
    copies = F.array(chunk, F.when(place >= size - before, chunk + 1), F.when(place < after, chunk - 1))
    return df.withColumn("_home", chunk).withColumn(CHUNK, F.explode(F.filter(copies, lambda c: c.isNotNull()))).withColumn("own", F.col(CHUNK) == F.col("_home")).drop("_home")


def rolling(df: DataFrame, values: dict[str, Column], order: str, size: int, before: int, after: int) -> DataFrame:
    """Adds columns, each a window expression over ``[*keys, CHUNK]``, computed one after the other per chunk with its halo."""
    out = with_halo(df, order, size, before, after)
    for name, value in values.items():
        out = out.withColumn(name, value)
    return out.where("own").drop(CHUNK, "own")
