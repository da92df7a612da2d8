"""Greedy selections of one medium: peaks with a least distance, ranked clips, one-to-one matches, frame gating, splitting.

Each is sequential within a medium, so a medium's rows, bounded by its length, are handled together by a grouped pandas
function; media are handled in parallel.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelore.operators import series
from framelore.operators.shared import materialise

KEYS = ["media_id"]
LEAST_SCORE = 0.01
TOUCH = 1e-6


def peaks(levels: DataFrame, value: str, count: int, min_gap: int) -> DataFrame:
    """Up to ``count`` peaks a medium: the highest second (of a tie the first) clears [second - gap, second + gap), and so on."""
    if min_gap < 1:
        raise ValueError("min_gap must be 1 or more")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("second")
        seconds, scores = pdf["second"].to_numpy(), pdf[value].to_numpy(float).copy()
        found = []
        while len(found) < count and len(scores):
            i = int(scores.argmax())
            if not scores[i] >= LEAST_SCORE:
                break
            found.append((seconds[i], scores[i]))
            scores[(seconds >= seconds[i] - min_gap) & (seconds < seconds[i] + min_gap)] = 0
        found.sort()
        return pd.DataFrame({"media_id": pdf["media_id"].iloc[0], "peak_no": range(1, len(found) + 1), "second": [s for s, _ in found], "score": [x for _, x in found]})

    return levels.groupBy("media_id").applyInPandas(pick, "media_id long, peak_no int, second long, score double")


def pick_highlights(signals: dict[str, DataFrame], weights: dict[str, float], forced: DataFrame, count: int, min_gap: int) -> DataFrame:
    """Peaks of several signals together: peak_no, second, score a medium.

    ``signals``: per name a table of media_id, second and a column of that name, dense from 0; seconds that one lacks fall
    away. Signals are normalised, weighted, summed and smoothed, forced seconds (media_id, second, ord) raised above all
    others, and the best peaks taken with ``min_gap`` between them. A forced second can still fall to a stronger neighbour.
    """
    both = reduce(lambda a, b: a.join(b, ["media_id", "second"]), signals.values())
    raised = series.boost(series.fuse(both, weights), forced, "fused")
    return peaks(raised, "boosted", count, min_gap)


def clip_bounds(levels: DataFrame, centers: DataFrame, value: str, shortest: int = 10, longest: int = 60, keys: list[str] = KEYS) -> DataFrame:
    """Bounds of a clip around each center second: as far as the series stays high, with single low seconds tolerated.

    High is the medium's 60th percentile. The search stops ``longest`` seconds away, or at two low seconds in a row. A clip
    under ``shortest`` is widened to both sides, one over ``longest`` is cut around the center. Centers lie among the seconds in
    the medium's windows, which find the nearest stop and the high second behind it; they meet no second one by one.
    """
    points = centers.where("second is not null").select(*keys, "second", F.lit(False).alias("own"))
    rows = levels.select(*keys, "second", F.lit(True).alias("own"), F.col(value).alias("value")).unionByName(points, allowMissingColumns=True).where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    # Centers first, then the seconds alone; or all by time, a center before the second of its time.
    along, upwards = (W.partitionBy(*keys).orderBy(*order) for order in (["own", "second"], ["second", "own"]))
    whole, passed = (W.unboundedPreceding, W.unboundedFollowing), (W.unboundedPreceding, W.currentRow)
    t, own = F.col("second"), F.col("own")
    high = F.col("value") >= F.expr("percentile(value, 0.6)").over(along.rowsBetween(*whole))
    marked = rows.withColumns({"high": F.when(own, high), "last": F.max(F.when(own, t)).over(along.rowsBetween(*whole))})
    # Neither the first second nor the last one begins or ends a clip as a high one.
    ends = {"low_next": ~F.lead("high").over(along), "low_before": ~F.lag("high").over(along), "high_left": F.when(F.col("high") & (t > 0), t), "high_right": F.when(F.col("high") & (t < F.col("last")), t)}
    nearest = {"next_high": F.expr("lead(high_left) ignore nulls").over(along), "prev_high": F.expr("lag(high_right) ignore nulls").over(along)}
    # Two low seconds in a row, by the high second behind them; by one out of every reach where there is none.
    stop_left, stop_right = ~F.col("high") & F.col("low_next"), ~F.col("high") & F.col("low_before")
    behind_left, behind_right = F.coalesce("next_high", F.col("last") + longest + 1), F.coalesce("prev_high", t - 2 * longest - 1)
    stops = marked.withColumns(ends).withColumns(nearest).where("second is not null").select(
        *keys, "second", "own", "last", "high_left", "high_right", F.when(F.col("high_left").isNotNull(), F.col("next_high")).alias("next_high"), F.when(F.col("high_right").isNotNull(), F.col("prev_high")).alias("prev_high"),
        F.when(stop_left, behind_left).alias("left"), F.when(stop_right, behind_right).alias("right"), F.when(stop_right, t).alias("right_at"), F.when(own, t).alias("own_at"),
    )
    # A stop at the center itself is none of its own: to the left a center comes before it, to the right the one after counts.
    seen = stops.withColumns({
        "left": F.last("left", ignorenulls=True).over(upwards.rowsBetween(*passed)), "before": F.last("own_at", ignorenulls=True).over(upwards.rowsBetween(*passed)), "after": F.expr("lead(own_at) ignore nulls").over(upwards),
        "right": F.expr("lead(right) ignore nulls").over(upwards), "right_then": F.expr("lead(right, 2) ignore nulls").over(upwards), "right_at": F.expr("lead(right_at) ignore nulls").over(upwards), "same": F.lag("second").over(upwards),
    })
    by_time = W.partitionBy(*keys).orderBy("second")
    reach_left, reach_right = by_time.rangeBetween(-longest, 0), by_time.rangeBetween(0, longest)
    met = seen.withColumns({"high_left": F.min("high_left").over(reach_left), "next_high": F.min("next_high").over(reach_left), "high_right": F.max("high_right").over(reach_right), "prev_high": F.max("prev_high").over(reach_right)})
    # The outermost high seconds in reach, whose ends don't count, and then those that no stop cuts off.
    first = F.when(F.col("high_left") > t - longest, F.col("high_left")).otherwise(F.col("next_high"))
    final = F.when(F.col("high_right") < t + longest, F.col("high_right")).otherwise(F.col("prev_high"))
    low_end = F.when(first.isNotNull(), F.greatest(first, "left"))
    high_end = F.when(final.isNotNull(), F.least(final, F.when(F.col("right_at") > t, F.col("right")).otherwise(F.col("right_then"))))
    group, c = [*keys, "center"], F.col("center")
    near = (F.col("before") >= t - longest) | (F.col("after") <= t + longest)
    found = met.where(~own & near & ~t.eqNullSafe(F.col("same"))).select(*keys, t.cast(centers.schema["second"].dataType).alias("center"), F.when(low_end <= t, low_end).otherwise(t).alias("start"), F.when(high_end >= t, high_end).otherwise(t).alias("end"), "last")
    pad = F.floor((shortest - (F.col("end") - F.col("start"))) / 2)
    wide = F.greatest(F.lit(0), F.col("start") - pad)
    short, long = F.col("end") - F.col("start") < shortest, F.col("end") - F.col("start") > longest
    cut = F.greatest(F.lit(0), c - longest // 2)
    start = F.when(short, wide).when(long, cut).otherwise(F.col("start"))
    end = F.when(short, F.least(F.col("last"), wide + shortest)).when(long, F.least(F.col("last"), cut + longest)).otherwise(F.col("end"))
    return found.select(*group, start.alias("start"), end.alias("end"))


def _absorb(clip: dict, kept: dict, longest: float) -> dict:
    """The union of two touching clips, or ``longest`` seconds of it around the better peak (of a tie the newcomer's)."""
    low, high = min(clip["start"], kept["start"]), max(clip["end"], kept["end"])
    best = clip if clip["score"] >= kept["score"] else kept
    if high - low > longest:
        low = min(max(best["center"] - longest / 2, low), high - longest)
        high = low + longest
    low = max(0.0, low)
    return {"start": round(low, 3), "end": round(high, 3), "center": round(best["center"], 3), "score": round(best["score"], 4)}


CLIP = "media_id long, clip_no int, start_sec double, end_sec double, center_sec double, score double"


def ranked_clips(windows: DataFrame, longest: float, threshold: float | None = None, target: float | None = None) -> DataFrame:
    """Clips of a medium from its best windows downwards; a window that touches a clip is taken into the first such.

    Stops below ``threshold``, or when clips last ``target`` seconds in all; a target of 0 or less gives none. With a threshold
    clips come by score, with a target by start. Times are rounded to three places, scores to four.
    """
    return _ranked(windows, longest, threshold, target).drop("least_score")


def duration_clips(windows: DataFrame, longest: float, target: float) -> DataFrame:
    """``ranked_clips`` up to ``target`` seconds, with least_score: the score of the last window that was used."""
    return _ranked(windows, longest, None, target)


def clips_of(pdf: pd.DataFrame, longest: float, threshold: float | None = None, target: float | None = None) -> tuple[list[dict], float]:
    """Clips of one medium's windows in the order of the windows that began them (first), and the score of the last one used."""
    clips: list[dict] = []
    used = 0.0
    for w in pdf.sort_values(["score", "win_no"], ascending=[False, True], kind="stable").itertuples():
        if threshold is not None and not w.score >= threshold or target is not None and (target <= 0 or sum(c["end"] - c["start"] for c in clips) >= target):
            break
        clip = {"start": w.start_sec, "end": min(w.end_sec, w.start_sec + longest), "center": w.center_sec, "score": w.score}
        used = round(w.score, 4)
        at = next((i for i, c in enumerate(clips) if clip["start"] <= c["end"] + TOUCH and c["start"] <= clip["end"] + TOUCH), None)
        if at is None:
            clips.append({"start": round(clip["start"], 3), "end": round(clip["end"], 3), "center": round(clip["center"], 3), "score": round(clip["score"], 4), "first": (w.score, w.win_no)})
        else:
            clips[at] = _absorb(clip, clips[at], longest) | {"first": clips[at]["first"]}
    return clips, used


def _ranked(windows: DataFrame, longest: float, threshold: float | None, target: float | None) -> DataFrame:

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        clips, used = clips_of(pdf, longest, threshold, target)
        clips.sort(key=(lambda c: -c["score"]) if target is None else (lambda c: c["start"]))
        return pd.DataFrame([(pdf["media_id"].iloc[0], i + 1, c["start"], c["end"], c["center"], c["score"], used) for i, c in enumerate(clips)], columns=["media_id", "clip_no", "start_sec", "end_sec", "center_sec", "score", "least_score"])

    needed = windows.select("media_id", "win_no", "start_sec", "end_sec", "center_sec", "score")
    if threshold is not None:
        needed = needed.where((F.col("score") >= threshold) & ~F.isnan("score"))
    return needed.groupBy("media_id").applyInPandas(pick, CLIP + ", least_score double")


#: Rounds of matching between two written tables.
ROUNDS_TOGETHER = 2


def match_pairs(candidates: DataFrame) -> DataFrame:
    """One-to-one matches of a medium's candidate pairs, the best first: by overlap, similarity, smaller gap, larger numbers.

    A pair that is the best of both its blocks is what taking the best pair again and again comes to as well. So each round
    takes all such pairs and leaves out the others of their blocks, until none is left; a task holds the pairs of one block, not
    those of a medium. Of repeated pairs of two numbers the best counts. The result is written: it is computed when called.
    """
    place = F.struct("overlap_sec", "similarity", (-F.col("gap_sec")).alias("closeness"), "pred_no", "true_no")
    pair = ["media_id", "pred_no", "true_no"]
    rows = F.max_by(F.struct(*candidates.columns), place).alias("row")
    left = candidates.groupBy(*pair).agg(rows, F.max(place).alias("place")).select(*pair, "row", "place", F.lit(False).alias("taken"))
    blocks = [W.partitionBy("media_id", c) for c in ("pred_no", "true_no")]
    chosen = None
    while True:
        for _ in range(ROUNDS_TOGETHER):
            best = F.lit(True)
            for b in blocks:
                best = best & (F.col("place") == F.max(F.when(~F.col("taken"), F.col("place"))).over(b))
            left = left.withColumn("taken", F.col("taken") | F.coalesce(best, F.lit(False)))
            for b in blocks:
                left = left.withColumn("_gone", F.max("taken").over(b)).where("taken or not _gone").drop("_gone")
        left = materialise(left)
        new = left.where("taken").select("row.*")
        chosen = new if chosen is None else chosen.union(new)
        left = left.where("not taken")
        if left.isEmpty():
            return chosen


def gate_frames(frames: DataFrame, value: str, threshold: float = 0.08, longest_skip: float = 8.0, disabled: bool = False) -> DataFrame:
    """Which frames are worth labelling: the first, one that differs from the last chosen, or when too much time has passed.

    ``value`` is a frame's level; the change is counted against the last chosen frame, not the one before. All are, if the gate
    is ``disabled``.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp")
        last: tuple[float, float] | None = None
        rows = []
        for t, x in zip(pdf["timestamp"], pdf[value], strict=True):
            change = None if last is None else abs(x - last[1])
            reason = "first_frame" if last is None else "disabled" if disabled else "change" if change >= threshold else "max_skip" if t - last[0] >= longest_skip else "propagated"
            if reason != "propagated":
                last = (t, x)
            rows.append((pdf["media_id"].iloc[0], t, change, reason != "propagated", reason))
        return pd.DataFrame(rows, columns=["media_id", "timestamp", "change_score", "selected", "reason"])

    return frames.groupBy("media_id").applyInPandas(pick, "media_id long, timestamp double, change_score double, selected boolean, reason string")


def split_long(intervals: DataFrame, levels: DataFrame, shortest: float, longest: float, reach: float = 0.8, frame: float = 0.0) -> DataFrame:
    """Cuts intervals over ``longest`` at the quietest moment near each target length; a short rest joins the piece before.

    ``levels``: media_id, at_sec, rms of frames of ``frame`` seconds. Of the frames that lie within ``reach`` of the target the
    first of the quietest counts, so a piece can be longer than ``longest`` by as much, and the search may run past the
    interval's end. A cut that leaves less than ``shortest`` is at the target instead.
    """

    def cut(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("at_sec")
        at, rms = b["at_sec"].to_numpy(float), b["rms"].to_numpy(float)
        out: list[list[float]] = []
        for start, end in a.sort_values("start_sec")[["start_sec", "end_sec"]].itertuples(index=False):
            first = len(out)
            while end - start > longest:
                target = start + longest
                near = np.flatnonzero((at >= target - reach) & (at + frame <= target + reach))
                point = float(at[near[rms[near].argmin()]]) if len(near) else target
                if point - start < shortest:
                    point = target
                out.append([start, point])
                start = point
            if len(out) > first and end - start < shortest:
                out[-1][1] = end
            else:
                out.append([start, end])
        return pd.DataFrame({"media_id": key[0], "start_sec": [x for x, _ in out], "end_sec": [x for _, x in out]})

    own = levels.select(F.col("media_id").alias("medium"), "at_sec", "rms")
    return intervals.groupBy("media_id").cogroup(own.groupBy("medium")).applyInPandas(cut, "media_id long, start_sec double, end_sec double")


def fit_duration(start: Column, end: Column, shortest: Column, longest: Column, duration: Column) -> tuple[Column, Column]:
    """A clip's bounds within a medium: too short ones grow to both sides, too long ones lose their end."""
    pad = F.greatest(F.lit(0.0), shortest - (end - start)) / 2
    short = end - start < shortest
    low = F.when(short, F.greatest(F.lit(0.0), start - pad)).otherwise(start)
    high = F.when(short, F.least(duration, end + pad)).otherwise(end)
    still = short & (high - low < shortest)
    high2 = F.when(still, F.least(duration, low + shortest)).otherwise(high)
    low2 = F.when(still & (high2 - low < shortest), F.greatest(F.lit(0.0), high2 - shortest)).otherwise(low)
    return low2, F.when(high2 - low2 > longest, low2 + longest).otherwise(high2)
