"""Greedy selections of media of any length: no task holds a medium.

What taking the best entry again and again comes to is settled from place to place: an entry that is better than all it conflicts
with is taken whatever happens elsewhere. Peaks go in rounds over chunks with their neighbours' rows, clips by stretches of
windows that touch one another, as a clip never leaves the stretch of its windows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelore.operators import chunks
from framelore.operators.selection import CLIP, LEAST_SCORE, TOUCH, clips_of
from framelore.operators.shared import materialise

KEYS = ["media_id"]
#: Rounds between two written tables; each needs rows from twice the gap further away.
ROUNDS_TOGETHER = 2
#: More than rounding to three places can move a clip's end.
ROUNDED = 0.001


def peaks(levels: DataFrame, value: str, count: int, min_gap: int, size: int = 7200) -> DataFrame:
    """``selection.peaks``, the chunks being of ``size`` seconds; null and NaN levels are no peaks.

    Each round takes the seconds that no better one clears (of a tie the first is better) and clears the worse that those reach;
    one just the gap before a taken one can be better, as a peak reaches further back than ahead, and stays. After n
    rounds a medium's n best peaks are settled, so ``count`` rounds do; mostly a few settle all. The result is written: it is
    computed when called. Repeated seconds of a medium count once, with the highest level.
    """
    if min_gap < 1:
        raise ValueError("min_gap must be 1 or more")
    reach = 2 * min_gap * ROUNDS_TOGETHER
    size = max(size, reach)
    score = F.col(value).cast("double")
    high = levels.where((score >= LEAST_SCORE) & ~F.isnan(score))
    live = high.groupBy(*KEYS, F.col("second").cast("long").alias("second")).agg(F.max(score).alias("score")).withColumn("taken", F.lit(False))
    frame = W.partitionBy(*KEYS, chunks.CHUNK).orderBy("second").rangeBetween(1 - min_gap, min_gap)
    place = F.struct("score", -F.col("second"))
    chosen, rounds = [], 0
    while rounds < count:
        left = chunks.with_halo(live, "second", size, reach, reach)
        for _ in range(ROUNDS_TOGETHER):
            left = left.withColumn("taken", F.col("taken") | (place == F.max(F.when(~F.col("taken"), place)).over(frame)))
            cleared = F.coalesce(F.max(F.when(F.col("taken"), place)).over(frame) > place, F.lit(False))
            left = left.withColumn("gone", cleared).where("taken or not gone").drop("gone")
        left = materialise(left.where("own").drop(chunks.CHUNK, "own"))
        rounds += ROUNDS_TOGETHER
        chosen.append(left.where("taken").drop("taken"))
        live = left.where("not taken")
        if live.isEmpty():
            break
    found = levels.sparkSession.createDataFrame([], "media_id long, second long, score double") if not chosen else chosen[0]
    for more in chosen[1:]:
        found = found.union(more)
    best = found.withColumn("place", F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("score"), "second"))).where(F.col("place") <= count)
    return best.select("media_id", F.row_number().over(W.partitionBy(*KEYS).orderBy("second")).alias("peak_no"), "second", "score")


def ranked_clips(windows: DataFrame, longest: float, threshold: float, size: float = 7200.0) -> DataFrame:
    """``selection.ranked_clips`` by a threshold, the chunks being of ``size`` seconds.

    Windows are cut into stretches that nothing touches from outside; each is one task's rows. Clips are numbered by score, of
    a tie in the order of the windows that began them.
    """
    strong = windows.where((F.col("score") >= threshold) & ~F.isnan("score")).select("media_id", "win_no", "start_sec", "end_sec", "center_sec", "score")
    ends = strong.withColumn("clip_end", F.least("end_sec", F.col("start_sec") + longest))
    order = ["start_sec", "clip_end", "win_no"]
    reached = chunks.scan(ends, {"reached": chunks.Scan("max", F.col("clip_end"), before=True)}, order, size)
    stretches = chunks.islands(reached, F.col("start_sec") - F.col("reached") > TOUCH + ROUNDED, order, size)

    def pick(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        clips, _ = clips_of(pdf, longest)
        return pd.DataFrame([(key[0], c["start"], c["end"], c["center"], c["score"], *c["first"]) for c in clips], columns=["media_id", "start_sec", "end_sec", "center_sec", "score", "first_score", "first_no"])

    found = stretches.groupBy("media_id", "island").applyInPandas(pick, "media_id long, start_sec double, end_sec double, center_sec double, score double, first_score double, first_no long")
    number = F.row_number().over(W.partitionBy("media_id").orderBy(F.desc("score"), F.desc("first_score"), "first_no")).cast("long")
    return found.withColumn("clip_no", number).select(*[c.split()[0] for c in CLIP.split(", ")])
