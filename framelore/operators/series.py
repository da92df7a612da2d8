"""Per-second series of a medium: smoothing, baselines, normalisation, fusion, scores of words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelore.functions.rounding import round_half_even
from framelore.operators.bounded import beside

KEYS = ["media_id"]


def _along(keys: list[str], order: str = "second") -> W:
    return W.partitionBy(*keys).orderBy(order)


def convolve(value: str, kernel: list[float], keys: list[str] = KEYS, order: str = "second") -> Column:
    """Centred weighted sum; what lies beyond a medium's ends counts as zero. Kernels of even length lean to the past."""
    w, half = _along(keys, order), len(kernel) // 2
    taps = [F.coalesce(F.lead(value, i - half).over(w) if i >= half else F.lag(value, half - i).over(w), F.lit(0.0)) * F.lit(k) for i, k in enumerate(kernel)]
    return reduce(lambda a, b: a + b, taps)


def box_mean(value: str, keys: list[str] = KEYS, size: int = 5) -> Column:
    """Mean over ``size`` rows, zeros beyond the ends counted."""
    half = size // 2
    return F.sum(value).over(_along(keys).rowsBetween(-half, size - half - 1)) / size


def normalised(value: str, keys: list[str] = KEYS) -> Column:
    """Between 0 and 1 by a medium's extremes; a flat series gives 0."""
    whole = W.partitionBy(*keys)
    low, high = F.min(value).over(whole), F.max(value).over(whole)
    return (F.col(value) - low) / (high - low + 1e-9)


def rolling_median(value: str, keys: list[str] = KEYS, size: int = 60) -> Column:
    """Median of the ``size`` rows from half of them back; fewer at the ends."""
    return F.expr(f"percentile({value}, 0.5)").over(_along(keys).rowsBetween(-(size // 2), size - size // 2 - 1))


def rms_per_bucket(samples: DataFrame, value: str, bucket: Column, keys: list[str] = KEYS) -> DataFrame:
    """bucket, rms of samples that are rows; ``bucket`` says which one a sample falls in. Nulls count as no samples."""
    x = F.col(value).cast("double")
    return samples.groupBy(*keys, bucket.alias("bucket")).agg(F.sqrt(F.avg(x * x)).alias("rms"))


def durations(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Each medium's duration, by its last end."""
    return rows.groupBy(*keys).agg(F.max("end_sec").alias("duration"))


def audio_excitement(series: DataFrame, level: str = "level", keys: list[str] = KEYS) -> DataFrame:
    """Adds smoothed, baseline and ratio."""
    out = series.withColumn("smoothed", convolve(level, [0.1, 0.25, 0.3, 0.25, 0.1], keys))
    out = out.withColumn("baseline", rolling_median("smoothed", keys))
    return out.withColumn("ratio", F.col("smoothed") / (F.col("baseline") + 1e-6))


def occurrences(text: Column, keyword: Column) -> Column:
    """Non-overlapping occurrences of a keyword."""
    return F.floor((F.length(text) - F.length(F.replace(text, keyword, F.lit("")))) / F.length(keyword))


def keyword_scores(segments: DataFrame, lexicon: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per second in which segments start: score (weights times occurrences, nested keywords count too) and density.

    The lexicon is a parameter: it is broadcast to the segments, and one too large for that raises an error.
    """
    second = F.floor("start_sec").alias("second")
    hits = beside(segments.select(*keys, "seg_no", second, "text"), lexicon)
    per_segment = hits.groupBy(*keys, "second", "seg_no").agg(F.sum(F.col("weight") * occurrences(F.col("text"), F.col("keyword"))).alias("score"))
    return per_segment.groupBy(*keys, "second").agg(F.sum("score").alias("score"), F.count("*").alias("density"))


def must_include(segments: DataFrame, lexicon: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per forcing keyword a segment holds: second and ord, in segment order."""
    found = beside(segments, lexicon.where("must_include")).where(F.col("text").contains(F.col("keyword")))
    return found.select(*keys, F.floor("start_sec").alias("second"), F.row_number().over(W.partitionBy(*keys).orderBy("seg_no", "keyword")).alias("ord"))


def dense(media: DataFrame, length: Column, keys: list[str] = KEYS) -> DataFrame:
    """A row for every second from 0, ``length`` of them."""
    return media.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), length.cast("long") - 1)).alias("second"))


def text_series(segments: DataFrame, lexicon: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Dense second, score: smoothed word scores plus smoothed density scaled to 0 to 3."""
    duration = segments.groupBy(*keys).agg(F.max_by("end_sec", "seg_no").alias("duration"))
    spine = dense(duration, F.floor("duration") + 2, keys)
    scored = spine.join(keyword_scores(segments, lexicon, keys), [*keys, "second"], "left").fillna(0, ["score", "density"])
    smooth = scored.withColumn("score", box_mean("score", keys)).withColumn("density", box_mean("density", keys))
    top = F.max("density").over(W.partitionBy(*keys))
    scaled = F.when(top > 0, F.col("density") / top * 3).otherwise(F.col("density"))
    return smooth.select(*keys, "second", (F.col("score") + scaled).alias("score"))


def fuse(series: DataFrame, weights: dict[str, float], keys: list[str] = KEYS) -> DataFrame:
    """Weighted sum of the normalised columns, box-smoothed over five seconds, or all where a medium has fewer, as fused."""
    out = series
    for column in weights:
        out = out.withColumn(f"n_{column}", normalised(column, keys))
    total = reduce(lambda a, b: a + b, (F.col(f"n_{c}") * w for c, w in weights.items()))
    length = F.count(F.lit(1)).over(W.partitionBy(*keys))
    smoothed = box_mean("raw", keys)
    for size in (4, 3, 2, 1):  # a box of even length reaches further back than ahead
        smoothed = F.when(length == size, box_mean("raw", keys, size)).otherwise(smoothed)
    return out.withColumn("raw", total).withColumn("fused", smoothed).drop("raw", *(f"n_{c}" for c in weights))


def boost(series: DataFrame, forced: DataFrame, value: str, keys: list[str] = KEYS) -> DataFrame:
    """Raise forced seconds: the k-th valid entry of a medium sets its second to 1.5 ** k times the maximum; the last one holds.

    Each entry sees the maximum that the ones before have set, which is why the factor compounds.
    """
    valid = forced.join(series.select(*keys, "second"), [*keys, "second"], "left_semi")
    ranked = valid.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy("ord")))
    last = ranked.groupBy(*keys, "second").agg(F.max("k").alias("k"))
    top = F.max(value).over(W.partitionBy(*keys))
    return series.withColumn("top", top).join(last, [*keys, "second"], "left").withColumn("boosted", F.coalesce(F.col("top") * F.pow(F.lit(1.5), F.col("k")), F.col(value))).drop("top", "k")


def window_mean(value: str, keys: list[str] = KEYS, half: int = 10) -> Column:
    """Mean of a column over ``half`` seconds to either side."""
    return F.avg(value).over(_along(keys).rowsBetween(-half, half))


def timeline_of_windows(windows: DataFrame, durations: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per second the best score of the windows over it, smoothed by 0.2, 0.6, 0.2; seconds without a window stay 0.

    A window covers the seconds from floor(start) to ceil(end). A medium has floor(duration) + 2 seconds.
    """
    spine = dense(durations, F.greatest(F.lit(1), F.floor("duration") + 2), keys)
    covered = windows.select(*keys, "score", F.explode(F.sequence(F.floor("start_sec"), F.ceil("end_sec"))).alias("second"))
    best = covered.groupBy(*keys, "second").agg(F.max(F.greatest("score", F.lit(0.0))).alias("best"))
    out = spine.join(best, [*keys, "second"], "left").withColumn("peak", F.coalesce("best", F.lit(0.0)))
    return out.withColumn("score", convolve("peak", [0.2, 0.6, 0.2], keys)).select(*keys, "second", F.when(F.col("best").isNull(), 0.0).otherwise(F.col("score")).alias("score"))


def slices(durations: DataFrame, size: float, hop: float, keys: list[str] = KEYS) -> DataFrame:
    """Sliding windows over each medium's duration: win_no, start_sec, end_sec, center_sec.

    The last window ends with the medium. A medium shorter than a window has one, cut to its length; an empty one has [0, size].
    """
    steps = F.floor((F.col("duration") - size) / hop)
    regular = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(steps, F.lit(0).cast("long"))), lambda i: i * F.lit(hop))
    tail = F.col("duration") - size
    starts = F.when(F.col("duration") <= size, F.array(F.lit(0.0))).when(F.element_at(regular, -1) < tail, F.concat(regular, F.array(tail))).otherwise(regular)
    rows = durations.select(*keys, "duration", F.posexplode(starts).alias("win_no", "start_sec"))
    end = F.when(F.col("duration") > 0, F.least(F.col("start_sec") + size, F.col("duration"))).otherwise(F.lit(size))
    return rows.select(*keys, "win_no", round_half_even(F.col("start_sec"), 3).alias("start_sec"), round_half_even(end, 3).alias("end_sec"), round_half_even((F.col("start_sec") + end) / 2, 3).alias("center_sec"))
