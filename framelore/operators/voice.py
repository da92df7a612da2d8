"""Voiced stretches of recordings, and how well subtitles match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelore.functions.edits import edit_distance
from framelore.operators.islands import merge_intervals, runs
from framelore.operators.joins import subtitle_candidates
from framelore.operators.selection import match_pairs, split_long

KEYS = ["media_id"]


def voiced(frames: DataFrame, level: str, least: float, factor: float = 1.8, keys: list[str] = KEYS) -> DataFrame:
    """Adds voiced: a level of at least ``least`` and ``factor`` times the medium's 35th percentile."""
    quiet = F.expr(f"percentile({level}, 0.35)").over(W.partitionBy(*keys))
    return frames.withColumn("voiced", F.col(level) >= F.greatest(F.lit(least), quiet * factor))


def voiced_intervals(frames: DataFrame, level: str, order: str, hop: float, least: float, gap: float, keys: list[str] = KEYS) -> DataFrame:
    """Voiced runs as seconds, with short gaps closed."""
    found = runs(voiced(frames, level, least, keys=keys), "voiced", order, keys)
    seconds = found.select(*keys, (F.col("first") * hop).alias("start_sec"), ((F.col("last") + 1) * hop).alias("end_sec"))
    return merge_intervals(seconds, gap, keys)


def trimmed(intervals: DataFrame, edge: float, shortest: float, durations: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Intervals widened by ``edge`` within the medium; those under half of ``shortest`` are left out."""
    wide = intervals.join(durations, keys).select(*keys, F.greatest(F.lit(0.0), F.col("start_sec") - edge).alias("start_sec"), F.least("duration", F.col("end_sec") + edge).alias("end_sec"))
    return wide.where(F.col("end_sec") - F.col("start_sec") >= shortest / 2)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def frame_rms(samples: DataFrame, value: str, order: str, size: int, hop: int, keys: list[str] = KEYS) -> DataFrame:
    """frame_no, rms of frames of ``size`` samples, one every ``hop``; only whole frames. ``order`` numbers samples from 0."""
    at = F.col(order)
    frame = F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((at - size) / hop) + 1), F.floor(at / hop)))
    each = samples.select(*keys, frame.alias("frame_no"), F.col(value).cast("double").alias("x")) if hop <= size else samples.where(at % hop < size).select(*keys, F.floor(at / hop).alias("frame_no"), F.col(value).cast("double").alias("x"))
    return each.groupBy(*keys, "frame_no").agg(F.sqrt(F.avg(F.col("x") * F.col("x")) + 1e-12).alias("rms"), F.count("*").alias("n")).where(F.col("n") == size).drop("n")


def prepared_clips(frames: DataFrame, level: str, order: str, hop: float, least: float, gap: float, shortest: float, longest: float, least_voice: float, edge: float = 0.0) -> DataFrame:
    """Clips for enrolment: voiced stretches with gaps closed and widened by ``edge``, long ones split at quiet places, short or
    quiet ones left out.

    ``frames``: media_id, ``order`` (a frame's number) and level. Returns media_id, clip_no (from 1, by kept clips only),
    start_sec, end_sec, voice_sec: seconds of frames at the level of ``least`` or more.
    """
    ends = frames.groupBy("media_id").agg(((F.max(order) + 1) * hop).alias("duration"))
    found = trimmed(voiced_intervals(frames, level, order, hop, least, gap), edge, shortest, ends)
    at = (F.col(order) * hop).alias("at_sec")
    pieces = split_long(found, frames.select("media_id", at, F.col(level).alias("rms")), shortest, longest)
    loud = frames.where(F.col(level) >= least).select("media_id", F.col(order).alias("frame"))
    inside = pieces.select("*", F.explode(F.sequence(F.ceil(F.col("start_sec") / hop), F.ceil(F.col("end_sec") / hop) - 1)).alias("frame"))
    voice = inside.join(loud, ["media_id", "frame"]).groupBy("media_id", "start_sec", "end_sec").agg((F.count("*") * hop).alias("voice_sec"))
    kept = voice.where((F.col("end_sec") - F.col("start_sec") >= shortest) & (F.col("voice_sec") >= least_voice))
    number = F.row_number().over(W.partitionBy("media_id").orderBy("start_sec")).cast("long")
    return kept.select("media_id", number.alias("clip_no"), "start_sec", "end_sec", "voice_sec")


def evaluate_subtitles(pred: DataFrame, true: DataFrame, least_similarity: float = 0.5, tolerance: float = 0.5, search: float = 1.0) -> DataFrame:
    """How well predicted subtitles agree with true ones, one row a medium.

    Blocks are matched one to one; matched_pairs are the matches of sufficient similarity, over which start and end errors are
    taken (NaN without any); correct_matches are those within ``tolerance`` at both ends, which precision, recall and F1 count.
    """
    matches = match_pairs(subtitle_candidates(pred, true, search)).where(F.col("similarity") >= least_similarity)
    right = (F.col("start_error_sec") <= tolerance) & (F.col("end_error_sec") <= tolerance)
    middle = lambda c: F.expr(f"percentile({c}, 0.5)")
    found = matches.groupBy("media_id").agg(
        F.count("*").alias("matched_pairs"), F.count_if(right).alias("correct_matches"),
        F.avg("start_error_sec").alias("start_error_mean_sec"), middle("start_error_sec").alias("start_error_median_sec"),
        F.avg("end_error_sec").alias("end_error_mean_sec"), middle("end_error_sec").alias("end_error_median_sec"),
    )
    counts = pred.groupBy("media_id").agg(F.count("*").alias("pred_count")).join(true.groupBy("media_id").agg(F.count("*").alias("gt_count")), "media_id", "full")
    cer = character_error_rate(pred, true).withColumnRenamed("cer", "global_cer")
    errors = [c for c in found.columns if c.endswith("_sec")]
    out = counts.join(cer, "media_id").join(found, "media_id", "left").fillna(0, ["pred_count", "gt_count", "matched_pairs", "correct_matches"]).fillna(float("nan"), errors)
    p, r = _ratio(F.col("correct_matches"), F.col("pred_count")), _ratio(F.col("correct_matches"), F.col("gt_count"))
    return out.withColumns({"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)})


def character_error_rate(pred: DataFrame, true: DataFrame, order: str = "seg_no", keys: list[str] = KEYS) -> DataFrame:
    """Edit distance of a medium's whole texts over the true one's length; with no true text 0 if there is none either, else 1."""
    whole = lambda df, name: df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "").alias(name))
    both = whole(pred, "p").join(whole(true, "t"), keys, "full").fillna("", ["p", "t"])
    n = F.length("t")
    return both.repartition(*keys).select(*keys, F.when(n > 0, edit_distance(F.col("p"), F.col("t")) / n).when(F.length("p") > 0, 1.0).otherwise(0.0).alias("cer"))
