"""Interval and band joins by time buckets, so that they are hash joins and never nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelore.functions.edits import similarity
from framelore.functions.text import slug, stripped
from framelore.operators.bounded import beside

KEYS = ["media_id"]


def _bucketed(df: DataFrame, low: Column, high: Column, size: float) -> DataFrame:
    return df.withColumn("bucket", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))


def overlap_join(left: DataFrame, right: DataFrame, tolerance: float = 0.0, size: float = 16.0, keys: list[str] = KEYS) -> DataFrame:
    """Pairs of rows of which ``right`` touches ``left`` widened by ``tolerance``; ends count as inside.

    Both sides have start_sec and end_sec; in the result they carry l_ and r_, as all columns but the keys do. A pair comes
    out of the bucket in which the later of both begins, so no pair comes twice and none needs removing.
    """
    ls, le = F.col("start_sec") - tolerance, F.col("end_sec") + tolerance
    a = _bucketed(left, ls, le, size).select(*keys, "bucket", *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in keys])
    b = _bucketed(right, F.col("start_sec"), F.col("end_sec"), size).select(*keys, "bucket", *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    first = F.floor(F.greatest(F.col("l_start_sec") - tolerance, F.col("r_start_sec")) / size)
    touch = (F.col("r_end_sec") >= F.col("l_start_sec") - tolerance) & (F.col("r_start_sec") <= F.col("l_end_sec") + tolerance)
    return a.join(b, [*keys, "bucket"]).where(touch & (F.col("bucket") == first)).drop("bucket")


def near_join(points: DataFrame, rows: DataFrame, width: float, size: float = 32.0, keys: list[str] = KEYS) -> DataFrame:
    """Pairs of a point (center_sec) and a row whose start lies at most ``width`` from it."""
    a = _bucketed(points, F.col("center_sec") - width, F.col("center_sec") + width, size)
    b = rows.withColumn("bucket", F.floor(F.col("start_sec") / size))
    return a.join(b, [*keys, "bucket"]).where(F.abs(F.col("start_sec") - F.col("center_sec")) <= width).drop("bucket")


def clip_segments(clips: DataFrame, segments: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """A clip's segments with times counted from the clip's start, not below zero, numbered from 1."""
    from pyspark.sql import Window as W

    pairs = overlap_join(clips, segments, keys=keys)
    number = F.row_number().over(W.partitionBy(*keys, "l_clip_no").orderBy("r_seg_no"))
    zero = F.lit(0.0)
    return pairs.select(*keys, F.col("l_clip_no").alias("clip_no"), number.alias("number"), F.greatest(zero, F.col("r_start_sec") - F.col("l_start_sec")).alias("start_sec"), F.greatest(zero, F.col("r_end_sec") - F.col("l_start_sec")).alias("end_sec"), F.col("r_text").alias("text"))


def nearby_text(points: DataFrame, segments: DataFrame, width: float = 12.0, most: int = 300, keys: list[str] = KEYS) -> DataFrame:
    """The dialogue around each point (center_sec), in order, joined by " / " and cut; "(no dialogue)" where there is none."""
    stripped = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    found = near_join(points, segments.withColumn("text", stripped).where("text <> ''"), width, keys=keys)
    texts = found.groupBy(*keys, "center_sec").agg(F.array_sort(F.collect_list(F.struct("seg_no", "text"))).alias("texts"))
    joined = F.substring(F.array_join(F.transform("texts", lambda x: x["text"]), " / "), 1, most)
    return points.join(texts, [*keys, "center_sec"], "left").select(*keys, "center_sec", F.coalesce(joined, F.lit("(no dialogue)")).alias("nearby"))


def describe_clips(points: DataFrame, segments: DataFrame, lexicon: DataFrame, width: float = 8.0, most: int = 28, keys: list[str] = KEYS) -> DataFrame:
    """A short name for each point (center_sec): the nearby text of the highest weight of words that it holds, as a slug.

    Of a tie the first text counts; where the best is blank, the first nearby one; "clip" where nothing is left. The lexicon is
    a parameter of bounded size.
    """
    words = beside(segments.select(*keys, "seg_no", "start_sec", "text"), lexicon)
    score = F.sum(F.when(F.col("text").contains(F.col("keyword")), F.col("weight")).otherwise(0)).alias("score")
    scored = words.groupBy(*keys, "seg_no", "start_sec", "text").agg(score)
    near = near_join(points.select(*keys, "center_sec"), scored, width, keys=keys).withColumn("text", stripped(F.col("text")))
    found = near.groupBy(*keys, "center_sec").agg(F.min_by("text", F.struct((-F.col("score")).alias("s"), "seg_no")).alias("best"), F.min_by("text", "seg_no").alias("first"))
    named = points.join(found, [*keys, "center_sec"], "left")
    text = F.coalesce(F.when(F.col("best") == "", F.col("first")).otherwise(F.col("best")), F.lit(""))
    return named.select(*keys, "center_sec", slug(text, most).alias("description"))


def value_at(points: DataFrame, levels: DataFrame, value: str, keys: list[str] = KEYS) -> DataFrame:
    """Adds value: the series at each point's second (center_sec), the last one beyond its end, 0 without a series."""
    last = levels.groupBy(*keys).agg(F.max("second").alias("last_second"))
    at = points.join(last, keys, "left").withColumn("second_at", F.least(F.floor("center_sec"), F.col("last_second")))
    own = levels.select(*keys, F.col("second").alias("second_at"), F.col(value).alias("value"))
    return at.join(own, [*keys, "second_at"], "left").select(*points.columns, F.coalesce("value", F.lit(0.0)).alias("value"))


def subtitle_candidates(pred: DataFrame, true: DataFrame, tolerance: float = 1.0, keys: list[str] = KEYS, least: float | None = None) -> DataFrame:
    """Pairs of subtitles that overlap, or of which starts or ends differ by at most ``tolerance``, and how alike their texts are.

    With ``least`` only pairs of that similarity come out, and texts are not compared further than that needs. Pairs are dealt
    out to all tasks before they are compared, however few files or tasks the subtitles came from.
    """
    a, b, c, d = F.col("l_start_sec"), F.col("l_end_sec"), F.col("r_start_sec"), F.col("r_end_sec")
    overlap = F.greatest(F.lit(0.0), F.least(b, d) - F.greatest(a, c))
    gap = F.least(F.abs(a - c), F.abs(b - d))
    pairs = overlap_join(pred, true, tolerance, keys=keys).withColumns({"overlap_sec": overlap, "gap_sec": gap})
    dealt = pairs.where("overlap_sec > 0 or gap_sec <= " + repr(float(tolerance))).repartition(*keys, "l_seg_no", "r_seg_no")
    found = dealt.select(*keys, F.col("l_seg_no").alias("pred_no"), F.col("r_seg_no").alias("true_no"), "overlap_sec", similarity(F.col("l_text"), F.col("r_text"), least).alias("similarity"), "gap_sec", F.abs(a - c).alias("start_error_sec"), F.abs(b - d).alias("end_error_sec"))
    return found if least is None else found.where("similarity is not null")
