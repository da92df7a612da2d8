"""Subtitle and review files: tolerant readers, from rows of whole file texts, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelore.functions.text import clock_seconds, slug, srt_seconds, srt_time, stamp, stripped, without_space

KEYS = ["media_id"]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """media_id (the file's name without its ending) and body of each text file under a path."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("media_id"), F.col("value").alias("body"))


def parse_srt(files: DataFrame, loose: bool = False, keys: list[str] = KEYS) -> DataFrame:
    """idx, start_sec, end_sec, text of each block that has a number, a time line and text; other blocks are left out.

    Texts lose all white space, and an end before its start becomes the start. ``loose``: blocks need three lines, whatever
    they hold; lines after the second are joined by spaces, empty texts stay, ends are left as they are, and the time line must
    begin with a time.
    """
    body = F.regexp_replace("body", r"\r\n?", "\n")
    gap = r"\n\n+" if loose else r"\n\s*\n+"
    blocks = files.select(*keys, F.posexplode(F.split(stripped(body), gap)).alias("block", "part"))
    if loose:
        lines = blocks.withColumn("lines", F.split(stripped(F.col("part")), "\n"))
    else:
        lines = blocks.withColumn("lines", F.filter(F.transform(F.split("part", "\n"), stripped), lambda x: x != ""))
    time = F.get("lines", F.lit(1))
    ends = F.split(time, r"\s+-->\s+" if loose else r"\s*-->\s*")
    shape = time.rlike(r"^\d+:\d+:\d+,\d+\s+-->\s+\d+:\d+:\d+,\d+") if loose else time.contains("-->")
    timed = lines.where((F.size("lines") >= 3) & shape).withColumns({"start_sec": srt_seconds(F.get(ends, F.lit(0))), "end_sec": srt_seconds(F.get(ends, F.lit(1)))}).where("start_sec is not null and end_sec is not null")
    rest = F.slice("lines", F.lit(3), F.size("lines"))
    if loose:
        rows = timed.withColumn("text", stripped(F.array_join(rest, " ")))
    else:
        rows = timed.withColumns({"text": without_space(F.array_join(rest, "")), "end_sec": F.greatest("start_sec", "end_sec")}).where("text <> ''")
    number = F.row_number().over(W.partitionBy(*keys).orderBy("block"))
    return rows.select(*keys, number.alias("idx"), "start_sec", "end_sec", "text")


def format_srt(segments: DataFrame, order: str = "seg_no", keys: list[str] = KEYS) -> DataFrame:
    """One file text a medium: numbered blocks of time line and stripped text."""
    numbered = segments.withColumn("number", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
    block = F.concat(F.col("number").cast("string"), F.lit("\n"), srt_time(F.col("start_sec")), F.lit(" --> "), srt_time(F.col("end_sec")), F.lit("\n"), stripped(F.col("text")), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("number", block.alias("block"))))
    return numbered.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n").alias("srt"))


def parse_review(files: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Highlights of a review in markdown: index, start_sec, end_sec, reason, confidence, by start.

    A section without a readable start or end is left out; a missing or unreadable confidence is 1, a missing reason empty.
    """
    head = r"(?imd)^##\s+highlight_(\d+)"
    sections = files.select(*keys, F.col("body"), F.regexp_extract_all("body", F.lit(head), F.lit(1)).alias("numbers"), F.slice(F.split("body", head), 2, 1_000_000).alias("parts"))
    rows = sections.select(*keys, F.posexplode(F.arrays_zip("numbers", "parts")).alias("place", "x")).select(*keys, "place", F.col("x.numbers").alias("number"), F.col("x.parts").alias("part"))
    field = lambda name: stripped(F.regexp_extract("part", rf"(?imd)^[*\-]\s*{name}:\s*(.+)$", 1))
    read = rows.select(*keys, "place", F.col("number").try_cast("int").alias("index"), clock_seconds(field("start")).alias("start_sec"), clock_seconds(field("end")).alias("end_sec"), field("reason").alias("reason"), F.coalesce(field("confidence").try_cast("double"), F.lit(1.0)).alias("confidence"))
    return read.where("start_sec is not null and end_sec is not null")


def clip_names(highlights: DataFrame, min_confidence: float, keys: list[str] = KEYS) -> DataFrame:
    """Adds clip_name, NN_MMmSSs_reason, numbered among the highlights that are sure enough."""
    sure = highlights.where((F.col("confidence") >= min_confidence) & ~F.isnan("confidence"))
    number = F.row_number().over(W.partitionBy(*keys).orderBy("start_sec", "place"))
    return sure.withColumn("clip_name", F.concat(F.format_string("%02d_", number), stamp(F.col("start_sec")), F.lit("_"), slug(F.col("reason"))))


def metric_report(metrics: DataFrame, least_similarity: float = 0.5, tolerance: float = 0.5, keys: list[str] = KEYS) -> DataFrame:
    """A text for each row of subtitle metrics; errors that are NaN read n/a."""
    ms = lambda c: F.when(F.isnan(c), "n/a").otherwise(F.format_string("%.1f ms", F.col(c) * 1000))
    lines = [
        F.lit("Subtitle Verification"),
        F.format_string("Pred blocks    : %d", "pred_count"),
        F.format_string("GT blocks      : %d", "gt_count"),
        F.format_string("Global CER     : %.4f", "global_cer"),
        F.format_string(f"Matched pairs  : %d (text similarity >= {least_similarity:.2f})", "matched_pairs"),
        F.concat(F.lit("Start error    : mean "), ms("start_error_mean_sec"), F.lit(", median "), ms("start_error_median_sec")),
        F.concat(F.lit("End error      : mean "), ms("end_error_mean_sec"), F.lit(", median "), ms("end_error_median_sec")),
        F.format_string(f"Match F1       : P=%.4f R=%.4f F1=%.4f (<= {tolerance:.1f}s timing tolerance)", "precision", "recall", "f1"),
        F.format_string("Correct matches: %d", "correct_matches"),
    ]
    return metrics.select(*keys, F.array_join(F.array(*lines), "\n").alias("report"))
