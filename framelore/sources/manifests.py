"""JSON files in and out, summaries of speakers, and the sheet of candidates that a reviewer reads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEYS = ["media_id"]


def read_json(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """Rows of whole-file JSON under a path, or those of the list ``field`` in it; none where the path or the list is missing."""
    inner = f"{field} array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in StructType.fromDDL(schema))}>>" if field else schema
    try:
        rows = spark.read.schema(inner).json(path, multiLine=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.select(F.inline(field)) if field else rows


def listed(columns: list[str], order: str) -> Column:
    """A group's rows as an ordered list. One medium's or speaker's rows, so bounded by its length."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), F.struct(*columns).alias("_row"))))
    return F.transform(rows, lambda x: x["_row"])


def manifest(rows: DataFrame, field: str, order: str, keys: list[str] = KEYS, pretty: bool = True) -> DataFrame:
    """One JSON text a medium: its keys and its rows, in order, as the list ``field``. Nulls are written."""
    columns = [c for c in rows.columns if c not in keys]
    whole = rows.groupBy(*keys).agg(listed(columns, order).alias(field))
    options = {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}
    return whole.select(*keys, F.to_json(F.struct(*keys, field), options).alias("json"))


def speaker_summary(sources: DataFrame, clips: DataFrame) -> DataFrame:
    """source_count, total_clips, clip_sec and sources (each with its clip_count) of every speaker.

    ``sources``: speaker, source; ``clips``: speaker, source, start_sec, end_sec. Sources without clips count too.
    """
    each = clips.groupBy("speaker", "source").agg(F.count("*").alias("clip_count"), F.sum(F.col("end_sec") - F.col("start_sec")).alias("clip_sec"))
    full = sources.select("speaker", "source").distinct().join(each, ["speaker", "source"], "left").fillna(0, ["clip_count", "clip_sec"])
    return full.groupBy("speaker").agg(F.count("*").alias("source_count"), F.sum("clip_count").alias("total_clips"), F.sum("clip_sec").alias("clip_sec"), listed(["source", "clip_count"], "source").alias("sources"))


#: What a reviewer writes back, as ``subtitles.parse_review`` reads it.
ANSWER = """```
## highlight_01
* start: MM:SS
* end: MM:SS
* reason: a few words
* confidence: 0.00-1.00
```"""


def _number(c: str, places: int) -> Column:
    return F.format_string(f"%.{places}f", F.bround(F.col(c).cast("double"), places))


def candidate_sheet(candidates: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """A markdown sheet a medium from rows of candidate_no, center_sec, score, level, event_score, nearby."""
    second = F.floor("center_sec").cast("long")
    at = F.format_string("%02d:%02d", F.expr("cast(floor(center_sec) as bigint) div 60"), second % 60)
    block = F.concat_ws(
        "\n",
        F.concat(F.format_string("## Candidate %02d - ", F.col("candidate_no").cast("long")), at),
        F.concat(F.lit("- at "), at, F.lit(" ("), _number("center_sec", 0), F.lit(" s)")),
        F.concat(F.lit("- score "), _number("score", 3)),
        F.concat(F.lit("- loudness "), _number("level", 3)),
        F.concat(F.lit("- event "), _number("event_score", 3)),
        F.concat(F.lit("- dialogue: "), F.coalesce("nearby", F.lit(""))),
        F.lit(""),
    )
    sheets = candidates.withColumn("block", block).groupBy(*keys).agg(listed(["block"], "candidate_no").alias("blocks"))
    title = F.concat(F.lit("# Candidates of "), F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]))
    count = F.concat(F.size("blocks").cast("string"), F.lit(" in all. For each that you keep, write:"))
    parts = F.concat(F.array(title, F.lit(""), count, F.lit(""), F.lit(ANSWER), F.lit("")), F.transform("blocks", lambda b: b["block"]))
    return sheets.select(*keys, F.array_join(parts, "\n").alias("sheet"))
