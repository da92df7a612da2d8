"""The driver's tables read as media timelines: segments, frames, series, windows, reviews. Seconds are multiples of 0.25."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tokens that score in the driver's text, nested ones among them, and those that force a second.
LEXICON = [("th", 1, False), ("the", 2, False), ("ing", 3, False), ("er", 1, False), ("tion", 4, True), ("ouer", 5, True)]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "keyword string, weight int, must_include boolean")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, seg_no, start_sec, end_sec, text from conversations."""
    c = _read(spark, sf_dir, "conversations")
    start = (F.col("turn") * 4 + ((F.col("conv_id") * 3 + F.col("turn") * 5) % 4) * 0.25).cast("double")
    return c.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seg_no"), start.alias("start_sec"), (start + 1 + (F.length("text") % 12) * 0.25).alias("end_sec"), "text")


def subtitle_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predicted and true subtitles: whole texts, the predicted shifted and shortened."""
    s = segments(spark, sf_dir)
    shift = ((F.col("seg_no") * 7 + F.col("media_id")) % 5 - 2) * 0.25
    pred = s.select("media_id", "seg_no", (F.col("start_sec") + shift).alias("start_sec"), (F.col("end_sec") + shift).alias("end_sec"), F.expr("substr(text, 1, greatest(0, length(text) - cast(seg_no % 3 as int)))").alias("text"))
    return pred, s


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled frames of one user's events each, every 2 s, with a pause of 4 s more after some."""
    e = _read(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    pauses = F.coalesce(F.count_if(F.col("event_id") % 11 == 0).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    e = e.withColumns({"ord": F.row_number().over(w), "pauses": pauses})
    faces = F.array(*[F.lit(x) for x in ("neutral", "happy", "angry", "surprised", "unclear")])
    return e.select(
        F.col("user_id").alias("media_id"),
        "event_id",
        ((F.col("ord") - 1) * 2.0 + F.col("pauses") * 4.0).alias("timestamp"),
        F.col("event_type").alias("scene_type"),
        F.least(F.lit(5), F.floor(F.col("value") / 82)).cast("int").alias("intensity"),
        (F.col("k") % 6).alias("danger_level"),
        (F.col("k") / 100).alias("confidence"),
        F.element_at(faces, F.col("k") % 5 + 1).alias("expression_a"),
        F.element_at(faces, (F.col("k") + F.col("event_id").cast("int")) % 5 + 1).alias("expression_b"),
        (F.col("k") % 7 == 0).alias("notable_change"),
        F.concat(F.lit("item "), F.col("k").cast("string")).alias("scene_summary"),
        (F.col("k") % 3 == 0).alias("selected"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, second, level: quantity by supplier and month, dense from 0 to 83."""
    li = _read(spark, sf_dir, "lineitem")
    second = ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).cast("long")
    sums = li.groupBy(F.col("l_suppkey").alias("media_id"), second.alias("second")).agg(F.sum(F.col("l_quantity").cast("long")).alias("level"))
    spine = li.select(F.col("l_suppkey").alias("media_id")).distinct().select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(83).cast("long"))).alias("second"))
    return spine.join(sums, ["media_id", "second"], "left").select("media_id", "second", F.coalesce("level", F.lit(0)).cast("double").alias("level"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored detector windows: 1.5 s long, every 0.5 s of media of 200 windows; the score comes from the label."""
    e = _read(spark, sf_dir, "embeddings")
    start = (F.col("vec_id") % 200) * 0.5
    score = ((F.col("label") * 37 + F.col("vec_id") * 13) % 64) / 64.0
    return e.select(F.expr("vec_id div 200").alias("media_id"), F.col("vec_id").alias("win_no"), start.alias("start_sec"), (start + 1.5).alias("end_sec"), (start + 0.75).alias("center_sec"), score.alias("score"), "embedding")


#: The same adapters as DuckDB common table expressions.
SQL = {
    "lexicon": "lexicon(keyword, weight, must_include) AS (VALUES " + ", ".join(f"('{k}', {w}, {str(m).lower()})" for k, w, m in LEXICON) + ")",
    "segments": """segments AS (
  SELECT conv_id AS media_id, turn AS seg_no, CAST(turn * 4 + ((conv_id * 3 + turn * 5) % 4) * 0.25 AS DOUBLE) AS start_sec,
    CAST(turn * 4 + ((conv_id * 3 + turn * 5) % 4) * 0.25 + 1 + (length(text) % 12) * 0.25 AS DOUBLE) AS end_sec, text
  FROM conversations)""",
    "pair": """gt AS (SELECT * FROM segments),
pred AS (
  SELECT media_id, seg_no, CAST(start_sec + ((seg_no * 7 + media_id) % 5 - 2) * 0.25 AS DOUBLE) AS start_sec,
    CAST(end_sec + ((seg_no * 7 + media_id) % 5 - 2) * 0.25 AS DOUBLE) AS end_sec, substr(text, 1, CAST(greatest(0, length(text) - seg_no % 3) AS BIGINT)) AS text
  FROM gt)""",
    "frames": """e AS (
  SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord,
    coalesce(sum(CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pauses
  FROM events),
frames AS (
  SELECT user_id AS media_id, event_id, CAST((ord - 1) * 2 + pauses * 4 AS DOUBLE) AS timestamp, event_type AS scene_type, CAST(least(5, floor(value / 82)) AS INTEGER) AS intensity,
    k % 6 AS danger_level, CAST(k AS DOUBLE) / 100 AS confidence,
    CASE k % 5 WHEN 0 THEN 'neutral' WHEN 1 THEN 'happy' WHEN 2 THEN 'angry' WHEN 3 THEN 'surprised' ELSE 'unclear' END AS expression_a,
    CASE (k + event_id) % 5 WHEN 0 THEN 'neutral' WHEN 1 THEN 'happy' WHEN 2 THEN 'angry' WHEN 3 THEN 'surprised' ELSE 'unclear' END AS expression_b,
    k % 7 = 0 AS notable_change, 'item ' || CAST(k AS VARCHAR) AS scene_summary, k % 3 = 0 AS selected
  FROM e)""",
    "series": """spine AS (SELECT media_id, unnest(range(84)) AS second FROM (SELECT DISTINCT l_suppkey AS media_id FROM lineitem) AS x),
sums AS (SELECT l_suppkey AS media_id, (year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS second, sum(CAST(l_quantity AS BIGINT)) AS level FROM lineitem GROUP BY ALL),
series AS (SELECT spine.media_id, spine.second, CAST(coalesce(level, 0) AS DOUBLE) AS level FROM spine LEFT JOIN sums ON sums.media_id = spine.media_id AND sums.second = spine.second)""",
    "windows": """windows AS (
  SELECT vec_id // 200 AS media_id, vec_id AS win_no, vec_id % 200 * CAST(0.5 AS DOUBLE) AS start_sec, vec_id % 200 * CAST(0.5 AS DOUBLE) + 1.5 AS end_sec, vec_id % 200 * CAST(0.5 AS DOUBLE) + 0.75 AS center_sec,
    CAST((label * 37 + vec_id * 13) % 64 AS DOUBLE) / 64 AS score, embedding
  FROM embeddings)""",
}
