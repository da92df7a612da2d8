"""Driver queries of the media-timeline operators, and their DuckDB SQL.

Computed doubles are rounded to six places on both sides, after sums of exact binary fractions wherever there is a choice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelore.functions import text as T
from framelore.functions.rounding import round_half_even
from framelore.operators import cache, chunks, detector, images, islands, joins, long_selection, quantiles, selection, series, shared, vectors, voice
from framelore.sources import adapters as A
from framelore.sources import manifests, media_files, pcm, recordings, subtitles
from framelore.streaming import timeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *parts: str) -> Callable:
    """Register a query; ``parts`` names the adapters whose tables its SQL reads."""

    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            text = sql.strip()
            ctes = ", ".join(A.SQL[p] for p in parts)
            ORACLE_SQL[fn.__name__] = f"WITH RECURSIVE {ctes}{', ' if text.startswith('+') else ' '}{text.removeprefix('+')}" if parts else text
        return fn

    return add


def same_rows(name: str) -> Callable:
    """Register a query whose rows are those of an earlier one, reached in another way; it has the same SQL."""

    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        ORACLE_SQL[fn.__name__] = ORACLE_SQL[name]
        return fn

    return add


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


COUNT = "(length(text) - length(replace(text, keyword, ''))) // length(keyword)"
KEYWORDS = f"""hits AS (SELECT media_id, seg_no, CAST(floor(start_sec) AS BIGINT) AS second, CAST(sum(weight * ({COUNT})) AS BIGINT) AS s FROM segments, lexicon GROUP BY ALL),
ks AS (SELECT media_id, second, CAST(sum(s) AS BIGINT) AS score, count(*) AS density FROM hits GROUP BY media_id, second)"""
TEXT_SERIES = f"""{KEYWORDS},
dur AS (SELECT media_id, arg_max(end_sec, seg_no) AS d FROM segments GROUP BY media_id),
sp AS (SELECT media_id, unnest(range(CAST(floor(d) AS BIGINT) + 2)) AS second FROM dur),
z AS (SELECT sp.media_id, sp.second, coalesce(score, 0) AS score, coalesce(density, 0) AS density FROM sp LEFT JOIN ks ON ks.media_id = sp.media_id AND ks.second = sp.second),
sm AS (SELECT media_id, second, sum(score) OVER w / CAST(5 AS DOUBLE) AS score, sum(density) OVER w / CAST(5 AS DOUBLE) AS density FROM z WINDOW w AS (PARTITION BY media_id ORDER BY second ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
ts AS (SELECT media_id, second, score + CASE WHEN max(density) OVER (PARTITION BY media_id) > 0 THEN density / max(density) OVER (PARTITION BY media_id) * 3 ELSE density END AS score FROM sm)"""


@query(f"+{TEXT_SERIES} SELECT media_id, second, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY round(score, 6) DESC, second) AS rn FROM ts) AS x WHERE rn = 1", "segments", "lexicon")
def text_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most exciting second of each conversation, by its words."""
    scored = _round(series.text_series(A.segments(spark, sf_dir), A.lexicon(spark)), "score")
    best = F.row_number().over(W.partitionBy("media_id").orderBy(F.desc("score"), "second"))
    return scored.withColumn("rn", best).where("rn = 1").drop("rn")


@query(f"+{KEYWORDS} SELECT media_id, second, score, density FROM ks", "segments", "lexicon")
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(series.keyword_scores(A.segments(spark, sf_dir), A.lexicon(spark)), "score", "density")


@query("SELECT media_id, CAST(floor(start_sec) AS BIGINT) AS second, row_number() OVER (PARTITION BY media_id ORDER BY seg_no, keyword) AS ord FROM segments, lexicon WHERE must_include AND contains(text, keyword)", "segments", "lexicon")
def must_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(series.must_include(A.segments(spark, sf_dir), A.lexicon(spark)), "ord")


@query(f"+{TEXT_SERIES} SELECT media_id, second, round(score, 6) AS score FROM ts", "segments", "lexicon")
def text_score_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(series.text_series(A.segments(spark, sf_dir), A.lexicon(spark)), "score")


NORM = "(level - min(level) OVER m) / (max(level) OVER m - min(level) OVER m + 1e-9)"


@query(f"SELECT media_id, second, round({NORM}, 6) AS norm FROM series WINDOW m AS (PARTITION BY media_id)", "series")
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.series(spark, sf_dir).select("media_id", "second", series.normalised("level").alias("norm")), "norm")


def _two(df: DataFrame) -> DataFrame:
    return df.withColumn("other", (F.col("level") * 7 + F.col("second") * 13) % 101)


@query("""+t AS (SELECT media_id, second, level, (level * 7 + second * 13) % 101 AS other FROM series),
n AS (SELECT media_id, second, 0.45 * (level - min(level) OVER m) / (max(level) OVER m - min(level) OVER m + 1e-9) + 0.55 * (other - min(other) OVER m) / (max(other) OVER m - min(other) OVER m + 1e-9) AS x FROM t WINDOW m AS (PARTITION BY media_id))
SELECT media_id, second, round(sum(x) OVER (PARTITION BY media_id ORDER BY second ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS fused FROM n""", "series")
def fused_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.fuse(_two(A.series(spark, sf_dir)), {"level": 0.45, "other": 0.55})
    return _round(out.select("media_id", "second", "fused"), "fused")


@query("SELECT l_suppkey AS media_id, CAST(year(l_shipdate) AS BIGINT) AS bucket, round(sqrt(CAST(sum(CAST(l_quantity AS BIGINT) * CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*)), 6) AS rms FROM lineitem GROUP BY ALL")
def rms_per_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("media_id"), "l_shipdate", "l_quantity")
    return _round(series.rms_per_bucket(li, "l_quantity", F.year("l_shipdate").cast("long")), "rms")


SMOOTH5 = "0.1 * coalesce(lag(level, 2) OVER w, 0) + 0.25 * coalesce(lag(level, 1) OVER w, 0) + 0.3 * level + 0.25 * coalesce(lead(level, 1) OVER w, 0) + 0.1 * coalesce(lead(level, 2) OVER w, 0)"


@query(f"""+s AS (SELECT media_id, second, {SMOOTH5} AS smoothed FROM series WINDOW w AS (PARTITION BY media_id ORDER BY second)),
b AS (SELECT media_id, second, smoothed, quantile_cont(smoothed, 0.5) OVER (PARTITION BY media_id ORDER BY second ROWS BETWEEN 30 PRECEDING AND 29 FOLLOWING) AS baseline FROM s)
SELECT media_id, second, round(smoothed, 6) AS smoothed, round(baseline, 6) AS baseline, round(smoothed / (baseline + 1e-6), 6) AS ratio FROM b""", "series")
def rolling_median_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.audio_excitement(A.series(spark, sf_dir)).select("media_id", "second", "smoothed", "baseline", "ratio")
    return _round(out, "smoothed", "baseline", "ratio")


@query("""+f AS (SELECT media_id, CASE WHEN second % 11 = 0 THEN second // 2 ELSE second + 40 END AS second, second AS ord FROM series WHERE level % 5 = 0),
k AS (SELECT media_id, second, row_number() OVER (PARTITION BY media_id ORDER BY ord) AS k FROM f WHERE second < 84),
l AS (SELECT media_id, second, max(k) AS k FROM k GROUP BY ALL)
SELECT s.media_id, s.second, round(coalesce(max(level) OVER (PARTITION BY s.media_id) * pow(1.5, k), level), 2) AS boosted FROM series AS s LEFT JOIN l ON l.media_id = s.media_id AND l.second = s.second""", "series")
def forced_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.series(spark, sf_dir)
    forced = s.where("level % 5 = 0").select("media_id", F.expr("case when second % 11 = 0 then second div 2 else second + 40 end").alias("second"), F.col("second").alias("ord"))
    # Values reach 10 ** 10 here, so they are rounded to two places.
    return series.boost(s, forced, "level").select("media_id", "second", F.round("boosted", 2).alias("boosted"))


@query(f"""+n AS (SELECT media_id, second, {NORM} AS norm FROM series WINDOW m AS (PARTITION BY media_id))
SELECT media_id, second, round(avg(norm) OVER (PARTITION BY media_id ORDER BY second ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS mean FROM n""", "series")
def window_mean_excitement(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.series(spark, sf_dir).select("media_id", "second", series.normalised("level").alias("norm"))
    return _round(n.select("media_id", "second", series.window_mean("norm").alias("mean")), "mean")


@query("SELECT media_id, round(quantile_cont(level, 0.6), 6) AS p60, round(quantile_cont(level, 0.35), 6) AS p35 FROM series GROUP BY media_id", "series")
def percentile_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.series(spark, sf_dir).groupBy("media_id").agg(F.expr("percentile(level, 0.6)").alias("p60"), F.expr("percentile(level, 0.35)").alias("p35")), "p60", "p35")


@query("""SELECT media_id, event_id, timestamp, last_value(CASE WHEN selected THEN scene_type END IGNORE NULLS) OVER w AS scene_type,
  CASE WHEN NOT selected THEN last_value(CASE WHEN selected THEN timestamp END IGNORE NULLS) OVER w END AS source_timestamp
FROM frames WINDOW w AS (PARTITION BY media_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "frames")
def locf_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.carry_forward(A.frames(spark, sf_dir), "selected", ["scene_type"]).select("media_id", "event_id", "timestamp", "scene_type", "source_timestamp")


SMOOTHED = """sm AS (
  SELECT media_id, event_id, timestamp, confidence, notable_change, scene_summary,
    CAST(round_even(avg(intensity) OVER n, 0) AS INTEGER) AS intensity, CAST(round_even(avg(danger_level) OVER n, 0) AS INTEGER) AS danger_level,
    CASE WHEN lag(expression_a) OVER w = lead(expression_a) OVER w AND lag(expression_a) OVER w <> expression_a AND confidence < 0.85 THEN lag(expression_a) OVER w ELSE expression_a END AS expression_a,
    CASE WHEN lag(expression_b) OVER w = lead(expression_b) OVER w AND lag(expression_b) OVER w <> expression_b AND confidence < 0.85 THEN lag(expression_b) OVER w ELSE expression_b END AS expression_b,
    CASE WHEN lag(scene_type) OVER w = lead(scene_type) OVER w AND confidence < greatest(lag(confidence) OVER w, lead(confidence) OVER w) + CAST(0.2 AS DOUBLE) THEN lag(scene_type) OVER w ELSE scene_type END AS scene_type
  FROM frames WINDOW w AS (PARTITION BY media_id ORDER BY timestamp), n AS (PARTITION BY media_id ORDER BY timestamp ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


@query(f"+{SMOOTHED} SELECT media_id, event_id, intensity, danger_level, expression_a, expression_b, scene_type FROM sm", "frames")
def smooth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.smooth_frames(A.frames(spark, sf_dir)).select("media_id", "event_id", "intensity", "danger_level", "expression_a", "expression_b", "scene_type")


@query("""+b AS (SELECT *, CASE WHEN scene_type <> lag(scene_type) OVER w OR timestamp - lag(timestamp) OVER w > 3 THEN 1 ELSE 0 END AS b FROM frames WINDOW w AS (PARTITION BY media_id ORDER BY timestamp)),
i AS (SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS island FROM b),
c AS (SELECT media_id, island, expression_a, count(*) AS n, min(timestamp) AS seen FROM i GROUP BY ALL),
d AS (SELECT media_id, island, expression_a FROM (SELECT *, row_number() OVER (PARTITION BY media_id, island ORDER BY n DESC, seen) AS rn FROM c) AS x WHERE rn = 1),
c2 AS (SELECT media_id, island, expression_b, count(*) AS n, min(timestamp) AS seen FROM i GROUP BY ALL),
d2 AS (SELECT media_id, island, expression_b FROM (SELECT *, row_number() OVER (PARTITION BY media_id, island ORDER BY n DESC, seen) AS rn FROM c2) AS x WHERE rn = 1),
g AS (SELECT media_id, island, min(timestamp) AS start_sec, max(timestamp) AS last, min(scene_type) AS scene_type, avg(intensity) AS ai, avg(danger_level) AS ad, count(*) AS frame_count FROM i GROUP BY ALL),
s AS (SELECT media_id, island, scene_summary FROM (SELECT *, row_number() OVER (PARTITION BY media_id, island ORDER BY confidence DESC, timestamp) AS rn FROM i) AS x WHERE rn = 1)
SELECT g.media_id, start_sec, coalesce(lead(start_sec) OVER (PARTITION BY g.media_id ORDER BY g.island), last + 2) AS end_sec, scene_type, round_even(ai, 3) AS avg_intensity, round_even(ad, 3) AS avg_danger_level, frame_count, expression_a, expression_b, scene_summary
FROM g JOIN d ON d.media_id = g.media_id AND d.island = g.island JOIN d2 ON d2.media_id = g.media_id AND d2.island = g.island JOIN s ON s.media_id = g.media_id AND s.island = g.island""", "frames")
def scene_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.scenes(A.frames(spark, sf_dir), 0.5).drop("island", "avg_confidence")


@query("""+p AS (SELECT *, lag(scene_type) OVER w AS s0, lag(intensity) OVER w AS i0, lag(danger_level) OVER w AS d0, lag(expression_a) OVER w AS a0, lag(expression_b) OVER w AS b0, lag(confidence) OVER w AS c0 FROM frames WINDOW w AS (PARTITION BY media_id ORDER BY timestamp))
SELECT media_id, timestamp, 'scene_transition' AS event_type, greatest(confidence, c0) AS confidence FROM p WHERE scene_type <> s0
UNION ALL SELECT media_id, timestamp, 'intensity_spike', confidence FROM p WHERE intensity - i0 >= 2
UNION ALL SELECT media_id, timestamp, 'danger_spike', confidence FROM p WHERE danger_level - d0 >= 2
UNION ALL SELECT media_id, timestamp, 'expression_a_change', confidence FROM p WHERE expression_a <> a0 AND expression_a NOT IN ('neutral', 'unclear')
UNION ALL SELECT media_id, timestamp, 'expression_b_change', confidence FROM p WHERE expression_b <> b0 AND expression_b NOT IN ('neutral', 'unclear')
UNION ALL SELECT media_id, timestamp, 'notable_change', confidence FROM p WHERE notable_change""", "frames")
def scene_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.frame_events(A.frames(spark, sf_dir))


@query("""+t AS (SELECT * FROM windows WHERE score >= 0.6),
b AS (SELECT *, CASE WHEN start_sec - lag(end_sec) OVER (PARTITION BY media_id ORDER BY win_no) > 0.75 THEN 1 ELSE 0 END AS b FROM t),
i AS (SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY win_no ROWS UNBOUNDED PRECEDING) AS island FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY media_id, island ORDER BY score DESC, win_no DESC) AS best, row_number() OVER (PARTITION BY media_id, island ORDER BY win_no DESC) AS last FROM i)
SELECT media_id, CAST(island AS BIGINT) AS island, min(start_sec) AS start_sec, max(CASE WHEN last = 1 THEN end_sec END) AS end_sec, max(CASE WHEN best = 1 THEN center_sec END) AS peak_sec, max(score) AS peak_prob FROM r GROUP BY media_id, island""", "windows")
def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(islands.merge_windows(A.windows(spark, sf_dir), 0.6, 0.75), "island")


@query("""+b AS (SELECT *, CASE WHEN start_sec - max(end_sec) OVER (PARTITION BY media_id ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0.5 THEN 1 ELSE 0 END AS b FROM segments),
i AS (SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY start_sec, end_sec ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT media_id, CAST(island AS BIGINT) AS island, min(start_sec) AS start_sec, max(end_sec) AS end_sec FROM i GROUP BY media_id, island""", "segments")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(islands.merge_intervals(A.segments(spark, sf_dir), 0.5), "island")


@query("""+v AS (SELECT media_id, second, level >= greatest(5, 1.8 * quantile_cont(level, 0.35) OVER (PARTITION BY media_id)) AS v FROM series),
i AS (SELECT *, second - row_number() OVER (PARTITION BY media_id ORDER BY second) AS island FROM v WHERE v)
SELECT media_id, min(second) AS first, max(second) AS last FROM i GROUP BY media_id, island""", "series")
def voiced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.runs(voice.voiced(A.series(spark, sf_dir), "level", 5.0), "voiced", "second").select("media_id", "first", "last")


TIME = "printf('%02d:%02d:%02d,%03d', CAST(floor({0}) AS BIGINT) // 3600, CAST(floor({0}) AS BIGINT) % 3600 // 60, CAST(floor({0}) AS BIGINT) % 60, CAST(({0} - floor({0})) * 1000 AS BIGINT))"
CLIPS = "clips AS (SELECT media_id, seg_no AS clip_no, start_sec - 2 AS cs, start_sec + 5 AS ce, start_sec AS center_sec FROM segments)"


def _clips(s: DataFrame) -> DataFrame:
    return s.select("media_id", F.col("seg_no").alias("clip_no"), (F.col("start_sec") - 2).alias("start_sec"), (F.col("start_sec") + 5).alias("end_sec"))


@query(f"""+{CLIPS}
SELECT s.media_id, clip_no, row_number() OVER (PARTITION BY s.media_id, clip_no ORDER BY seg_no) AS number, greatest(0, start_sec - cs) AS start_sec, greatest(0, end_sec - cs) AS end_sec, text
FROM clips JOIN segments AS s ON s.media_id = clips.media_id AND s.end_sec >= cs AND s.start_sec <= ce""", "segments")
def clip_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.segments(spark, sf_dir)
    return _long(joins.clip_segments(_clips(s), s), "number")


@query(f"""+{CLIPS},
n AS (SELECT s.media_id, clip_no, row_number() OVER (PARTITION BY s.media_id, clip_no ORDER BY seg_no) AS number, greatest(0, start_sec - cs) AS a, greatest(0, end_sec - cs) AS b, text
FROM clips JOIN segments AS s ON s.media_id = clips.media_id AND s.end_sec >= cs AND s.start_sec <= ce)
SELECT media_id, clip_no, string_agg(CAST(number AS VARCHAR) || chr(10) || {TIME.format('a')} || ' --> ' || {TIME.format('b')} || chr(10) || trim(text, ' ' || chr(10)) || chr(10), chr(10) ORDER BY number) AS srt FROM n GROUP BY media_id, clip_no""", "segments")
def clip_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subtitle file of every clip."""
    s = A.segments(spark, sf_dir)
    return subtitles.format_srt(joins.clip_segments(_clips(s), s), "number", ["media_id", "clip_no"])


@query(f"""+{CLIPS}
SELECT c.media_id, center_sec, coalesce(substr(string_agg(text, ' / ' ORDER BY s.seg_no), 1, 300), '(no dialogue)') AS nearby FROM clips AS c LEFT JOIN (SELECT media_id, seg_no, start_sec, trim(text, ' ' || chr(10)) AS text FROM segments WHERE trim(text, ' ' || chr(10)) <> '') AS s
ON s.media_id = c.media_id AND abs(s.start_sec - center_sec) <= 6 GROUP BY c.media_id, center_sec""", "segments")
def nearby_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.segments(spark, sf_dir)
    points = s.select("media_id", F.col("start_sec").alias("center_sec"))
    return joins.nearby_text(points, s, 6.0)


@query(f"""SELECT media_id, string_agg(CAST(seg_no + 1 AS VARCHAR) || chr(10) || {TIME.format('start_sec')} || ' --> ' || {TIME.format('end_sec')} || chr(10) || trim(text, ' ' || chr(10)) || chr(10), chr(10) ORDER BY seg_no) AS srt
FROM segments GROUP BY media_id""", "segments")
def srt_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.format_srt(A.segments(spark, sf_dir))


@query("SELECT media_id, CAST(seg_no + 1 AS BIGINT) AS idx, start_sec, greatest(start_sec, end_sec) AS end_sec, regexp_replace(text, '[\\s\\x{85}\\pZ]+', '', 'g') AS text FROM gt WHERE regexp_replace(text, '[\\s\\x{85}\\pZ]+', '', 'g') <> ''", "segments", "pair")
def srt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitles written as files and read back."""
    written = subtitles.format_srt(A.subtitle_pair(spark, sf_dir)[1])
    return _long(subtitles.parse_srt(written.withColumnRenamed("srt", "body")), "idx")


@query("""SELECT media_id, seg_no AS place, CAST(seg_no AS BIGINT) AS number, start_sec, start_sec + 60 AS end_sec, CASE WHEN seg_no % 3 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(seg_no * 0.125 AS DOUBLE) END AS confidence,
  ltrim(replace(text, chr(10), ' ')) AS reason FROM segments WHERE seg_no % 5 <> 4""", "segments")
def review_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews in markdown, a section a segment, some of them broken, read as highlights."""
    # A reason is one line, so line feeds become spaces.
    s = A.segments(spark, sf_dir).withColumn("text", F.translate("text", "\n", " "))
    clock = lambda c: F.format_string("%02d:%05.2f", F.floor(c / 60), c % 60)
    sure = F.when(F.col("seg_no") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("- confidence: "), (F.col("seg_no") * 0.125).cast("string"), F.lit("\n")))
    start = F.when(F.col("seg_no") % 5 == 4, F.lit("soon")).otherwise(clock(F.col("start_sec")))
    section = F.concat(F.format_string("## highlight_%02d\n", "seg_no"), F.lit("- start: "), start, F.lit("\n* end: "), clock(F.col("start_sec") + 60), F.lit("\n- reason: "), F.col("text"), F.lit(".\n"), sure)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", section.alias("x")))), lambda x: x["x"]), "\n")
    read = subtitles.parse_review(s.groupBy("media_id").agg(body.alias("body")))
    return read.select("media_id", F.col("index").cast("long").alias("place"), F.col("index").cast("long").alias("number"), "start_sec", "end_sec", "confidence", F.regexp_replace("reason", r"\.\z", "").alias("reason"))


@query("""+x AS (SELECT media_id, seg_no, start_sec AS s, end_sec AS e, max(end_sec) OVER (PARTITION BY media_id) AS d FROM segments),
y AS (SELECT *, e - s < 3 AS short, greatest(0, 3 - (e - s)) / 2 AS pad FROM x),
z AS (SELECT *, CASE WHEN short THEN greatest(0, s - pad) ELSE s END AS lo, CASE WHEN short THEN least(d, e + pad) ELSE e END AS hi FROM y),
q AS (SELECT *, CASE WHEN short AND hi - lo < 3 THEN least(d, lo + 3) ELSE hi END AS hi2 FROM z),
r AS (SELECT *, CASE WHEN short AND hi - lo < 3 AND hi2 - lo < 3 THEN greatest(0, hi2 - 3) ELSE lo END AS lo2 FROM q)
SELECT media_id, seg_no, CAST(lo2 AS DOUBLE) AS start_sec, CAST(CASE WHEN hi2 - lo2 > 3.25 THEN lo2 + 3.25 ELSE hi2 END AS DOUBLE) AS end_sec FROM r""", "segments")
def clamp_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.segments(spark, sf_dir).withColumn("d", F.max("end_sec").over(W.partitionBy("media_id")))
    low, high = selection.fit_duration(F.col("start_sec"), F.col("end_sec"), F.lit(3.0), F.lit(3.25), F.col("d"))
    return s.select("media_id", "seg_no", low.alias("start_sec"), high.alias("end_sec"))


@query("""SELECT media_id, seg_no AS place, printf('%02d_', row_number() OVER (PARTITION BY media_id ORDER BY start_sec, seg_no)) || printf('%02dm%02ds', CAST(floor(start_sec) AS BIGINT) // 60, CAST(floor(start_sec) AS BIGINT) % 60) || '_' ||
  CASE WHEN slug = '' THEN 'clip' ELSE slug END AS clip_name
FROM (SELECT *, substr(regexp_replace(regexp_replace(trim(text, ' ' || chr(10)), '[\\s\\pZ]+', '_', 'g'), '[^\\p{L}\\p{N}_]', '', 'g'), 1, 40) AS slug FROM gt) AS x WHERE seg_no % 4 <> 1""", "segments", "pair")
def clip_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.subtitle_pair(spark, sf_dir)[1].select("media_id", F.col("seg_no").alias("place"), "start_sec", F.col("text").alias("reason"), F.when(F.col("seg_no") % 4 == 1, 0.2).otherwise(0.9).alias("confidence"))
    return subtitles.clip_names(s, 0.5).select("media_id", "place", "clip_name")


@query()
def subtitle_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(joins.subtitle_candidates(*A.subtitle_pair(spark, sf_dir)).drop("start_error_sec", "end_error_sec"), "similarity")


@query()
def subtitle_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(voice.character_error_rate(*A.subtitle_pair(spark, sf_dir)), "cer")


@query()
def subtitle_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.match_pairs(joins.subtitle_candidates(*A.subtitle_pair(spark, sf_dir)))


@query()
def subtitle_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = voice.evaluate_subtitles(*A.subtitle_pair(spark, sf_dir))
    return _round(out, "global_cer", "start_error_mean_sec", "start_error_median_sec", "end_error_mean_sec", "end_error_median_sec", "precision", "recall", "f1")


@query()
def subtitle_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation as a text for each medium."""
    return subtitles.metric_report(voice.evaluate_subtitles(*A.subtitle_pair(spark, sf_dir)))


@query("""WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) AS y GROUP BY label, i),
b AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m),
v AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings),
c AS (SELECT vec_id, label, greatest(-1, least(1, sum(CAST(embedding[i] AS DOUBLE) / n * x))) AS x FROM v, b GROUP BY vec_id, label),
r AS (SELECT vec_id, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC) AS rn FROM c)
SELECT vec_id, round(greatest(0, least(1, (0.7 * max(x) + 0.3 * avg(CASE WHEN rn <= 3 THEN x END) + 1) / 2)), 4) AS score FROM r GROUP BY vec_id""")
def vector_top3_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the means of all labels."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ordered = F.array_sort(F.collect_list(F.struct("dim", "mean")))
    means = vectors.mean_vector(e, ["label"]).groupBy("label").agg(F.transform(ordered, lambda x: x["mean"]).alias("mean"))
    own = e.select("vec_id", vectors.unit(F.col("embedding")).alias("embedding"))
    return vectors.prototype_scores(own, means.select(vectors.unit(F.col("mean")).alias("embedding")), ["vec_id"]).withColumn("score", F.round("score", 4))


@query("SELECT CAST(label AS BIGINT) AS label, CAST(i - 1 AS BIGINT) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) AS x GROUP BY label, i")
def prototype_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return _round(_long(vectors.mean_vector(e, ["label"]), "label", "dim"), "mean")


@query("""+d AS (SELECT media_id, max(end_sec) AS d FROM segments GROUP BY media_id),
n AS (SELECT media_id, d, unnest(range(CAST(greatest(0, floor((d - 1.5) / 0.5)) AS BIGINT) + 1)) * CAST(0.5 AS DOUBLE) AS s FROM d),
a AS (SELECT media_id, d, s FROM n UNION SELECT media_id, d, d - 1.5 FROM d WHERE d > 1.5)
SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY s) - 1 AS BIGINT) AS win_no, s AS start_sec, least(s + 1.5, d) AS end_sec FROM a""", "segments")
def window_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series.durations(A.segments(spark, sf_dir))
    return _long(series.slices(d, 1.5, 0.5).drop("center_sec"), "win_no")


@query("""+d AS (SELECT media_id, max(end_sec) AS d FROM windows GROUP BY media_id),
sp AS (SELECT media_id, unnest(range(CAST(greatest(1, floor(d) + 2) AS BIGINT))) AS second FROM d),
b AS (SELECT sp.media_id, sp.second, max(score) AS best FROM sp LEFT JOIN windows AS w ON w.media_id = sp.media_id AND sp.second BETWEEN floor(w.start_sec) AND ceil(w.end_sec) GROUP BY ALL),
c AS (SELECT media_id, second, best, coalesce(best, 0) AS p FROM b)
SELECT media_id, second, round(CASE WHEN best IS NULL THEN 0 ELSE 0.2 * coalesce(lag(p) OVER w, 0) + 0.6 * p + 0.2 * coalesce(lead(p) OVER w, 0) END, 6) AS score FROM c WINDOW w AS (PARTITION BY media_id ORDER BY second)""", "windows")
def window_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = A.windows(spark, sf_dir)
    return _round(series.timeline_of_windows(w, series.durations(w)), "score")


@query("SELECT event_id, props AS candidate FROM events")
def json_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", T.json_candidate(F.concat(F.lit("noise [x { "), F.col("props"), F.lit(" tail]"))).alias("candidate"))


@query("""SELECT event_id, 'other' AS scene_type, 'item ' || k AS scene_summary, CAST(least(5, CAST(k AS INTEGER)) AS INTEGER) AS intensity, CAST(k AS INTEGER) % 7 = 0 AS notable_change, CAST(least(1, CAST(k AS DOUBLE) / 64) AS DOUBLE) AS confidence, true AS parse_ok
FROM (SELECT event_id, regexp_extract(props, '[0-9]+') AS k FROM events) AS e""")
def scene_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0)
    raw = F.concat(F.lit('Here: {"scene_type": "unknown", "scene_summary": " item  '), k, F.lit('", "intensity": "'), k, F.lit('", "notable_change": "'), F.when(k.cast("int") % 7 == 0, "Yes").otherwise("no"), F.lit('", "confidence": '), (k.cast("double") / 64).cast("string"), F.lit("} done"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", T.parse_scene(raw).alias("x"))
    return e.select("event_id", "x.scene_type", "x.scene_summary", "x.intensity", "x.notable_change", "x.confidence", "x.parse_ok")


@query("""+s AS (SELECT media_id, second, level FROM series), p AS (
  SELECT media_id, 0 AS step, CAST(NULL AS BIGINT) AS second, CAST(NULL AS DOUBLE) AS score, list(level ORDER BY second) AS left_over FROM s GROUP BY media_id
  UNION ALL
  SELECT media_id, step + 1, CAST(place - 1 AS BIGINT), top, list_transform(left_over, lambda x, i: CASE WHEN i >= place - 6 AND i < place + 6 THEN CAST(0 AS DOUBLE) ELSE x END)
  FROM (SELECT *, list_max(left_over) AS top, list_position(left_over, list_max(left_over)) AS place FROM p) AS y WHERE top >= 0.01 AND step < 10)
SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY second) AS INTEGER) AS peak_no, second, score FROM p WHERE step > 0""", "series")
def peaks_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.peaks(A.series(spark, sf_dir), "level", 10, 6)


@query("""+c AS (SELECT media_id, second AS center FROM series),
m AS (SELECT media_id, second, level < quantile_cont(level, 0.6) OVER (PARTITION BY media_id) AS low FROM series),
p AS (SELECT *, lead(low) OVER w AS nx, lag(low) OVER w AS pv FROM m WINDOW w AS (PARTITION BY media_id ORDER BY second)),
j AS (SELECT c.media_id, center, second AS t, low, max(CASE WHEN second < center AND low AND nx THEN second END) OVER g AS bl, min(CASE WHEN second > center AND low AND pv THEN second END) OVER g AS br
  FROM c JOIN p ON p.media_id = c.media_id AND abs(second - center) <= 20 WINDOW g AS (PARTITION BY c.media_id, center)),
b AS (SELECT media_id, center, coalesce(min(CASE WHEN NOT low AND t <= center AND t > coalesce(bl, -1) AND t > greatest(0, center - 20) THEN t END), center) AS s,
  coalesce(max(CASE WHEN NOT low AND t >= center AND t < coalesce(br, 84) AND t < least(83, center + 20) THEN t END), center) AS e FROM j GROUP BY media_id, center)
SELECT media_id, center,
  CASE WHEN e - s < 6 THEN greatest(0, s - (6 - (e - s)) // 2) WHEN e - s > 20 THEN greatest(0, center - 10) ELSE s END AS start,
  CASE WHEN e - s < 6 THEN least(83, greatest(0, s - (6 - (e - s)) // 2) + 6) WHEN e - s > 20 THEN least(83, greatest(0, center - 10) + 20) ELSE e END AS "end" FROM b""", "series")
def clip_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.series(spark, sf_dir)
    return _long(selection.clip_bounds(s, s, "level", 6, 20), "start", "end")


CLIP = "STRUCT(s DOUBLE, e DOUBLE, c DOUBLE, x DOUBLE)"


def _ranked(used: str, more: str, best_first: bool) -> str:
    """Clips of 5 seconds at most: a recursion takes the windows that ``used`` admits one by one, the best first, as long as
    the medium's list of clips meets ``more``; the window goes into the first clip that it touches."""
    return f"""+n AS (SELECT media_id, start_sec AS s, least(end_sec, start_sec + 5) AS e, center_sec AS c, score AS x, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, win_no) AS n FROM windows WHERE {used}),
t AS (
  SELECT DISTINCT media_id, CAST(0 AS BIGINT) AS n, CAST([] AS {CLIP}[]) AS clips, CAST(NULL AS DOUBLE) AS least FROM n
  UNION ALL
  SELECT media_id, n, CASE WHEN place IS NULL THEN list_append(clips, struct_pack(s := round(s, 3), e := round(e, 3), c := round(c, 3), x := round_even(x, 4)))
    ELSE list_concat(clips[:place - 1], [struct_pack(s := round(lo, 3), e := round(lo + least(high - low, 5), 3), c := round(b.c, 3), x := round_even(b.x, 4))], clips[place + 1:]) END, round_even(x, 4)
  FROM (SELECT *, CASE WHEN high - low > 5 THEN least(greatest(b.c - 2.5, low), high - 5) ELSE low END AS lo
    FROM (SELECT *, least(s, old.s) AS low, greatest(e, old.e) AS high, CASE WHEN x >= old.x THEN struct_pack(s := s, e := e, c := c, x := x) ELSE old END AS b
      FROM (SELECT *, clips[place] AS old FROM (SELECT t.media_id, n.n, t.clips, n.s, n.e, n.c, n.x, nullif(list_position(list_transform(t.clips, lambda k: n.s <= k.e + 1e-6 AND k.s <= n.e + 1e-6), true), 0) AS place
        FROM t JOIN n ON n.media_id = t.media_id AND n.n = t.n + 1 WHERE {more}) AS y1) AS y2) AS y3) AS y4),
done AS (SELECT media_id, arg_max(clips, n) AS clips, arg_max(least, n) AS least_score FROM t GROUP BY media_id),
flat AS (SELECT media_id, least_score, unnest(range(1, len(clips) + 1)) AS i, unnest(clips) AS k FROM done)
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY {"-k.x" if best_first else "k.s"}, i) AS clip_no, k.s AS start_sec, k.e AS end_sec, k.c AS center_sec, k.x AS score"""


@query(_ranked("score >= 0.8", "true", True) + " FROM flat", "windows")
def ranked_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.ranked_clips(A.windows(spark, sf_dir), 5.0, threshold=0.8)


@query(_ranked("true", "coalesce(list_sum(list_transform(t.clips, lambda k: k.e - k.s)), 0) < 20", False) + ", least_score FROM flat", "windows")
def duration_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.duration_clips(A.windows(spark, sf_dir), 5.0, 20.0)


@query("""+f AS (SELECT media_id, timestamp, confidence AS x, row_number() OVER (PARTITION BY media_id ORDER BY timestamp) AS n FROM frames),
g AS (
  SELECT media_id, n, timestamp, x AS kept, timestamp AS kept_at, CAST(NULL AS DOUBLE) AS change_score, true AS selected, 'first_frame' AS reason FROM f WHERE n = 1
  UNION ALL
  SELECT f.media_id, f.n, f.timestamp,
    CASE WHEN abs(f.x - g.kept) >= 0.3 OR f.timestamp - g.kept_at >= 8 THEN f.x ELSE g.kept END, CASE WHEN abs(f.x - g.kept) >= 0.3 OR f.timestamp - g.kept_at >= 8 THEN f.timestamp ELSE g.kept_at END,
    abs(f.x - g.kept), abs(f.x - g.kept) >= 0.3 OR f.timestamp - g.kept_at >= 8, CASE WHEN abs(f.x - g.kept) >= 0.3 THEN 'change' WHEN f.timestamp - g.kept_at >= 8 THEN 'max_skip' ELSE 'propagated' END
  FROM g JOIN f ON f.media_id = g.media_id AND f.n = g.n + 1)
SELECT media_id, timestamp, change_score, selected, reason FROM g""", "frames")
def frame_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.gate_frames(A.frames(spark, sf_dir), "confidence", 0.3)


@query("SELECT media_id, event_id FROM frames AS f WHERE selected AND NOT EXISTS (SELECT 1 FROM events AS x WHERE x.event_id = f.event_id AND x.event_id % 4 = 0)", "frames")
def pending_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected frames that no earlier run has labelled."""
    f = A.frames(spark, sf_dir)
    labels = f.where("event_id % 4 = 0").select("media_id", "event_id", "timestamp", F.lit("label").alias("source"))
    return cache.pending(f, labels, ["media_id", "event_id", "timestamp"]).select("media_id", "event_id")


@query("""SELECT media_id, event_id, timestamp, CASE WHEN event_id % 5 = 0 THEN 'fresh' ELSE 'second' END AS scene_type FROM frames WHERE selected AND (event_id % 4 = 0 OR event_id % 5 = 0)""", "frames")
def known_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the selected frames out of a cache with older and propagated ones, and out of new labels."""
    f = A.frames(spark, sf_dir)
    label = lambda df, name, ord, source="label": df.select("media_id", "event_id", "timestamp", F.lit(name).alias("scene_type"), F.lit(ord).alias("ord"), F.lit(source).alias("source"))
    kept = f.where("event_id % 4 = 0")
    old = label(kept, "first", 1).union(label(kept, "second", 2)).union(label(f, "carried", 3, "propagated"))
    found = cache.known(f, old, label(f.where("event_id % 5 = 0"), "fresh", 0), ["media_id", "event_id", "timestamp"])
    return found.select("media_id", "event_id", "timestamp", "scene_type")


def _stretches(gap: float) -> str:
    """Tables m (voiced stretches s to e of each medium, with gaps closed) and what leads to it."""
    return f"""v AS (SELECT media_id, second, level >= greatest(5, 1.8 * quantile_cont(level, 0.35) OVER (PARTITION BY media_id)) AS v FROM series),
i AS (SELECT *, second - row_number() OVER (PARTITION BY media_id ORDER BY second) AS island FROM v WHERE v),
r AS (SELECT media_id, min(second) * CAST(0.5 AS DOUBLE) AS s, (max(second) + 1) * CAST(0.5 AS DOUBLE) AS e FROM i GROUP BY media_id, island),
b AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY media_id ORDER BY s) > {gap} THEN 1 ELSE 0 END AS b FROM r),
k AS (SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM b),
m AS (SELECT media_id, g, min(s) AS s, max(e) AS e FROM k GROUP BY media_id, g)"""


@query(f"""+{_stretches(0.5)}
SELECT media_id, count(*) AS clip_count, sum(e - s) AS voiced_sec, max(e - s) AS longest_sec FROM m GROUP BY media_id""", "series")
def enrollment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voiced stretches of each medium, with gaps of half a second closed: how many, how long."""
    found = voice.voiced_intervals(A.series(spark, sf_dir), "level", "second", 0.5, 5.0, 0.5)
    length = F.col("end_sec") - F.col("start_sec")
    return found.groupBy("media_id").agg(F.count("*").alias("clip_count"), F.sum(length).alias("voiced_sec"), F.max(length).alias("longest_sec"))


def _pieces(shortest: float) -> str:
    """Tables up to pieces: stretches of ``shortest`` seconds or more, cut at the first quietest second near each target."""
    return f"""{_stretches(3.0)},
hop AS (SELECT a.media_id, a.second * CAST(0.5 AS DOUBLE) AS s, arg_min(b.second * CAST(0.5 AS DOUBLE), (b.level, b.second)) AS q FROM series AS a JOIN series AS b ON b.media_id = a.media_id AND abs((b.second - a.second) * 0.5 - 6) <= 0.8 GROUP BY ALL),
cut AS (SELECT media_id, s AS first, s, e, 0 AS step FROM m WHERE e - s >= {shortest}
  UNION ALL
  SELECT c.media_id, c.first, CASE WHEN q - c.s >= 2 THEN q ELSE c.s + 6 END, c.e, c.step + 1 FROM cut AS c LEFT JOIN hop ON hop.media_id = c.media_id AND hop.s = c.s WHERE c.e - c.s > 6),
follow AS (SELECT *, lead(s) OVER (PARTITION BY media_id, first ORDER BY step) AS nx FROM cut),
pieces AS (SELECT media_id, s AS start_sec, CASE WHEN nx IS NULL OR e - nx < 2 THEN e ELSE nx END AS end_sec FROM follow WHERE NOT (nx IS NULL AND step > 0 AND e - s < 2))"""


@query(f"+{_pieces(0)} SELECT media_id, start_sec, end_sec FROM pieces", "series")
def split_voiced(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.series(spark, sf_dir)
    found = voice.voiced_intervals(s, "level", "second", 0.5, 5.0, 3.0)
    return selection.split_long(found, s.select("media_id", (F.col("second") * 0.5).alias("at_sec"), F.col("level").alias("rms")), 2.0, 6.0)


@query("""+x AS (SELECT media_id, 'item ' || CAST(event_id % 7 AS VARCHAR) AS a, 'Item ' || CAST(event_id % 3 AS VARCHAR) AS b, timestamp FROM frames),
s AS (SELECT media_id, timestamp, 0 AS place, a AS entity FROM x UNION ALL SELECT media_id, timestamp, 1, b FROM x),
c AS (SELECT media_id, entity, count(*) AS n, min(timestamp * 2 + place) AS seen FROM s GROUP BY ALL)
SELECT media_id, string_agg(entity, '|' ORDER BY n DESC, seen) AS entities FROM c GROUP BY media_id""", "frames")
def entity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda prefix, n: F.concat(F.lit(prefix), (F.col("event_id") % n).cast("string"))
    f = A.frames(spark, sf_dir).withColumn("e", F.array(name("item ", 7), name("Item ", 3)))
    return islands.ranked_entities(f, "e", ["media_id"], "timestamp").select("media_id", F.array_join("entities", "|").alias("entities"))


@query(f"""+{TEXT_SERIES},
j AS (SELECT s.media_id, s.second, level, score AS words FROM series AS s JOIN ts ON ts.media_id = s.media_id AND ts.second = s.second),
u AS (SELECT media_id, second, count(*) OVER m AS size, (level - min(level) OVER m) / (max(level) OVER m - min(level) OVER m + 1e-9) * CAST(0.45 AS DOUBLE) + (words - min(words) OVER m) / (max(words) OVER m - min(words) OVER m + 1e-9) * CAST(0.55 AS DOUBLE) AS x FROM j WINDOW m AS (PARTITION BY media_id)),
fused AS (SELECT media_id, second, (coalesce(lag(x, 2) OVER w, 0) + coalesce(lag(x) OVER w, 0) + x + coalesce(lead(x) OVER w, 0) + coalesce(lead(x, 2) OVER w, 0)) / 5 AS x FROM u WINDOW w AS (PARTITION BY media_id ORDER BY second)),
f AS (SELECT media_id, CAST(floor(start_sec) AS BIGINT) AS second, row_number() OVER (PARTITION BY media_id ORDER BY seg_no, keyword) AS ord FROM segments, lexicon WHERE must_include AND contains(text, keyword)),
fk AS (SELECT f.media_id, f.second, row_number() OVER (PARTITION BY f.media_id ORDER BY ord) AS k FROM f JOIN fused ON fused.media_id = f.media_id AND fused.second = f.second),
fl AS (SELECT media_id, second, max(k) AS k FROM fk GROUP BY ALL),
raised AS (SELECT s.media_id, s.second, coalesce(max(x) OVER (PARTITION BY s.media_id) * pow(CAST(1.5 AS DOUBLE), k), x) AS x FROM fused AS s LEFT JOIN fl ON fl.media_id = s.media_id AND fl.second = s.second),
p AS (
  SELECT media_id, 0 AS step, CAST(NULL AS BIGINT) AS second, CAST(NULL AS DOUBLE) AS score, list(x ORDER BY second) AS left_over FROM raised GROUP BY media_id
  UNION ALL
  SELECT media_id, step + 1, CAST(place - 1 AS BIGINT), top, list_transform(left_over, lambda x, i: CASE WHEN i >= place - 15 AND i < place + 15 THEN CAST(0 AS DOUBLE) ELSE x END)
  FROM (SELECT *, list_max(left_over) AS top, list_position(left_over, list_max(left_over)) AS place FROM p) AS y WHERE top >= 0.01 AND step < 25)
SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY second) AS INTEGER) AS peak_no, second, round(score, 6) AS score FROM p WHERE step > 0""", "segments", "lexicon", "series")
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of level and text together, with forced seconds raised."""
    segments, lexicon = A.segments(spark, sf_dir), A.lexicon(spark)
    level = A.series(spark, sf_dir).select("media_id", "second", "level")
    words = series.text_series(segments, lexicon).select("media_id", "second", F.col("score").alias("words"))
    return _round(selection.pick_highlights({"level": level, "words": words}, {"level": 0.45, "words": 0.55}, series.must_include(segments, lexicon), 25, 15), "score")


@query(f"""+k AS (SELECT seg_no, s.media_id, start_sec, trim(text, ' ' || chr(10)) AS text, CAST(sum(CASE WHEN contains(text, keyword) THEN weight ELSE 0 END) AS BIGINT) AS score FROM segments AS s, lexicon GROUP BY ALL),
c AS (SELECT media_id, start_sec + 1 AS center_sec FROM segments),
b AS (SELECT c.media_id, center_sec, arg_min(text, (-score, seg_no)) AS best, arg_min(text, seg_no) AS first FROM c JOIN k ON k.media_id = c.media_id AND abs(k.start_sec - center_sec) <= 8 GROUP BY ALL),
s AS (SELECT media_id, center_sec, substr(regexp_replace(regexp_replace(CASE WHEN best = '' THEN first ELSE best END, '[\\s\\pZ]+', '_', 'g'), '[^\\p{{L}}\\p{{N}}_]', '', 'g'), 1, 28) AS x FROM b)
SELECT media_id, center_sec, CASE WHEN x = '' THEN 'clip' ELSE x END AS description FROM s""", "segments", "lexicon")
def clip_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.segments(spark, sf_dir)
    return joins.describe_clips(s.select("media_id", (F.col("start_sec") + 1).alias("center_sec")), s, A.lexicon(spark))


@query("""+x AS (SELECT media_id, event_id, timestamp, selected, last_value(CASE WHEN selected THEN event_id END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS src FROM frames)
SELECT x.media_id, x.event_id, x.timestamp, f.scene_type, CASE WHEN x.selected THEN 'label' WHEN src IS NOT NULL THEN 'propagated' END AS source, CASE WHEN NOT x.selected THEN f.timestamp END AS source_timestamp FROM x LEFT JOIN frames AS f ON f.event_id = x.src""", "frames")
def propagated_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the selected frames, some given twice, joined to all frames and carried forward."""
    f = A.frames(spark, sf_dir)
    chosen = f.where("selected").select("media_id", "timestamp", "scene_type")
    labels = chosen.select("*", F.lit(1).alias("ord")).union(chosen.select("media_id", "timestamp", F.lit("stale"), F.lit(0)))
    return islands.propagated_log(f.select("media_id", "event_id", "timestamp", "selected"), labels, ["scene_type"])


@query("""+e AS (SELECT media_id, second, least(sp.top, second + 3) AS at, level FROM (SELECT *, max(second) OVER (PARTITION BY media_id) AS top FROM series) AS sp)
SELECT e.media_id, e.second AS center, s.level AS value FROM e JOIN series AS s ON s.media_id = e.media_id AND s.second = e.at""", "series")
def clamped_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.series(spark, sf_dir)
    points = s.select("media_id", F.col("second").alias("center"), (F.col("second") + 3).cast("double").alias("center_sec"))
    return joins.value_at(points, s, "level").select("media_id", "center", "value")


@query("""+f AS (SELECT media_id, unnest(range(20)) AS frame_no FROM (SELECT DISTINCT media_id FROM series) AS x)
SELECT f.media_id, f.frame_no, round(sqrt(avg(level * level) + 1e-12), 6) AS rms FROM f JOIN series AS s ON s.media_id = f.media_id AND second >= frame_no * 4 AND second < frame_no * 4 + 8 GROUP BY f.media_id, f.frame_no""", "series")
def frame_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 8 samples, every 4."""
    return _round(voice.frame_rms(A.series(spark, sf_dir), "level", "second", 8, 4), "rms")


@query(f"""+{_pieces(1)},
voice AS (SELECT p.media_id, start_sec, end_sec, count(*) * CAST(0.5 AS DOUBLE) AS voice_sec FROM pieces AS p JOIN series AS s ON s.media_id = p.media_id AND level >= 5 AND second * 0.5 >= start_sec AND second * 0.5 < end_sec GROUP BY ALL)
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_sec) AS clip_no, start_sec, end_sec, voice_sec FROM voice WHERE end_sec - start_sec >= 2 AND voice_sec >= 1.5""", "series")
def prepared_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voiced stretches split, filtered and numbered, ready for enrolment."""
    return voice.prepared_clips(A.series(spark, sf_dir), "level", "second", 0.5, least=5.0, gap=3.0, shortest=2.0, longest=6.0, least_voice=1.5)


BANK = """m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) AS y GROUP BY label, i),
bank AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m),
v AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings),
cosines AS (SELECT vec_id, label, greatest(-1, least(1, sum(CAST(embedding[i] AS DOUBLE) / n * x))) AS x FROM v, bank GROUP BY vec_id, label)"""
SCORED = f"""{BANK},
ranks AS (SELECT vec_id, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC) AS rn FROM cosines),
scored AS (SELECT vec_id, greatest(0, least(1, (0.7 * max(x) + 0.3 * avg(CASE WHEN rn <= 3 THEN x END) + 1) / 2)) AS score FROM ranks GROUP BY vec_id),
w AS (SELECT w.media_id, w.win_no, w.start_sec, w.end_sec, w.center_sec, s.score FROM windows AS w JOIN scored AS s ON s.vec_id = w.win_no)"""


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label, at length 1: label, embedding."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ordered = F.array_sort(F.collect_list(F.struct("dim", "mean")))
    means = vectors.mean_vector(e, ["label"]).groupBy("label").agg(F.transform(ordered, lambda x: x["mean"]).alias("embedding"))
    return vectors.prototype_bank(means, ["label"])


def _detection(spark: SparkSession, sf_dir: str) -> detector.Detection:
    w = A.windows(spark, sf_dir)
    return detector.detect(w, _bank(spark, sf_dir), series.durations(w), 0.62, 0.5)


@query(f"""+{SCORED},
d AS (SELECT media_id, max(end_sec) AS d FROM w GROUP BY media_id),
sp AS (SELECT media_id, unnest(range(CAST(greatest(1, floor(d) + 2) AS BIGINT))) AS second FROM d),
b AS (SELECT sp.media_id, sp.second, max(score) AS best FROM sp LEFT JOIN w ON w.media_id = sp.media_id AND sp.second BETWEEN floor(w.start_sec) AND ceil(w.end_sec) GROUP BY ALL),
c AS (SELECT media_id, second, best, coalesce(best, 0) AS p FROM b)
SELECT media_id, second, round(CASE WHEN best IS NULL THEN 0 ELSE 0.2 * coalesce(lag(p) OVER o, 0) + 0.6 * p + 0.2 * coalesce(lead(p) OVER o, 0) END, 4) AS score FROM c WINDOW o AS (PARTITION BY media_id ORDER BY second)""", "windows")
def detector_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector's score for every second, from embedded windows and a bank."""
    return _detection(spark, sf_dir).timeline.withColumn("score", F.round("score", 4))


@query(f"""+{SCORED},
t AS (SELECT * FROM w WHERE score >= 0.62),
b AS (SELECT *, CASE WHEN start_sec - lag(end_sec) OVER (PARTITION BY media_id ORDER BY win_no) > 0.5 THEN 1 ELSE 0 END AS b FROM t),
i AS (SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY win_no ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT media_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec, arg_max(center_sec, score) AS peak_sec, round(max(score), 4) AS peak_prob FROM i GROUP BY media_id, island""", "windows")
def detector_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of strong windows of the same detection."""
    return _detection(spark, sf_dir).spans.select("media_id", "start_sec", "end_sec", "peak_sec", F.round("peak_prob", 4).alias("peak_prob"))


@query(f"""WITH {BANK},
ranks AS (SELECT vec_id, label % 3 AS s, x, row_number() OVER (PARTITION BY vec_id, label % 3 ORDER BY x DESC) AS rn FROM cosines),
scored AS (SELECT vec_id, s, greatest(0, least(1, (0.7 * max(x) + 0.3 * avg(CASE WHEN rn <= 3 THEN x END) + 1) / 2)) AS score FROM ranks GROUP BY vec_id, s),
o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, s) AS place FROM scored),
b AS (SELECT vec_id, max(CASE WHEN place = 1 THEN s END) AS s, max(CASE WHEN place = 1 THEN score END) AS score, max(CASE WHEN place = 2 THEN score END) AS next FROM o GROUP BY vec_id)
SELECT vec_id, CASE WHEN score >= 0.55 AND (next IS NULL OR score - next >= 0.03) THEN 'speaker ' || s ELSE 'unknown' END AS speaker, round(score, 4) AS score FROM b""")
def speaker_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the banks of three speakers, of some labels' means each."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", vectors.unit_row(F.col("embedding")).alias("embedding"))
    banks = _bank(spark, sf_dir).select(F.concat(F.lit("speaker "), (F.col("label") % 3).cast("string")).alias("speaker"), "embedding")
    return vectors.speaker_labels(e, banks, ["vec_id"], 0.55, 0.03).withColumn("score", F.round("score", 4))


@query("""WITH v AS (SELECT label, embedding, greatest(1e-8, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS n FROM embeddings),
m AS (SELECT label, i, count(*) AS clips, avg(CAST(embedding[i] AS DOUBLE) / n) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM v) AS y GROUP BY label, i)
SELECT CAST(label AS BIGINT) AS label, clips AS clip_count, CAST(i - 1 AS BIGINT) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS mean FROM m""")
def bank_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank of every label's vectors: how many, and their mean direction."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    means = vectors.bank_means(vectors.prototype_bank(e, ["label"]), ["label"])
    return _round(_long(means.select("label", "clip_count", F.posexplode("mean").alias("dim", "mean")), "label", "dim"), "mean")


@query("""WITH f AS (SELECT user_id AS media_id, printf('frame_%06d', event_id) AS frame FROM events),
d AS (SELECT media_id, count(*) * CAST(0.25 AS DOUBLE) - 1 AS d FROM f GROUP BY media_id)
SELECT f.media_id, frame, least((row_number() OVER (PARTITION BY f.media_id ORDER BY frame) - 1) * CAST(0.25 AS DOUBLE), d) AS timestamp FROM f JOIN d ON d.media_id = f.media_id""")
def frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of frames sampled four times a second; the last ones share the medium's end."""
    f = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("media_id"), F.format_string("frame_%06d", "event_id").alias("frame"))
    durations = f.groupBy("media_id").agg((F.count("*") * 0.25 - 1).alias("duration"))
    return recordings.frame_index(f, durations, 4.0)


@query("""+g AS (SELECT media_id, start_sec AS t, row_number() OVER (PARTITION BY media_id ORDER BY start_sec) AS n, list_transform(embedding, lambda x: CAST(CAST((CAST(x AS DOUBLE) + 1) / 2 AS FLOAT) AS DOUBLE)) AS grey FROM windows),
box AS (SELECT media_id, n, o, list_transform(list_filter(range(1, 65), lambda i: (i - 1) // 8 BETWEEN o // 2 AND o // 2 + 6 AND (i - 1) % 8 BETWEEN o % 2 AND o % 2 + 6), lambda i: grey[i]) AS x FROM g, (SELECT unnest(range(4)) AS o) AS offsets),
sums AS (SELECT *, list_avg(x) AS m, list_avg(list_transform(x, lambda y: y * y)) AS q FROM box),
pairs AS (SELECT a.media_id, a.n AS kept, b.n, a.o, a.m AS ma, b.m AS mb, a.q - a.m * a.m AS va, b.q - b.m * b.m AS vb, list_inner_product(a.x, b.x) / 49 - a.m * b.m AS ab FROM sums AS a JOIN sums AS b ON b.media_id = a.media_id AND b.o = a.o AND b.n > a.n AND b.n - a.n <= 16),
alike AS (SELECT media_id, kept, n, avg((2 * ma * mb + CAST(0.0001 AS DOUBLE)) * (2 * ab * 49 / 48 + CAST(0.0009 AS DOUBLE)) / ((ma * ma + mb * mb + CAST(0.0001 AS DOUBLE)) * ((va + vb) * 49 / 48 + CAST(0.0009 AS DOUBLE)))) AS s FROM pairs GROUP BY ALL),
gate AS (
  SELECT media_id, n, t, n AS kept, t AS kept_at, CAST(NULL AS DOUBLE) AS s, true AS selected, 'first_frame' AS reason FROM g WHERE n = 1
  UNION ALL
  SELECT media_id, n, t, CASE WHEN why = 'propagated' THEN kept ELSE n END, CASE WHEN why = 'propagated' THEN kept_at ELSE t END, s, why <> 'propagated', why
  FROM (SELECT x.media_id, g.n, g.t, x.kept, x.kept_at, a.s, CASE WHEN round(1 - a.s, 6) >= 0.9 THEN 'change' WHEN g.t - x.kept_at >= 8 THEN 'max_skip' ELSE 'propagated' END AS why
    FROM gate AS x JOIN g ON g.media_id = x.media_id AND g.n = x.n + 1 JOIN alike AS a ON a.media_id = x.media_id AND a.kept = x.kept AND a.n = g.n) AS y)
SELECT media_id, t AS timestamp, round(s, 6) AS similarity, round(1 - s, 6) AS change_score, selected, reason FROM gate""", "windows")
def image_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as grey images of 8 x 8, gated by structural similarity."""
    w = A.windows(spark, sf_dir)
    grey = F.transform("embedding", lambda x: (x + 1) / 2)
    return images.gate_images(w.select("media_id", F.col("start_sec").alias("timestamp"), grey.alias("grey")), 8, 0.9, 8.0)


@query("""SELECT media_id, CAST(json_object('media_id', media_id, 'clips', list(struct_pack(seg_no := seg_no, start_sec := start_sec, end_sec := end_sec) ORDER BY seg_no)) AS VARCHAR) AS json
FROM segments GROUP BY media_id""", "segments")
def clip_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text a medium, of all its clips."""
    return manifests.manifest(A.segments(spark, sf_dir).select("media_id", "seg_no", "start_sec", "end_sec"), "clips", "seg_no", pretty=False)


@query("""+c AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seg_no) AS no, start_sec + 1 AS center, (media_id * 7 + seg_no * 13) % 64 / CAST(64 AS DOUBLE) AS score FROM segments),
b AS (SELECT *, printf('%02d:%02d', CAST(floor(center) AS BIGINT) // 60, CAST(floor(center) AS BIGINT) % 60) AS mmss FROM c),
k AS (SELECT media_id, no, printf('## Candidate %02d - %s', no, mmss) || chr(10) || '- at ' || mmss || printf(' (%.0f s)', center) || chr(10) || printf('- score %.3f', score) || chr(10) || printf('- loudness %.3f', 1 - score) || chr(10) || printf('- event %.3f', score / 2)
  || chr(10) || '- dialogue: ' || coalesce(text, '') || chr(10) AS block FROM b)
SELECT media_id, '# Candidates of ' || media_id || chr(10) || chr(10) || count(*) || ' in all. For each that you keep, write:' || chr(10) || chr(10) || '```' || chr(10) || '## highlight_01' || chr(10) || '* start: MM:SS' || chr(10) || '* end: MM:SS' || chr(10)
  || '* reason: a few words' || chr(10) || '* confidence: 0.00-1.00' || chr(10) || '```' || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY no) AS sheet FROM k GROUP BY media_id""", "segments")
def candidate_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment as a candidate, as a reviewer's sheet."""
    score = (F.col("media_id") * 7 + F.col("seg_no") * 13) % 64 / 64
    number = F.row_number().over(W.partitionBy("media_id").orderBy("seg_no")).alias("candidate_no")
    c = A.segments(spark, sf_dir).select("media_id", number, (F.col("start_sec") + 1).alias("center_sec"), score.alias("score"), (1 - score).alias("level"), (score / 2).alias("event_score"), F.col("text").alias("nearby"))
    return manifests.candidate_sheet(c)


@query(f"""+{_stretches(0.5)},
c AS (SELECT media_id, count(*) AS n, sum(e - s) AS sec FROM m GROUP BY media_id),
a AS (SELECT x.media_id % 7 AS speaker, x.media_id AS source, coalesce(n, 0) AS n, coalesce(sec, 0) AS sec FROM (SELECT DISTINCT media_id FROM series) AS x LEFT JOIN c ON c.media_id = x.media_id)
SELECT speaker, count(*) AS source_count, CAST(sum(n) AS BIGINT) AS total_clips, sum(sec) AS clip_sec, string_agg(source || '=' || n, '|' ORDER BY source) AS sources FROM a GROUP BY speaker""", "series")
def speaker_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips by speaker and source; sources without voice count too."""
    s = A.series(spark, sf_dir)
    own = lambda df, *more: df.select((F.col("media_id") % 7).alias("speaker"), F.col("media_id").alias("source"), *more)
    clips = own(voice.voiced_intervals(s, "level", "second", 0.5, 5.0, 0.5), "start_sec", "end_sec")
    text = F.transform("sources", lambda x: F.concat(x["source"].cast("string"), F.lit("="), x["clip_count"].cast("string")))
    return manifests.speaker_summary(own(s), clips).withColumn("sources", F.array_join(text, "|"))


# The same operators on media that no task holds whole: here chunks are short, so that every medium has many.


@same_rows("locf_propagate")
def long_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.frames(spark, sf_dir)
    return chunks.carry_forward(f, "selected", ["scene_type"], 64.0).select("media_id", "event_id", "timestamp", "scene_type", "source_timestamp")


@same_rows("span_merge")
def long_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(chunks.merge_windows(A.windows(spark, sf_dir), 0.6, 0.75, 50), "island")


@same_rows("interval_merge")
def long_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(chunks.merge_intervals(A.segments(spark, sf_dir), 0.5, 8.0), "island")


@same_rows("voiced_runs")
def long_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voiced runs, by a percentile that no task sees all values for."""
    s = A.series(spark, sf_dir)
    quiet = quantiles.percentiles(s, "level", {"quiet": 0.35})
    loud = s.join(quiet, "media_id").withColumn("voiced", F.col("level") >= F.greatest(F.lit(5.0), F.col("quiet") * 1.8))
    return chunks.runs(loud, "voiced", "second", 20).select("media_id", "first", "last")


@same_rows("rolling_median_ratio")
def long_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothing and rolling median by chunks with the rows around them."""
    keys = ["media_id", chunks.CHUNK]
    values = {"smoothed": series.convolve("level", [0.1, 0.25, 0.3, 0.25, 0.1], keys), "baseline": series.rolling_median("smoothed", keys), "ratio": F.col("smoothed") / (F.col("baseline") + 1e-6)}
    out = chunks.rolling(A.series(spark, sf_dir), values, "second", 40, 32, 31)
    return _round(out.select("media_id", "second", *values), *values)


@same_rows("percentile_threshold")
def long_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(quantiles.percentiles(A.series(spark, sf_dir), "level", {"p60": 0.6, "p35": 0.35}), "p60", "p35")


@same_rows("peaks_nms")
def long_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks by rounds over chunks of 30 seconds."""
    return long_selection.peaks(A.series(spark, sf_dir), "level", 10, 6, 30)


@same_rows("ranked_clips")
def long_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked clips by stretches of windows that touch."""
    return long_selection.ranked_clips(A.windows(spark, sf_dir), 5.0, 0.8, 20.0)


@query(f"""+s AS (SELECT media_id, second, {SMOOTH5} AS x FROM series WINDOW w AS (PARTITION BY media_id ORDER BY second))
SELECT media_id, second, round_even(CAST(floor(x * 16) AS DOUBLE) / 16, 3) AS rounded FROM s""", "series")
def rounded_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed levels in sixteenths, whose half thousandths are exact, rounded to even."""
    x = F.floor(series.convolve("level", [0.1, 0.25, 0.3, 0.25, 0.1]) * 16) / 16
    return A.series(spark, sf_dir).withColumn("x", x).select("media_id", "second", round_half_even(F.col("x"), 3).alias("rounded"))


@query("SELECT media_id, CAST(count(*) AS BIGINT) AS frames, CAST(count(DISTINCT scene_type) AS BIGINT) AS kinds, CAST(sum(CASE WHEN selected THEN 1 ELSE 0 END) AS BIGINT) AS labelled FROM frames GROUP BY media_id", "frames")
def smoothed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothed log of each medium with its raw copy and defaults: what it keeps of the raw labels."""
    log = islands.smoothed_log(A.frames(spark, sf_dir))
    return log.groupBy("media_id").agg(F.count("raw").alias("frames"), F.count_distinct("raw.scene_type").alias("kinds"), F.count_if("selected").alias("labelled"))


@same_rows("srt_roundtrip")
def subtitle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitles written as a file for each medium, and read back from the files."""
    path = f"{shared.folder(spark)}/subtitles-{uuid.uuid4().hex}"
    media_files.write_files(subtitles.format_srt(A.subtitle_pair(spark, sf_dir)[1]), path, "media_id", "srt", ".srt")
    read = subtitles.read_files(spark, path).withColumn("media_id", F.col("media_id").cast("long"))
    return _long(subtitles.parse_srt(read), "idx")


@query("SELECT media_id, seg_no, start_sec, end_sec, text FROM segments", "segments")
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips written as a JSON file for each medium, and read back from the files."""
    path = f"{shared.folder(spark)}/manifests-{uuid.uuid4().hex}"
    s = A.segments(spark, sf_dir).withColumn("medium", F.col("media_id"))
    media_files.write_files(manifests.manifest(s, "clips", "seg_no"), path, "media_id", "json", ".json")
    schema = "medium long, seg_no long, start_sec double, end_sec double, text string"
    return _long(manifests.read_json(spark, path, schema, "clips").withColumnRenamed("medium", "media_id"), "media_id", "seg_no")


@query("SELECT media_id, second, least(32767, level * 16) / 32768 AS rms FROM series", "series")
def recording_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels written as a recording for each medium, 8 samples a second, and measured from byte ranges of the files."""
    path = f"{shared.folder(spark)}/recordings-{uuid.uuid4().hex}"
    sample = F.least(F.lit(32767), F.col("level") * 16).cast("int")
    second = F.repeat(F.format_string("%02x%02x", sample % 256, (sample / 256).cast("int")), 8)
    listed = F.array_sort(F.collect_list(F.struct("second", second.alias("hex"))))
    body = F.unhex(F.array_join(F.transform(listed, lambda x: x["hex"]), ""))
    media_files.write_files(A.series(spark, sf_dir).groupBy("media_id").agg(body.alias("body")), path, "media_id", "body", ".pcm")
    read = pcm.split_second_levels(spark, path, header=False, rate=8, seconds=30, together=3600)
    return read.select(F.regexp_extract("path", "([0-9]+)[.]pcm$", 1).cast("long").alias("media_id"), "second", "rms")


@query("""SELECT event_id, CASE WHEN event_id % 5 > 0 THEN '{' || chr(10) || '  "k": ' || k || chr(10) || '}'
    ELSE '{' || chr(10) || '  "validated_json": false,' || chr(10) || '  "warning": "no JSON found in the answer",' || chr(10) || '  "raw_output": "it says ' || k || '"' || chr(10) || '}' END AS output,
  event_id % 5 > 0 AS validated, CASE WHEN event_id % 5 > 0 THEN 'Here: ' || props ELSE 'it says ' || k END AS plain
FROM (SELECT event_id, props, regexp_extract(props, '[0-9]+') AS k FROM events) AS e""")
def answer_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with and without JSON, as JSON and as they are."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit(" Here: "), F.col("props"), F.lit("\n"))).otherwise(F.concat(F.lit("it says "), F.regexp_extract("props", "[0-9]+", 0), F.lit(" ")))
    return e.select("event_id", T.format_answer(raw).alias("x"), T.format_answer(raw, as_json=False).alias("y")).select("event_id", "x.output", "x.validated", F.col("y.output").alias("plain"))


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    cents = F.round(F.col("value") * 100).cast("long")
    return e.select(F.col("user_id").alias("media_id"), F.col("ts").cast("timestamp").alias("ts"), cents.alias("score"), cents.alias("level"))


def _bounds(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.unix_micros(c) for c in ("start", "end")})


@query("""WITH e AS (SELECT user_id AS media_id, epoch_us(ts) AS t, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY media_id ORDER BY t) > 7200000000 THEN 1 ELSE 0 END AS b FROM e),
g AS (SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY t) AS g FROM b)
SELECT media_id, min(t) AS start, max(t) + 7200000000 AS "end", count(*) AS windows, max(cents) AS best FROM g GROUP BY media_id, g""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events, two hours apart; the same plan runs on a stream."""
    return _bounds(timeline.sessions(_timed(spark, sf_dir), "2 hours", "1 hour"))


@query("""WITH e AS (SELECT user_id AS media_id, epoch_us(ts) AS t, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
w AS (SELECT media_id, (t // 7200000000 - k) * 7200000000 AS start, cents FROM e, (SELECT unnest(range(3)) AS k) AS x)
SELECT media_id, start, start + 21600000000 AS "end", round(CAST(sum(cents) AS DOUBLE) / count(*), 6) AS level FROM w GROUP BY media_id, start""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of a user's events in windows of six hours, one every two; the same plan runs on a stream."""
    return _round(_bounds(timeline.sliding(_timed(spark, sf_dir), "6 hours", "2 hours", "1 hour")), "level")
