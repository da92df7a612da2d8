import json
import random

from pyspark.sql import functions as F

from framelore.functions import text as T
from framelore.sources import subtitles
from framelore.streaming import timeline


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_times(spark):
    assert one(spark, T.srt_time(F.lit(3661.25))) == "01:01:01,250"
    assert one(spark, T.srt_time(F.lit(-1.0))) == "00:00:00,000"
    assert one(spark, T.srt_time(F.lit(1.9996))) == "00:00:01,1000"
    assert one(spark, T.srt_seconds(F.lit("00:00:01,1000"))) == 2.0
    assert one(spark, T.clock_seconds(F.lit("01:02:03.5"))) == 3723.5
    assert one(spark, T.clock_seconds(F.lit("soon"))) is None
    assert one(spark, T.slug(F.lit(" big  boss! 再見 "))) == "big_boss_再見"
    assert one(spark, T.slug(F.lit("!?"))) == "clip"


def test_scene_answers():
    whole = {"scene_type": " Menu ", "scene_summary": "one two three four five six seven eight nine ten eleven", "important_entities": ["  Map  of  Ys ", "map of ys", "", 7], "intensity": "2.5", "danger_level": -3, "notable_change": " Yes ", "confidence": "0.25"}
    got = T.read_scene(f"prose [sic] {json.dumps(whole)} more prose")
    assert got == ("menu", "one two three four five six seven eight nine ten", ["Map of Ys", "7"], 2, 0, True, 0.25, True, None)
    odd = {"scene_type": "party", "scene_summary": None, "important_entities": "Map", "intensity": None, "danger_level": "many", "notable_change": 0, "confidence": -2}
    assert T.read_scene(json.dumps(odd)) == ("other", "unclear", [], 0, 0, False, 0.0, True, None)
    assert T.read_scene("nothing here {or here]")[-2:] == (False, "no_json_object_found")
    assert T.read_scene("[1]")[-1] == "json_not_object"
    assert T.read_scene(None)[-2:] == (False, "no_json_object_found")


def first_json(text):
    for i, c in enumerate(text):
        if c in "[{":
            for j in range(i + 1, len(text) + 1):
                try:
                    json.loads(text[i:j])
                    return text[i:j]
                except ValueError:
                    pass
    return None


def test_json_in_prose():
    rng = random.Random(6)
    parts = ['{"a": [1, {}]}', "[", "{", "]", "}", '"', "[1, NaN]", " ", "x", "[true]", '{"b":', "[-1]", "[[", "\\"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=8))
        assert T.json_in_text(text) == first_json(text), text
    assert T.json_in_text("[" * 100_000) is None and T.json_in_text("[" * 3000 + "[1]") == "[1]"


def test_answers_in_columns(spark):
    df = spark.createDataFrame([('x {"a": 1}',), ("plain ",), (None,)], "raw string")
    got = df.select(T.format_answer(F.col("raw")).alias("x"), T.json_candidate(F.col("raw")).alias("c")).select("x.*", "c").collect()
    assert [r.validated for r in got] == [True, False, False] and got[0].c == '{"a": 1}' and '"raw_output": "plain"' in got[1].output


def test_srt(spark, tmp_path):
    blocks = ["7\r\n00:01:04,250 --> 00:01:09,500\r\nder  kleine\u3000Fluss", "8\nno arrow at all\nwords", "9\n00:02:30,125-->00:02:20,750\nfin de la nuit\n", "10\n00:03:00,000 --> 00:03:04,000", "11\n00:03:10.500 --> 00:03:11.500\ndots are no commas"]
    (tmp_path / "river.srt").write_text("\r\n\r\n".join(blocks))
    files = subtitles.read_files(spark, f"file://{tmp_path}")
    got = [(r.media_id, r.idx, r.start_sec, r.end_sec, r.text) for r in subtitles.parse_srt(files).orderBy("idx").collect()]
    assert got == [("river", 1, 64.25, 69.5, "derkleineFluss"), ("river", 2, 150.125, 150.125, "findelanuit")]
    loose = [(r.start_sec, r.end_sec, r.text) for r in subtitles.parse_srt(files, loose=True).orderBy("idx").collect()]
    # A block of two lines is none, and neither is one whose arrow has no space around it.
    assert loose == [(64.25, 69.5, "der  kleine\u3000Fluss")]


def test_review(spark):
    body = '"## highlight_00"\n## highlight_01\n- start: 01:00\n- end: 01:10\n- reason: big  win\n- confidence: high\n\n## Highlight_2\n* start: 00:05\n* end: 00:09\n- confidence: 0.25\n## highlight_03\n- start: x\n- end: 00:10\n'
    df = spark.createDataFrame([("m", body)], "media_id string, body string")
    got = subtitles.parse_review(df).orderBy("start_sec").collect()
    assert [(r["index"], r.start_sec, r.end_sec, r.reason, r.confidence) for r in got] == [(2, 5, 9, "", 0.25), (1, 60, 70, "big  win", 1.0)]
    assert [r.clip_name for r in subtitles.clip_names(subtitles.parse_review(df), 0.5).collect()] == ["01_01m00s_big_win"]


def test_streamed_labels(spark, tmp_path):
    schema = "media_id long, timestamp double, label string, selected boolean"
    spark.createDataFrame([(1, 0.0, "a", True), (1, 2.0, "b", False), (1, 4.0, "c", True), (2, 0.0, "z", False)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = timeline.carry_forward_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("labels").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r.media_id, r.timestamp, r.label) for r in spark.table("labels").collect() if r.label) == [(1, 0.0, "a"), (1, 2.0, "a"), (1, 4.0, "c")]


def run_stream(stream, name, path, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination(120)


def test_streamed_sessions_and_windows(spark, tmp_path):
    rows = [(1, 0, 0.2), (1, 3, 0.9), (1, 20, 0.5), (2, 1, 0.1)]
    df = spark.createDataFrame(rows, "media_id long, s long, score double").selectExpr("media_id", "timestamp_seconds(s) AS ts", "score", "score AS level")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    run_stream(timeline.sessions(source, "5 seconds", "1 second"), "sessions", f"{tmp_path}/a", "complete")
    assert sorted((r.media_id, r.windows, r.best) for r in spark.table("sessions").collect()) == [(1, 1, 0.5), (1, 2, 0.9), (2, 1, 0.1)]
    run_stream(timeline.sliding(source, "4 seconds", "2 seconds", "1 second"), "slid", f"{tmp_path}/b", "complete")
    got = {(r.media_id, r.start.second): r.level for r in spark.table("slid").where("year(start) = 1970").collect()}
    assert abs(got[1, 0] - 0.55) < 1e-9 and got[1, 2] == 0.9 and got[1, 18] == 0.5


def test_metric_report(spark):
    ddl = "media_id long, pred_count long, gt_count long, global_cer double, matched_pairs long, start_error_mean_sec double, start_error_median_sec double, end_error_mean_sec double, end_error_median_sec double, precision double, recall double, f1 double, correct_matches long"
    row = (1, 3, 2, 0.125, 1, 0.25, float("nan"), 0.0, 1.0, 0.5, 0.25, 1 / 3, 1)
    text = subtitles.metric_report(spark.createDataFrame([row], ddl)).first().report.split("\n")
    assert text[3] == "Global CER     : 0.1250" and text[5] == "Start error    : mean 250.0 ms, median n/a" and "F1=0.3333" in text[7]
