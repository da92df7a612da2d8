"""Streams in micro-batches of shuffled rows against the same operators on tables; restarts and replays."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from framelore.operators import images, islands
from framelore.streaming import labels, ordered

START = datetime(2024, 1, 1, tzinfo=UTC)
LATE = "30 seconds"


@pytest.fixture(autouse=True)
def rocks(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def at(seconds):
    return START + timedelta(seconds=seconds)


def nearly_shuffled(rows, rng, reach=12.0):
    """Rows, of which the first column is their second, none more than ``reach`` out of order."""
    return sorted(rows, key=lambda r: r[0] + rng.random() * reach)


def feed(spark, folder, rows, schema, n):
    """Another micro-batch of a stream that reads a folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/part={n}")


def run(stream, folder):
    """All that waits, in one micro-batch a file; the query ends, and the next call starts it again from its checkpoint."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/part=*")


def test_gate_of_a_stream_equals_that_of_a_table(spark, tmp_path):
    rng = random.Random(61)
    schema = "second double, ts timestamp, media_id long, timestamp double, grey array<float>"
    rows = []
    for m in (1, 2):
        image = [rng.random() for _ in range(64)]
        for i in range(25):
            if rng.random() < 0.3:
                image = [rng.random() for _ in range(64)]
            rows.append((2.0 * i, at(2 * i), m, 2.0 * i, None if rng.random() < 0.1 else [min(1.0, x + rng.random() / 50) for x in image]))
    table = spark.createDataFrame(rows, schema)
    want = sorted(map(repr, images.gate_images(table, 8, 0.3, 6.0).collect()))
    shuffled = nearly_shuffled(rows, rng)
    stream = ordered.gate_stream(source(spark, tmp_path, schema), 8, LATE, 0.3, 6.0)
    for n, part in enumerate((shuffled[:14], shuffled[14:33], shuffled[33:], [(9999.0, at(9999), 3, 9999.0, None)], [(9999.0, at(9999), 4, 9999.0, None)])):
        feed(spark, tmp_path, part, schema, n)
        if n in (1, 4):  # the state of the first run is still there in the second
            run(stream, tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").where("media_id < 3").collect()
    assert sorted(map(repr, got)) == want


def test_spans_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    rng = random.Random(62)
    schema = "second double, ts timestamp, media_id long, win_no long, start_sec double, end_sec double, center_sec double, score double"
    rows = []
    for m in (1, 2, 3):
        start = 0.0
        for n in range(40):
            start += rng.choice([0.5, 0.5, 1.0, 4.0])
            rows.append((start, at(start), m, n, start, start + 1.5, start + 0.75, rng.choice([0.2, 0.6, 0.8, 0.95])))
    table = spark.createDataFrame(rows, schema)
    columns = ["media_id", "start_sec", "end_sec", "peak_sec", "peak_prob"]
    want = sorted(tuple(r) for r in islands.merge_windows(table, 0.6, 0.5).select(*columns).collect())
    shuffled = nearly_shuffled(rows, rng)
    stream = ordered.spans_stream(source(spark, tmp_path, schema), 0.6, 0.5, LATE)
    late = (1.0, at(1), 1, 999, 1.0, 2.5, 1.75, 1.0)  # far behind the watermark by then: left out
    for n, part in enumerate((shuffled[:50], shuffled[50:], [(9999.0, at(9999), 7, 0, 9999.0, 9999.5, 9999.2, 0.1)], [late], [(9999.5, at(9999), 8, 0, 9999.0, 9999.5, 9999.2, 0.1)])):
        feed(spark, tmp_path, part, schema, n)
        if n in (0, 4):
            run(stream, tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").select(*columns).collect()
    assert sorted(tuple(r) for r in got) == want


FRAME = "media_id long, frame string, timestamp double, selected boolean"
LABEL = "media_id long, frame string, timestamp double, source string, scene_type string"


def label(frames):
    return frames.select("media_id", "frame", "timestamp", F.lit("label").alias("source"), F.concat(F.lit("scene "), "frame").alias("scene_type"))


def test_cache_fed_by_a_stream_survives_replays(spark, tmp_path):
    frames = [(m, f"f{i}", float(i), i % 3 > 0) for m in (1, 2) for i in range(12)]
    stream = source(spark, tmp_path, FRAME)
    store = f"{tmp_path}/store"
    asked = spark.sparkContext.accumulator(0)

    def counted(rows):
        asked.add(rows.count())
        return label(rows)

    for n, part in enumerate((frames[:9], frames[5:20], frames[20:] + frames[:3])):
        feed(spark, tmp_path, part, FRAME, n)
        labels.feed_cache(stream, counted, store, LABEL, f"{tmp_path}/checkpoint").awaitTermination(180)
    found = labels.read_labels(spark, store, LABEL).collect()
    assert sorted((r.media_id, r.frame) for r in found) == sorted((m, f) for m, f, _, s in frames if s)
    assert asked.value == len(found) and {r.ord for r in found} == {0, 1, 2}
    # A batch that is tried again is left alone; one that failed before its line in the ledger is written once.
    query = spark.read.parquet(f"{store}/ledger").first().query
    again = spark.createDataFrame(frames[:9] + [(3, "g", 0.0, True)], FRAME)
    assert not labels.feed_batch(again, label, store, LABEL, query, 0)
    label(again.where("media_id = 3")).write.parquet(f"{store}/labels/query={query}/batch=3")
    assert labels.read_labels(spark, store, LABEL).count() == len(found)
    assert labels.feed_batch(again, label, store, LABEL, query, 3)
    assert not labels.feed_batch(again, label, store, LABEL, query, 3)
    assert labels.read_labels(spark, store, LABEL).count() == len(found) + 1
    assert labels.read_labels(spark, f"{tmp_path}/nothing", LABEL).count() == 0
