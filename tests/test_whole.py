"""The driver's queries read whole texts and tables; compared with plain Python on the smallest table."""

import re
import tempfile
from collections import defaultdict

import numpy as np
import pytest

from framelore.plans import catalog
from framelore.sources import adapters

SF = "/root/testdata/sf0.001"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def turns(spark):
    return {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}


def shortened(text, turn):
    return text[: max(0, len(text) - turn % 3)]


def test_subtitles_are_compared_whole(spark, turns):
    got = catalog.QUERIES["subtitle_candidates"](spark, SF).collect()
    assert any(max(len(turns[r.media_id, n]) for n in (r.pred_no, r.true_no)) > 40 for r in got)
    for r in got:
        p, t = shortened(turns[r.media_id, r.pred_no], r.pred_no), turns[r.media_id, r.true_no]
        n = max(len(p), len(t))
        assert r.similarity == pytest.approx(1 - levenshtein(p, t) / n if n else 1, abs=1e-6)


def test_error_rate_is_of_whole_texts(spark, turns):
    media = defaultdict(list)
    for (m, turn), text in sorted(turns.items()):
        media[m].append((shortened(text, turn), text))
    for r in catalog.QUERIES["subtitle_cer"](spark, SF).collect():
        p, t = ("".join(x) for x in zip(*media[r.media_id], strict=True))
        # Only ends of segments are missing, so the distance is what was cut.
        assert r.cer == pytest.approx((len(t) - len(p)) / len(t), abs=1e-6)


def test_subtitle_files_and_reviews_keep_whole_texts(spark, turns):
    files = catalog.QUERIES["srt_roundtrip"](spark, SF).collect()
    assert {(r.media_id, r.idx - 1): r.text for r in files} == {k: re.sub(r"\s+", "", t) for k, t in turns.items()}
    reviews = catalog.QUERIES["review_parse"](spark, SF).collect()
    assert {(r.media_id, r.number): r.reason for r in reviews} == {k: t.replace("\n", " ").lstrip() for k, t in turns.items() if k[1] % 5 != 4}


@pytest.fixture(scope="module")
def levels(spark):
    media = defaultdict(list)
    for r in adapters.series(spark, SF).orderBy("media_id", "second").collect():
        media[r.media_id].append(r.level)
    return media


def test_every_forced_second_is_boosted(spark, levels):
    got = {(r.media_id, r.second): r.boosted for r in catalog.QUERIES["forced_boost"](spark, SF).collect()}
    for m, series in levels.items():
        values = list(series)
        for second, level in enumerate(series):
            at = second // 2 if second % 11 == 0 else second + 40
            if level % 5 == 0 and at < len(values):
                values[at] = 1.5 * max(values)
        assert [got[m, s] for s in range(len(values))] == pytest.approx(values, rel=1e-9, abs=0.006)


def test_every_second_is_a_clip_center(spark, levels):
    got = {(r.media_id, r.center): (r.start, r.end) for r in catalog.QUERIES["clip_bounds"](spark, SF).collect()}
    assert len(got) == sum(map(len, levels.values()))
    lows = {m: np.array(x) < np.percentile(x, 60) for m, x in levels.items()}
    for (m, c), bounds in got.items():
        low = lows[m]
        ends = []
        for step, stop in ((-1, max(0, c - 20)), (1, min(83, c + 20))):
            end = c
            for t in range(c, stop, step):
                if t != c and low[t] and low[t - step]:
                    break
                end = end if low[t] else t
            ends.append(end)
        s, e = ends
        if e - s < 6:
            s = max(0, s - (6 - (e - s)) // 2)
            e = min(83, s + 6)
        elif e - s > 20:
            s = max(0, c - 10)
            e = min(83, s + 20)
        assert bounds == (s, e)


def test_every_segment_is_a_clip_and_a_point(spark):
    media = defaultdict(list)
    for r in adapters.segments(spark, SF).orderBy("media_id", "seg_no").collect():
        media[r.media_id].append(r)
    clips, points = set(), set()
    for m, rows in media.items():
        for c in rows:
            inside = [s for s in rows if s.end_sec >= c.start_sec - 2 and s.start_sec <= c.start_sec + 5]
            clips |= {(m, c.seg_no, i, max(0, s.start_sec - c.start_sec + 2), max(0, s.end_sec - c.start_sec + 2), s.text) for i, s in enumerate(inside, 1)}
            points.add((m, c.start_sec, " / ".join(s.text.strip() for s in rows if abs(s.start_sec - c.start_sec) <= 6 and s.text.strip())[:300] or "(no dialogue)"))
    got = catalog.QUERIES["clip_segments"](spark, SF).collect()
    assert len(got) == len(clips) and {(r.media_id, r.clip_no, r.number, r.start_sec, r.end_sec, r.text) for r in got} == clips
    assert {tuple(r) for r in catalog.QUERIES["nearby_text"](spark, SF).collect()} == points


def test_vectors_are_scored_against_every_label(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    unit = lambda v: v / np.linalg.norm(v)
    groups = defaultdict(list)
    for r in rows:
        groups[r.label].append(np.array(r.embedding, float))
    bank = np.array([unit(np.mean(v, axis=0)) for v in groups.values()])
    got = {r.vec_id: r.score for r in catalog.QUERIES["vector_top3_score"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        best = np.sort(bank @ unit(np.array(r.embedding, float)))[::-1][:3]
        assert got[r.vec_id] == pytest.approx((0.7 * best[0] + 0.3 * best.mean() + 1) / 2, abs=1e-4)


def test_no_event_is_left_out(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").collect()
    ids = {r.event_id for r in events}
    for name in ("locf_propagate", "smooth_labels"):
        assert {r.event_id for r in catalog.QUERIES[name](spark, SF).collect()} == ids
    frames = defaultdict(list)
    for r in adapters.frames(spark, SF).collect():
        frames[r.media_id].append((r.timestamp, r.event_id, r.selected))
    steps = {b[0] - a[0] for rows in frames.values() for a, b in zip(sorted(rows), sorted(rows)[1:], strict=False)}
    assert steps == {2.0, 6.0}
    order = defaultdict(list)
    for r in sorted(events, key=lambda r: (r.ts, r.event_id)):
        order[r.user_id].append(r.event_id)
    assert {m: [e for _, e, _ in sorted(rows)] for m, rows in frames.items()} == order
    assert sum(r.frame_count for r in catalog.QUERIES["scene_segments"](spark, SF).collect()) == len(ids)
    assert catalog.QUERIES["frame_gate"](spark, SF).count() == len(ids)
    assert {r.event_id for r in catalog.QUERIES["pending_frames"](spark, SF).collect()} == {e for rows in frames.values() for _, e, s in rows if s and e % 4}


def test_media_of_windows_are_bounded(spark):
    rows = spark.range(2000).selectExpr("id AS vec_id", "CAST(id % 10 AS INT) AS label", "array(1f) AS embedding")
    path = f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    rows.write.parquet(f"{path}/embeddings.parquet")
    windows = adapters.windows(spark, path)
    sizes = windows.groupBy("media_id").count().collect()
    assert len(sizes) == 10 and {r["count"] for r in sizes} == {200}
    bounds = windows.groupBy("media_id").agg({"start_sec": "max"}).collect()
    assert {r[1] for r in bounds} == {99.5}
    clips = catalog.QUERIES["ranked_clips"](spark, path)
    assert clips.where("score < 0.8").count() == 0 and clips.select("media_id").distinct().count() == 10
    assert catalog.QUERIES["span_merge"](spark, path).select("media_id").distinct().count() == 10
