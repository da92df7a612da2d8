"""Media that no task holds whole: running and rolling values by chunks, percentiles by selection, matches by rounds; distances, rounding."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelore.functions import edits, rounding
from framelore.operators import chunks, islands, long_selection, quantiles, selection, series

SIZE = 50


def rows_of(df):
    return sorted(tuple(repr(x) for x in r) for r in df.collect())


@pytest.fixture(scope="module")
def windows(spark):
    rng = random.Random(51)
    rows = []
    for m in (1, 2, None):
        at = 0.0
        for n in range(700 if m == 1 else 60):
            at += rng.choice([0.25, 0.5, 0.5, 3.0])
            rows.append((m, n, at, at + rng.choice([0.25, 1.5, 6.0]), at + 0.125, rng.choice([0.1, 0.5, 0.7, 0.9, float("nan")]), rng.random() < 0.3, rng.choice("abc")))
    return spark.createDataFrame(rows, "media_id long, win_no long, start_sec double, end_sec double, center_sec double, score double, selected boolean, label string").repartition(3)


def test_spans_and_intervals_by_chunks(windows):
    named = windows.where("media_id is not null")
    for size in (1, SIZE, 10_000):
        assert rows_of(chunks.merge_windows(named, 0.6, 0.75, size)) == rows_of(islands.merge_windows(named, 0.6, 0.75))
        assert rows_of(chunks.merge_intervals(windows, 0.5, size)) == rows_of(islands.merge_intervals(windows, 0.5))


def test_runs_and_carried_labels_by_chunks(windows):
    assert rows_of(chunks.runs(windows, "selected", "win_no", SIZE)) == rows_of(islands.runs(windows, "selected", "win_no"))
    timed = windows.withColumnRenamed("start_sec", "timestamp")
    assert rows_of(chunks.carry_forward(timed, "selected", ["label"], SIZE)) == rows_of(islands.carry_forward(timed, "selected", ["label"]))


def test_no_window_holds_a_medium(windows):
    plan = chunks.merge_windows(windows, 0.6, 0.75, SIZE)._jdf.queryExecution().optimizedPlan().toString()
    alone = [line for line in plan.split("\n") if "Window" in line and chunks.CHUNK not in line]
    assert alone == []


def test_scans_of_empty_tables_and_nulls(spark, windows):
    assert chunks.merge_intervals(windows.where("false"), 0.5, SIZE).count() == 0
    df = spark.createDataFrame([(1, 1, None), (1, 2, 4), (1, 120, None), (1, 121, 7), (1, None, 2)], "media_id long, at long, x long")
    scans = {"total": chunks.Scan("sum", F.col("x")), "top": chunks.Scan("max", F.col("x"), before=True), "last": chunks.Scan("last", F.col("x"))}
    got = {r["at"]: (r.total, r.top, r.last) for r in chunks.scan(df, scans, ["at"], SIZE).collect()}
    assert got == {None: (2, None, 2), 1: (2, 2, 2), 2: (6, 2, 4), 120: (6, 4, 4), 121: (13, 4, 7)}


def test_rolling_values_with_the_rows_around(spark):
    rng = random.Random(52)
    levels = spark.createDataFrame([(m, t, rng.random()) for m in (1, 2) for t in range(430 if m == 1 else 7)], "media_id long, second long, level double")
    keys = ["media_id", chunks.CHUNK]
    values = {"smoothed": series.convolve("level", [0.1, 0.25, 0.3, 0.25, 0.1], keys), "baseline": series.rolling_median("smoothed", keys), "mean": series.window_mean("level", keys)}
    got = chunks.rolling(levels, values, "second", SIZE, 32, 31)
    want = levels.withColumn("smoothed", series.convolve("level", [0.1, 0.25, 0.3, 0.25, 0.1])).withColumn("baseline", series.rolling_median("smoothed")).withColumn("mean", series.window_mean("level"))
    a, b = ([tuple(r) for r in x.orderBy("media_id", "second").collect()] for x in (got, want))
    assert np.allclose(a, b, rtol=1e-12)
    with pytest.raises(ValueError):
        chunks.with_halo(levels, "second", 10, 32, 31)


@pytest.mark.parametrize("bins", [2, 1024])
def test_percentiles_by_selection(spark, bins):
    rng = np.random.default_rng(53)
    groups = {1: rng.normal(size=400), 2: np.array([3.0]), 3: np.repeat([1.0, 2.0], [300, 2]), 4: 10.0 ** rng.integers(-300, 300, 60), 5: np.array([-1.7e308, 1.7e308]), 6: rng.integers(0, 9, 100).astype(float)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [(1, None), (2, float("nan")), (7, None), (None, 5.0)]
    fractions = {"low": 0.35, "middle": 0.5, "high": 0.6, "end": 1.0}
    got = {r.media_id: r for r in quantiles.percentiles(spark.createDataFrame(rows, "media_id long, v double").repartition(3), "v", fractions, bins=bins).collect()}
    assert set(got) == {*groups, 7, None} and got[7].low is None and got[None].high == 5.0
    for g, x in groups.items():
        for name, f in fractions.items():
            if g != 5:
                assert got[g][name] == pytest.approx(np.percentile(x, 100 * f), rel=1e-9)
    assert got[5].end == 1.7e308


def test_rounds_of_percentiles_send_no_table_to_every_task(spark, monkeypatch):
    plans = []

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df)

    materialise = quantiles.materialise
    monkeypatch.setattr(quantiles, "materialise", written)
    # Many tasks a round, so that a group's parts lie apart.
    monkeypatch.setattr(quantiles, "TASK_ROWS", 100, raising=False)
    rng = np.random.default_rng(57)
    groups = {g: rng.integers(0, 10 ** (g % 5), 40).astype(float) for g in range(60)} | {None: rng.normal(size=3000)}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "media_id long, v double")
    got = quantiles.percentiles(df, "v", {"a": 0.35, "b": 0.6})
    assert len(plans) > 3 and not [p for p in plans if "Broadcast" in p]
    for r in got.collect():
        assert (r.a, r.b) == pytest.approx(tuple(np.percentile(groups[r.media_id], [35, 60])), rel=1e-12)


def greedy_pairs(rows):
    left, right, out = set(), set(), []
    for r in sorted(rows, key=lambda r: (r[3], r[4], -r[5], r[1], r[2]), reverse=True):
        if (r[0], r[1]) not in left and (r[0], r[2]) not in right:
            left.add((r[0], r[1]))
            right.add((r[0], r[2]))
            out.append(r)
    return sorted(out)


def test_matches_by_rounds_are_the_greedy_ones(spark):
    rng = random.Random(54)
    rows = [(m, p, t, rng.randrange(3) / 2, rng.randrange(3) / 2, rng.randrange(2) / 2) for m in range(8) for p in range(12) for t in range(12) if rng.random() < 0.4]
    chain = [(99, i, i + d, 1.0 + (2 * i + d) / 64, 0.5, 0.0) for i in range(20) for d in (0, 1)]
    schema = "media_id long, pred_no long, true_no long, overlap_sec double, similarity double, gap_sec double"
    got = selection.match_pairs(spark.createDataFrame(rows + chain + rows[:5], schema).repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == greedy_pairs(rows + chain)
    assert selection.match_pairs(spark.createDataFrame([], schema)).count() == 0


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance_is_the_tables():
    rng = random.Random(55)
    letters = "aab\u00e9\U0001f600\u4e2d\u0301 "
    for _ in range(1500):
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 90)))
        b = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 90))) if rng.random() < 0.5 else "".join(c for c in a if rng.random() < 0.9) + a[:3]
        want = table_distance(a, b)
        assert edits.distance(a, b) == edits.distance(b, a) == want
        most = rng.randrange(0, 60)
        assert edits.distance(a, b, most) == min(want, most + 1)


def test_distances_in_columns(spark):
    pairs = [("", ""), ("a", ""), ("n\u00e9 \u00e0 l'\u00e9t\u00e9", "ne a l'ete"), ("\u65e5\u672c\u8a9e\u306e\u5b57\u5e55", "\u65e5\u672c\u306e\u5b57"), (None, "x"), ("x" * 3000, "y" * 2000 + "x" * 500)]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    assert [r[0] for r in df.select(edits.edit_distance(a, b)).collect()] == [None if x is None else table_distance(x, y) for x, y in pairs]
    whole = [r[0] for r in df.select(edits.similarity(a, b)).collect()]
    assert whole[:2] == [1.0, 0.0] and whole[4] is None
    assert [r[0] for r in df.select(edits.similarity(a, b, 0.6)).collect()] == [x if x is not None and x >= 0.6 else None for x in whole]


def test_rounding_is_pythons(spark):
    rng = random.Random(56)
    numbers = [2.675, 0.0625, 0.5, 1.5, 2.5, -2.675, -0.0, 0.0, 1e-9, 5e-324, 1e15, 2.0**52 + 0.5, 1.7e308, 0.285, 1.005, 0.0005, 1.0005, 4503599627.3704955]
    numbers += [rng.uniform(-1000, 1000) for _ in range(5000)] + [rng.random() * 10.0 ** rng.randrange(-12, 14) for _ in range(3000)]
    numbers += [(rng.randrange(10**6) * 2 + 1) / 2 / 10 ** rng.randrange(0, 5) for _ in range(2000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i long, x double")
    for places in (0, 2, 3, 4, 9):
        got = [r[0] for r in df.orderBy("i").select(rounding.round_half_even(F.col("x"), places)).collect()]
        assert got == [round(x, places) for x in numbers]
    odd = spark.createDataFrame([(float("inf"),), (None,), (float("nan"),)], "x double").select(rounding.round_half_even(F.col("x"), 3)).collect()
    assert odd[0][0] == float("inf") and odd[1][0] is None and odd[2][0] != odd[2][0]


def test_fusion_of_short_media(spark):
    rows = [(n, t, float((t * 7 + n) % 5)) for n in range(1, 8) for t in range(n)]
    got = {}
    for r in series.fuse(spark.createDataFrame(rows, "media_id long, second long, level double"), {"level": 1.0}).orderBy("media_id", "second").collect():
        got.setdefault(r.media_id, []).append(r.fused)
    for n in range(1, 8):
        x = np.array([v for m, _, v in rows if m == n])
        scaled = (x - x.min()) / (x.max() - x.min() + 1e-9)
        size = min(5, n)
        assert np.allclose(got[n], np.convolve(scaled, np.ones(size) / size, mode="same"))


def test_clips_for_a_duration_tell_the_last_score(spark):
    rows = [(1, n, n * 4.0, n * 4 + 1.5, n * 4 + 0.75, s) for n, s in enumerate([0.91234, 0.2, 0.55557, 0.7])]
    w = spark.createDataFrame(rows, "media_id long, win_no long, start_sec double, end_sec double, center_sec double, score double")
    got = selection.duration_clips(w, 5.0, 4.0).orderBy("clip_no").collect()
    assert [(r.start_sec, r.score, r.least_score) for r in got] == [(0.0, 0.9123, 0.5556), (8.0, 0.5556, 0.5556), (12.0, 0.7, 0.5556)]
    assert selection.duration_clips(w, 5.0, 0.0).count() == 0


def test_smoothed_log_keeps_the_raw_labels(spark):
    schema = "media_id long, timestamp double, scene_type string, intensity int, danger_level int, confidence double, expression_a string, expression_b string, source string"
    rows = [(1, 0.0, "menu", 1, 0, 0.5, "x", "y", None), (1, 2.0, "combat", 4, 0, 0.4, "z", "y", "propagated"), (1, 4.0, "menu", 1, 3, 0.5, "x", "y", None)]
    got = islands.smoothed_log(spark.createDataFrame(rows, schema)).orderBy("timestamp").collect()
    assert [(r.raw.scene_type, r.scene_type, r.raw.intensity, r.intensity, r.source, r.selected, r.reason) for r in got] == [("menu", "menu", 1, 2, "label", True, None), ("combat", "menu", 4, 2, "propagated", True, None), ("menu", "menu", 1, 2, "label", True, None)]


@pytest.mark.parametrize("shape", ["ties", "ramp"])
def test_peaks_by_rounds_are_the_greedy_ones(spark, shape):
    rng = random.Random(71)
    rows = [(m, t, rng.randrange(8) / 4 if shape == "ties" else t / 8) for m in range(6) for t in range(rng.randrange(1, 400))]
    levels = spark.createDataFrame(rows, "media_id long, second long, level double").repartition(3)
    for count, gap in ((1, 1), (7, 3), (500, 4)):
        assert rows_of(long_selection.peaks(levels, "level", count, gap, SIZE)) == rows_of(selection.peaks(levels, "level", count, gap))


def test_peaks_by_rounds_of_gaps_nulls_and_nothing(spark):
    schema = "media_id long, second long, level double"
    rows = [(1, 5, 2.0), (1, 5, 3.0), (1, 900, float("nan")), (1, 901, 1.0), (1, 902, None), (2, 0, 0.0), (None, 3, 1.0)]
    got = long_selection.peaks(spark.createDataFrame(rows, schema), "level", 9, 6, SIZE).collect()
    assert sorted((r.media_id or 0, r.peak_no, r.second, r.score) for r in got) == [(0, 1, 3, 1.0), (1, 1, 5, 3.0), (1, 2, 901, 1.0)]
    assert long_selection.peaks(spark.createDataFrame([], schema), "level", 9, 6).count() == 0
    assert long_selection.peaks(spark.createDataFrame(rows, schema), "level", 0, 6).count() == 0
    with pytest.raises(ValueError):
        long_selection.peaks(spark.createDataFrame(rows, schema), "level", 9, 0)


def test_clips_by_stretches_are_the_greedy_ones(spark, windows):
    named = windows.where("media_id is not null")
    for longest, threshold in ((2.0, 0.1), (5.0, 0.6), (40.0, 0.8)):
        assert rows_of(long_selection.ranked_clips(named, longest, threshold, SIZE)) == rows_of(selection.ranked_clips(named, longest, threshold))
    assert long_selection.ranked_clips(windows.limit(0), 5.0, 0.5).count() == 0
    of_null = long_selection.ranked_clips(windows.where("media_id is null"), 5.0, 0.6, SIZE)
    assert rows_of(of_null) == rows_of(selection.ranked_clips(windows.where("media_id is null"), 5.0, 0.6))


def bounds(levels, c, shortest, longest):
    """A clip around ``c``, second by second; ``levels`` by second."""
    seconds, last = sorted(levels), max(levels)
    low = {t: levels[t] < np.percentile(list(levels.values()), 60) for t in seconds}
    ends = []
    for side in (-1, 1):
        reach = max(0, c - longest) if side < 0 else min(last, c + longest)
        end, before = c, None
        for t in sorted((t for t in seconds if side * (t - c) >= 0), key=lambda t: side * t):
            inner = [x for x in seconds if side * (x - t) < 0]
            near = max(inner, key=lambda x: side * x) if inner else None
            if abs(t - c) > longest or t != c and low[t] and near is not None and low[near]:
                break
            if not low[t] and side * (reach - t) > 0:
                end = t
        ends.append(end)
    s, e = ends
    if e - s < shortest:
        s = max(0, s - int((shortest - (e - s)) // 2))
        return s, min(last, s + shortest)
    if e - s > longest:
        s = max(0, c - longest // 2)
        return s, min(last, s + longest)
    return s, e


def test_clip_bounds_pair_no_seconds_with_centers(spark):
    rng = random.Random(58)
    media = {m: {t + m % 3: float(rng.randrange(2 + m % 9)) for t in range(60) if rng.random() < 0.9} for m in range(20)}
    centers = [(m, c) for m in media for c in [*range(-3, 90, 4), 9, 9]]
    levels = spark.createDataFrame([(m, t, x) for m, levels in media.items() for t, x in levels.items()] + [(None, 1, 2.0)], "media_id long, second long, level double")
    points = spark.createDataFrame([*centers, (1, None), (None, 1), (99, 1)], "media_id long, second long")
    found = selection.clip_bounds(levels, points, "level", 6, 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and plan.count(" Sort ") == 2
    want = {(m, c): bounds(media[m], c, 6, 20) for m, c in centers if any(abs(t - c) <= 20 for t in media[m])}
    got = found.collect()
    assert len(got) == len(want) and {(r.media_id, r.center): (r.start, r.end) for r in got} == want
