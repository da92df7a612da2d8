"""Labels of earlier runs, and clips for enrolment, against plain Python."""

import random

import numpy as np
import pytest

from framelore.operators import cache, voice

LABELS = "media_id long, frame string, timestamp double, text string, ord int, source string"


def tables(spark):
    frames = [(1, "a", 0.0, True), (1, "b", 1.0, True), (1, "c", 2.0, False), (1, "d", -1.0, True), (2, "a", 0.0, True)]
    old = [(1, "a", 0.0, "old", 1, "label"), (1, "a", 0.0, "newer", 2, "label"), (1, "b", 1.0, "carried", 9, "propagated"), (1, "c", 2.0, "unselected", 1, "label"), (1, "d", None, "no time", 1, "label"), (3, "z", 0.0, "gone", 1, "label")]
    return spark.createDataFrame(frames, "media_id long, frame string, timestamp double, selected boolean"), spark.createDataFrame(old, LABELS)


def test_pending_frames(spark):
    frames, old = tables(spark)
    assert sorted((r.media_id, r.frame) for r in cache.pending(frames, old).collect()) == [(1, "b"), (2, "a")]
    assert cache.pending(frames, old, force=True).count() == 4
    assert cache.pending(frames, old.where("false")).count() == 4


def test_known_labels(spark):
    frames, old = tables(spark)
    fresh = spark.createDataFrame([(1, "a", 0.0, "fresh", 0, "label"), (2, "a", 0.0, "first", 0, "label")], LABELS)
    texts = lambda df: {(r.media_id, r.frame): r.text for r in df.collect()}
    assert texts(cache.known(frames, old)) == {(1, "a"): "newer", (1, "d"): "no time"}
    both = cache.known(frames, old, fresh)
    assert texts(both) == {(1, "a"): "fresh", (1, "d"): "no time", (2, "a"): "first"}
    assert both.columns == old.columns
    assert [(r.media_id, r.frame) for r in cache.pending(frames, both).collect()] == [(1, "b")]
    assert texts(cache.known(frames, old, fresh, force=True)) == {(1, "a"): "fresh", (2, "a"): "first"}
    assert texts(cache.known(frames, old, force=True)) == {}


def clips(x, hop, least, gap, shortest, longest, least_voice, edge):
    floor = max(least, 1.8 * np.percentile(x, 35))
    merged = []
    for i in np.flatnonzero(x >= floor):
        if merged and i * hop - merged[-1][1] <= gap:
            merged[-1][1] = (i + 1) * hop
        else:
            merged.append([i * hop, (i + 1) * hop])
    pieces = []
    for start, end in merged:
        start, end = max(0.0, start - edge), min(len(x) * hop, end + edge)
        if end - start < shortest / 2:
            continue
        own = []
        while end - start > longest:
            target = start + longest
            near = [i for i in range(len(x)) if target - 0.8 <= i * hop <= target + 0.8]
            cut = min(near, key=lambda i: (x[i], i)) * hop if near else target
            if cut - start < shortest:
                cut = target
            own.append([start, cut])
            start = cut
        if own and end - start < shortest:
            own[-1][1] = end
        else:
            own.append([start, end])
        pieces += own
    out = []
    for start, end in sorted(pieces):
        sec = sum(hop for i in range(len(x)) if start <= i * hop < end and x[i] >= least)
        if end - start >= shortest and sec >= least_voice and sec > 0:
            out.append((len(out) + 1, start, end, sec))
    return out


@pytest.mark.parametrize("edge", [0.0, 0.25])
def test_prepared_clips(spark, edge):
    rng = random.Random(4)
    media = {}
    for m in range(12):
        levels, x = rng.choices([1, 2, 12, 20], k=14), []
        for level in levels:
            x += [level + rng.randrange(4) for _ in range(rng.randrange(1, 18))]
        media[m] = np.array(x, float)
    rows = [(m, i, float(v)) for m, x in media.items() for i, v in enumerate(x)]
    frames = spark.createDataFrame(rows, "media_id long, second long, level double")
    got = voice.prepared_clips(frames, "level", "second", 0.5, least=5.0, gap=1.0, shortest=2.0, longest=6.0, least_voice=1.5, edge=edge).collect()
    want = {(m, *c) for m, x in media.items() for c in clips(x, 0.5, 5.0, 1.0, 2.0, 6.0, 1.5, edge)}
    assert len(want) > 10
    assert {tuple(r) for r in got} == want
