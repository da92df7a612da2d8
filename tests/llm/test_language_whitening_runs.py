"""Language identification, whitening and periodic runs against brute force, held-out accuracy and odd rows."""

import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from framelore.llm import language_id, periodic_runs, whitening

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(language_id.VOCABULARY)


# Periodic runs


def brute_runs(x, least_words=2, least_times=2):
    """Every maximal stretch of every period, smallest periods only."""
    n, out = len(x), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if x[i] == x[i + q]:
                j = i
                while j + q < n and x[j] == x[j + q]:
                    j += 1
                length = j - i + q
                if length >= max(least_words, least_times * q) and not any(all(x[t] == x[t + p] for t in range(i, i + length - p)) for p in range(1, q)):
                    out.add((i, length, q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_all_runs_of_random_words():
    rng = random.Random(1)
    for k in range(400):
        x = [rng.randrange(1 + k % 4) for _ in range(rng.randrange(0, 60))]
        if k % 3 == 0:
            x = (x[: rng.randrange(1, 8)] * 20)[: rng.randrange(1, 40)] + x
        if k % 7 == 0:
            a, x = [0], [0, 1]
            for _ in range(rng.randrange(1, 6)):
                a, x = x, x + a
        got = sorted(map(tuple, periodic_runs.all_runs(np.array(x, np.int64)).tolist()), key=lambda r: (r[0], r[2])) if x else []
        assert got == brute_runs(x)


def test_runs_of_the_least_length():
    rng = random.Random(2)
    for k in range(150):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(0, 3)):
            period = [f"p{rng.randrange(99)}" for _ in range(rng.randrange(1, 14))]
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = (period * 30)[: rng.randrange(20, 60)]
        assert periodic_runs.runs([w.encode() for w in words]) == brute_runs(words, 24, 3)


def brute_digest(doc_id, text):
    words, at = [], None
    for i, c in enumerate((text or "") + " "):
        if c in " \t\n\v\f\r":
            if at is not None:
                words.append(text[at:i])
            at = None
        elif at is None:
            at = i
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words, 24, 3)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    milli = best[1] * 1000 // best[2] if best[0] is not None else None
    listing = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return len(found), *best, milli, sha256(listing.encode()).hexdigest(), sha256(kept.encode()).hexdigest()


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 90))) for _ in range(120)]
    texts += ["la " * 50, "a b c " * 30, "x\x1cy z\t" * 40, None, "", " \n ", ("one two three " * 9 + "four five six seven " * 7)]
    rows = [(i, t, 1, [1]) for i, t in enumerate(texts)]
    rows += rows[120:122] + [(None, "la " * 50, None, None)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, start int, runs array<int>").write.parquet(f"{folder}/documents.parquet")
    got = [tuple(r) for r in periodic_runs.op13_periodic_runs(spark, folder).collect()]
    want = [(i, *brute_digest(i, t)) for i, t, *_ in rows if i is not None]
    assert sorted(repr(r) for r in got if r[0] is not None) == sorted(map(repr, want))
    assert [r[1:5] for r in got if r[0] is None] == [(1, 0, 50, 1)]
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_very_long_periodic_text():
    rng = random.Random(4)
    period = [str(rng.randrange(10**6)).encode() for _ in range(9_000)]
    assert periodic_runs.runs([b"start"] + period * 6) == [(1, 54_000, 9_000)]


# Language identification


def segmentations(word, weight, vocabulary):
    """Every way to cut a word into pieces: its pieces and probability."""
    if not word:
        return [([], 1.0)]
    out = []
    for n in range(1, len(word) + 1):
        if (i := vocabulary.automaton.get(word[:n], None)) is not None:
            out += [([i, *rest], np.exp(weight[i]) * p) for rest, p in segmentations(word[n:], weight, vocabulary)]
    return out


def test_all_segmentations_are_summed():
    vocabulary = language_id.pieces(PATH)
    rng = np.random.default_rng(5)
    weight = np.log(rng.dirichlet(np.ones(len(vocabulary.lengths)), 2)).T
    words = ["the", "an", "ouen", "école", "a", "中文字x", "ß", "\U0001f600a", "thethe"]
    lattice = language_id.Lattice(words, vocabulary)
    scores, got = lattice.scores(weight), np.zeros(len(weight))
    times = np.arange(1.0, len(words) + 1)
    for i, word in enumerate(words):
        plain = language_id.START + "".join(c if c in vocabulary.known else language_id.UNKNOWN for c in word)
        for column in range(2):
            ways = segmentations(plain, weight[:, column], vocabulary)
            assert scores[i, column] == pytest.approx(np.log(sum(p for _, p in ways)))
            if column == 0:
                for cut, p in ways:
                    for piece in cut:
                        got[piece] += times[i] * p / sum(p for _, p in ways)
    for long in (True, False):
        assert np.allclose(lattice.expected(weight[:, :1], times, long), got) and np.allclose(lattice.scores(weight, long), scores)


def test_a_very_long_word_is_scored():
    vocabulary = language_id.pieces(PATH)
    weight = np.full((len(vocabulary.lengths), 2), -10.0)
    scores = language_id.Lattice(["ab" * 5000, "ab"], vocabulary).scores(weight)
    assert np.isfinite(scores).all() and scores[0, 0] < -10_000


def test_held_out_languages_are_found(spark):
    got = {r.doc_id: r for r in language_id.op11_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    out = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert {d.doc_id for d in out} == {i for i, r in got.items() if r.held_out}
    assert sum(got[d.doc_id].lang_pred == d.lang for d in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string, held_out int"
    rows = [(1, "the house and the garden", "en", "x", 1), (2, "das haus und der garten", "de", "x", 1), (3, None, "en", None, None), (4, "12 34 !?", None, None, None), (5, "", "de", None, None), (None, "THE HOUSE", None, None, None), (1, "the house and the garden", "en", "x", 1)]
    docs = spark.createDataFrame(rows, schema)
    model = language_id.train(docs)
    got = language_id.identify(docs, model, ["doc_id"], ["doc_id long"]).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "en"), (1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und")]
    assert {r.score for r in got if r.lang_pred == "und"} == {0.0}
    none = docs.where("false")
    untrained = language_id.train(none)
    assert untrained.languages == [] and language_id.identify(none, untrained, ["doc_id"], ["doc_id long"]).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, untrained, ["doc_id"], ["doc_id long"]).collect()} == {"und"}


# Whitening


def brute_whitening(vectors, count):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors], object)
    n, total = len(x), x.sum(0)
    d = n * x - total
    centred = (d / n).astype(float)
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:count]
    return (d * d).sum(1), centred @ u[:, order] / np.sqrt(e[order]), e[order] / np.trace(v)


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(6)
    good = (rng.normal(size=(300, 12)) * np.arange(1, 13)).astype(np.float32)
    rows = [(i, v.tolist(), 1.0, 2) for i, v in enumerate(good)]
    bad = [(900, None, 1.0, 1), (901, [], 1.0, 1), (902, [1.0] * 11 + [None], 1.0, 1), (903, [float("nan")] * 12, 1.0, 1), (904, [float("inf")] * 12, 1.0, 1), (905, [1.0], 1.0, 1)]
    schema = "vec_id long, embedding array<float>, whitened double, n int"
    got = whitening.whiten(spark.createDataFrame([*rows, *bad], schema).repartition(3)).collect()
    deviation, white, explained = brute_whitening(good, 8)
    assert len(got) == 300 * 8 and {r.n for r in got} == {300} and len({r.identity_error for r in got}) == 1
    sign = {c: np.sign(next(r.whitened for r in got if r.vec_id == 0 and r.component == c) * white[0, c - 1]) for c in range(1, 9)}
    for r in got:
        assert r.deviation == deviation[r.vec_id]
        assert r.whitened == pytest.approx(sign[r.component] * white[r.vec_id, r.component - 1], abs=1e-8)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-9


def test_whitening_of_few_equal_and_no_rows(spark):
    schema = "vec_id long, embedding array<double>"
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert make([]) == [] and make([(1, [1.0, 2.0])]) == [] and make([(1, [1.0, 2.0])] * 3) == []
    two = make([(1, [0.0, 1.0]), (None, [1.0, 1.0]), (1, [0.0, 1.0])])
    assert sorted((r.vec_id or 0, r.component, r.n) for r in two) == [(0, 1, 3), (1, 1, 3), (1, 1, 3)]
    assert {r.explained for r in two} == {1.0}


def test_exact_beyond_longs(spark):
    rows = [(1, [2.0**52]), (2, [-(2.0**52)]), (3, [1.0]), (4, [2.0**60])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(r.vec_id for r in got) == [1, 2, 3] and {r.n for r in got} == {3}
    exact = sum(x := [2**62 + 100_000, -(2**62) + 100_000, 1024 + 100_000])
    want = {i + 1: (3 * v - exact) ** 2 for i, v in enumerate(x)}
    assert {r.vec_id: r.deviation for r in got} == {i: (d if d < 2**63 else None) for i, d in want.items()}
