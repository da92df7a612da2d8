"""Toxicity by a counterfactual-regularised logistic classifier.

A text's features are its distinct lower-case words and the words' prefixes, hashed; nothing but the text is read. The model
is fitted on at most FIT_ROWS labelled rows, drawn by a hash of doc_id; scoring covers every row. Features come in by their
association with the label over distinct texts. The loss is the log loss plus L2, plus SWAP_WEIGHT times the mean squared change
of the logit when an identity term in a sentence of a labelled text is swapped for another of its family: where a group is only
mentioned more often in toxic texts, its name must not move the score, so neutral mentions stay clean. Families are a parameter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_rows, materialise, table

FIT_ROWS = 20_000
LEAST_Z = 4.0
PREFIXES = (4, 5)
L2 = 2e-4
SWAP_WEIGHT = 10.0
STEPS = 250
BITS = 24
MOST_BYTES = 64 << 20

#: Families of identity terms; a term is swapped for the others of its family.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "citizen", "refugee"),
    ("immigrants", "citizens", "refugees"),
    ("deaf", "blind", "disabled"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def features_of_words(words: set[str]) -> set[str]:
    """The words and the marked prefixes of longer ones."""
    out = set(words)
    for n in PREFIXES:
        out.update("^" + w[:n] for w in words if len(w) > n)
    return out


def hashed(features: set[str]) -> np.ndarray:
    ids = np.fromiter(map(xxhash.xxh64_intdigest, features), np.uint64, len(features))
    return np.unique((ids >> np.uint64(64 - BITS)).astype(np.int32))


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def swaps(text: str | None, families: tuple = IDENTITY_TERMS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each sentence, each identity term and each other term of its family: the features that go and come in a swap."""
    families_of = {term: f for f in families for term in f}
    for sentence in _SENTENCE.split((text or "").lower()):
        words = set(_WORD.findall(sentence))
        for term in words & families_of.keys():
            before = features_of_words(words)
            for other in families_of[term]:
                if other != term:
                    after = features_of_words(words - {term} | {other})
                    yield hashed(before - after), hashed(after - before)


class Model:
    """Weights by hashed feature, and a bias."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.ids, self.weights, self.bias = ids, weights, float(bias)

    def score(self, found: np.ndarray) -> float:
        z = self.bias
        if len(self.ids):
            at = np.searchsorted(self.ids, found)
            at[at == len(self.ids)] = 0
            z += float(self.weights[at[self.ids[at] == found]].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(chosen: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray, int]], swap_weight: float = SWAP_WEIGHT) -> Model:
    """``chosen``: sorted feature ids. ``rows``: those of each distinct labelled text. ``pairs``: chosen ids that go and come in a
    swap, and how many sentences have it."""
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    if not n1 or not n0:  # nothing to learn from: everything is as clean, or as toxic, as what was seen
        return Model(np.empty(0, np.int32), np.empty(0), 3.0 if n1 else -3.0)
    places = [np.searchsorted(chosen, x) for x in rows]
    r, k = np.repeat(np.arange(len(rows)), [len(x) for x in places]), np.concatenate(places)

    # Differences of the swapped pairs, as entries (pair, feature, +1 or -1).
    sides = [(i, np.searchsorted(chosen, x), sign) for i, (gone, come, _) in enumerate(pairs) for x, sign in ((gone, 1.0), (come, -1.0))]
    pr, pk, ps = (np.concatenate(x) if sides else np.empty(0, np.int64) for x in ([np.full(len(x), i) for i, x, _ in sides], [x for _, x, _ in sides], [np.full(len(x), sign) for _, x, sign in sides]))
    share = np.array([n for _, _, n in pairs], float)
    share /= max(1.0, share.sum())

    w, bias = np.zeros(len(chosen) + 1), np.log(n1 / n0)
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, weights=w[k], minlength=len(rows)) + bias + w[-1], -30, 30)))
        g = (p - labels) / len(rows)
        grad = np.append(np.bincount(k, weights=g[r], minlength=len(chosen)) + L2 * w[:-1], g.sum())
        if len(pr):
            change = np.bincount(pr, weights=w[pk] * ps, minlength=len(pairs)) * share
            grad[:-1] += 2 * swap_weight * np.bincount(pk, weights=change[pr] * ps, minlength=len(chosen))
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(chosen, w[:-1], bias + w[-1])


def held_out() -> F.Column:
    """Rows that labels are never learned from: crc32 of doc_id as text is divisible by 5. A null doc_id is held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, families: tuple = IDENTITY_TERMS, fit_rows: int = FIT_ROWS, swap_weight: float = SWAP_WEIGHT) -> Model:
    """Fit on a sample of labelled rows that are not held out. Rows of one doc_id with different labels, and equal texts with
    different ones, count as toxic.

    Features are counted and chosen by Spark; the driver gets the chosen ids, the sample's rows as lists of those, and the
    distinct swaps, and raises an error where these would take more than MOST_BYTES.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # at most fit_rows pairs of numbers: small enough to broadcast

    def read(rows: Iterator[tuple]) -> Iterator[tuple]:
        for text, toxic in rows:
            found = hashed(features_of_words(words_of(text)))
            gone = Counter((a.tobytes(), b.tobytes()) for a, b in swaps(text, families))
            yield toxic, found.tobytes(), [(a, b, n) for (a, b), n in gone.items()]

    drawn = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    read_schema = "toxic int, features binary, swaps array<struct<gone: binary, come: binary, n: int>>"
    texts = materialise(map_rows(drawn, ["text", "toxic"], read_schema, read).groupBy("features").agg(F.max("toxic").alias("toxic"), F.first("swaps").alias("swaps")))
    n, n1 = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    chosen = _chosen(texts, n, n1) if 0 < n1 < n else np.empty(0, np.int32)

    def keep(data: bytes) -> bytes:
        found = np.frombuffer(data, np.int32)
        return found[np.isin(found, chosen, assume_unique=True)].tobytes()

    def narrow(rows: Iterator[tuple]) -> Iterator[tuple]:
        for features, toxic in rows:
            yield keep(features), toxic

    def narrow_swaps(rows: Iterator[tuple]) -> Iterator[tuple]:
        for gone, come, n in rows:
            yield keep(gone), keep(come), n

    few = map_rows(texts, ["features", "toxic"], "features binary, toxic int", narrow)
    each = texts.select(F.explode("swaps").alias("x")).select("x.*")
    pairs = map_rows(each, ["gone", "come", "n"], "gone binary, come binary, n int", narrow_swaps).groupBy("gone", "come").agg(F.sum("n").alias("n")).where("gone <> come")
    size = sum(x.agg(F.coalesce(F.sum(sum(F.octet_length(c) for c in names)), F.lit(0))).first()[0] for x, names in ((few, ["features"]), (pairs, ["gone", "come"])))
    if size > MOST_BYTES:
        raise ValueError(f"the fit would take {size} bytes of features to the driver, more than {MOST_BYTES}; lower fit_rows")
    ids = lambda data: np.frombuffer(data, np.int32)
    rows = sorted((bytes(r.features), r.toxic) for r in few.collect())
    swapped = sorted((bytes(r.gone), bytes(r.come), r.n) for r in pairs.collect())
    discard(texts)
    return fit(chosen, [ids(x) for x, _ in rows], np.array([t for _, t in rows], float), [(ids(a), ids(b), n) for a, b, n in swapped], swap_weight)


def _chosen(texts: DataFrame, n: int, n1: int) -> np.ndarray:
    """All features of at least 3 texts whose share differs by LEAST_Z standard errors between toxic and other ones."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x, np.int32) for x in batch.column(0).to_pylist()]
            toxic = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), [len(x) for x in rows])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)), pa.array(toxic.astype(np.int32))], names=["id", "toxic"])

    counts = texts.select("features", "toxic").mapInArrow(spread, "id int, toxic int").groupBy("id").agg(F.count("*").alias("c"), F.sum("toxic").alias("c1")).where("c >= 3")
    share = F.col("c") / n
    spread_of = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n1 + 1 / (n - n1)))
    ranked = counts.select("id", (F.abs(F.col("c1") / n1 - (F.col("c") - F.col("c1")) / (n - n1)) / spread_of).alias("z")).where(F.col("z") >= LEAST_Z)
    found = ranked.select("id").limit(MOST_BYTES // 4 + 1).collect()  # ids of BITS bits: 2 ** 24 at most
    if len(found) > MOST_BYTES // 4:
        raise ValueError(f"features of over {MOST_BYTES} bytes")
    return np.sort(np.array([r.id for r in found], np.int32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts get the score of no words at all.

    Very long texts are read whole, repeated rows get one score, an empty table gives no rows and other columns are ignored.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, out, text in rows:
            x = model.score(hashed(features_of_words(words_of(text))))
            yield doc_id, out, x, int(x >= 0.5)

    return map_rows(docs.select("doc_id", held_out().alias("held_out"), "text"), ["doc_id", "held_out", "text"], "doc_id long, held_out boolean, score double, predicted int", run)


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text is not predicted toxic, with all their columns, in one pass and without a join.

    Each row is judged by its own text, so repeated rows go or stay together; a null doc_id is judged like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([model.score(hashed(features_of_words(words_of(x)))) < 0.5 for x in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
