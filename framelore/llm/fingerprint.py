"""Document fingerprints by consistent weighted sampling.

A text's terms are its words in lower case, weighted by their counts. For sample k every term has its own r and c, each
Gamma(2, 1), and b, uniform in 0 to 1, all drawn from a hash of the term. With weight w

    t = floor(ln w / r + b),   ln y = r (t - b),   ln a = ln c - ln y - r

the term of smallest a gives the sample (term, t). Two texts have the same k-th sample with a probability equal to the
generalised Jaccard similarity of their weights, sum of minima over sum of maxima. A fingerprint holds SAMPLES samples as
16-bit hashes in hex; likeness is the share of equal ones.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_rows, materialise, table

SAMPLES = 128
CACHED_TERMS = 150_000
CACHED_FREQUENT = 10_000

_SEEDS = np.random.default_rng(11).integers(0, 2**32, size=(3, SAMPLES), dtype=np.uint32)
_EACH = np.arange(SAMPLES)
_TINY = np.float32(2**-32)


def draws(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, b and ln c of every (term, sample), from the terms' 64-bit hashes. Each draw takes 32 mixed bits."""
    low = (terms & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None]
    high = (terms >> np.uint64(32)).astype(np.uint32)[:, None]

    def bits(i: int) -> np.ndarray:
        x = low ^ _SEEDS[i]
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x += high
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        return x

    def gamma(i: int) -> np.ndarray:
        """Minus the logarithm of a product of two uniforms of 16 bits."""
        x = bits(i)
        u = (x >> np.uint32(16)).view(np.int32).astype(np.float32)
        v = (x & np.uint32(0xFFFF)).view(np.int32).astype(np.float32)
        u += np.float32(0.5)
        v += np.float32(0.5)
        u *= v
        u *= _TINY
        np.log(u, out=u)
        return np.negative(u, out=u)

    c = gamma(1)
    b = (bits(2) >> np.uint32(8)).view(np.int32).astype(np.float32)
    b *= np.float32(2**-24)
    return gamma(0), b, np.log(c, out=c)


class Rows:
    """Rows of draws by term, in arrays of a fixed number of slots; all are forgotten when these are full."""

    def __init__(self, slots: int, made) -> None:
        self.slots, self.made = slots, made
        self.slot: dict[str, int] = {}
        self.hashes = np.empty(slots, np.uint64)
        self.arrays: list[np.ndarray] = []

    def at(self, terms: list[str]) -> np.ndarray:
        slot = self.slot
        new = [x for x in terms if x not in slot]
        if new:
            if len(slot) + len(new) > self.slots:
                slot.clear()
                new = terms
            h = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
            rows = self.made(h)
            if not self.arrays:
                self.arrays = [np.empty((self.slots, SAMPLES), np.float32) for _ in rows]
            at = len(slot)
            self.hashes[at : at + len(new)] = h
            for kept, row in zip(self.arrays, rows, strict=True):
                kept[at : at + len(new)] = row
            slot.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(slot.__getitem__, terms), np.int64, len(terms))


def _at_weight_one(h: np.ndarray) -> tuple[np.ndarray]:
    """ln a at weight 1, where t is 0."""
    r, b, lc = draws(h)
    b -= 1
    r *= b
    r += lc
    return (r,)


class Sampler:
    """Fingerprints of texts. The draws of recent terms are kept, so most terms cost one row look-up."""

    def __init__(self) -> None:
        self.once, self.several = Rows(CACHED_TERMS, _at_weight_one), Rows(CACHED_FREQUENT, draws)

    def samples(self, text: str) -> np.ndarray | None:
        """SAMPLES 16-bit hashes of (term, t); None for a text without words."""
        counts = Counter(text.lower().split())
        if not counts:
            return None
        best = np.full(SAMPLES, np.inf, np.float32)
        found = np.zeros(SAMPLES, np.uint64)
        single = [x for x, n in counts.items() if n == 1]
        several = [x for x, n in counts.items() if n > 1]

        def take(block: np.ndarray, hashes: np.ndarray, t: np.ndarray | None) -> None:
            j = block.argmin(axis=0)
            low = block[j, _EACH]
            h = hashes[j]
            if t is not None:
                h = h + t[j, _EACH].astype(np.int64).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
            better = low < best
            best[better], found[better] = low[better], h[better]

        for i in range(0, len(single), 2048):
            at = self.once.at(single[i : i + 2048])
            take(self.once.arrays[0][at], self.once.hashes[at], None)
        for i in range(0, len(several), 1024):
            part = several[i : i + 1024]
            at = self.several.at(part)
            r, b, lc = (x[at] for x in self.several.arrays)
            t = np.log(np.array([counts[x] for x in part], np.float32))[:, None] / r
            t += b
            np.floor(t, out=t)
            b -= t
            b -= 1
            b *= r
            b += lc  # ln c - r (t - b + 1)
            take(b, self.several.hashes[at], t)
        found ^= found >> np.uint64(29)
        found *= np.uint64(0xBF58476D1CE4E5B9)
        return (found >> np.uint64(48)).astype(">u2")


def to_bytes(samples: np.ndarray | None) -> bytes:
    """Two bytes a sample; empty for a text without words."""
    return b"" if samples is None else samples.tobytes()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of equal samples: 1 for two texts without words, 0 for one."""
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COLUMNS = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next smaller doc_id (ties: by a hash of the text), after the last the first; a single
    document follows itself. Null texts count as empty, a null doc_id comes last. Repeated rows follow one another.
    Very long texts are read whole, an empty table gives no rows and other columns are ignored. One
    range exchange brings neighbours together; only each partition's first and last rows meet across partitions.
    """
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def inner(rows: Iterator[tuple]) -> Iterator[tuple]:
        sampler = Sampler()
        previous = None
        for doc_id, text in rows:
            own = sampler.samples(text)
            if previous is None:
                yield (doc_id, *(None,) * 6, text, 0)
            else:
                yield (*_described(sampler, *previous, text, own), None, None)
            previous = doc_id, text, own
        if previous is not None:
            yield (previous[0], *(None,) * 6, previous[1], 1)

    done = materialise(map_rows(ranged, ["doc_id", "text"], f"{COLUMNS}, edge string, place int", inner))
    # Two rows a partition, in the order of the whole table: a partition's last row is followed by the next one's first.
    edges = done.where("place is not null").select("doc_id", "edge", "place", F.xxhash64("edge").alias("tie"))
    whole = W.orderBy(F.col("doc_id").desc_nulls_last(), "tie", "place")
    everything = whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    pairs = edges.withColumn("following", F.coalesce(F.lead("edge").over(whole), F.first("edge").over(everything))).where("place = 1")

    def outer(rows: Iterator[tuple]) -> Iterator[tuple]:
        sampler = Sampler()
        for doc_id, text, following in rows:
            yield _described(sampler, doc_id, text, sampler.samples(text), following, sampler.samples(following))

    rows = done.where("place is null").drop("edge", "place").union(map_rows(pairs, ["doc_id", "edge", "following"], COLUMNS, outer))
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def _described(sampler: Sampler, doc_id: int, text: str, own: np.ndarray | None, following: str, next_own: np.ndarray | None) -> tuple:
    changed = edited(text, following)
    after = sampler.samples(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "replace")).digest()
    return doc_id, len(text), digest, to_bytes(own), to_bytes(after), likeness(own, after), likeness(own, next_own)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
