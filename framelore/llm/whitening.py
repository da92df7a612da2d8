"""Whitening of embeddings: MLlib's Gramian of exactly centred rows, a local eigendecomposition, a broadcast projection.

A component c becomes the whole number floor(1024 * c) + 100000. Sums over these are exact, so each row is centred in whole
numbers, n * x - S, before it becomes doubles. ``RowMatrix.computeGramianMatrix`` adds up the products in a tree over the
executors; divided by n it is the covariance, of which only width times width numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, materialise, table

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Longest vectors: the Gramian of these is what the driver and MLlib hold.
MOST_WIDTH = 4096
LONG = 2**63


class Sums(NamedTuple):
    """The number of rows, and the exact sum of each dimension."""

    n: int
    total: list[int]


def whole_vectors(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, x: each component as a whole number.

    Left out are vectors that are null or empty, that hold a null or non-finite component or one that no long holds once
    scaled, and those not of the most frequent length, of a tie the longer. Null ids and repeated rows stay; other columns
    are ignored.
    """
    scaled = f"floor({scale} * cast(c as double))"
    fits = f"c is not null and not isnan(cast(c as double)) and abs({scale} * cast(c as double)) < {LONG - 2 * offset}d"
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(f"size(e) > 0 and forall(e, c -> {fits})")
    width = given.groupBy(F.size("e").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if width and width["width"] > MOST_WIDTH:
        raise ValueError(f"vectors of {width['width']} components; {MOST_WIDTH} at most")
    return given.where(F.size("e") == (width["width"] if width else 0)).select("vec_id", F.expr(f"transform(e, c -> cast({scaled} as bigint) + {offset})").alias("x"))


def sums(whole: DataFrame) -> Sums:
    """Exact sums: each task's own in whole numbers of any size, then by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                x = _matrix(batch.slice(at, BATCH_ROWS)["x"])
                n += len(x)
                # Halves of 32 bits, so that no sum of a batch is beyond a long.
                total = total + (x >> 32).sum(0).astype(object) * 2**32 + (x & 0xFFFFFFFF).sum(0).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(len(total)), pa.int32()), "n": pa.array([n] * len(total), pa.int64()), "s": [str(s) for s in total]})

    each = whole.select("x").mapInArrow(run, "dim int, n long, s string")
    rows = each.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()  # MOST_WIDTH rows at most
    return Sums(rows[0]["n"] if rows else 0, [int(r["s"]) for r in rows])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def deviations(x: np.ndarray, of: Sums) -> np.ndarray:
    """n * x - S, exact: as longs where they and the sum of their squares are sure to fit, else as Python's whole numbers."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    most = max(abs(of.n * v - s) for v in (low, high) for s in (min(of.total), max(of.total)))
    if max(most * most * x.shape[1], of.n * max(abs(low), abs(high)), *map(abs, of.total)) < LONG:
        return of.n * x - np.array(of.total, np.int64)
    return of.n * x.astype(object) - np.array(of.total, object)


def centred(whole: DataFrame, of: Sums) -> DataFrame:
    """e: each row less the mean, as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                x = _matrix(batch.slice(at, BATCH_ROWS)["x"])
                yield pa.RecordBatch.from_arrays([_lists((deviations(x, of) / of.n).astype(float))], ["e"])

    return whole.select("x").mapInArrow(run, "e array<double>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def covariance(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """The covariance of centred rows (e), divisor n."""
    mllib = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("e").alias("v")), "v")
    return RowMatrix(mllib, n, width).computeGramianMatrix().toArray() / n


class Whitening(NamedTuple):
    """What makes whitened components of whole vectors; ``basis`` has a column for each, ``explained`` its share of the variance."""

    of: Sums
    basis: np.ndarray
    explained: list[float]


def fit(whole: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The components of the highest variance; those along which nothing varies, up to rounding, are left out."""
    of = sums(whole)
    width = len(of.total)
    if not of.n:
        return Whitening(of, np.zeros((0, 0)), [])
    v = covariance(centred(whole, of), of.n, width)
    e, u = np.linalg.eigh(v)
    order = [i for i in np.argsort(-e, kind="stable")[:components] if e[i] > max(e.max(), 0) * width * np.finfo(float).eps]
    return Whitening(of, u[:, order] / np.sqrt(e[order]), (e[order] / np.trace(v)).tolist())


def project(whole: DataFrame, by: Whitening) -> DataFrame:
    """vec_id, deviation (a decimal text: the exact sum of squares of n * x - S), e (whitened components) of each row."""
    sent = whole.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, basis, _ = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                d = deviations(_matrix(part["x"]), of)
                yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array([str(s) for s in (d * d).sum(1)]), _lists((d / of.n).astype(float) @ basis)], ["vec_id", "deviation", "e"])

    return whole.mapInArrow(run, "vec_id long, deviation string, e array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error, for each usable vector and component.

    ``vectors``: vec_id and embedding; see ``whole_vectors`` for which are left out. deviation is null where no long holds it.
    identity_error is measured on the whitened rows themselves, centred once more. No usable vectors, or none that differ,
    give no rows.
    """
    whole = materialise(whole_vectors(vectors))
    by = fit(whole, components)
    count = len(by.explained)
    if not count:
        return whole.select("vec_id", F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")]).where("false")
    made = materialise(project(whole, by))
    means = made.agg(*[F.avg(F.col("e")[i]).alias(f"m{i}") for i in range(count)]).first()
    again = made.select(F.array(*[F.col("e")[i] - float(m) for i, m in enumerate(means)]).alias("e"))
    error = float(np.abs(covariance(again, by.of.n, count) - np.eye(count)).max())
    shares = F.array(*map(F.lit, by.explained))
    rows = made.select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("e").alias("place", "whitened"))
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(by.of.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
