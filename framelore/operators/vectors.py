"""Vectors against prototypes: cosine scores, prototype banks, normalisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelore.operators.shared import materialise

EPS = 1e-8
BANK_ROWS, VECTOR_ROWS = 4096, 1024
UNKNOWN = "unknown"


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(_doubles(v), _doubles(v)))


def _over(v: Column, length: Column) -> Column:
    """A vector over a length, which is computed once: written into the inner function it would be for every component."""
    return F.get(F.transform(F.array(length), lambda n: F.transform(_doubles(v), lambda x: x / n)), F.lit(0))


def unit(v: Column) -> Column:
    """A vector of length 1; one of length near 0 stays as it is."""
    n = norm(v)
    return _over(v, F.when(n > EPS, n).otherwise(F.when(n.isNotNull(), 1.0)))


def unit_row(v: Column) -> Column:
    """A vector over its length, or over 1e-8 where that is shorter: the rule for the rows of a bank."""
    return _over(v, F.greatest(norm(v), F.lit(EPS)))


def mixed_score(best: Column) -> Column:
    """0.7 of the best cosine and 0.3 of the mean of the best few, moved from -1..1 to 0..1; 0 without any, null where one is NaN."""
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best)
    mixed = (0.7 * F.array_max(best) + 0.3 * mean + 1) / 2
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed))
    return F.when(F.size(best) == 0, 0.0).when(~F.isnan(mixed), score)


def packed(rows: DataFrame, columns: list[str], vector: str, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors of one length: ids (their ``columns``), width, matrix (doubles, row after row).

    A vector that is null or holds a null is a row of NaN, in a block of the width 0 if it is null.
    """
    ids = F.struct(*columns) if columns else F.struct(F.lit(0).alias("none"))
    taken = rows.select(ids.alias("id"), _doubles(F.col(vector)).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.array(pc.fill_null(pc.list_value_length(batch["v"]), 0))
            for width in np.unique(widths).tolist():
                own = np.flatnonzero(widths == width)
                for at in range(0, len(own), size):
                    some = batch.take(pa.array(own[at : at + size]))
                    matrix = pc.fill_null(some["v"].flatten(), float("nan")).to_numpy(zero_copy_only=False)
                    ids = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some["id"])
                    yield pa.RecordBatch.from_arrays([ids, pa.array([width], pa.int32()), pa.array([matrix.tobytes()], pa.binary())], ["ids", "width", "matrix"])

    kind = taken.schema["id"].dataType.simpleString()
    return taken.mapInArrow(run, f"ids array<{kind}>, width int, matrix binary")


def nearest(vectors: DataFrame, bank: DataFrame, keys: list[str], vector: str, top: int, group: str | None = None) -> DataFrame:
    """``keys`` and tops of every vector: for each group of the bank (one, null, without ``group``) the best ``top`` cosines.

    A blocked matrix product: the bank, of any size, is cut into blocks of BANK_ROWS vectors and the vectors into blocks of
    VECTOR_ROWS, each of which is sent to every block of the bank; what it finds there is merged, a few cosines a vector and
    group. Vectors of another length than the bank's have NaN. The bank is written first: it is computed once, when called.
    """
    written = materialise(packed(bank, [group] if group else [], vector, BANK_ROWS).withColumn("bank_no", F.monotonically_increasing_id()))
    count = written.count()
    many = max(1, count)
    blocks = packed(vectors, keys, vector, VECTOR_ROWS)
    if count > 1:
        blocks = materialise(blocks.withColumn("block_no", F.monotonically_increasing_id()))
    else:
        blocks = blocks.withColumn("block_no", F.lit(0).cast("long"))
    sent = blocks.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    names = F.transform("ids", lambda x: x[group].cast("string")).alias("names") if group else F.lit(None).cast("array<string>").alias("names")
    dealt = written.select(names, F.col("width").alias("bank_width"), F.col("matrix").alias("bank"), F.pmod(F.xxhash64("bank_no"), F.lit(many)).cast("int").alias("bucket"))
    met = sent.join(dealt, "bucket", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                ids = part["ids"].flatten()
                n = len(ids)
                width, other, data = part["bank_width"][0].as_py(), part["width"][0].as_py(), part["bank"][0].as_py()
                of: dict[str | None, np.ndarray] = {}
                if data is not None:
                    rows = np.frombuffer(data).reshape(-1, width) if width else np.zeros((1, 0))
                    labels = part["names"][0].as_py() or [None] * len(rows)
                    if width == other and width:
                        found = np.clip(np.frombuffer(part["matrix"][0].as_py()).reshape(n, width) @ rows.T, -1, 1)
                    else:
                        found = np.full((n, len(rows)), np.nan)
                    for name in dict.fromkeys(labels):
                        own = found[:, [j for j, x in enumerate(labels) if x == name]]
                        of[name] = -np.sort(-own, axis=1)[:, :top]
                sizes = [x.shape[1] for x in of.values()]
                best = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes * n)]).astype(np.int32)), pa.array(np.concatenate(list(of.values()), axis=1).ravel() if of else np.zeros(0)))
                structs = pa.StructArray.from_arrays([pa.array(list(of) * n, pa.string()), best], ["name", "best"])
                tops = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(of), pa.int32()), structs)
                block = pa.array(np.full(n, part["block_no"][0].as_py()))
                yield pa.RecordBatch.from_arrays([block, pa.array(np.arange(n)), ids, tops], ["block_no", "place", "id", "tops"])

    kind = vectors.select(F.struct(*keys).alias("id")).schema["id"].dataType.simpleString()
    out = met.select("block_no", "ids", "width", "matrix", "names", "bank_width", "bank").mapInArrow(run, f"block_no long, place long, id {kind}, tops array<struct<name: string, best: array<double>>>")
    if count > 1:
        each = out.select("block_no", "place", "id", F.explode_outer("tops").alias("t"))
        best = F.slice(F.sort_array(F.flatten(F.collect_list("t.best")), asc=False), 1, top).alias("best")
        merged = each.groupBy("block_no", "place", F.col("t.name").alias("name")).agg(F.first("id").alias("id"), best)
        out = merged.groupBy("block_no", "place").agg(F.first("id").alias("id"), F.collect_list(F.struct("name", "best")).alias("tops"))
    return out.select("id.*", "tops")


def prototype_scores(vectors: DataFrame, prototypes: DataFrame, keys: list[str], vector: str = "embedding", top: int = 3) -> DataFrame:
    """Score 0 to 1 of each vector against a bank of any size, a table with the vector column; 0 without prototypes.

    A vector that is null, holds a null or has another length than the bank's has no score.
    """
    best = F.coalesce(F.get("tops", F.lit(0))["best"], F.array().cast("array<double>"))
    return nearest(vectors, prototypes, keys, vector, top).select(*keys, mixed_score(best).alias("score"))


def prototype_bank(clips: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """A bank from one vector a clip: the clips with their vectors at length 1. Clips without a vector are left out."""
    return clips.where(F.col(vector).isNotNull()).select(*keys, unit_row(F.col(vector)).alias(vector))


def bank_means(bank: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """clip_count and the mean vector, at length 1, of each of several banks."""
    ordered = F.array_sort(F.collect_list(F.struct("dim", "mean")))
    means = mean_vector(bank, keys, vector).groupBy(*keys).agg(F.transform(ordered, lambda x: x["mean"]).alias("mean"))
    counts = bank.groupBy(*keys).agg(F.count("*").alias("clip_count"))
    return counts.join(means, keys, "left").withColumn("mean", unit(F.col("mean")))


def speaker_labels(vectors: DataFrame, banks: DataFrame, keys: list[str], least: float, margin: float, vector: str = "embedding", top: int = 3) -> DataFrame:
    """The known speaker that each vector is nearest to: speaker, score.

    ``banks``: speaker and the vector column. A vector is "unknown" when its best score is under ``least`` or less than
    ``margin`` above that of the next speaker, and with no banks at all. Ties go to the first name.
    """
    scored = F.transform("tops", lambda t: F.struct((-mixed_score(t["best"])).alias("lack"), t["name"].alias("speaker")))
    ranked = nearest(vectors, banks, keys, vector, top, "speaker").select(*keys, F.array_sort(F.filter(scored, lambda x: x["lack"].isNotNull())).alias("ranked"))
    best, second = -F.get("ranked", F.lit(0))["lack"], -F.get("ranked", F.lit(1))["lack"]
    sure = (best >= least) & (second.isNull() | (best - second >= margin))
    return ranked.select(*keys, F.when(sure, F.get("ranked", F.lit(0))["speaker"]).otherwise(UNKNOWN).alias("speaker"), F.coalesce(best, F.lit(0.0)).alias("score"))


def mean_vector(vectors: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Component-wise mean of each group, one row a component: dim, mean."""
    return vectors.select(*keys, F.posexplode(vector).alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
