"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector's components are the weights of its terms, one a position. Candidates lie in blocks of BLOCK_ROWS vectors, each with
one posting column a term. A query block meets every candidate block: for each term the queries' non-zero weights scatter the
term's postings into dense score arrays, the best TOP of a block are selected, and the blocks' selections are merged by query.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_rows, materialise, table

TOP = 5
EVERY = 50
SCALE = 256
BLOCK_ROWS = 4096
QUERY_ROWS = 256


def vector_blocks(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """block, ids, width, values: vectors of floor(scale * x) in blocks of at most BLOCK_ROWS rows.

    Vectors that are null or empty, or hold a null or non-finite component, are left out, as are null ids. Shorter vectors
    have no weight on the terms they lack. Values are whole numbers, kept as doubles, row after row.
    """
    x = f"{scale} * cast(x as double)"
    taken = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        f"vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan({x}) and abs({x}) < double('infinity'))"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                ids, rows = batch.slice(at, BLOCK_ROWS).columns
                sizes = np.diff(rows.offsets.to_numpy())
                width = int(sizes.max())
                values = np.zeros((len(ids), width))
                values[np.arange(width) < sizes[:, None]] = np.floor(scale * rows.flatten().to_numpy())
                yield pa.RecordBatch.from_pydict({"ids": [ids.to_numpy().tobytes()], "width": pa.array([width], pa.int32()), "values": [values.tobytes()]})

    made = taken.mapInArrow(run, "ids binary, width int, values binary")
    return materialise(made.withColumn("block", F.monotonically_increasing_id()))


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products, one term at a time: each query's weight times the term's postings is added to its scores.

    Exact for whole numbers of any size: beyond 64 bits they are Python's.
    """
    terms = min(queries.shape[1], candidates.shape[1])
    queries, candidates = queries[:, :terms], candidates[:, :terms]
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * terms
    most = max(float(np.abs(x).max(initial=0)) for x in (queries, candidates))
    kind = np.int32 if bound < 2**31 and most < 2**31 else np.int64 if bound < 2**62 and most < 2**62 else object
    whole = np.vectorize(int, otypes=[object]) if kind is object else lambda x: x.astype(kind)
    postings = np.ascontiguousarray(whole(candidates.T))
    scores = np.zeros((len(queries), len(candidates)), kind)
    weights = whole(queries)
    for i in range(len(queries)):
        row = scores[i]
        for t in np.flatnonzero(weights[i]):
            row += weights[i, t] * postings[t]
    return scores


LONGEST = 2**63 - 1


def beyond(score: int) -> str | None:
    """A text by which scores that no long holds sort, the highest first in descending order; null for others."""
    if -LONGEST <= score <= LONGEST:
        return None
    digits = str(abs(score))
    return f"{len(digits):04}{digits}" if score > 0 else f"{9999 - len(digits):04}" + "".join(str(9 - int(d)) for d in digits)


def _best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Positions of the ``top`` highest scores, ties to smaller ids."""
    if len(scores) > top:
        least = np.sort(scores)[-top] if scores.dtype == object else np.partition(scores, len(scores) - top)[len(scores) - top]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:top]


def top_k(vectors: DataFrame, top: int = TOP, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by ``every``, the best of all other rows.

    A query's own row is left out, not other rows of the same id. Fewer candidates give fewer ranks; no vectors, no rows.
    Scores that no long holds rank by their exact value and are returned as the nearest long. Other columns are ignored.
    """
    blocks = vector_blocks(vectors)

    def pick(rows: Iterator[tuple]) -> Iterator[tuple]:
        for block, ids, width, values in rows:
            known = np.frombuffer(ids, np.int64)
            matrix = np.frombuffer(values).reshape(-1, width)
            at = np.flatnonzero(known % every == 0)
            for i in range(0, len(at), QUERY_ROWS):
                part = at[i : i + QUERY_ROWS]
                yield block, json.dumps(part.tolist()), known[part].tobytes(), width, np.ascontiguousarray(matrix[part]).tobytes()

    queries = map_rows(blocks, ["block", "ids", "width", "values"], "from_block long, places string, query_ids binary, query_width int, query_values binary", pick)
    # Candidate blocks are dealt into buckets; each query block, 1 row in ``every`` of the table, is sent to every bucket.
    buckets = max(1, blocks.count())
    sent = queries.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    met = blocks.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int")).join(sent, "bucket")

    def search(rows: Iterator[tuple]) -> Iterator[tuple]:
        for block, ids, width, values, origin, places, query_ids, query_width, query_values in rows:
            known = np.frombuffer(ids, np.int64)
            asked = np.frombuffer(query_ids, np.int64)
            scores = accumulate(np.frombuffer(query_values).reshape(-1, query_width), np.frombuffer(values).reshape(-1, width))
            for i, (place, row) in enumerate(zip(json.loads(places), scores, strict=True)):
                others, names = row, known
                if origin == block:
                    others, names = np.delete(row, place), np.delete(known, place)
                for j in _best(others, names, top):
                    score = int(others[j])
                    yield int(asked[i]), origin, place, int(names[j]), max(-LONGEST, min(LONGEST, score)), beyond(score)

    columns = ["block", "ids", "width", "values", "from_block", "places", "query_ids", "query_width", "query_values"]
    found = map_rows(met, columns, "query_id long, origin long, place int, vec_id long, score long, beyond string", search)
    order = W.partitionBy("query_id", "origin", "place").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
parts AS (SELECT vec_id, unnest(q) AS x, unnest(range(len(q))) AS t FROM v),
scores AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM parts AS a JOIN parts AS b ON a.t = b.t AND a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0 GROUP BY a.vec_id, b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) AS x
WHERE rank <= 5
"""
