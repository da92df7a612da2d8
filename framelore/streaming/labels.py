"""A cache of labels fed by a stream of frames, each micro-batch written once however often it is tried."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framelore.operators import cache


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("basePath", path).option("recursiveFileLookup", False).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The labels of all batches in the ledger, with ord, which grows by batch. ``schema``: the labels' columns.

    What a batch wrote before it failed is not in the ledger and not read.
    """
    marks = "query string, batch long"
    ledger = _read(spark, f"{path}/ledger", f"ord long, {marks}").select("query", "batch", "ord")
    labels = _read(spark, f"{path}/labels", f"{schema}, {marks}")
    return labels.join(ledger, ["query", "batch"]).drop("query", "batch")


def write_batch(fresh: DataFrame, path: str, query: str, batch: int) -> None:
    """Write a batch's labels to its own folder, then its line in the ledger; both replace what a failed attempt left."""
    here = f"query={query}/batch={batch}"
    fresh.write.mode("overwrite").parquet(f"{path}/labels/{here}")
    fresh.sparkSession.range(1).select(F.lit(batch).cast("long").alias("ord")).write.mode("overwrite").parquet(f"{path}/ledger/{here}")


def feed_batch(frames: DataFrame, label: Callable[[DataFrame], DataFrame], path: str, schema: str, query: str, batch: int, keys: list[str] = cache.KEYS) -> bool:
    """Label what a batch of frames has that no earlier batch has labelled, and keep it; False if the batch was kept before."""
    spark = frames.sparkSession
    kept = _read(spark, f"{path}/ledger", "ord long, query string, batch long").where((F.col("query") == query) & (F.col("batch") == batch))
    if not kept.isEmpty():
        return False
    known = read_labels(spark, path, schema)
    write_batch(label(cache.pending(frames.dropDuplicates(keys), known, keys)), path, query, batch)
    return True


def feed_cache(frames: DataFrame, label: Callable[[DataFrame], DataFrame], path: str, schema: str, checkpoint: str, keys: list[str] = cache.KEYS) -> StreamingQuery:
    """Starts a stream that labels frames (``keys`` and selected) and adds them to the cache under ``path``.

    ``label`` turns a table of frames into ``schema``, which has the keys and source. The ledger holds the stream's own id, which
    its checkpoint keeps, and the batch's number: a batch that is replayed after a restart is left alone if it was written.
    """

    def each(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        feed_batch(batch, label, path, schema, query, number, keys)

    return frames.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
