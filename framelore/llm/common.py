"""Shared helpers: reading inputs, cutting lineage, Arrow batches of rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a new local one, but only if Spark runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="framelore-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote. Only for tables that nothing still to be run reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def wrapped(df: DataFrame, **columns) -> DataFrame:
    """``df`` as one struct column ``row``, with further columns beside it that no column of ``df`` can clash with."""
    return df.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def map_rows(df: DataFrame, columns: list[str], schema: str, fn: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Arrow-batched map over the tuples of ``columns``; ``fn`` sees each task's rows as one stream.

    Spark bounds an input batch by ``spark.sql.execution.arrow.maxBytesPerBatch``, output batches hold BATCH_ROWS rows, so
    memory follows the longest rows, not the partition.
    """
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH_ROWS):
                    yield from zip(*(column.to_pylist() for column in batch.slice(at, BATCH_ROWS).columns), strict=True)

        out: list[tuple] = []
        for row in fn(rows()):
            out.append(row)
            if len(out) == BATCH_ROWS:
                yield _batch(out, arrow)
                out = []
        if out:
            yield _batch(out, arrow)

    return df.select(*columns).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
