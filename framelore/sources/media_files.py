"""One file a medium: a data source that writes each row as a file of its own, all of them or none."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ATTEMPTS = "_attempts"


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's attempt."""

    folder: str


class MediaFileWriter(DataSourceWriter):
    """Each attempt of a task writes into its own folder; the commit of the whole moves what the counted attempts wrote.

    So a failed task leaves nothing among the files, and what a task wrote twice comes out once. Attempts that nobody counts
    go with the folder of attempts.
    """

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.write_id = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, root = self._at()
        folder = f"{root}/{ATTEMPTS}/{self.write_id}/{uuid.uuid4().hex}"
        store.create_dir(folder)
        for name, body in iterator:
            if not name or "/" in name or name.startswith("_"):
                raise ValueError(f"not a file name: {name!r}")
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(body.encode() if isinstance(body, str) else bytes(body or b""))
        return Written(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self._at()
        if self.overwrite:
            old = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File]
            for path in old:
                store.delete_file(path)
        for message in messages:
            if message is not None:
                for f in store.get_file_info(fs.FileSelector(message.folder)):
                    store.move(f.path, f"{root}/{f.base_name}")
        store.delete_dir(f"{root}/{ATTEMPTS}/{self.write_id}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self._at()
        folder = f"{root}/{ATTEMPTS}/{self.write_id}"
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


class MediaFiles(DataSource):
    """``format("media_files")``: rows of name and body, a text or bytes; option path, a folder that all tasks reach."""

    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema.fields] != ["name", "body"]:
            raise ValueError("media_files takes the columns name and body")
        return MediaFileWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaFiles)


def write_files(files: DataFrame, path: str, name: str, body: str, ending: str, overwrite: bool = False) -> None:
    """Write column ``body`` of every row to the file that column ``name`` names, with an ending, under ``path``.

    Rows of the same name and body are one file; of the same name and another body, an error, and nothing is written. A null
    body is an empty file, a null name an error. A file that is there is replaced; with ``overwrite`` all others go as well.
    """
    register(files.sparkSession)
    named = files.select(F.concat(F.col(name).cast("string"), F.lit(ending)).alias("name"), F.coalesce(F.col(body), F.lit("").cast(files.schema[body].dataType)).alias("body"))
    least, most = F.min("body"), F.max("body")
    one = named.groupBy("name").agg(F.when(least == most, least).otherwise(F.raise_error(F.concat(F.lit("two files of the name "), F.col("name")))).alias("body"))
    one.select("name", "body").write.format("media_files").mode("overwrite" if overwrite else "append").option("path", path).save()
