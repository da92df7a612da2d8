"""Recordings read by byte ranges: a data source whose tasks each read some seconds of a file, however long it is."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from framelore.sources.recordings import RATE, frame_levels, pcm_samples, resampled


class Format(NamedTuple):
    """Where a file's samples begin, how many there are of all channels together, and how they are kept."""

    begin: int
    frames: int
    width: int
    channels: int
    rate: int


def read_format(file: pa.NativeFile, size: int) -> Format:
    """The format of a WAV file, from its chunks' heads alone. A data chunk that claims more than the file holds ends with it."""
    if file.read_at(12, 0)[:4] != b"RIFF":
        raise ValueError("not a RIFF file")
    at, shape = 12, None
    while at + 8 <= size:
        kind, length = struct.unpack("<4sI", file.read_at(8, at))
        if kind == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read_at(16, at + 8))
            if tag not in (1, 0xFFFE) or bits % 8:
                raise ValueError("not whole-number PCM")
            shape = bits // 8, channels, rate
        elif kind == b"data":
            if shape is None:
                raise ValueError("samples before their format")
            width, channels, rate = shape
            return Format(at + 8, min(length, size - at - 8) // (width * channels), width, channels, rate)
        at += 8 + length + length % 2
    raise ValueError("no samples")


class SecondsOfFile(NamedTuple):
    """A range of a file's whole seconds, last not included."""

    path: str
    format: Format
    first: int
    last: int


class Ranges(InputPartition):
    """What one task reads: a long file's range, or those of several short files."""

    def __init__(self, ranges: list[SecondsOfFile]) -> None:
        self.ranges = ranges


class LevelReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.header = options.get("header", "true").lower() == "true"
        self.rate, self.step = int(options.get("rate", RATE)), int(options.get("seconds", 600))
        self.together = max(self.step, int(options.get("together", self.step)))
        self.ending = options.get("ending", ".wav" if self.header else ".pcm")

    def partitions(self) -> list[InputPartition]:
        """Ranges of at most ``seconds`` seconds, in tasks of at most ``together``. Heads are read here; samples only by the tasks."""
        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        out: list[Ranges] = []
        full = self.together
        for f in sorted(files, key=lambda f: f.path):
            if f.type == fs.FileType.File and f.path.endswith(self.ending):
                with store.open_input_file(f.path) as file:
                    form = read_format(file, f.size) if self.header else Format(0, f.size // 2, 2, 1, self.rate)
                seconds = -(-form.frames * self.rate // form.rate) // self.rate
                for at in range(0, seconds, self.step):
                    part = SecondsOfFile(f.path, form, at, min(at + self.step, seconds))
                    length = part.last - part.first
                    if full + length > self.together:
                        out.append(Ranges([]))
                        full = 0
                    out[-1].ranges.append(part)
                    full += length
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for part in partition.ranges:
            yield self._levels(store, part)

    def _levels(self, store: fs.FileSystem, part: SecondsOfFile) -> pa.RecordBatch:
        """Levels of the range's seconds. Resampling looks at some samples beyond both ends, so it reads a margin that it cuts off."""
        path, form, first, last = part
        # A margin of whole seconds begins at a sample that falls on one of the new rate.
        shared = math.gcd(form.rate, self.rate)
        reach = -(-10 * max(form.rate, self.rate) // self.rate) + 1 if form.rate != self.rate else 0
        margin = -(-max(reach, form.rate // shared) // form.rate) if reach else 0
        begin, end = max(0, first - margin), last + margin
        frame = form.width * form.channels
        count = max(0, min(form.frames, end * form.rate) - begin * form.rate)
        with store.open_input_file(path) as file:
            raw = file.read_at(count * frame, form.begin + begin * form.rate * frame)
        x = resampled(pcm_samples(raw, form.width, form.channels), form.rate, self.rate)
        rms = frame_levels(x[(first - begin) * self.rate : (last - begin) * self.rate], self.rate, self.rate)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rms), pa.string()), pa.array(np.arange(first, first + len(rms))), pa.array(rms)], ["path", "second", "rms"])


class PcmLevels(DataSource):
    """``format("pcm_levels")``: loudness by second of the recordings under ``path``. Options: header (true for WAV, else bare
    16-bit samples at ``rate``), rate, seconds of a range, together (what a task's ranges last at most, one range if it is less),
    ending of the files' names."""

    @classmethod
    def name(cls) -> str:
        return "pcm_levels"

    def schema(self) -> str:
        return "path string, second long, rms double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LevelReader(self.options)


def split_second_levels(spark: SparkSession, path: str, header: bool = True, rate: int = RATE, seconds: int = 600, together: int = 0) -> DataFrame:
    """``recordings.second_levels`` without a file in one task: path, second, rms; a last part of a second is left out."""
    spark.dataSource.register(PcmLevels)
    options = {"header": str(header).lower(), "rate": rate, "seconds": seconds, "together": together}
    return spark.read.format("pcm_levels").options(**options).load(path)
