"""Recordings as files: where they lie, and their loudness by second or frame. Samples stay in the task that reads a file."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelore.functions.rounding import round_half_even

RATE = 16_000
LEVELS = "path string, {} long, rms double"


def read_recordings(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """path, content, speaker, source, prepared of the recordings in a folder of one folder a speaker.

    ``speaker`` is the folder's name and ``source`` the file's; ``prepared`` tells whether the file lies in the speaker's
    folder of that name. Select columns before you use it: without ``content`` no file is opened.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    place = r"([^/]+)/(prepared/)?([^/]+)$"
    part = lambda n: F.regexp_extract("path", place, n)
    return files.select("path", "content", part(1).alias("speaker"), part(3).alias("source"), (part(2) != "").alias("prepared"))


def enrolment(recordings: DataFrame) -> DataFrame:
    """Each speaker's prepared recordings, or all where none is prepared."""
    some = recordings.groupBy("speaker").agg(F.max("prepared").alias("any_prepared"))
    return recordings.join(some, "speaker").where("prepared = any_prepared").drop("any_prepared")


def resampled(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Polyphase resampling by a Kaiser-windowed low-pass filter (beta 5, ten zero crossings to a side)."""
    shared = math.gcd(source, target)
    up, down = target // shared, source // shared
    if up == down or not len(x):
        return x
    half = 10 * max(up, down)
    taps = np.sinc(np.arange(-half, half + 1) / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    at = np.arange(-(-len(x) * up // down)) * down + half
    out = np.empty(len(at))
    for phase in range(up):
        own = taps[phase::up][::-1]
        mine = np.flatnonzero(at % up == phase)
        padded = np.pad(x, (len(own) - 1, half // up + 1))
        out[mine] = np.lib.stride_tricks.sliding_window_view(padded, len(own))[at[mine] // up] @ own
    return out


def pcm_samples(content: bytes, width: int, channels: int) -> np.ndarray:
    """Samples from -1 to 1 of whole numbers of ``width`` bytes, channels averaged. 8-bit samples are centred first."""
    raw = np.frombuffer(content, np.uint8)
    if width == 1:
        x = raw.astype(float) - 128
    else:
        wide = np.zeros((len(raw) // width, 4), np.uint8)
        wide[:, 4 - width :] = raw[: len(wide) * width].reshape(-1, width)
        x = wide.view("<i4")[:, 0].astype(float) / 2 ** (32 - 8 * width)
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1) / 2 ** (8 * width - 1)


def decode_wav(content: bytes, rate: int = RATE) -> np.ndarray:
    """Samples from -1 to 1 of whole-number PCM, channels averaged, at ``rate`` a second. 8-bit samples are centred first."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, source = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    return resampled(pcm_samples(raw, width, channels), source, rate)


def decode_pcm(content: bytes) -> np.ndarray:
    """The whole file as 16-bit samples; a header that it has becomes samples too."""
    return np.frombuffer(content[: len(content) // 2 * 2], "<i2") / 32768


def frame_levels(samples: np.ndarray, size: int, hop: int, floor: float = 0.0) -> np.ndarray:
    """Root mean square of each whole frame of ``size`` samples, one every ``hop``; ``floor`` is added to the mean."""
    if len(samples) < size:
        return np.zeros(0)
    total = np.concatenate([[0.0], np.cumsum(np.square(samples, dtype=float))])
    starts = np.arange(0, len(samples) - size + 1, hop)
    return np.sqrt(np.maximum(total[starts + size] - total[starts], 0) / size + floor)


def _levels(recordings: DataFrame, decode: Callable[[bytes], np.ndarray], number: str, size: int, hop: int, floor: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in pdf.itertuples(index=False):
                rms = frame_levels(decode(content), size, hop, floor)
                yield pd.DataFrame({"path": path, number: np.arange(len(rms)), "rms": rms})

    return recordings.select("path", "content").mapInPandas(run, LEVELS.format(number))


def second_levels(recordings: DataFrame, header: bool = True, rate: int = RATE) -> DataFrame:
    """second, rms of each recording; a last part of a second is left out.

    With ``header`` files are WAV and resampled; without, every byte is taken as 16-bit samples at ``rate``.
    """
    decode = (lambda c: decode_wav(c, rate)) if header else decode_pcm
    return _levels(recordings, decode, "second", rate, rate, 0.0)


def voice_levels(recordings: DataFrame, frame_ms: int = 30, hop_ms: int = 10, rate: int = RATE) -> DataFrame:
    """frame_no, rms of each WAV recording's frames, for ``voice.voiced_intervals``."""
    return _levels(recordings, lambda c: decode_wav(c, rate), "frame_no", rate * frame_ms // 1000, rate * hop_ms // 1000, 1e-12)


def frame_index(frames: DataFrame, durations: DataFrame, fps: float, keys: list[str] = ["media_id"]) -> DataFrame:  # noqa: B006
    """Adds timestamp to frames sampled at ``fps``, in order of their name; none lies beyond the medium's duration."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy("frame")) - 1
    timed = frames.join(durations.select(*keys, round_half_even(F.col("duration"), 3).alias("last")), keys)
    return timed.withColumn("timestamp", F.least(round_half_even(place * F.lit(1 / fps), 3), "last")).drop("last")
