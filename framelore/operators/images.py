"""Grey frames: structural similarity, and which frames differ enough from the last chosen one to be worth labelling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 7
#: Fixed values of the published formula, for levels from 0 to 1.
C1, C2 = 0.01**2, 0.03**2


def _box(x: np.ndarray) -> np.ndarray:
    """Mean of each whole window, by summed areas."""
    total = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = WINDOW
    return (total[n:, n:] - total[:-n, n:] - total[n:, :-n] + total[:-n, :-n]) / n**2


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Mean structural similarity of two grey images, over whole 7 x 7 windows with sample variances."""
    a, b = a.astype(float), b.astype(float)
    ma, mb = _box(a), _box(b)
    n = WINDOW**2 / (WINDOW**2 - 1)
    va, vb, both = n * (_box(a * a) - ma * ma), n * (_box(b * b) - mb * mb), n * (_box(a * b) - ma * mb)
    return float(np.mean((2 * ma * mb + C1) * (2 * both + C2) / ((ma**2 + mb**2 + C1) * (va + vb + C2))))


def gate_images(frames: DataFrame, width: int, threshold: float = 0.08, longest_skip: float = 8.0, disabled: bool = False) -> DataFrame:
    """Which frames are worth labelling: similarity, change_score, selected, reason, by media_id and timestamp.

    ``frames``: media_id long, timestamp double, grey: an image's levels from 0 to 1, row by row, ``width`` a row, 7 rows at
    least. Each frame is compared with the last chosen one: chosen are the first, those that change by ``threshold``, and
    those ``longest_skip`` seconds after it; all if the gate is ``disabled``. A medium's frames pass through one task in
    order, which keeps the last chosen image alone. A frame without an image counts as wholly changed.
    """

    def gate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        medium, chosen, at = None, None, 0.0
        for pdf in batches:
            out = []
            for m, t, grey in pdf.itertuples(index=False):
                image = None if grey is None else np.asarray(grey).reshape(-1, width)
                alike = change = None
                if m != medium:
                    reason = "first_frame"
                else:
                    alike = 0.0 if image is None or chosen is None or image.shape != chosen.shape else similarity(chosen, image)
                    change = round(1 - alike, 6)
                    reason = "disabled" if disabled else "change" if change >= threshold else "max_skip" if t - at >= longest_skip else "propagated"
                if reason != "propagated":
                    medium, chosen, at = m, image, t
                out.append((m, t, None if alike is None else round(alike, 6), change, reason != "propagated", reason))
            yield pd.DataFrame(out, columns=["media_id", "timestamp", "similarity", "change_score", "selected", "reason"])

    ordered = frames.select("media_id", "timestamp", F.col("grey").cast("array<float>")).repartition("media_id").sortWithinPartitions("media_id", "timestamp")
    return ordered.mapInPandas(gate, "media_id long, timestamp double, similarity double, change_score double, selected boolean, reason string")
