"""Labels kept from earlier runs: what still needs labelling, and all labels together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["media_id", "frame", "timestamp"]
FRESH = "label"


def _usable(cache: DataFrame, source: str) -> DataFrame:
    """Labels that a labeller gave, not propagated ones; a missing time counts as -1."""
    return cache.where(F.col("source") == source).fillna({"timestamp": -1.0})


def pending(frames: DataFrame, cache: DataFrame, keys: list[str] = KEYS, force: bool = False, source: str = FRESH) -> DataFrame:
    """Selected frames without a label in the cache; every selected one with ``force``.

    ``frames`` has a boolean selected; ``cache`` has the keys and source. Both are hashed by the keys, nothing is broadcast.
    """
    chosen = frames.where("selected")
    return chosen if force else chosen.join(_usable(cache, source).select(*keys), keys, "left_anti")


def known(frames: DataFrame, cache: DataFrame, fresh: DataFrame | None = None, keys: list[str] = KEYS, force: bool = False, source: str = FRESH) -> DataFrame:
    """Labels of the selected frames, from new labels where there are any and else from the cache; with ``force`` new ones only.

    ``cache`` has an order column ord: of several labels of a frame the highest counts. ``fresh`` has the cache's columns. Write
    the result as the next run's cache, to another place than that it was read from.
    """
    tables = [] if force else [_usable(cache, source).withColumn("age", F.lit(0))]
    if fresh is not None:
        tables.append(_usable(fresh, source).withColumn("age", F.lit(1)))
    if not tables:
        return cache.where("false")
    labels = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
    rest = [c for c in cache.columns if c not in keys]
    best = labels.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("age", "ord")).alias("best")).select(*keys, "best.*")
    return best.join(frames.where("selected").select(*keys), keys, "left_semi").select(*cache.columns)
