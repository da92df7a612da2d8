"""Sharding by histogram sort.

Rows are put in the order of a key, a hash of the text and then one of the doc_id, and cut into ranges of near equal bytes. The
splitters are found without sorting: each round counts exact bytes by the key's next PROBE hex digits, below every candidate
boundary inside the intervals that still hold a splitter. A splitter is settled at the first boundary whose bytes lie within
its tolerance of the target; else its interval is probed further. Then the rows are exchanged once, by shard and slice, and numbered.

Equal texts lie side by side in the order, and a boundary within the text's digits never cuts them apart. A group of equal texts
is cut only where no other boundary lies within the tolerance, so sizes stay near equal however large a group is.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialise, table, wrapped

SHARDS = 8
PROBE = 2
DIGITS = 32
#: Share of a shard's bytes by which a splitter may miss its target.
TOLERANCE = 0.002
#: Bytes of rows that one task numbers, and the fewest digits by which rows are dealt out for that.
RANGE_BYTES = 256 << 20
LEAST_DIGITS = 2
#: Digits of the text's hash at the begin of a key; how many times the usual bytes make a slice a hot one.
TEXT_DIGITS = 16
HOT = 4
_AFTER = "g"  # follows every hex digit


def _hex(*columns: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.xxhash64(*columns)), 16, "0"))


def splitters(keys: DataFrame, targets: list[int], tolerances: list[float]) -> list[str]:
    """For each target a cut: the bytes of the keys that sort before it come within the target's tolerance, or as near as whole
    keys allow.

    ``keys``: sort_key (DIGITS hex digits), size. ``targets`` ascend. At most len(targets) * 16 ** PROBE sums come back in a
    round, and DIGITS / PROBE rounds are needed at most.
    """
    state = [("", 0) for _ in targets]  # prefix of the interval, bytes before it
    settled: list[str | None] = [None] * len(targets)
    for digits in range(PROBE, DIGITS + 1, PROBE):
        inside = keys
        if digits > PROBE:
            inside = keys.where(F.substring("sort_key", 1, digits - PROBE).isin(sorted({p for (p, _), cut in zip(state, settled, strict=True) if cut is None})))
        counts = inside.groupBy(F.substring("sort_key", 1, digits).alias("probe")).agg(F.sum("size").alias("size")).collect()
        by_prefix: dict[str, list[tuple[str, int]]] = {}
        for row in sorted((r["probe"], r["size"]) for r in counts):
            by_prefix.setdefault(row[0][: digits - PROBE], []).append(row)
        for i, target in enumerate(targets):
            if settled[i] is not None:
                continue
            prefix, before = state[i]
            for probe, size in by_prefix[prefix]:
                if before + size >= target:
                    break
                before += size
            state[i] = probe, before
            below, above = target - before, before + size - target
            if min(below, above) <= tolerances[i] or digits == DIGITS:
                settled[i] = probe if below < above else probe + _AFTER
        if None not in settled:
            break
    return settled


def range_of(key: Column, cuts: list[str]) -> Column:
    """How many cuts are at or below the key, found by halving."""

    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]), half(lo, mid)).otherwise(half(mid + 1, hi))

    return half(0, len(cuts))


def slice_of(keys: DataFrame, total: int) -> Column:
    """What numbers a shard's rows side by side: the first digits of the text's hash, so many that slices are of RANGE_BYTES at
    most. Where these hold much more than others do, as a text of many rows makes them, digits of the id's hash follow.
    """
    digits = max(LEAST_DIGITS, ceil(log(max(1, total / RANGE_BYTES), 16)))
    prefix = F.substring("sort_key", 1, digits)
    usual = max(1, total / 16**digits)
    # Each holds over HOT shares of the usual, so there are at most 16 ** digits / HOT.
    hot = keys.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("size")).where(F.col("size") > HOT * usual).collect()
    if not hot:
        return prefix
    more = min(TEXT_DIGITS, ceil(log(max(r["size"] for r in hot) / usual, 16)))
    return F.when(prefix.isin([r["prefix"] for r in hot]), F.concat(prefix, F.substring("sort_key", TEXT_DIGITS + 1, more))).otherwise(prefix)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``: row (a struct of its columns), size, shard, slot; slots are gapless from 0 in a shard.

    Size is the text's UTF-8 bytes plus 1; null texts count as empty, very long ones whole. Repeated rows with one doc_id and
    text share a key and lie in one shard. No column of ``docs`` can clash, as all lie in the struct. No rows, no shards.

    A shard's rows are numbered slice by slice, in as many tasks as there are bytes for.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    key = F.concat(_hex(text), _hex("doc_id", F.col("text").isNull()))
    ready = wrapped(docs, size=(F.octet_length(text) + 1).cast("long"), sort_key=key)
    keys = materialise(ready.select("sort_key", "size"))
    total = keys.agg(F.sum("size")).first()[0] or 0
    targets = [max(1, (i * total) // shards) for i in range(1, shards)] if total else []
    cuts = sorted(splitters(keys, targets, [TOLERANCE * total / shards] * len(targets))) if targets else []
    place = {"shard": range_of(F.col("sort_key"), cuts), "slice": slice_of(keys, total)}
    counts = materialise(keys.withColumns(place).groupBy("shard", "slice").agg(F.count("*").alias("n")))
    discard(keys)
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(W.partitionBy("shard", "slice").orderBy("sort_key"))
    ranked = ready.withColumns(place).withColumn("rank", rank)
    return ranked.join(counts.select("shard", "slice", earlier.alias("earlier")), ["shard", "slice"]).select("row", "size", "shard", (F.col("earlier") + F.col("rank") - 1).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce("row.text", F.lit("")).cast("binary"))
    return shard(docs).select("row.doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
