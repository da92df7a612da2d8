"""Exact percentiles of groups of any size, by selection: histograms of values, refined around the ranks that are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelore.operators.shared import discard, materialise

KEYS = ["media_id"]
BINS = 1024
#: Into how many parts a group's rows are dealt to meet its spans.
SALTS = 32
#: How many rows a task of a round gets; tables of few distinct numbers are too small as files to be cut by their size.
TASK_ROWS = 250_000


def percentiles(df: DataFrame, value: str, fractions: dict[str, float], keys: list[str] = KEYS, bins: int = BINS) -> DataFrame:
    """A column by name for each fraction of every group: what ``percentile`` gives, interpolated between two ranks.

    Each round counts the rows between two values in ``bins`` bins and keeps the bin that holds the rank, with the least and
    greatest value in it; it ends when these are equal. Counts are added up before they are exchanged and a group's rows are
    dealt into parts, so no task holds a group; tasks are as many as rows need. Nulls and NaN are left out; a group without other
    values has nulls.
    """
    if bins < 2:
        raise ValueError("bins must be 2 or more")
    rows = df.select(*keys, F.col(value).cast("double").alias("v"))
    # Equal values are one row with their number, so that a value that many rows have is none too many for a part.
    valid = materialise(rows.where("v is not null and not isnan(v)").groupBy(*keys, "v").agg(F.count("*").alias("times")))
    ends = valid.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("times").alias("n"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(f)).alias("f")) for name, f in fractions.items()]))
    place = materialise(ends.select("*", asked.alias("a")).select(*keys, "lo", "hi", "a.name", ((F.col("n") - 1) * F.col("a.f")).alias("place")))
    two = F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")
    open_ranks = materialise(place.select(*keys, "lo", "hi", two).distinct().withColumn("below", F.lit(0).cast("long")))
    tasks = 1 + (valid.count() + SALTS * (place.count() // len(fractions))) // TASK_ROWS
    found, written = None, [open_ranks]
    while True:
        done = open_ranks.where("lo = hi").select(*keys, "rank", F.col("lo").alias("v"))
        found = done if found is None else found.union(done)
        left = open_ranks.where("lo < hi")
        if left.isEmpty():
            break
        open_ranks = materialise(_refined(valid, left, keys, bins, tasks))
        written.append(open_ranks)
    values = materialise(found)
    discard(valid, *written)
    low, high = (values.select(*[F.col(k).alias(f"{p}_{k}") for k in keys], F.col("rank").alias(f"{p}_rank"), F.col("v").alias(f"{p}_v")) for p in ("low", "high"))
    met = place
    for p, side, rank in (("low", low, F.floor("place")), ("high", high, F.ceil("place"))):
        same = F.col(f"{p}_rank") == rank
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{p}_{k}"))
        # By their files these are small, by their rows too large to be sent whole to every task.
        met = met.join(side.hint("merge"), same)
    share = F.col("place") - F.floor("place")
    between = F.when(F.col("low_v") == F.col("high_v"), F.col("low_v")).otherwise((1 - share) * F.col("low_v") + share * F.col("high_v"))
    got = met.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, between)).alias(name) for name in fractions])
    renamed = got.select(*[F.col(k).alias(f"_{k}") for k in keys], *fractions)
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.select(*keys).distinct().join(renamed, match, "left").select(*keys, *fractions)


def _refined(valid: DataFrame, left: DataFrame, keys: list[str], bins: int, tasks: int) -> DataFrame:
    """The ranks' bins, of narrower ends.

    Ranks between the same two values share a span, known by its group and the number of values below it. Spans of a group don't
    overlap, so a value is counted in one at most, the last that begins at or below it; a rank's bin is found the same way.
    """
    dealt = valid.select(*keys, "v", "times", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("part"), F.lit(None).cast("struct<below: bigint, lo: double, hi: double>").alias("span"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    spans = left.select(*keys, "below", "lo", "hi").distinct().select(*keys, F.col("lo").alias("v"), F.lit(None).cast("long").alias("times"), parts.alias("part"), F.struct("below", "lo", "hi").alias("span"))
    together = dealt.union(spans).repartition(tasks, *keys, "part")
    upwards = W.partitionBy(*keys, "part").orderBy("v", F.col("times").asc_nulls_first())
    met = together.withColumn("span", F.last("span", ignorenulls=True).over(upwards)).where("times is not null and v <= span.hi").select(*keys, "part", "v", "times", "span.*")
    # Halves, so that no difference of two doubles is infinite.
    share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    # The greatest value has the last bin for itself where all others are less: ends always come closer.
    cut = F.when(F.col("v") == F.col("hi"), bins - 1).otherwise(F.least(F.floor(share * bins), F.lit(bins - 2)))
    counts = met.groupBy(*keys, "part", "below", cut.alias("bin")).agg(F.sum("times").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).drop("part")
    ranks = left.select(*keys, "below", "rank")
    both = counts.unionByName(ranks, allowMissingColumns=True).repartition(tasks, *keys, "below")
    added = both.groupBy(*keys, "below", "bin", "rank").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    span = W.partitionBy(*keys, "below")
    run = added.withColumn("before", F.col("below") + F.sum("n").over(span.orderBy("bin")) - F.col("n"))
    place = span.orderBy(F.coalesce("rank", "before"), F.col("rank").asc_nulls_first())
    held = F.last(F.when(F.col("rank").isNull(), F.struct("lo", "hi", F.col("before").alias("below"))), ignorenulls=True).over(place)
    return run.withColumn("held", held).where("rank is not null").select(*keys, "held.lo", "held.hi", "rank", "held.below")
