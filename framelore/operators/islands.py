"""Gaps and islands: spans of scored windows, merged intervals, runs, scenes, and what happens between neighbouring frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelore.functions.rounding import round_half_even

KEYS = ["media_id"]


def islands(df: DataFrame, begins: Column, order: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Numbers runs of rows, from 0, in a column island: a run begins where ``begins`` holds, and at the first row."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("begins", F.coalesce(begins, F.lit(False)).cast("int")).withColumn("island", F.sum("begins").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("begins")


def merge_windows(windows: DataFrame, threshold: float, max_gap: float, keys: list[str] = KEYS) -> DataFrame:
    """Spans of windows that score ``threshold`` or more: a gap over ``max_gap`` after the window before begins a new one.

    A span's peak is its best window, the later one of a tie; its end is the last window's.
    """
    w = W.partitionBy(*keys).orderBy("win_no")
    strong = windows.where((F.col("score") >= threshold) & ~F.isnan("score"))
    spans = islands(strong, F.col("start_sec") - F.lag("end_sec").over(w) > max_gap, ["win_no"], keys)
    best = F.struct("score", "win_no")
    return spans.groupBy(*keys, "island").agg(F.min_by("start_sec", "win_no").alias("start_sec"), F.max_by("end_sec", "win_no").alias("end_sec"), F.max_by("center_sec", best).alias("peak_sec"), F.max("score").alias("peak_prob"))


def merge_intervals(intervals: DataFrame, gap: float, keys: list[str] = KEYS) -> DataFrame:
    """Intervals joined where the next starts at most ``gap`` after the furthest end so far."""
    before = W.partitionBy(*keys).orderBy("start_sec", "end_sec").rowsBetween(W.unboundedPreceding, -1)
    runs = islands(intervals, F.col("start_sec") - F.max("end_sec").over(before) > gap, ["start_sec", "end_sec"], keys)
    return runs.groupBy(*keys, "island").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"))


def runs(df: DataFrame, flag: str, order: str, keys: list[str] = KEYS) -> DataFrame:
    """First and last position of each run of rows whose flag holds."""
    w = W.partitionBy(*keys).orderBy(order)
    numbered = islands(df, F.col(flag) != F.lag(flag).over(w), [order], keys)
    return numbered.where(flag).groupBy(*keys, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"))


def carry_forward(frames: DataFrame, selected: str, columns: list[str], keys: list[str] = KEYS, order: str = "timestamp") -> DataFrame:
    """Rows that aren't selected take ``columns`` from the latest selected row, and its time as source_timestamp."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    latest = F.last(F.when(F.col(selected), F.struct(order, *columns)), ignorenulls=True).over(w)
    rest = [c for c in frames.columns if c not in columns]
    return frames.withColumn("latest", latest).select(*rest, *[F.col(f"latest.{c}").alias(c) for c in columns], F.when(~F.col(selected), F.col(f"latest.{order}")).alias("source_timestamp"))


def propagated_log(frames: DataFrame, labels: DataFrame, columns: list[str], keys: list[str] = KEYS, order: str = "timestamp") -> DataFrame:
    """Labels joined to their frames and carried forward to those that weren't selected.

    ``labels``: keys, ``order``, ord and ``columns``; of several for one frame that of the highest ord holds. Adds columns,
    source (label or propagated, null before the first label) and source_timestamp. A selected frame without a label stays empty.
    """
    latest = labels.groupBy(*keys, order).agg(F.max_by(F.struct(*columns), "ord").alias("label")).select(*keys, order, "label.*")
    joined = frames.join(latest, [*keys, order], "left")
    carried = carry_forward(joined, "selected", columns, keys, order)
    source = F.when(F.col("selected"), "label").when(F.col("source_timestamp").isNotNull(), "propagated")
    return carried.withColumn("source", source).drop("selected")


def smooth_frames(frames: DataFrame, keys: list[str] = KEYS, order: str = "timestamp") -> DataFrame:
    """Smooth labels against both neighbours, all reading the raw ones.

    Levels become the rounded mean of the three; an expression yields to two equal neighbours where its confidence is below
    0.85; a scene type yields to them unless its confidence exceeds theirs by 0.2. The first and last frame have one neighbour.
    """
    w = W.partitionBy(*keys).orderBy(order)
    near = w.rowsBetween(-1, 1)

    def level(c: str) -> Column:
        return F.least(F.lit(5), F.greatest(F.lit(0), F.bround(F.avg(c).over(near)).cast("int")))

    def around(c: str) -> tuple[Column, Column]:
        return F.lag(c).over(w), F.lead(c).over(w)

    def expression(c: str) -> Column:
        before, after = around(c)
        return F.when((before == after) & (before != F.col(c)) & (F.col("confidence") < 0.85), before).otherwise(F.col(c))

    before, after = around("scene_type")
    rival = F.greatest(*around("confidence")) + 0.2
    scene = F.when((before == after) & (F.col("confidence") < rival), before).otherwise(F.col("scene_type"))
    return frames.select(*[c for c in frames.columns if c not in SMOOTHED], level("intensity").alias("intensity"), level("danger_level").alias("danger_level"), expression("expression_a").alias("expression_a"), expression("expression_b").alias("expression_b"), scene.alias("scene_type"))


def smoothed_log(frames: DataFrame, keys: list[str] = KEYS, order: str = "timestamp") -> DataFrame:
    """The smoothed log: frames as ``smooth_frames`` gives them, with what each was before as a struct column raw.

    Columns that a frame's log may lack have defaults: source is label, selected is true; reason, similarity and change_score are
    null. Further columns stay.
    """
    defaults = {"source": F.lit("label"), "selected": F.lit(True), "reason": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double"), "change_score": F.lit(None).cast("double")}
    whole = frames.withColumns({c: F.coalesce(F.col(c), v) if c in frames.columns else v for c, v in defaults.items()})
    labels = [c for c in frames.columns if c not in (*keys, order, *defaults)]
    return smooth_frames(whole.withColumn("raw", F.struct(*labels)), keys, order)


SMOOTHED = ["intensity", "danger_level", "expression_a", "expression_b", "scene_type"]


def scenes(frames: DataFrame, fps: float, keys: list[str] = KEYS, order: str = "timestamp") -> DataFrame:
    """Scenes of equal type without a gap over 1.5 frames. A scene ends where the next begins, the last a frame later.

    Expressions are the most frequent, of a tie the first seen; the summary is that of the surest frame, of a tie the first.
    """
    w = W.partitionBy(*keys).orderBy(order)
    begins = (F.col("scene_type") != F.lag("scene_type").over(w)) | (F.col(order) - F.lag(order).over(w) > 1.5 / fps)
    numbered = islands(frames, begins, [order], keys)
    main = numbered.groupBy(*keys, "island").agg(
        F.min(order).alias("start_sec"), F.max(order).alias("last"), F.first("scene_type").alias("scene_type"),
        round_half_even(F.avg("intensity"), 3).alias("avg_intensity"), round_half_even(F.avg("danger_level"), 3).alias("avg_danger_level"),
        F.max_by("scene_summary", F.struct("confidence", -F.col(order))).alias("scene_summary"), round_half_even(F.avg("confidence"), 4).alias("avg_confidence"), F.count("*").alias("frame_count"),
    )
    faces = ["expression_a", "expression_b"]
    main = main.join(dominant(numbered, faces, [*keys, "island"], order), [*keys, "island"], "left")
    following = F.lead("start_sec").over(W.partitionBy(*keys).orderBy("island"))
    return main.withColumn("end_sec", F.coalesce(following, F.col("last") + 1 / fps)).drop("last")


def dominant(df: DataFrame, values: list[str], keys: list[str], order: str) -> DataFrame:
    """Each group's most frequent value of every column, of a tie the one seen first; null where a column has none."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).alias("value")) for i, c in enumerate(values)]))
    rows = df.select(*keys, F.col(order).alias("at"), each.alias("face")).where("face.value is not null")
    counts = rows.groupBy(*keys, "face").agg(F.struct(F.count("*").alias("n"), (-F.min("at")).alias("seen")).alias("rank"))
    best = [F.max_by("face.value", F.when(F.col("face.which") == i, F.col("rank"))).alias(c) for i, c in enumerate(values)]
    return counts.groupBy(*keys).agg(*best)


def ranked_entities(df: DataFrame, entities: str, keys: list[str], order: str) -> DataFrame:
    """Entities of each group by count, of a tie the first seen: frame by frame, then by place in the frame's list."""
    seen = df.select(*keys, order, F.posexplode(entities).alias("place", "entity"))
    counts = seen.groupBy(*keys, "entity").agg(F.count("*").alias("n"), F.min(F.struct(order, "place")).alias("first"))
    return counts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "entity"))), lambda x: x["entity"]).alias("entities"))


def frame_events(frames: DataFrame, keys: list[str] = KEYS, order: str = "timestamp") -> DataFrame:
    """What changes from one frame to the next: event_type and confidence, up to six a frame."""
    w = W.partitionBy(*keys).orderBy(order)
    was = lambda c: F.lag(c).over(w)
    new_face = lambda c: (F.col(c) != was(c)) & ~F.col(c).isin("neutral", "unclear")
    both = F.greatest("confidence", was("confidence"))
    event = lambda holds, name, sure: F.when(holds, F.struct(F.lit(name).alias("event_type"), sure.alias("confidence")))
    own = F.col("confidence")
    found = F.array(
        event(F.col("scene_type") != was("scene_type"), "scene_transition", both),
        event(F.col("intensity") - was("intensity") >= 2, "intensity_spike", own),
        event(F.col("danger_level") - was("danger_level") >= 2, "danger_spike", own),
        event(new_face("expression_a"), "expression_a_change", own),
        event(new_face("expression_b"), "expression_b_change", own),
        event(F.col("notable_change"), "notable_change", own),
    )
    rows = frames.withColumn("found", F.filter(found, lambda x: x.isNotNull()))
    return rows.select(*keys, order, F.explode("found").alias("event")).select(*keys, order, "event.event_type", "event.confidence")
