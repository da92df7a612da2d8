"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Each round scales the cells' token weights so that the totals by
source, then by language, then by topic meet their target shares; rounds go on until no total is off by more than TOLERANCE.
The fitted weights become probabilities, min(1, scale * weight), with the scale at which KEEP of all tokens are expected to
stay. Documents are then drawn systematically: ordered by length within their cell, every 1 / probability-th stays from a start
that the cell's name fixes, so that each has its cell's probability and the drawn tokens follow the targets closely. Only cells
are iterated over; texts are read once.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialise, table

#: A margin's target shares are proportional to its tokens to this power: below 1, large ones give way to small ones.
TEMPER = {"source": 0.6, "lang": 0.8, "topic": 0.9}
KEEP = 0.6
TOLERANCE = 1e-3
ROUNDS_AT_ONCE = 4
#: Shares that rounds bring no nearer than by this part contradict each other.
LEAST_GAIN = 1e-3
#: Rounds that the SQL beside the query writes out.
SQL_ROUNDS = 60
#: Up to so many cells lie in one partition, where windows over margins need no exchange; more are exchanged margin by margin.
CELLS_TOGETHER = 100_000
DIGITS = 7
CELL = list(TEMPER)
#: Topics by words, counted wherever they stand in a text. The driver's prose is invented, so but for the first these are groups
#: of its own words, from each of its languages.
TOPICS = {"licence": ("icense",), "craft": ("ering", "keit", "dans", "mente"), "trade": ("ation", "sich", "pour"), "travel": ("enten", "lich", "elle", "ando")}


def tokens_of(text: Column) -> Column:
    """Words, counted as runs between single spaces and line ends; none in a null or empty text."""
    return F.when(F.length(text) > 0, _found(text, " ") + _found(text, "\n") + 1).otherwise(0).cast("long")


def _found(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of an ASCII word."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(word), F.lit("")))) / len(word)


def topic_counts(text: Column, topics: dict[str, tuple[str, ...]] = TOPICS) -> Column:
    """How often each topic's words occur, in the topics' order."""
    return F.array(*[reduce(lambda a, b: a + b, (_found(text, w) for w in words)) for words in topics.values()])


def topic_of(counts: Column, topics: dict[str, tuple[str, ...]] = TOPICS) -> Column:
    """The topic of the highest count, of a tie the first; "other" where none occurs, as in null and empty texts."""
    most = F.array_max(counts)
    return F.when(most > 0, F.element_at(F.array(*[F.lit(t) for t in topics]), F.array_position(counts, most).cast("int"))).otherwise("other")


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """``cells``: a column for each margin, tokens. ``targets``: per margin a table of it and share. Adds weight and residual.

    Weights times tokens sum to the tokens, and their totals by every margin meet its shares within ``tolerance``: as many rounds
    as that takes. Where the shares contradict each other, rounds bring them no nearer; then the last margin's are met, and
    residual, by how much a margin is missed at most, is above the tolerance. Cells without tokens keep weight 1. A margin's
    cells meet in one window; cells are few beside documents.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    fitted = cells.withColumn("weight", F.lit(1.0))
    for margin, target in targets.items():
        fitted = fitted.join(target.withColumnRenamed("share", f"share_{margin}"), margin)
    fitted = materialise(fitted.withColumn("off", F.lit(0.0)))
    few = fitted.count() <= CELLS_TOGETHER
    missed = float("inf")
    while total:
        step = fitted.coalesce(1) if few else fitted
        for _ in range(ROUNDS_AT_ONCE):
            off = F.lit(0.0)
            for margin in targets:
                now = F.sum(F.col("weight") * F.col("tokens")).over(W.partitionBy(margin))
                factor = F.when(now > 0, F.col(f"share_{margin}") * F.lit(float(total)) / now).otherwise(1.0)
                others = [c for c in fitted.columns if c not in ("weight", "off")]
                step = step.select(*others, (F.col("weight") * factor).alias("weight"), F.greatest(off, F.abs(factor - 1)).alias("off"))
                off = F.col("off")
        before, fitted = fitted, materialise(step)
        discard(before)
        last, missed = missed, fitted.agg(F.max("off")).first()[0]
        if missed <= tolerance:
            break
        if missed >= last * (1 - LEAST_GAIN):
            warnings.warn(f"the target shares contradict each other: one is missed by {missed:.3g}", stacklevel=2)
            break
    return fitted.select(*cells.columns, "weight", F.lit(missed if total else 0.0).alias("residual"))


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares of a margin: its tokens to a power, over their sum."""
    sums = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("raw"))
    whole = sums.agg(F.sum("raw").alias("whole"))  # one row
    return sums.join(F.broadcast(whole)).select(margin, F.when(F.col("whole") > 0, F.col("raw") / F.col("whole")).otherwise(0.0).alias("share"))


def calibrated(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """Adds probability, min(1, scale * weight) to DIGITS places, where the expected tokens are ``keep`` of all.

    The scale rises as more cells reach 1, and settles when no further cell does. Two sums a round reach the driver.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    scale, settled = 0.0, not total
    while not settled:
        full = F.col("weight") * scale >= 1
        whole, rest = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight") * F.col("tokens")))).first()
        new = max(scale, (keep * total - whole) / rest) if rest else scale
        settled, scale = new == scale, new
    return cells.withColumn("probability", F.round(F.least(F.lit(1.0), F.col("weight") * F.lit(scale)), DIGITS) if total else F.lit(1.0))


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit("mix"), *parts).cast("binary"))


def mixed(docs: DataFrame, columns: list[str] | None = None, keep: float = KEEP, temper: dict[str, float] = TEMPER, topics: dict[str, tuple[str, ...]] = TOPICS) -> DataFrame:
    """One row per row of ``docs``: row (a struct of its ``columns``, all by default), source, lang, topic, tokens, probability, kept.

    Null sources and languages are cells of their own, named by an empty text. Repeated rows are drawn one by one, and no
    column of ``docs`` can clash, as all lie in the struct. Empty and null texts have no tokens and count in no margin; their
    probability follows their cell's weight. Very long texts count whole. No rows give no rows.

    A cell's documents are numbered slice by slice, by the magnitude of their length and a digest of doc_id, so no cell is
    sorted in one task however large it is.
    """
    own = F.struct(*(columns or docs.columns)).alias("row")
    source, lang = (F.coalesce(c, F.lit("")).alias(c) for c in ("source", "lang"))
    keyed = docs.select(own, source, lang, topic_counts(F.col("text"), topics).alias("counts"), tokens_of(F.col("text")).alias("tokens"), _digest(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("draw"))
    topic = topic_of(F.col("counts"), topics).alias("topic")
    ready = materialise(keyed.select("row", "source", "lang", topic, "tokens", "draw", F.length(F.bin("tokens")).alias("size"), F.substring("draw", 1, 2).alias("slice")))
    cells = materialise(ready.groupBy(*CELL).agg(F.sum("tokens").alias("tokens")))
    targets = {m: materialise(tempered(cells, m, temper[m])) for m in CELL}
    fitted = calibrated(rake(cells, targets), keep)

    part = [*CELL, "size", "slice"]
    before = F.coalesce(F.sum("n").over(W.partitionBy(*CELL).orderBy("size", "slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slices = ready.groupBy(*part).agg(F.count("*").alias("n")).withColumn("before", before).join(fitted.select(*CELL, "probability"), CELL)
    ranked = ready.withColumn("at", F.row_number().over(W.partitionBy(*part).orderBy("tokens", "draw"))).join(slices.drop("n"), part)
    start = F.conv(F.substring(_digest(*[F.col(c) for c in CELL]), 1, 8), 16, 10).cast("double") / float(2**32)
    upto = lambda rank: F.floor(F.col("probability") * rank + start)
    rank = F.col("before") + F.col("at")
    return ranked.select("row", *CELL, "tokens", "probability", (upto(rank) > upto(rank - 1)).alias("kept"))


def mix(docs: DataFrame) -> DataFrame:
    """The drawn documents, with all their columns."""
    return mixed(docs).where("kept").select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang"])
    return out.select("row.*", "topic", "tokens", "probability", "kept")


def _sql() -> str:
    found = lambda text, w: f"(length({text}) - length(replace({text}, {w}, ''))) / {{n}}"
    gaps = " + ".join(found("text", w).format(n=1) for w in ("' '", "chr(10)"))
    counts = {t: " + ".join(found("text0", f"'{w}'").format(n=len(w)) for w in words) for t, words in TOPICS.items()}
    best = "greatest(" + ", ".join(counts) + ")"
    steps = [
        f"""l AS (SELECT doc_id, source, lang, coalesce(source, '') AS c_source, coalesce(lang, '') AS c_lang, coalesce(text, '') AS text0,
    CAST(CASE WHEN length(text) > 0 THEN {gaps} + 1 ELSE 0 END AS BIGINT) AS tokens FROM documents)""",
        "n AS (SELECT * EXCLUDE (text0), " + ", ".join(f"{x} AS {t}" for t, x in counts.items()) + " FROM l)",
        f"d AS (SELECT *, CASE WHEN {best} = 0 THEN 'other' " + " ".join(f"WHEN {t} = {best} THEN '{t}'" for t in counts) + " END AS c_topic, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw, length(bin(tokens)) AS size FROM n)",
        "w0 AS (SELECT c_source, c_lang, c_topic, CAST(sum(tokens) AS DOUBLE) AS tokens, CAST(1 AS DOUBLE) AS weight, CAST(0 AS DOUBLE) AS off FROM d GROUP BY c_source, c_lang, c_topic)",
    ]
    for m, p in TEMPER.items():
        steps.append(f"t_{m} AS (SELECT c_{m}, raw / sum(raw) OVER () AS share FROM (SELECT c_{m}, pow(sum(tokens), {p}) AS raw FROM w0 GROUP BY c_{m}) AS x)")
    n = 0
    for i in range(SQL_ROUNDS):
        # Before each batch of rounds it is settled whether the last one has met the tolerance; then weights stay.
        if i % ROUNDS_AT_ONCE == 0:
            steps.append(f"o{i // ROUNDS_AT_ONCE} AS MATERIALIZED (SELECT " + (f"max(off) <= {TOLERANCE} AS met FROM w{n})" if i else "false AS met)"))
        for m in TEMPER:
            was = "0" if m == CELL[0] else "off"
            steps.append(f"""w{n + 1} AS MATERIALIZED (SELECT c_source, c_lang, c_topic, tokens, weight * CASE WHEN met THEN 1 ELSE factor END AS weight, CASE WHEN met THEN off ELSE greatest({was}, abs(factor - 1)) END AS off
  FROM (SELECT w.*, CASE WHEN now > 0 THEN share * (SELECT sum(tokens) FROM w0) / now ELSE 1 END AS factor FROM w{n} AS w JOIN (SELECT c_{m}, sum(weight * tokens) AS now FROM w{n} GROUP BY c_{m}) AS s ON s.c_{m} = w.c_{m} JOIN t_{m} ON t_{m}.c_{m} = w.c_{m}) AS x, o{i // ROUNDS_AT_ONCE})""")
            n += 1
    steps.append("s0 AS (SELECT CAST(0 AS DOUBLE) AS scale)")
    last = 20
    for i in range(last):
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT greatest(max(scale), ({KEEP} * sum(tokens) - sum(CASE WHEN weight * scale >= 1 THEN tokens ELSE 0 END)) / sum(CASE WHEN weight * scale >= 1 THEN 0 ELSE weight * tokens END)) AS scale FROM w{n}, s{i})")
    steps.append(f"""r AS (SELECT d.*, round(least(1, weight * scale), {DIGITS}) AS probability,
    CAST('0x' || substr(md5('mix:' || d.c_source || ':' || d.c_lang || ':' || d.c_topic), 1, 8) AS BIGINT) / 4294967296.0 AS start,
    row_number() OVER (PARTITION BY d.c_source, d.c_lang, d.c_topic ORDER BY size, substr(draw, 1, 2), d.tokens, draw) AS rank
  FROM d JOIN w{n} AS w ON w.c_source = d.c_source AND w.c_lang = d.c_lang AND w.c_topic = d.c_topic, s{last})""")
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, source, lang, c_topic AS topic, tokens, probability, floor(probability * rank + start) > floor(probability * (rank - 1) + start) AS kept FROM r"""


SQL = _sql()
