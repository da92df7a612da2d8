"""Tables that are parameters, such as word lists and prototype banks: small enough to travel with every task, or an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 10_000
MOST_BYTES = 64 << 20


def as_array(small: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """One row whose column rows holds ``small``; more than ``most`` rows or 64 MB of it raise an error, none are left out."""
    rows = small.limit(most + 1).agg(F.collect_list(F.struct("*")).alias("rows"))
    fits = (F.size("rows") <= most) & (F.length(F.to_json("rows")) <= MOST_BYTES)
    return rows.select(F.when(fits, F.col("rows")).otherwise(F.raise_error(F.lit(f"a parameter table has over {most} rows or {MOST_BYTES} bytes"))).alias("rows"))


def beside(df: DataFrame, small: DataFrame) -> DataFrame:
    """Every row of ``df`` with every row of a parameter table."""
    return df.crossJoin(F.broadcast(as_array(small))).select(*df.columns, F.inline("rows"))
