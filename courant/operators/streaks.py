"""Running streaks over a history, without putting a whole history in one task.

A streak grows by one on an `add` row, falls to zero on a `reset` row and stays
on any other row. The history of each key is cut into time chunks. Streaks are
first counted inside the chunks; then the few chunk totals of a key are chained
to find what each chunk inherits. A key with a third of all rows is spread over
as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600


def running_streak(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: str,
    add: Column,
    reset: Column,
    chunk_seconds: int = HOUR,
    name: str = "streak",
) -> DataFrame:
    """Add the streak after each row, rows of a key taken in (`time`, `tie`) order."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    # One key that is never null (the industry of an old log row may have been
    # deleted), so that the windows and the join share one partitioning.
    keyed = df.withColumns({
        "_key": F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}),
        "_chunk": at - F.pmod(at, F.lit(chunk_seconds * 1_000_000)),
    })
    in_chunk = Window.partitionBy("_key", "_chunk").orderBy(time, tie).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # Adds so far less adds up to the last reset; both windows share one sort.
    local = (
        keyed.withColumn("_adds", F.sum(F.when(add, 1).otherwise(0)).over(in_chunk))
        .withColumn("_base", F.max(F.when(reset, F.col("_adds"))).over(in_chunk))
        .withColumn("_streak", F.col("_adds") - F.coalesce("_base", F.lit(0)))
    )
    # Reads the history once more, but only the narrow columns that decide a streak.
    totals = local.groupBy("_key", "_chunk").agg(
        F.max("_base").isNotNull().alias("_reset"),
        F.max_by("_streak", F.struct(time, tie)).alias("_tail"),
    )
    by_chunk = Window.partitionBy("_key").orderBy("_chunk")
    upto = by_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chained = (
        totals.withColumn("_sum", F.sum("_tail").over(upto))
        .withColumn("_start", F.max(F.when(F.col("_reset"), F.col("_sum") - F.col("_tail"))).over(upto))
        .withColumn("_out", F.col("_sum") - F.coalesce("_start", F.lit(0)))
        .withColumn("_in", F.coalesce(F.lag("_out").over(by_chunk), F.lit(0)))
        .select("_key", "_chunk", "_in")
    )
    inherited = F.when(F.col("_base").isNull(), F.col("_in")).otherwise(F.lit(0))
    return (
        local.join(chained, ["_key", "_chunk"])
        .withColumn(name, F.col("_streak") + inherited)
        .select(*df.columns, name)
    )
