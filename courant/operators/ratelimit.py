"""Sliding-window rate limit per key.

An attempt is allowed if fewer than `limit` attempts were *allowed* in the last
window; a rejected attempt leaves no trace. Each decision depends on earlier
ones, but never on more than the last `limit` allowed times. Three things keep
a key of any size from being one long task:

- Time is cut into slots of a window. Where a slot and the one before it hold at
  most `limit` attempts together, the slot is calm: whatever came before, all its
  attempts are allowed, and the memory at its end is just them. Calm slots need
  counts only, and every one of them starts the decisions anew.
- A stretch of busy slots between them is cut into slices of SLICE_SLOTS slots,
  each decided in its own group from the memory at its start.
- That memory comes from a chain over the bare times of a stretch, which jumps
  from one allowed time to the next by binary search: the work is bounded by
  `limit` steps a window, however many attempts there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ten attempts a minute.
LIMIT, WINDOW_SECONDS = 10, 60
#: Slots of a window in one slice of a busy stretch, and parts of a slot whose times travel together.
SLICE_SLOTS, SLOT_PARTS = 64, 16


def admit(allowed: list[int], at: int, limit: int, window: int) -> bool:
    """Decide one attempt; `allowed` keeps the times still in the window."""
    while allowed and at - allowed[0] >= window:
        allowed.pop(0)
    if len(allowed) >= limit:
        return False
    allowed.append(at)
    return True


def follow(allowed: list[int], times: np.ndarray, limit: int, window: int) -> None:
    """Decide sorted attempts, visiting only those that are allowed."""
    i = 0
    while i < len(times):
        if admit(allowed, int(times[i]), limit, window):
            i += 1
        else:
            i = int(np.searchsorted(times, allowed[0] + window)) if allowed else len(times)


def _slots(timed: DataFrame, key: str, limit: int, window: int, slice_slots: int) -> DataFrame:
    """(_key, _s, _stretch, _slice) of the slots that need decisions in order.

    A stretch starts with the calm slot before its first busy one, whose
    attempts are the memory it begins with.
    """
    counts = timed.where("_slot IS NOT NULL").groupBy(F.col(key).alias("_key"), F.col("_slot").alias("_s")).agg(
        F.count("*").alias("_n"))
    by_slot = Window.partitionBy("_key").orderBy("_s")
    near = F.coalesce(F.col("_s") - F.lag("_s").over(by_slot) == window, F.lit(False))
    counts = counts.withColumn("_near", near).withColumn(
        "_busy", F.col("_n") + F.when(F.col("_near"), F.lag("_n").over(by_slot)).otherwise(0) > limit)
    leads = ~F.col("_busy") & F.coalesce(
        (F.lead("_s").over(by_slot) - F.col("_s") == window) & F.lead("_busy").over(by_slot), F.lit(False))
    begins = F.when(leads | (F.col("_busy") & ~F.col("_near")), F.col("_s"))
    stretch = F.last(F.col("_begins"), ignorenulls=True).over(by_slot.rowsBetween(Window.unboundedPreceding, 0))
    return (
        counts.withColumns({"_leads": leads, "_begins": begins}).withColumn("_stretch", stretch)
        .where("_busy OR _leads")
        .select("_key", "_s", "_stretch", F.floor(
            (F.col("_s") - F.col("_stretch")) / F.lit(window * slice_slots)).cast("long").alias("_slice"))
    )


def _memories(placed: DataFrame, key: str, limit: int, window: int) -> DataFrame:
    """(_mkey, _mstretch, _mslice, _memory): allowed times at the start of every slice but the first."""
    long = placed.groupBy(F.col(key).alias("_lkey"), F.col("_stretch").alias("_lstretch")).agg(
        F.max("_slice").alias("_last")).where("_last > 0")
    same = F.col(key).eqNullSafe(F.col("_lkey")) & (F.col("_stretch") == F.col("_lstretch"))
    part = F.floor(F.pmod("_at", F.lit(window)) * SLOT_PARTS / window)
    times = (
        placed.join(long, same).where("_slice < _last")
        .groupBy(F.col(key).alias("_mkey"), F.col("_stretch").alias("_mstretch"), "_slice", "_slot", part.alias("_part"))
        .agg(F.sort_array(F.collect_list("_at")).alias("_times"))
    )
    schema = T.StructType([
        times.schema["_mkey"], T.StructField("_mstretch", T.LongType()),
        T.StructField("_mslice", T.LongType()), T.StructField("_memory", T.ArrayType(T.LongType())),
    ])
    ordered = times.repartition("_mkey", "_mstretch").sortWithinPartitions("_mkey", "_mstretch", "_slice", "_slot", "_part")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, allowed = None, []
        for batch in batches:
            found = []
            names = batch["_mkey"].astype(object).where(batch["_mkey"].notna(), None)
            for name, stretch, piece, times in zip(names, batch["_mstretch"], batch["_slice"], batch["_times"]):
                if current is not None and (name, stretch, piece) != current:
                    found.append((*current[:2], current[2] + 1, list(allowed)))
                    if (name, stretch) != current[:2]:
                        allowed = []
                current = (name, stretch, piece)
                follow(allowed, np.asarray(times), limit, window)
            yield pd.DataFrame(found, columns=schema.names, dtype=object)
        if current is not None:
            yield pd.DataFrame([(*current[:2], current[2] + 1, allowed)], columns=schema.names, dtype=object)

    return ordered.mapInPandas(chain, schema)


def rate_limit(
    attempts: DataFrame, key: str, time: str, tie: str,
    limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS, slice_slots: int = SLICE_SLOTS,
) -> DataFrame:
    """Add `allowed` to each attempt: null where the time is null, which counts for nothing."""
    window = window_seconds * 1_000_000
    at = F.unix_micros(F.col(time).cast("timestamp"))
    timed = attempts.withColumn("_at", at).withColumn("_slot", F.col("_at") - F.pmod("_at", F.lit(window)))
    slots = _slots(timed, key, limit, window, slice_slots)
    placed = timed.join(slots, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slot") == F.col("_s")), "left")
    calm = placed.where("_stretch IS NULL").select(
        *attempts.columns, F.when(F.col("_at").isNotNull(), True).alias("allowed"))
    busy = placed.where("_stretch IS NOT NULL").select(*attempts.columns, "_at", "_slot", "_stretch", "_slice")
    memories = _memories(busy, key, limit, window)
    same = (
        F.col(key).eqNullSafe(F.col("_mkey")) & (F.col("_stretch") == F.col("_mstretch"))
        & (F.col("_slice") == F.col("_mslice"))
    )
    ordered = (
        busy.join(memories, same, "left").repartition(key, "_stretch", "_slice")
        .sortWithinPartitions(key, "_stretch", "_slice", "_at", tie)
    )
    schema = T.StructType([*attempts.schema.fields, T.StructField("allowed", T.BooleanType())])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, allowed = None, []
        for batch in batches:
            verdicts = []
            names = batch[key].astype(object).where(batch[key].notna(), None)
            rows = zip(names, batch["_stretch"], batch["_slice"], batch["_at"], batch["_memory"])
            for name, stretch, piece, moment, memory in rows:
                if (name, stretch, piece) != current:
                    current, allowed = (name, stretch, piece), [] if memory is None else [int(t) for t in memory]
                verdicts.append(admit(allowed, moment, limit, window))
            yield batch.drop(columns=["_stretch", "_slice", "_at", "_memory"]).assign(allowed=verdicts)

    columns = [*attempts.columns, "_stretch", "_slice", "_at", "_memory"]
    return calm.unionByName(ordered.select(*columns).mapInPandas(decide, schema))
