"""How long history is kept."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courant.sources.tables import without_ids

# Days kept.
SEEN_DAYS, SNAPSHOT_DAYS, LOG_DAYS = 7, 3, 30


def _cutoff(as_of: Column, days: int) -> Column:
    return as_of - F.lit(timedelta(days=days))


def prune_seen(seen: DataFrame, as_of: Column) -> DataFrame:
    return seen.where(F.col("first_seen_at") >= _cutoff(as_of, SEEN_DAYS))


def expire_snapshots(log: DataFrame, as_of: Column) -> DataFrame:
    fresh = F.col("created_at") >= _cutoff(as_of, SNAPSHOT_DAYS)
    return log.withColumn("html_snapshot", F.when(fresh, F.col("html_snapshot")))


def prune_log(log: DataFrame, as_of: Column) -> DataFrame:
    return log.where(F.col("created_at") >= _cutoff(as_of, LOG_DAYS))


def cleanup_report(seen: DataFrame, log: DataFrame, as_of: Column) -> DataFrame:
    """What a clean-up removes; snapshots are counted before old rows are deleted."""
    of_seen = seen.agg(F.count_if(F.col("first_seen_at") < _cutoff(as_of, SEEN_DAYS)))
    old_snapshot = (F.col("created_at") < _cutoff(as_of, SNAPSHOT_DAYS)) & F.col("html_snapshot").isNotNull()
    of_log = log.agg(
        F.count_if(old_snapshot).alias("snapshots_cleared"),
        F.count_if(F.col("created_at") < _cutoff(as_of, LOG_DAYS)).alias("log_deleted"),
    )
    return of_log.select(of_seen.scalar().alias("seen_deleted"), "snapshots_cleared", "log_deleted")


def reset_seen(seen: DataFrame, sources: DataFrame, industry_ids: list[int]) -> DataFrame:
    """Forget the articles of some industries' sources. Rows without a source stay."""
    dropped = sources.where(F.col("industry_id").isin(industry_ids))
    return without_ids(seen, dropped.select(F.col("id").alias("source_id")), "source_id")
