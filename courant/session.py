"""Session settings the jobs rely on, and where lineage may be cut."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings: AQE splits skewed join partitions even when that costs one
# more shuffle, since one source or symbol may hold a large share of the rows.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Text work costs much per byte, so small shuffles keep their parallelism too.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows may be long texts: what a Python task holds at a time is bounded by bytes as well.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; sizes (partitions, memory) stay the cluster's."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, where it is not installed there."""
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="courant-package-")) / package.name
    spark.sparkContext.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Only a local session, where driver and executors share a disk, gets one of
    its own if none is named.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="courant-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: rounds do not pile up lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# A side is broadcast up to this many rows and this many bytes (as JSON).
SMALL_ROWS, SMALL_BYTES = 20_000, 8 * 1024 * 1024


def small_side(df: DataFrame) -> DataFrame:
    """Mark a configuration table for broadcast, if it really is small.

    Its size is measured first, on at most one row more than the limit. A
    larger one is joined by shuffle, where AQE splits the hot partitions.
    """
    size = df.limit(SMALL_ROWS + 1).agg(
        F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("chars")
    ).first()
    return F.broadcast(df) if size["n"] <= SMALL_ROWS and (size["chars"] or 0) <= SMALL_BYTES else df
