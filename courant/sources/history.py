"""History tables laid out by day, and in buckets of the key they are asked by.

A day is a partition: what is older than a period is dropped as whole folders,
without reading a row; reading a period lists its days only; and a day that is
written again replaces itself. Inside a day rows lie in buckets of the key, so
an anti-join with fresh rows shuffles the fresh rows alone.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64  # for a table of some GB a day; a table keeps the number it was made with
_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def store_days(rows: DataFrame, table: str, day: Column, key: str, buckets: int = BUCKETS) -> None:
    """Write rows into the days they belong to; those days' former rows are replaced, other days stay.

    The first call makes the table, with `buckets` buckets. Rows are dealt out by
    key first, so that a day has one file a bucket.
    """
    spark = rows.sparkSession
    laid = rows.withColumn("day", day.cast("date")).repartition(buckets, key)
    if not spark.catalog.tableExists(table):
        laid.write.partitionBy("day").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
        return
    before = spark.conf.get(_OVERWRITE)
    spark.conf.set(_OVERWRITE, "dynamic")
    try:
        laid.select(*spark.table(table).columns).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(_OVERWRITE, before)


def stored_days(spark: SparkSession, table: str) -> list[date]:
    """The days a table has, from its catalog; as many as days, whatever they hold."""
    names = [r[0] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    days = [n.removeprefix("day=") for n in names]
    return sorted(date.fromisoformat(d) for d in days if d != "__HIVE_DEFAULT_PARTITION__")


def drop_days(spark: SparkSession, table: str, before: date) -> list[date]:
    """Drop whole days older than `before`; only folders are touched."""
    gone = [d for d in stored_days(spark, table) if d < before]
    for d in gone:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (day = DATE'{d}')")
    return gone


def since(spark: SparkSession, table: str, first: date) -> DataFrame:
    """The rows from a day on; earlier days are not listed."""
    return spark.table(table).where(F.col("day") >= F.lit(first))


def unseen_since(df: DataFrame, table: str, first: date, key: str = "url") -> DataFrame:
    """Rows whose key no day from `first` on has. The stored side stays where it lies."""
    return df.join(since(df.sparkSession, table, first).select(key), key, "left_anti")
