"""Reading and changing the stored tables.

A change returns the table's new rows as a DataFrame; `publish` writes them.
Parquet files cannot be updated in place, so a change is a plan over the old
rows, written to a new folder or over the partitions it touches.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courant.sources.schemas import TABLES

# A list of ids typed in by a person is sent to all tasks up to this length.
SMALL_LIST = 10_000


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Scan a stored table with its declared schema (no inference)."""
    return spark.read.schema(TABLES[name]).parquet(path)


def publish(
    df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = ()
) -> None:
    """Write rows as Parquet; `replace` overwrites only the partitions present in `df`."""
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if mode == "replace":
        if not partition_by:
            raise ValueError("replace works on partitions; name partition_by")
        writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    else:
        writer.mode(mode).parquet(path)


def of_industry(df: DataFrame, industry_id: int | None = None) -> DataFrame:
    """Rows of one industry, or of all of them when no id is given."""
    return df if industry_id is None else df.where(F.col("industry_id") == industry_id)


def by_id(df: DataFrame, value: int, key: str = "id") -> DataFrame:
    """The row with this id, or no row."""
    return df.where(F.col(key) == value)


def first_config(df: DataFrame, key: str = "id") -> DataFrame:
    """The configuration row with the lowest id."""
    return df.orderBy(key).limit(1)


def by_ids(df: DataFrame, ids: Sequence[int], key: str = "id") -> DataFrame:
    """Rows for the requested ids in request order; unknown ids give no row."""
    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("request_pos", T.LongType()),
    ])
    wanted = df.sparkSession.createDataFrame(
        [(value, pos) for pos, value in enumerate(ids)], schema
    )
    if len(ids) <= SMALL_LIST:
        wanted = F.broadcast(wanted)
    return df.join(wanted, key).orderBy("request_pos")


def without_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Delete the rows whose key is listed in `ids`."""
    return df.join(ids.select(key), key, "left_anti")


def replace_rows(df: DataFrame, new_rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Drop all rows of the given keys and put the new rows in their place."""
    return without_ids(df, keys.distinct(), key).unionByName(new_rows)


def add_columns(df: DataFrame, added: Mapping[str, tuple[T.DataType, object]]) -> DataFrame:
    """Add the columns an older table lacks, with their defaults; leave others alone."""
    missing = {
        name: F.lit(default).cast(kind)
        for name, (kind, default) in added.items() if name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def first_per_key(
    df: DataFrame, keys: Iterable[str], order: Iterable[str], rest: Iterable[str] | None = None
) -> DataFrame:
    """The first row of each key in the given order.

    A minimum over a struct, not a window: copies collapse in the map tasks
    before the shuffle, so a key with a third of all rows does no harm.
    """
    keys, order = list(keys), list(order)
    taken = set(keys) | set(order)
    rest = [c for c in (df.columns if rest is None else rest) if c not in taken]
    fields = [c for c in order if c not in keys] + rest
    best = df.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("_first"))
    return best.select(*keys, *[F.col("_first")[c].alias(c) for c in fields])


def unseen(df: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose url was not pushed before, for whichever industry."""
    return df.join(seen.select(key), key, "left_anti")


def seen_rows(pushed: DataFrame, seen: DataFrame, order: Sequence[str], as_of: Column) -> DataFrame:
    """Rows to append to the seen table after a successful push: one per new url."""
    once = first_per_key(pushed, ["url"], order, ["title", "source_id"])
    return unseen(once, seen).select(
        "url", "title", "source_id", as_of.alias("first_seen_at")
    )
