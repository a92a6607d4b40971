"""What several operators share: reading tables, written intermediate tables, word hashing."""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from courant.session import shared_folder

U64 = np.uint64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the installed tokenizer files lie; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def batched(spark: SparkSession) -> SparkSession:
    """Bound what a Python task holds of long texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: read many times, computed once.

    The table outlives lost executors and has statistics a planner can use.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """As `written`, in buckets of `column`: grouping by it needs no shuffle."""
    spark = df.sparkSession
    table_name = f"{name}_{uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{table_name}"
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(table_name)
    return spark.table(table_name)


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on unsigned 64-bit integers."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class WordHashes(dict):
    """64-bit hashes by word; forgets all beyond a bound, so memory stays bounded."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))
