"""Top rows per group, safe for a group that holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    spread: Sequence[str],
    limit: int,
    own_limit: str | None = None,
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """Rank rows within `keys` by `order` and keep `limit` of each group.

    Two passes. The first ranks inside slices of a group; its constant limit
    lets Spark drop rows before the shuffle, in each map task. The second
    ranks the at most `salts * limit` rows per group that are left. `spread`
    names columns that tell rows apart and so fill the slices evenly;
    `own_limit` a column with a smaller limit of the group's own.
    """
    slice_no = F.pmod(F.xxhash64(*spread), F.lit(salts))
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    sliced = (
        df.withColumn("_slice", slice_no)
        .withColumn(rank, F.row_number().over(inner))
        .where(F.col(rank) <= limit)
        .drop("_slice", rank)
    )
    ranked = sliced.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= limit)
    return ranked if own_limit is None else ranked.where(F.col(rank) <= F.col(own_limit))
