"""Connected components of a links table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courant.session import checkpointed


#: Links in a partition: few links are not dealt out over the partitions of a large shuffle.
PART_LINKS = 200_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b) that is not the smallest of its component.

    Large and small stars take turns: each step hangs neighbours on the smallest
    neighbour known, until the links are stars. Minimums have a map-side part
    and the joins are plain equi-joins, so a hot node is split like any skewed
    key. Rows with a null or with a = b are ignored; repeated rows count once.
    The number of rounds grows with the logarithm of the longest path.
    """
    edges = checkpointed(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while (state := _state(edges)) != before and state[0]:
        before = state
        edges = edges.coalesce(1 + state[0] // PART_LINKS)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        large = checkpointed(large.coalesce(1 + 2 * state[0] // PART_LINKS))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        edges = checkpointed(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
