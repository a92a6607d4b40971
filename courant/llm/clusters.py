"""Centroid clustering by heaps of bounds, in exact integers.

A vector's gap is its distance to the second nearest centroid less that to its
own. When centroids move, the gap of a vector of cluster c shrinks by at most
the way of c and the longest way of any other centroid; what a cluster has lost
that way since the start is its `offset`. A vector enters the heap of its
cluster under the key offset + gap, so keys need no renewal as centroids move:
only vectors whose key the offset has reached may be nearer to another centroid.
They are popped, compared exactly with all centroids, and pushed anew.

A heap outlives its task as sorted runs in the shared folder, as an external
priority queue does. A run is the table that one round pushes, ordered by
cluster and key, so that popping reads the head of each run: the filter on
cluster and key reaches the Parquet reader, which skips the row groups beyond.
Nothing is ever deleted from a run. An entry that was popped lies below its
cluster's offset from then on, an entry still in the heap above it, so every
vector has exactly one entry above. There is no shuffle of vectors and no join;
the driver holds the centroids and, for each, the sums of its vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courant.llm.common import written

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 8, 10, 64, 1024, "3:"
#: Distances are long integers, so a component, scaled, must stay below this bound.
BOUND = 1 << 27
#: Bounds are floating point: gaps are taken smaller and ways longer by this share.
SLACK = 1e-9
COLUMNS = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _whole(x: Column) -> Column:
    """A component as an integer; one beyond the bound is an error."""
    scaled = F.floor(x.cast("double") * SCALE)
    said = f"a component of 2^27 / {SCALE} or more: its squared distance is no long integer"
    return F.when(F.abs(scaled) < BOUND, scaled.cast("int")).otherwise(F.raise_error(F.lit(said)).cast("int"))


def _scan(columns: list[str], centroids: np.ndarray, offsets: np.ndarray):
    """Push vectors: nearest centroid, the smaller number on ties, and the key in its heap."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        goals = centroids.astype(np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)
            square = np.stack([((x - c) ** 2).sum(axis=1) for c in goals], axis=1)
            mine = square.argmin(axis=1)
            at = np.arange(len(x))
            distance = square[at, mine]
            if len(goals) > 1:
                square[at, mine] = np.iinfo(np.int64).max
                near, far = np.sqrt(distance.astype(float)), np.sqrt(square.min(axis=1).astype(float))
                key = offsets[mine] + (far * (1 - SLACK) - near * (1 + SLACK))
                # Above the offset in any case: ways are 0 or at least 1, so the next way pops it.
                key = np.maximum(key, np.nextafter(offsets[mine], np.inf))
            else:
                key = np.full(len(x), np.inf)
            new = [pa.array(mine, pa.int32()), pa.array(key, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [batch.column("cluster"), *new], [*columns, "was", "cluster", "key"]
            )

    return scan


def _measure(columns: list[str], centroids: np.ndarray):
    """The squared distance of each vector to its own centroid."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        goals = centroids.astype(np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)
            distance = ((x - goals[batch.column("cluster").to_numpy()]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [batch.column("cluster"), pa.array(distance, pa.int64())],
                [*columns, "cluster", "distance"],
            )

    return measure


class _Heaps:
    """The heaps of all clusters: their runs, offsets, and the sums of what they hold."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, kept: list[str]) -> None:
        self.centroids, self.kept = centroids, kept
        self.offsets = np.zeros(len(centroids))
        self.sums = [[0] * WIDTH for _ in centroids]
        self.counts = [0] * len(centroids)
        self.runs: list[DataFrame] = []
        self.push(rows.withColumn("cluster", F.lit(None).cast("int")))

    def push(self, rows: DataFrame) -> None:
        """Scan vectors exactly, write them as a run, and add what moved to the sums."""
        columns = [*self.kept, "x"]
        schema = rows.select(*columns, F.col("cluster").alias("was"), "cluster").schema.add("key", "double")
        scanned = rows.select(*columns, "cluster").mapInArrow(_scan(columns, self.centroids, self.offsets), schema)
        run = written(scanned.sortWithinPartitions("cluster", "key"), "heap-run")
        self.runs.append(run.drop("was"))
        moved = run.where("was IS NULL OR was <> cluster").select(
            "x", F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("s")),
                                   F.struct(F.col("was").alias("c"), F.lit(-1).alias("s")))).alias("m")
        ).where("m.c IS NOT NULL").groupBy("m.c").agg(
            F.sum("m.s").alias("n"),
            F.array(*[F.sum(F.col("x")[i].cast("long") * F.col("m.s")) for i in range(WIDTH)]).alias("x"),
        )
        for row in moved.collect():  # at most a row for each cluster
            self.counts[row["c"]] += row["n"]
            self.sums[row["c"]] = [a + b for a, b in zip(self.sums[row["c"]], row["x"])]

    def move(self) -> np.ndarray:
        """Put each centroid that has vectors at the floor of their mean; the offsets before that."""
        old, before = self.centroids, self.offsets
        self.centroids = np.array([
            [s // n for s in total] if n else c.tolist() for c, total, n in zip(old, self.sums, self.counts)
        ], np.int64).reshape(old.shape)
        way = np.sqrt(((self.centroids - old) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
        others = np.array([max((w for j, w in enumerate(way) if j != c), default=0.0) for c in range(len(way))])
        self.offsets = before + (way + others) * (1 + SLACK)
        return before

    def above(self, low: np.ndarray, high: np.ndarray | None = None) -> DataFrame:
        """Entries with a key above `low` and, if given, not above `high`, by cluster."""

        def between(c: int) -> Column:
            found = (F.col("cluster") == c) & (F.col("key") > float(low[c]))
            return found if high is None else found & (F.col("key") <= float(high[c]))

        wanted = [c for c in range(len(low)) if high is None or high[c] > low[c]]
        one_of = reduce(lambda a, b: a | b, map(between, wanted), F.lit(False))
        return reduce(DataFrame.unionByName, [run.where(one_of) for run in self.runs])


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS,
    rounds: int = ROUNDS, seed: str = SEED,
) -> DataFrame:
    """Rows of `vectors` with `cluster`, `distance`, inertias and the hash of their centroid.

    Vectors of 64 components, none null or not finite, are kept, with every
    component x as floor(1024 x); all other rows go. The first centroids are the
    vectors whose SHA-256 of `seed` and id is smallest, in that order (equal
    hashes: smaller vector first); with fewer vectors than clusters there are
    fewer clusters. Each round assigns every vector to its nearest centroid
    (ties: the smaller number) and then moves each centroid that has vectors to
    the floor of their mean; in the end all are assigned once more. `distance`
    is the squared one, `cluster_inertia` and `inertia` its sums.

    A row with a null id takes part, its id as an empty text. Repeated rows each
    count. No vector kept: no row. Of other columns of `vectors` those named
    like an added one are replaced, the others stay. A scaled component of 2^27
    or more, or an inertia beyond a long, raises an error.
    """
    taken = {c.lower() for c in COLUMNS}
    kept = [c for c in vectors.columns if c.lower() not in taken]
    v = F.col(f"`{vector_col}`")
    fit = (F.size(v) == WIDTH) & F.forall(v, lambda x: F.coalesce(
        ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != math.inf), F.lit(False)))
    plain = [f"c{i}" for i in range(len(kept))]  # names that clash with nothing added here
    rows = vectors.where(fit).select(
        *[F.col(f"`{c}`").alias(p) for c, p in zip(kept, plain)], F.transform(v, _whole).alias("x"),
        F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256).alias("_h"),
    )
    first = rows.select("_h", "x").orderBy("_h", "x").limit(clusters).collect()  # as many as clusters
    if not first:
        first_centroids = np.zeros((1, WIDTH), np.int64)
    else:
        first_centroids = np.array([r["x"] for r in first], np.int64)
    heaps = _Heaps(rows.drop("_h"), first_centroids, plain)
    for _ in range(rounds):
        before = heaps.move()
        if (heaps.offsets > before).any():
            heaps.push(heaps.above(before, heaps.offsets))
    columns = plain
    last = heaps.above(heaps.offsets).select(*columns, "x", "cluster")
    schema = last.drop("x", "cluster").schema.add("cluster", "integer").add("distance", "long")
    measured = written(last.mapInArrow(_measure(columns, heaps.centroids), schema), "clusters")
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = measured.groupBy("cluster").agg(wide.alias("s")).collect()  # a row for each cluster
    inertia = {r["cluster"]: int(r["s"]) for r in sums}
    total = sum(inertia.values())
    if total >= 1 << 63:
        raise ValueError("the inertia is no long integer")

    def of(values: dict, kind: str) -> Column:
        chosen = F.lit(None).cast(kind)
        for c, value in values.items():
            chosen = F.when(F.col("cluster") == c, F.lit(value).cast(kind)).otherwise(chosen)
        return chosen

    digest = {
        c: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for c, x in enumerate(heaps.centroids.tolist())
    }
    return measured.select(
        *[F.col(p).alias(c) for c, p in zip(kept, plain)], "cluster", "distance",
        of(inertia, "long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"),
        of(digest, "string").alias("centroid_sha256"),
    )
