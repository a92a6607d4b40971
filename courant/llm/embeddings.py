"""Near duplicates of vectors: a subspace pigeonhole join on the cosine.

Unit vectors are rotated and split into blocks of BLOCK_WIDTH coordinates. Two of
them with a cosine of at least t have a squared distance of at most 2 (1 - t),
so in some block theirs is at most that block's share of it. In each block the
pairs within its budget are found by a range join: a grid over its first two
coordinates, where a vector also visits the greater cells within reach. Full
vectors travel along and are compared exactly, in double precision, on the
spot; a pair counts in the first block whose budget it keeps, so no pair is
written out and none counts twice.

Equal vectors are one row with a weight. A cell of more than TILE rows is split
into tiles that are compared two by two, so a crowded cell is work for many
tasks. A tile returns a degree for each vector and one link to the smallest
vector of its part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courant.llm.common import written
from courant.llm.components import components

BLOCK_WIDTH, TILE, SEED = 4, 1000, 11


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))[0]


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Rotated unit vectors, summed in one order, so that a vector gets the same values in any company."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    turn = rotation(vectors.shape[1])
    out = np.zeros_like(unit)
    for k in range(unit.shape[1]):
        out += unit[:, k : k + 1] * turn[k]
    return out


def budgets(dim: int, threshold: float) -> list[tuple[int, int, float]]:
    """(first, end, squared distance) of each block, with a margin for rounding."""
    total = 2 * (1 - threshold)
    edges = [*range(0, dim, BLOCK_WIDTH), dim]
    return [(a, b, total * (b - a) / dim * (1 + 1e-9) + 1e-12) for a, b in zip(edges, edges[1:])]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _entries(threshold: float, with_vectors: bool):
    names = ["label", "dim", "block", "c1", "c2", "id", "n", "own", "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(batch)
            for dim in set(table.column("dim").to_pylist()):
                part = table.filter(pa.array([d == dim for d in table.column("dim").to_pylist()]))
                turned = rotated(_matrix(part.column("vec")))
                for block, (a, b, budget) in enumerate(budgets(dim, threshold)):
                    reach = math.sqrt(budget)
                    at = np.zeros((len(turned), 2))
                    at[:, : min(2, b - a)] = turned[:, a : min(a + 2, b)]
                    cell = np.floor(at / (2 * reach)).astype(np.int32)
                    low = np.floor((at - reach) / (2 * reach)).astype(np.int32)
                    high = np.floor((at + reach) / (2 * reach)).astype(np.int32)
                    rows, cells = [], []
                    for dx in (-1, 0, 1):
                        for dy in (-1, 0, 1):
                            to = cell + (dx, dy)
                            if (dx, dy) < (0, 0):
                                continue
                            there = ((to >= low) & (to <= high)).all(axis=1)
                            rows.append(np.flatnonzero(there))
                            cells.append(to[there])
                    row, to = np.concatenate(rows), np.concatenate(cells)
                    own = (to == cell[row]).all(axis=1)
                    taken = part.take(pa.array(row))
                    columns = [
                        taken.column("label"), taken.column("dim"), pa.array(np.full(len(row), block, np.int32)),
                        pa.array(to[:, 0], pa.int32()), pa.array(to[:, 1], pa.int32()), taken.column("id"), taken.column("n"),
                        pa.array(own), taken.column("vec"),
                    ]
                    keep = len(columns) if with_vectors else 5
                    yield from pa.Table.from_arrays(columns[:keep], names=names[:keep]).to_batches(2000)

    return run


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
        own = table.column("own").to_numpy(zero_copy_only=False)
        side = table.column("side").to_numpy()
        block, (i, j) = table.column("block")[0].as_py(), (table.column(c)[0].as_py() for c in ("i", "j"))
        vectors = _matrix(table.column("vec"))
        first, second = (np.flatnonzero(side == s) for s in (i, j))
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        norm = np.sqrt((scaled * scaled).sum(axis=1))
        unit = scaled / norm[:, None]
        close = unit[first] @ unit[second].T >= threshold - 1e-9
        close &= own[first][:, None] | own[second][None, :]
        if i == j:
            close &= np.arange(len(first))[:, None] < np.arange(len(second))[None, :]
        x, y = np.nonzero(close)
        x, y = first[x], second[y]
        found = []
        turned = rotated(vectors)
        edges = budgets(vectors.shape[1], threshold)
        for at in range(0, len(x), 20_000):
            a, b = x[at : at + 20_000], y[at : at + 20_000]
            a_b = (scaled[a] * scaled[b]).sum(axis=1) / (norm[a] * norm[b]) >= threshold
            apart = (turned[a] - turned[b]) ** 2
            kept = np.stack([apart[:, s:e].sum(axis=1) <= most for s, e, most in edges], axis=1)
            found.append(np.stack([a, b], axis=1)[a_b & (kept.argmax(axis=1) == block) & kept.any(axis=1)])
        pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        degree = np.zeros(len(ids), np.int64)
        np.add.at(degree, pairs[:, 0], n[pairs[:, 1]])
        np.add.at(degree, pairs[:, 1], n[pairs[:, 0]])
        root = ids.copy()
        while len(pairs):
            least = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
            before = root.copy()
            np.minimum.at(root, pairs[:, 0], least)
            np.minimum.at(root, pairs[:, 1], least)
            if (before == root).all():
                break
        hit = degree > 0
        return pa.table({"id": pa.array(ids[hit]), "degree": pa.array(degree[hit]), "root": pa.array(root[hit])})

    return run


def near_vectors(
    rows: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str | None = "label",
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Two vectors are linked where their labels are equal and not null (all count as
    equal without `label_col`), their lengths are equal and their cosine in
    double precision is at least `threshold`. Vectors that are null, zero or
    hold a null or non-finite component, and rows without an id, are linked
    with nothing; without an id there is no component either. Ids are taken to
    be unique; rows that share one are vectors of their own that share the
    component and get the same count. Other columns are not looked at.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    vector = F.col(vector_col).cast("array<double>")
    label = F.lit("") if label_col is None else F.col(label_col).cast("string")
    given = rows.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), vector.alias("v"))
    takes_part = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))
    valid = given.where(takes_part).mapInArrow(_packed, "id long, label string, dim int, vec binary")
    valid = written(valid, "vectors")
    classes = written(
        valid.groupBy("label", "dim", "vec").agg(F.min("id").alias("id"), F.count("*").alias("n")), "classes"
    )
    cell = ["label", "dim", "block", "c1", "c2"]
    cell_type = "label string, dim int, block int, c1 int, c2 int"
    whole = classes.mapInArrow(
        _entries(threshold, True), f"{cell_type}, id long, n long, own boolean, vec binary"
    )
    crowded = (
        classes.mapInArrow(_entries(threshold, False), cell_type).groupBy(*cell).agg(F.count("*").alias("held"))
        .where(F.col("held") > TILE).withColumn("parts", F.ceil(F.col("held") / TILE).cast("int"))
    )
    sided = (
        whole.join(crowded.drop("held"), cell, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("side", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    )
    found = written(
        sided.groupBy(*cell, "i", "j").applyInArrow(_compare(threshold), "id long, degree long, root long"), "links"
    )
    degrees = found.groupBy("id").agg(F.sum("degree").alias("degree"))
    label_of = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_class = written(
        classes.join(degrees, "id", "left").join(label_of, "id", "left")
        .select("label", "vec", (F.coalesce("degree", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "id").alias("component_id")), "class-links",
    )
    of_id = valid.join(of_class, ["label", "vec"]).select("id", "n_links", "component_id")
    of_id = of_id.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = given.select("id").join(of_id, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; minus zero becomes zero, so equal vectors have equal bytes."""
    for batch in batches:
        vectors = [np.asarray(v.values, dtype=np.float64) + 0.0 for v in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array([len(v) for v in vectors], pa.int32()),
                pa.array([v.tobytes() for v in vectors], pa.binary()),
            ],
            ["id", "label", "dim", "vec"],
        )
