"""Clustering against plain exact rounds over all vectors."""

import hashlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from courant.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(c))) for c in v]) for i, v, *_ in rows
            if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    def order(r):
        return hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]
    centroids = [v for _, v in sorted(kept, key=order)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, found) if c == n]
            if mine:
                centroids[n] = [sum(col) // len(mine) for col in zip(*mine)]
    found = assign()
    inertia = {n: sum(d for d, c in found if c == n) for n in range(len(centroids))}
    return [
        (i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for (i, _), (d, c) in zip(kept, found)
    ]


def awkward():
    nan, inf = float("nan"), float("inf")
    return [(9000, None, 1), (9001, [nan] * 64, 1), (9002, [inf] + [0.0] * 63, 1), (9003, [None] + [0.0] * 63, 1),
            (9004, [0.5] * 63, 1), (9005, [], 1), (9006, [0.0] * 64, None), (None, [0.25] * 64, 1)]


def result(df, **more):
    got = clusters.cluster(df, **more).select("vec_id", *clusters.COLUMNS).collect()
    return sorted(map(repr, map(tuple, got)))


@pytest.mark.parametrize("kind", ["groups", "noise", "copies", "grid"])
def test_like_plain_rounds(spark, kind):
    rng = np.random.default_rng(len(kind))
    x = {
        "groups": lambda: rng.normal(size=(6, 64))[rng.integers(0, 6, 200)] + 0.1 * rng.normal(size=(200, 64)),
        "noise": lambda: rng.normal(size=(150, 64)),
        "copies": lambda: np.repeat(rng.normal(size=(9, 64)), [100, 1, 1, 1, 30, 1, 1, 1, 1], axis=0),
        "grid": lambda: rng.integers(-1, 2, (150, 64)) * (rng.random((150, 64)) < 0.04) / 1024.0,  # many ties
    }[kind]().astype(np.float32)
    rows = [(i * 7, v.tolist(), i % 3) for i, v in enumerate(x)] + awkward()
    rows += rows[:4]
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(3)) == sorted(map(repr, plain_clusters(rows)))


def test_pops_only_what_expired(spark):
    rng = np.random.default_rng(0)
    x = (3 * rng.normal(size=(4, 64))[rng.integers(0, 4, 400)] + 0.05 * rng.normal(size=(400, 64))).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    pushed, push = [], clusters._Heaps.push

    def counted(heaps, df):
        push(heaps, df)
        pushed.append(heaps.runs[-1].count())

    clusters._Heaps.push = counted
    try:
        assert result(spark.createDataFrame(rows, SCHEMA), clusters=4) == sorted(map(repr, plain_clusters(rows, 4)))
    finally:
        clusters._Heaps.push = push
    assert pushed[0] == 400 and sum(pushed[1:]) < 5 * 400


def test_few_vectors_and_columns(spark):
    rows = [(i, [i / 8] * 64, 0) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"x": F.lit(1), "Cluster": F.lit(2), "key": F.lit(3), "was": F.lit(4), "c0": F.lit(5)})
    out = clusters.cluster(df)
    assert out.columns == ["vec_id", "embedding", "label", "x", "key", "was", "c0", *clusters.COLUMNS]
    assert {(r.x, r.key, r.was, r.c0, r.distance) for r in out.collect()} == {(1, 3, 4, 5, 0)}
    assert result(df) == sorted(map(repr, plain_clusters(rows)))
    assert result(spark.createDataFrame(rows[:1], SCHEMA)) == sorted(map(repr, plain_clusters(rows[:1])))
    assert result(spark.createDataFrame([], SCHEMA)) == []
    assert result(spark.createDataFrame(awkward()[:6], SCHEMA)) == []
    with pytest.raises(PySparkException, match="no long integer"):
        result(spark.createDataFrame([(1, [1e6] * 64, 0)], SCHEMA))
