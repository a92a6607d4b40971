"""Vectors, mixing, queries and the pipeline."""

import hashlib
import time
from collections import Counter

import numpy as np
import pytest
from llm_helpers import COLUMNS, components, corpus, near_components, unit_rows
from pyspark.sql import functions as F

import corpus_pipeline
from courant.llm import embeddings, hnsw, mixing, queries

VECTORS = "vec_id long, embedding array<float>, label int"


def awkward(start):
    nan, inf = float("nan"), float("inf")
    return [(start, None, 1), (start + 1, [0.0] * 16, 1), (start + 2, [nan] * 16, 1), (start + 3, [inf] + [1.0] * 15, 1),
            (start + 4, [None] + [1.0] * 15, 1), (start + 5, [], 1), (None, [1.0] * 16, 1)]


@pytest.mark.parametrize("tile", [1000, 7])
def test_near_vectors_like_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    x = unit_rows(3, 180).astype(np.float32)
    x[100:130] = x[5]  # equal vectors
    x[140] = 3 * x[5]
    rows = [(i * 2, v.tolist(), None if i % 11 == 0 else i % 2) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + awkward(900) + [(990, [1.0, 2.0], 0), (991, [1.0, 2.0], 0)], VECTORS).repartition(5)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = [
        (rows[i][0], rows[j][0]) for i in range(180) for j in range(i)
        if rows[i][2] is not None and rows[i][2] == rows[j][2] and u[i] @ u[j] >= 0.93
    ] + [(990, 991)]
    degree = Counter(i for pair in links for i in pair)
    want = components([r[0] for r in rows] + list(range(900, 906)) + [990, 991], links)
    got = [r for r in embeddings.near_vectors(df.withColumn("n_links", F.lit(7)), 0.93).collect()]
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == {
        i: (degree[i], c) for i, c in want.items()}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert embeddings.near_vectors(spark.createDataFrame([], VECTORS), 0.93).collect() == []


def test_search_recall(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 150)
    x = (unit_rows(8, 600) * np.linspace(0.5, 2, 600)[:, None]).astype(np.float32)
    x[200:260] = x[0]  # more equal vectors than results
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + awkward(9000)
    df = spark.createDataFrame(rows, VECTORS).repartition(4).withColumn("rank", F.lit(1))
    got = hnsw.search(df, df.where("vec_id % 20 = 0"), k=10, width=60).collect()
    d, hits, ids = x.astype(np.float64), 0, np.arange(600)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 600, 20))
    for q, answers in found.items():
        answers.sort()
        assert [a[0] for a in answers] == list(range(1, 14))
        scores = (d * d[q]).sum(axis=1)
        assert all(a[1] != q and abs(a[2] - scores[a[1]]) < 1e-12 for a in answers)
        assert sorted(answers, key=lambda a: (-a[2], a[1])) == answers
        scores[q] = -np.inf
        hits += len({a[1] for a in answers} & set(np.lexsort((ids, -scores))[:10].tolist()))
    assert hits / (10 * len(found)) >= 0.9


def test_graphs_of_many_vectors_are_built_and_searched_together():
    x = unit_rows(14, 6000, 32)
    start, total = time.thread_time(), 0
    for i in range(1_000_000):
        total = (total * 31 + i) & 0xFFFFFFFF
    plain, start = time.thread_time() - start, time.thread_time()
    points = hnsw._lifted(x)
    graph = hnsw.build(points)
    found = hnsw.nearest(points, graph, np.column_stack([x[:600], np.zeros(600)]), 160)
    assert time.thread_time() - start < 25 * plain  # node by node: 100 and more
    exact = np.argsort(-(x[:600] @ x.T), axis=1)[:, :20]
    assert np.mean([len({*a.tolist()} & {*b.tolist()}) / 20 for a, b in zip(exact, found)]) > 0.98
    for links in graph["links"]:
        assert (links < 6000).all() and all(len({*r[r >= 0].tolist()}) == (r >= 0).sum() and i not in r for i, r in enumerate(links))


def test_answers_of_several_shards_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 150)
    monkeypatch.setattr(hnsw, "LEAST_ROWS", 7)
    x = unit_rows(8, 600).astype(np.float32)
    x[200:260] = x[0]  # more equal vectors than results
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + awkward(9000), VECTORS).repartition(4)
    found = {}
    for r in hnsw.search(df, df.where("vec_id % 20 = 0"), k=10, width=200).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    d = x.astype(np.float64)
    assert set(found) == set(range(0, 600, 20))
    for q, answers in found.items():
        scores = (d * d[q]).sum(axis=1)
        scores[q] = -np.inf
        want = np.lexsort((np.arange(600), -scores))[:10].tolist()
        assert sorted(answers) == [(i + 1, v) for i, v in enumerate(want)]


def test_search_small(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (20, [0.0, 1.0], 1), (3, [0.5, 0.5], 1)], VECTORS)
    got = [(r.query_id, r["rank"], r.vec_id) for r in hnsw.search(df, df.where("vec_id % 20 = 0")).collect()]
    assert sorted(got) == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]
    assert hnsw.search(df.limit(0), df.limit(0)).collect() == []
    assert hnsw.search(df.where("vec_id = 0"), df).where("query_id = 0").collect() == []


# --- mixing -------------------------------------------------------------------------


def simulated(weights, blocks):
    """Earliest deadline first over all blocks, slot by slot, in phases."""
    left, out = {s: n for s, n in blocks.items() if n}, []
    while left:
        total, done, t = sum(weights[s] for s in left), dict.fromkeys(left, 0), 0
        active = list(left)
        while all(left.values()):
            ready = [(-(-(done[s] + 1) * total // weights[s]), s) for s in active if done[s] * total // weights[s] <= t]
            s = min(ready)[1]
            out.append(s)
            done[s] += 1
            left[s] -= 1
            t += 1
            for x in active:  # nobody is a whole block off
                assert abs(done[x] - t * weights[x] / total) < 1
        left = {s: n for s, n in left.items() if n}
    return out


def test_schedule_like_simulation():
    weights = {"a": 5, "b": 3, "c": 1, "d": 7}
    blocks = {"a": 40, "b": 90, "c": 2, "d": 11}
    slots = {}
    for r in mixing.phases(weights, blocks):
        for k in range(r["blocks"]):
            slot = r["first_slot"] + k // r["weight"] * r["period"] + r["places"][k % r["weight"]]
            assert slot not in slots
            slots[slot] = r["source"]
    assert [slots[i] for i in range(len(slots))] == simulated(weights, blocks)


def test_mix_keeps_all_rows(spark):
    rows = [(i % 90 if i % 13 else None, "s0" if i % 3 else f"s{i % 5}" if i % 4 else None, i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot int").repartition(5)
    got = mixing.mix(df, {"s0": 4, None: 2}, block_rows=3, default=1).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert len({r.position for r in got}) == len(rows)
    sizes = Counter(r.source for r in got)
    order = [s for _, s in sorted({(r.slot, r.source or "") for r in got})]
    weights = {s or "": {"s0": 4, None: 2}.get(s, 1) for s in sizes}
    assert order == simulated(weights, {s or "": -(-n // 3) for s, n in sizes.items()})
    whole = mixing.mixed(df, {"s0": 4, None: 2}, block_rows=3, default=1)
    assert whole.columns == df.columns and Counter(map(tuple, whole.collect())) == Counter(rows)


def test_mix_limits(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    for weights in ({"a": 0}, {"b": 1}, {"a": 10**6}):
        with pytest.raises(ValueError):
            mixing.mix(df, weights)
    assert mixing.mix(df.limit(0), {"a": 1}).collect() == []


# --- queries and pipeline ------------------------------------------------------------


def test_queries_cover_the_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rows = corpus(21, 140)
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        out.append(docs)
    return folder, rows, out


def test_stages_like_brute_force(spark, stages):
    _, rows, (language, lines, near, mix, tokens) = stages
    columns = [c.split()[0] for c in COLUMNS.split(", ")]
    assert all(s.columns == columns for s in (language, lines, near, mix))
    kept = {r.doc_id for r in language.collect()}
    assert kept <= {r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    assert len(kept) >= 0.95 * len(rows) - 6 and language.where("lang IS NULL").count() == 0
    left = {r.doc_id: r for r in lines.collect()}
    assert all(r.n_chars == len(r.text) for r in left.values())
    want, _ = near_components([(i, r.text) for i, r in left.items()], 4, 5)
    assert {r.doc_id for r in near.collect()} == {i for i, c in want.items() if i == c}
    assert Counter(map(tuple, mix.collect())) == Counter(map(tuple, near.collect()))
    ids = [r.doc_id for r in tokens.orderBy("position").collect()]
    expected = mixing.mix(near, queries.WEIGHTS, default=1).orderBy("position").collect()
    assert ids == [r.doc_id for r in expected]
    texts = {r.doc_id: r.text for r in near.collect()}
    assert all(r.text == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in tokens.collect())


def test_run_does_all_stages(spark, stages):
    folder, _, out = stages
    got = corpus_pipeline.run(spark, str(folder)).select("doc_id", "n_tokens", "text").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, out[-1].select("doc_id", "n_tokens", "text").collect()))


def test_pipeline_of_awkward_tables(spark, tmp_path):
    for name, rows in (("empty", []), ("nulls", [(None, None, None, None, None)] * 3 + [(1, "a b", None, None, 3)])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
        corpus_pipeline.run(spark, folder).collect()


def test_digests(spark):
    row = spark.createDataFrame([(1, [5, 6], "é")], "doc_id long, ids array<int>, text string")
    got = queries.bpe_digests(row).first()
    assert got.ids_sha256 == hashlib.sha256(b"5,6").hexdigest()
    assert got.decoded_sha256 == hashlib.sha256("é".encode()).hexdigest()


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    names = ["position", "id_", "rest_", "found", "n_lines", "n_removed", "gone", "component_id", "mark", "place"]
    rows = [(*r, *[f"{n}{i}" for n in names]) for i, r in enumerate(corpus(9, 40))]
    docs = spark.createDataFrame(rows, COLUMNS + "".join(f", {n} string" for n in names))
    given = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(all(r[n] == given[r.doc_id][n] for n in names) for r in got), name
