"""Approximate nearest neighbours: a navigable small-world graph per shard, results merged.

Distinct vectors are dealt over shards of about SHARD_ROWS by a hash. A task
builds the layered graph of a shard and stores it as flat arrays: vectors, ids,
and a neighbour row of fixed width per node and layer. Every row is indexed; of
equal vectors only the k + 1 smallest ids can be among k results, so the others
need no place. Queries go in blocks through all shards, and the k best of each
query are merged.

numpy works on many nodes or queries at a time. In each layer a node is linked to
a spread choice of the BUILD_WIDTH nodes nearest to it among those before it, found by block
products, and those link back; a row that is full is chosen anew. A search walks
the graph for TOGETHER queries in step and opens the OPENED nearest
nodes of each at once.

Nearness is the inner product. Vectors of unequal length get one more
coordinate, sqrt(m^2 - |x|^2) with m the greatest length in the shard (0 for
queries), which turns it into a distance the graph can be built on. Scores are
computed on the original vectors in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courant.llm.common import written
from courant.llm.embeddings import _packed, usable

SHARD_ROWS, QUERY_ROWS, LEAST_ROWS = 1 << 15, 1 << 16, 1000
MOST_TASKS = 20_000  # beyond it a task has several graphs, one after the other
LINKS, BUILD_WIDTH, SEARCH_WIDTH, SEED = 16, 80, 160, 3
TOGETHER, OPENED, ROWS = 128, 8, 256
#: A search of a larger graph than this is wider, by the root of the ratio, so that large shards miss no more than many small ones.
WIDTH_ROWS = 2000


def _search(points, norms, links, queries, entry, width):
    """The `width` nearest nodes found in one layer from a row of entries for each query: nearest first, -1 for none."""
    count, rows = len(queries), np.arange(len(queries))[:, None]
    met = np.zeros(count * len(points), np.int16)  # which column of a step brought a node, from 1

    def fresh(nodes):
        """Distances of the nodes not met before, once each; infinite for others."""
        wide, flat = nodes.shape[1], nodes.ravel()
        place = (nodes + rows * len(points)).ravel()
        at = np.flatnonzero((flat >= 0) & (met.take(place, mode="clip") == 0))
        place, column = place.take(at), (at % wide + 1).astype(np.int16)
        met[place] = column
        at = at[met.take(place) == column]
        ids, gap = flat.take(at), np.full(nodes.shape, np.inf, np.float32)
        x, ends = points.take(ids, axis=0), np.searchsorted(at, wide * np.arange(count + 1))
        near = np.empty(len(at), np.float32)
        for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
            near[a:b] = x[a:b] @ queries[i]
        gap.ravel()[at] = norms.take(ids) - 2 * near
        return gap

    def nearest_of(nodes, gaps, done):
        if nodes.shape[1] > width:
            order = np.argpartition(gaps, width - 1, axis=1)[:, :width]
            nodes, gaps, done = nodes[rows, order], gaps[rows, order], done[rows, order]
        order = np.argsort(gaps, axis=1)
        return nodes[rows, order], gaps[rows, order], done[rows, order]

    gaps = fresh(entry)
    best, gaps, done = nearest_of(entry, gaps, ~np.isfinite(gaps))
    while not done.all():
        place = np.argsort(done, axis=1, kind="stable")[:, :OPENED]  # the nearest that are not opened
        opened = np.where(done[rows, place], -1, best[rows, place])
        done[rows, place] = True
        around = np.where(opened[:, :, None] >= 0, links[opened], -1).reshape(count, -1)
        new = fresh(around)
        best, gaps, done = nearest_of(
            np.hstack([best, around]), np.hstack([gaps, new]), np.hstack([done, ~np.isfinite(new)]))
    return np.where(np.isfinite(gaps), best, -1)


def _spread(points, norms, nodes, gaps, most):
    """Up to `most` nodes of each row, nearest first, each nearer to the centre than to those taken; then the nearest left.

    Rows are in order of their distances; -1 is no node.
    """
    out = np.full((len(nodes), most), -1, np.int32)
    for at in range(0, len(nodes), ROWS):
        some, gap = nodes[at : at + ROWS], np.where(nodes[at : at + ROWS] >= 0, gaps[at : at + ROWS], np.inf)
        x, size = points[some], norms[some]
        apart = size[:, :, None] + size[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
        blocked = apart <= gap[:, :, None]  # row j, column i: j is nearer to i than to the centre
        taken, ruled, left = np.zeros(some.shape, bool), some < 0, np.full(len(some), most)
        for i in range(some.shape[1]):
            take = ~ruled[:, i] & (left > 0)
            taken[:, i], left = take, left - take
            ruled |= blocked[:, :, i] & take[:, None]
        order = np.argsort(~taken * 1 + (some < 0) * 1, axis=1, kind="stable")[:, :most]
        out[at : at + ROWS, : order.shape[1]] = np.take_along_axis(some, order, 1)
    return out


def _sorted_by_gap(points, norms, centres, nodes):
    """Nodes of each row nearest to its centre first, and their distances."""
    x = points[nodes]
    gaps = norms[nodes] + norms[centres][:, None] - 2 * (x @ points[centres][:, :, None])[:, :, 0]
    gaps = np.where(nodes >= 0, gaps, np.inf)
    order = np.argsort(gaps, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(gaps, order, 1)


def _layer(points, norms, nodes, wide):
    """Neighbour rows of `wide` for the nodes of a layer, in the order in which they come."""
    x, n = points[nodes], norms[nodes]
    table = np.full((len(nodes), wide), -1, np.int32)
    for start in range(0, len(nodes), ROWS):
        stop = min(start + ROWS, len(nodes))
        gaps = n[start:stop, None] + n[None, :stop] - 2 * (x[start:stop] @ x[:stop].T)
        gaps[np.arange(start, stop)[:, None] <= np.arange(stop)[None, :]] = np.inf
        near = np.broadcast_to(np.arange(stop), gaps.shape)
        if stop > BUILD_WIDTH:
            near = np.argpartition(gaps, BUILD_WIDTH - 1, axis=1)[:, :BUILD_WIDTH]
        gap = np.take_along_axis(gaps, near, 1)
        order = np.argsort(gap, axis=1, kind="stable")
        near, gap = np.take_along_axis(near, order, 1), np.take_along_axis(gap, order, 1)
        table[start:stop, :LINKS] = _spread(x, n, np.where(np.isfinite(gap), near, -1), gap, LINKS)

    # The links back, some to each node at a time; a row that is full is chosen anew.
    back, to = np.nonzero(table[:, :LINKS] >= 0)[0], table[:, :LINKS][table[:, :LINKS] >= 0]
    order = np.argsort(to, kind="stable")
    back, to = back[order].astype(np.int32), to[order]
    first = np.searchsorted(to, np.arange(len(nodes) + 1))
    turn = (np.arange(len(to)) - first[to]) // wide
    for t in range(int(turn.max()) + 1 if len(turn) else 0):
        own = np.flatnonzero(turn == t)
        centres = np.unique(to[own])
        for at in range(0, len(centres), ROWS):
            some = centres[at : at + ROWS]
            lo = first[some] + t * wide
            place = lo[:, None] + np.arange(wide)
            came = np.where(place < first[some + 1][:, None], back[np.minimum(place, len(back) - 1)], -1)
            every, gap = _sorted_by_gap(x, n, some, np.hstack([table[some], came]))
            full = (every >= 0).sum(axis=1) > wide
            chosen = every[:, :wide]
            if full.any():
                chosen[full] = _spread(x, n, every[full], gap[full], wide)
            table[some] = chosen
    return table


def build(points: np.ndarray) -> dict:
    """The graph of `points`: per layer a neighbour row for each node (-1: none), and the entry."""
    points = points.astype(np.float32)
    norms, count = np.einsum("ij,ij->i", points, points), len(points)
    rng = np.random.default_rng(SEED)
    layers_of = np.floor(-np.log(1 - rng.random(count)) / math.log(LINKS)).astype(int)
    top = int(layers_of.max())
    links = []
    for layer in range(top + 1):
        nodes, wide = np.flatnonzero(layers_of >= layer), 2 * LINKS if layer == 0 else LINKS
        table = _layer(points, norms, nodes, wide)
        full = np.full((count, wide), -1, np.int32)
        full[nodes] = np.where(table >= 0, nodes[table], -1)
        links.append(full)
    return {"links": links, "entry": int(layers_of.argmax()), "layer": top}


def nearest(points: np.ndarray, graph: dict, queries: np.ndarray, width: int) -> np.ndarray:
    """A row of the `width` nodes found nearest to each query, -1 for none."""
    points, out = points.astype(np.float32), []
    norms = np.einsum("ij,ij->i", points, points)
    for start in range(0, len(queries), TOGETHER):
        some = queries[start : start + TOGETHER].astype(np.float32)
        at = np.full((len(some), 1), graph["entry"])
        for layer in range(graph["layer"], 0, -1):
            at = _search(points, norms, graph["links"][layer], some, at, LINKS)
        found = _search(points, norms, graph["links"][0], some, at, width)
        out.append(np.pad(found, ((0, 0), (0, width - found.shape[1])), constant_values=-1) if found.shape[1] < width else found)
    return np.vstack(out)


def _lifted(vectors: np.ndarray) -> np.ndarray:
    size = (vectors * vectors).sum(axis=1)
    return np.column_stack([vectors, np.sqrt(np.maximum(size.max() - size, 0.0))])


def _index(table: pa.Table) -> pa.Table:
    """One row: the graph of a shard as flat arrays."""
    table = table.sort_by([("vec", "ascending"), ("id", "ascending")])
    all_vectors, ids = table.column("vec").to_pylist(), table.column("id").to_pylist()
    first = [i for i in range(len(ids)) if i == 0 or all_vectors[i] != all_vectors[i - 1]]
    order = np.random.default_rng(SEED).permutation(len(first))  # neighbours in value come in any order
    ends = np.array([*first[1:], len(ids)])
    vectors = np.stack([np.frombuffer(all_vectors[first[i]], np.float64) for i in order])
    graph = build(_lifted(vectors))
    copies = [ids[first[i] : ends[i]] for i in order]
    starts = np.cumsum([0, *map(len, copies)]).astype(np.int64)
    return pa.table({
        "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
        "dim": pa.array([vectors.shape[1]], pa.int32()),
        "vectors": pa.array([vectors.tobytes()], pa.binary()),
        "ids": pa.array([np.array([i for c in copies for i in c], np.int64).tobytes()], pa.binary()),
        "starts": pa.array([starts.tobytes()], pa.binary()),
        "links": pa.array([[t.tobytes() for t in graph["links"]]], pa.list_(pa.binary())),
        "entry": pa.array([graph["entry"]], pa.int32()), "layer": pa.array([graph["layer"]], pa.int32()),
    })


def _answers(k: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        for row in table.to_pylist():
            vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
            points = _lifted(vectors)
            ids, starts = (np.frombuffer(row[c], np.int64) for c in ("ids", "starts"))
            links = [
                np.frombuffer(t, np.int32).reshape(len(vectors), -1) for t in row["links"]
            ]
            graph = {"links": links, "entry": row["entry"], "layer": row["layer"]}
            queries = np.stack([np.frombuffer(raw, np.float64) for raw in row["queries"]])
            wide = math.ceil(width * math.sqrt(max(1, len(points) / WIDTH_ROWS)))
            every = nearest(points, graph, np.column_stack([queries, np.zeros(len(queries))]), wide)
            for query_id, query, found in zip(row["query_ids"], queries, every):
                found = found[found >= 0]
                scores = (vectors[found] * query).sum(axis=1)
                order = np.argsort(-scores, kind="stable")
                rows: list[tuple[float, int]] = []
                for s, e in zip((-scores[order]).tolist(), found[order].tolist()):
                    if len(rows) >= k and s > rows[-1][0]:
                        break
                    rows += [(s, int(i)) for i in ids[starts[e] : starts[e + 1]] if i != query_id]
                out += [(query_id, i, -s) for s, i in sorted(rows)[:k]]
        return pa.table({
            "query_id": pa.array([r[0] for r in out], pa.int64()), "vec_id": pa.array([r[1] for r in out], pa.int64()),
            "score": pa.array([r[2] for r in out], pa.float64()),
        })

    return run


def search(
    rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    width: int = SEARCH_WIDTH,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found nearest to each query, nearest first.

    Both tables have ids and vectors; a row is no answer to a query of its own
    id. Ties go to the smaller id; all candidates are returned if there are
    fewer than k. Vectors that are null, zero or hold a null or non-finite
    component, and rows without id, take no part; only vectors of one length
    are compared. Repeated rows with an id and vector count once.
    """
    def valid(df: DataFrame) -> DataFrame:
        named = df.select(F.col(id_col).cast("long").alias("id"), F.lit("").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("v"))
        packed = named.where(F.col("id").isNotNull() & usable(F.col("v"))).mapInArrow(
            _packed, "id long, label string, dim int, vec binary"
        )
        return packed.select("id", "dim", "vec").distinct()

    given = written(valid(rows), "vectors")
    asked = written(valid(queries), "queries")
    width = max(width, 2 * k)
    shards = (
        given.groupBy("dim").agg(F.count("*").alias("n"))
        .withColumn("shards", F.ceil(F.col("n") / SHARD_ROWS).cast("int")).select("dim", "shards")
    )
    shards = written(shards, "shards")
    n_shards = shards.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]

    def tasks(groups: int) -> int:
        """Several partitions a group: a graph is much work for few bytes, and hashes collide."""
        return max(1, min(3 * groups, MOST_TASKS))

    smallest = Window.partitionBy("dim", "vec").orderBy("id")
    indexed = given.withColumn("copy", F.row_number().over(smallest)).where(F.col("copy") <= k + 1)
    dealt = indexed.join(shards, "dim").withColumn(
        "shard", F.pmod(F.xxhash64("vec"), F.col("shards")).cast("int")
    )
    index = written(
        dealt.select("dim", "shard", "id", "vec").repartition(tasks(n_shards), "dim", "shard")
        .groupBy("dim", "shard").applyInArrow(
            _index, "shard int, dim int, vectors binary, ids binary, starts binary, links array<binary>, entry int, layer int"
        ), "index",
    )
    # A block has the index of each shard with it, so there are only as many as keep the cores busy.
    n_asked = asked.count()
    busy = -(-6 * rows.sparkSession.sparkContext.defaultParallelism // max(1, n_shards))
    block_rows = min(QUERY_ROWS, max(LEAST_ROWS, -(-n_asked // busy)))
    blocks = asked.join(
        asked.groupBy("dim").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "dim"
    ).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    blocks = blocks.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "vec")).alias("q")).select(
        "dim", "block", F.col("q.id").alias("query_ids"), F.col("q.vec").alias("queries")
    )
    spread = blocks.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    n_blocks = -(-n_asked // block_rows)
    both = spread.join(index, ["dim", "shard"]).repartition(tasks(n_shards * n_blocks), "dim", "shard", "block")
    found = both.groupBy("dim", "shard", "block").applyInArrow(
        _answers(k, width), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
