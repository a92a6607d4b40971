"""Mixing sources to target weights: Pfair scheduling of source blocks.

Rows of a source are cut into blocks. A source of integer weight w out of a
total of W is due w of every W slots: its block j is released at
floor(j * W / w) and has its deadline at ceil((j + 1) * W / w). Earliest
deadline first gives each slot to a released block, and no source is ever a
whole block ahead of or behind its share. The schedule repeats every W slots,
so it is made once for a period (W is bounded by PERIOD) and applied to any
number of blocks by arithmetic.

When a source runs out, the others go on with their weights among themselves:
a new phase starts. There are at most as many phases as sources, and what the
driver holds is a period for each.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courant.llm.common import written

PERIOD = 10_000  # bound on the sum of the weights
SOURCES = 1_000  # bound on the number of weights given
BLOCK_ROWS = 8
RUN_ROWS = 2_000  # rows of a source ranked by one task at a time, on average


def pfair(weights: Mapping[str, int]) -> list[str]:
    """The source that has each slot of one period."""
    total = sum(weights.values())
    waiting = [(0, name, 0) for name in sorted(weights)]  # release, source, block
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    slots = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, name, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[name]), name, j))
        _, name, j = heapq.heappop(ready)
        slots.append(name)
        if j + 1 < weights[name]:
            heapq.heappush(waiting, ((j + 1) * total // weights[name], name, j + 1))
    return slots


def phases(weights: Mapping[str, int], blocks: Mapping[str, int]) -> list[dict]:
    """Per phase and source: first block, blocks, weight, first slot, period, slots in the period."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    rows, at = [], 0
    while left:
        active = {s: weights[s] for s in left}
        order = pfair(active)
        period = len(order)
        places: dict[str, list[int]] = {s: [] for s in active}
        for i, s in enumerate(order):
            places[s].append(i)

        def slot_of(s: str, k: int) -> int:
            return k // active[s] * period + places[s][k % active[s]]

        length = min(slot_of(s, n - 1) for s, n in left.items()) + 1
        for s in active:
            whole, rest = divmod(length, period)
            taken = whole * active[s] + sum(p < rest for p in places[s])
            rows.append({
                "source": s, "first_block": done[s], "blocks": taken, "weight": active[s],
                "first_slot": at, "period": period, "places": places[s],
            })
            done[s] += taken
            left[s] -= taken
        left = {s: n for s, n in left.items() if n}
        at += length
    return [r for r in rows if r["blocks"]]


def _ranked(rows: DataFrame, order: Column) -> DataFrame:
    """`place`: the place of each row among those of its source in hash order, without a task per source."""
    sizes = rows.groupBy("source").agg(F.count("*").alias("rows"))
    runs = F.ceil(F.col("rows") / RUN_ROWS)
    run = F.floor((F.shiftrightunsigned("hash", 1) / F.lit(float(1 << 63))) * runs)
    cut = rows.join(F.broadcast(sizes), "source").withColumn("run", run).drop("rows")
    counts = cut.groupBy("source", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("source", "run").orderBy("hash", order)
    numbered = cut.withColumn("n", F.row_number().over(inside))
    return numbered.join(counts, ["source", "run"]).withColumn("place", F.col("earlier") + F.col("n") - 1).drop(
        "run", "n", "earlier"
    )


def mix(
    docs: DataFrame, weights: Mapping[str | None, int], id_col: str = "doc_id", source_col: str = "source",
    block_rows: int = BLOCK_ROWS, default: int | None = None,
) -> DataFrame:
    """(doc_id, source, block, slot, position) of every row, with slots by Pfair scheduling.

    `weights` are positive integers by source; a source without one has the
    weight `default`, or is an error. All rows are kept. Rows of a source stand in the
    order of a hash of their id, so the mix is also shuffled; ties of ids go by
    the row's further content, and fully equal rows are interchangeable. A null
    source is a source of its own. `position` is the row's place in the mix:
    slot * block_rows + place in the block (the last block of a source may be
    short, which leaves a gap). Other columns of `docs` only break ties.
    """
    if any(not isinstance(w, int) or w < 1 for w in weights.values()):
        raise ValueError("weights are positive integers")
    name = F.when(F.col(source_col).isNull(), F.lit("0")).otherwise(
        F.concat(F.lit("1"), F.col(source_col).cast("string"))
    )
    rest = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c != id_col])
    rows = docs.select(
        F.col(id_col).alias("doc_id"), name.alias("source"), F.xxhash64(id_col).alias("hash"), rest.alias("rest")
    )
    known = {("0" if s is None else f"1{s}"): w for s, w in weights.items()}
    sizes = rows.groupBy("source").agg(F.count("*").alias("n")).limit(SOURCES + 1).collect()
    if len(sizes) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    missing = [r["source"] for r in sizes if r["source"] not in known]
    if missing and default is None:
        raise ValueError(f"no weight for {sorted(missing)[:5]}")
    known |= dict.fromkeys(missing, default)
    total = sum(known[r["source"]] for r in sizes)
    if total > PERIOD:
        raise ValueError(f"the weights add up to {total}, more than {PERIOD}")
    plan = phases(known, {r["source"]: -(-r["n"] // block_rows) for r in sizes})
    schema = (
        "source string, first_block long, blocks long, weight long, first_slot long, period long, places array<int>"
    )
    spark = docs.sparkSession
    steps = F.broadcast(spark.createDataFrame([tuple(r.values()) for r in plan], schema))
    placed = _ranked(rows, F.struct("doc_id", "rest")).withColumn(
        "block", F.floor(F.col("place") / block_rows).cast("long")
    )
    k = F.col("block") - F.col("first_block")
    found = placed.join(steps, "source").where("block >= first_block AND block < first_block + blocks").withColumn(
        "slot",
        F.col("first_slot") + F.floor(k / F.col("weight")) * F.col("period")
        + F.get("places", (k % F.col("weight")).cast("int")),
    )
    return found.select(
        "doc_id", F.expr("if(source = '0', null, substring(source, 2))").alias("source"),
        "block", F.col("slot").cast("long").alias("slot"),
        (F.col("slot") * block_rows + F.col("place") % block_rows).cast("long").alias("position"),
        "rest",
    )


def mixed(docs: DataFrame, weights: Mapping[str | None, int], id_col: str = "doc_id",
          source_col: str = "source", block_rows: int = BLOCK_ROWS, default: int | None = None) -> DataFrame:
    """All rows of `docs`, sorted by their position in the mix across partitions."""
    place = written(mix(docs, weights, id_col, source_col, block_rows, default).select(
        F.col("doc_id").alias("id_"), F.col("rest").alias("rest_"), "position"
    ).dropDuplicates(["id_", "rest_"]), "mix")
    rest = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c != id_col])
    rows = docs.withColumn("rest_", rest)
    joined = rows.join(place, rows[id_col].eqNullSafe(place["id_"]) & (rows["rest_"] == place["rest_"]))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = joined.select(*[joined[f"`{c}`"] for c in docs.columns], "position")
    return order.repartitionByRange(parts, "position").sortWithinPartitions("position").drop("position")
