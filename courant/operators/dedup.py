"""Deduplication that keeps the earliest row of each group of copies.

The rule is greedy: going through the rows in input order, a row is kept unless
a row already kept is similar enough. `keep_first` computes it without walking
the rows one by one and without pairing all members of a group:

- rows that can be similar share a bucket, and only rows of a bucket are compared;
- in a short bucket all are compared, in a long one each with its *head*, the first rows;
- a row that is in the head of all its buckets knows all its earlier
  neighbours, so its fate can be settled; what it rules out drops out;
- the rest goes into the next round, with shorter buckets.

The head of a long bucket starts small, so a bucket full of copies shrinks to a
few rows cheaply in the first round, and grows from round to round, so that a
bucket of unlike rows is done in few. Long buckets are sliced over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courant.functions.urls import let
from courant.operators.topk import top_per_group
from courant.session import checkpointed, small_side
from courant.sources.tables import first_per_key

Similar = Callable[[DataFrame, DataFrame], DataFrame]

THRESHOLD = 0.85
# Buckets up to SHORT_ROWS are compared in full. The head of a longer one starts
# at FIRST_HEAD_ROWS and grows by HEAD_GROWTH a round, up to HEAD_ROWS.
SHORT_ROWS, FIRST_HEAD_ROWS, HEAD_GROWTH, HEAD_ROWS = 32, 4, 8, 256
SLICE_ROWS, RING_GROWTH = 1024, 64
# Buckets of titles and vectors are rarely long, so more of them is compared at once.
FULL_ROWS, RING_ROWS = 1024, 8192
# Unlike vectors stay in their bucket and every round sends all that is left once more, so heads and slices are several such buckets.
RING_HEADS, RING_SLICES = 8, 2
# Every round compares the short buckets of open titles again, so their heads are small once, against copies, then full.
TITLE_GROWTH = 256
GRAM_CHARS = 3
BITMAP_WORDS = 4
# A set that fills its bitmap looks like any other: candidates are compared by a wide one before their grams are.
WIDE_WORDS = 32
# Grams are ordered by how often grams of their cell occur; the counts of all cells are one small value.
GRAM_CELLS = 1 << 15
# Vectors are cut into cells around PIVOTS vectors, chosen among PIVOT_SAMPLE; angles are rounded by less than ANGLE_SLACK.
PIVOTS, PIVOT_SAMPLE, ANGLE_SLACK = 16, 512, 1e-6
# Blocking by signs instead, where a chance to miss a pair is allowed.
BITS, MAX_BANDS = 12, 256


def dedup_exact(
    df: DataFrame, order: Sequence[str], title: str = "title", within: Sequence[str] = ()
) -> DataFrame:
    """The first row of each title, in the given order."""
    return first_per_key(df, [*within, title], order).select(*df.columns)


def _shared_buckets(entries: DataFrame) -> DataFrame:
    """Entries whose bucket has another member, with the bucket's size."""
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return entries.drop("n").join(sizes, "bucket")


def _ends(big: DataFrame, head_rows: int) -> DataFrame:
    """The last of the first `head_rows` rows of each bucket; found without what the rows carry."""
    first = top_per_group(big.select("bucket", "ord"), ["bucket"], [F.asc("ord")], spread=["ord"], limit=head_rows)
    return first.groupBy(F.col("bucket").alias("_bucket")).agg(F.max("ord").alias("_end"))


def _edges(
    entries: DataFrame, head: DataFrame, similar: Similar, leads: Callable[[Column], Column], slice_rows: int
) -> DataFrame:
    """(first, later) for each entry and each similar earlier head row of its bucket that leads there.

    Long buckets are cut into slices, each with a copy of the (short) head;
    `similar` gives the pairs of slices and heads, which share bucket and slice.
    """
    slices = F.ceil(F.col("n") / slice_rows)
    left = entries.select(
        "bucket", F.pmod(F.xxhash64("ord"), slices).alias("slice"), "n",
        F.col("ord").alias("later"), F.col("payload").alias("_b"),
    )
    right = head.where(leads(F.col("payload"))).select(
        "bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1)).alias("slice"), "n",
        F.col("ord").alias("first"), F.col("payload").alias("_a"),
    )
    return similar(left.drop("n"), right.drop("n")).distinct()


def joined_where(alike: Callable[[Column, Column], Column]) -> Similar:
    """Pairs by a join that compares, so that those that fail are never rows."""

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.withColumnsRenamed({"bucket": "_bucket", "slice": "_slice"})
        same = (F.col("bucket") == F.col("_bucket")) & (F.col("slice") == F.col("_slice"))
        return left.join(
            other, same & (F.col("first") < F.col("later")) & alike(F.col("_a"), F.col("_b"))
        ).select("first", "later")

    return pairs


def _settle(edges: DataFrame, unready: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
    """Rows ruled out by rows that are certain to stay, and the edges still open."""
    live, dropped = edges, []
    while not live.isEmpty():
        free = live.select(F.col("first").alias("ord")).distinct().join(
            live.select(F.col("later").alias("ord")), "ord", "left_anti"
        )
        if unready is not None:
            free = free.join(unready, "ord", "left_anti")
        gone = checkpointed(
            live.join(free.withColumnRenamed("ord", "first"), "first", "left_semi")
            .select(F.col("later").alias("ord")).distinct()
        )
        if gone.isEmpty():
            break
        dropped.append(gone)
        live = checkpointed(
            live.join(gone.withColumnRenamed("ord", "first"), "first", "left_anti")
            .join(gone.withColumnRenamed("ord", "later"), "later", "left_anti")
        )
    return (reduce(DataFrame.unionByName, dropped) if dropped else None), live


def keep_first(
    nodes: DataFrame,
    buckets: DataFrame,
    similar: Similar,
    short_rows: int = SHORT_ROWS,
    head_rows: int = HEAD_ROWS,
    verify: Callable[[DataFrame], DataFrame] | None = None,
    leads: Callable[[Column], Column] = lambda payload: F.lit(True),
    slice_rows: int = SLICE_ROWS,
    growth: int = HEAD_GROWTH,
) -> DataFrame:
    """The `ord` of the rows that are dropped.

    `nodes` has `ord` (unique, sortable: the input order) and `payload` (what
    `similar` compares); `buckets` has (bucket, ord), one row per bucket a node
    is in, and may have `there`, what `similar` is told of the node in that bucket beside its payload.
    Where the payload is only a sketch, `verify` keeps the truly similar of the (first, later) pairs found.
    `leads` says of a payload whether the row is compared as the first of a pair in that bucket.
    """
    all_dropped = [nodes.select("ord").limit(0)]
    # Most rows share no bucket with any other; only the rest carry their payload on.
    entries = _shared_buckets(buckets).join(nodes.select("ord", "payload"), "ord")
    if "there" in buckets.columns:
        entries = entries.withColumn("payload", F.struct("payload.*", "there.*")).drop("there")
    entries = checkpointed(entries)
    size = FIRST_HEAD_ROWS
    while not entries.isEmpty():
        size = min(size, head_rows)
        short = max(short_rows, size)
        big = entries.where(F.col("n") > short)
        ends = checkpointed(_ends(big, size))
        placed = big.join(small_side(ends), F.col("bucket") == F.col("_bucket")).drop("_bucket")
        head = entries.where(F.col("n") <= short).unionByName(placed.where(F.col("ord") <= F.col("_end")).drop("_end"))
        found = _edges(entries, head, similar, leads, slice_rows)
        edges = checkpointed(verify(found) if verify else found)
        unready = None
        if not ends.isEmpty():
            unready = checkpointed(placed.where(F.col("ord") > F.col("_end")).select("ord").distinct())
        gone, live = _settle(edges, unready)
        if gone is not None:
            all_dropped.append(gone)
        if unready is None:
            break
        open_rows = unready.unionByName(live.select(F.col("later").alias("ord"))).distinct()
        if gone is not None:
            open_rows = open_rows.join(gone, "ord", "left_anti")
        entries = checkpointed(_shared_buckets(entries.join(open_rows, "ord", "left_semi")))
        size *= growth
    return reduce(DataFrame.unionByName, all_dropped)


# --- titles: exact Jaccard join on character grams -------------------------------


def grams(title: Column, size: int = GRAM_CHARS) -> Column:
    """The set of hashed character grams of a title; a short title is its own gram.

    The characters are put in an array first: finding the i-th one in a text
    means walking there, which takes the square of a title's length for all of them.
    """

    def of_chars(chars: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(chars) - size)
        return F.transform(starts, lambda i: F.xxhash64(F.concat(*[F.get(chars, i + k) for k in range(size)])))

    def of_text(low: Column) -> Column:
        return F.when(F.coalesce(F.length(low), F.lit(0)) < size, F.array(F.xxhash64(low))).otherwise(let(F.split(low, ""), of_chars))

    return F.array_distinct(let(F.lower(title), of_text))


def jaccard_at_least(a: Column, b: Column, threshold: float) -> Column:
    close = F.least(F.size(a), F.size(b)) >= threshold * F.greatest(F.size(a), F.size(b))
    enough = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n) >= threshold)
    return close & enough


def gram_prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(scope, ord, gram, pos): the grams of each set that any similar set must meet.

    Two sets with a Jaccard similarity of at least t share one of the first
    n - ceil(t * n) + 1 members of either, in any one order. The order is that of
    the counts of cells of grams, so that mostly rare grams come first; the
    counts are a value of GRAM_CELLS numbers, and no gram is shuffled for it.
    """
    cell = lambda g: F.pmod(g, F.lit(GRAM_CELLS)).cast("int")
    counts = sets.select(F.explode("payload").alias("gram")).groupBy(cell(F.col("gram")).alias("cell")).agg(
        F.count("*").alias("n"))
    every = sets.sparkSession.range(GRAM_CELLS).select(F.col("id").cast("int").alias("cell"))
    often = every.join(counts, "cell", "left").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("cell", F.coalesce("n", F.lit(0)).alias("n")))), lambda c: c["n"]))
    n = F.size("payload")
    taken = (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")
    ordered = F.sort_array(F.transform("payload", lambda g: F.struct(F.get(F.col("often"), cell(g)).alias("n"), g.alias("gram"))))
    return (
        sets.withColumn("often", often.scalar())
        .select("scope", "ord", F.posexplode(F.slice(ordered, F.lit(1), taken)).alias("pos", "g"))
        .select("scope", "ord", "g.gram", "pos")
    )


def gram_bits(sets: Column) -> Column:
    """A bitmap of a gram set, as four words."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def word(i: int) -> Column:
        bit = lambda g: F.call_function("shiftleft", one, F.pmod(g, F.lit(64)).cast("int"))
        mine = lambda g: F.pmod(F.shiftright(g, 6), F.lit(BITMAP_WORDS)) == i
        return F.aggregate(sets, none, lambda s, g: F.when(mine(g), s.bitwiseOR(bit(g))).otherwise(s))

    return F.array(*[word(i) for i in range(BITMAP_WORDS)])


def wide_bits(sets: Column) -> Column:
    """A bitmap of a gram set, as WIDE_WORDS words."""

    @F.pandas_udf("array<bigint>")
    def words(batch: pd.Series) -> pd.Series:
        found = []
        for grams_ in batch:
            bits = np.zeros(WIDE_WORDS * 64, np.uint8)
            bits[grams_ % len(bits)] = 1
            found.append(np.packbits(bits).view(np.int64))
        return pd.Series(found, dtype=object)

    return words(sets)


def may_be_similar(a: Column, b: Column, threshold: float, words: int = BITMAP_WORDS) -> Column:
    """False only for sets that differ too much: each unequal bit is an unequal gram."""
    if words > BITMAP_WORDS:  # one expression a word would be a method too long to be compiled
        differing = F.zip_with(a["bits"], b["bits"], lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        unequal = F.aggregate(differing, F.lit(0), lambda s, n: s + n)
    else:
        unequal = reduce(
            lambda s, i: s + F.bit_count(a["bits"][i].bitwiseXOR(b["bits"][i])), range(words), F.lit(0)
        )
    return unequal <= (a["size"] + b["size"]) * ((1 - threshold) / (1 + threshold)) + F.lit(1e-6)


def dedup_titles(
    df: DataFrame,
    order: Sequence[str],
    title: str = "title",
    within: Sequence[str] = (),
    threshold: float = THRESHOLD,
    short_rows: int = FULL_ROWS,
    head_rows: int = FULL_ROWS,
) -> DataFrame:
    """Near-duplicate titles removed by the overlap of their character grams; exact."""
    once = checkpointed(dedup_exact(df, order, title, within))
    scope = F.xxhash64(*within) if within else F.lit(0).cast("bigint")
    sets = checkpointed(
        once.select(F.struct(*order).alias("ord"), scope.alias("scope"), grams(F.col(title)).alias("payload"))
    )
    buckets = gram_prefixes(sets, threshold).select(
        F.xxhash64("scope", "gram").alias("bucket"), "ord", F.struct("pos").alias("there"))
    sketch = F.struct("scope", F.size("payload").alias("size"), gram_bits(F.col("payload")).alias("bits"))
    first = sets.select(F.col("ord").alias("first"), F.col("payload").alias("_a"))
    later = sets.select(F.col("ord").alias("later"), F.col("payload").alias("_b"))
    wide = checkpointed(sets.select(
        "ord", F.struct(F.size("payload").alias("size"), wide_bits(F.col("payload")).alias("bits")).alias("wide")))

    def similar(a: Column, b: Column) -> Column:
        # Sizes, then what both can still share from here on, then the bitmaps.
        near = F.least(a["size"], b["size"]) >= threshold * F.greatest(a["size"], b["size"]) - 1e-9
        left = F.least(a["size"] - a["pos"], b["size"] - b["pos"])
        enough = left >= (a["size"] + b["size"]) * (threshold / (1 + threshold)) - 1e-6
        return near & enough & (a["scope"] == b["scope"]) & may_be_similar(a, b, threshold)

    def verify(pairs: DataFrame) -> DataFrame:
        alike = jaccard_at_least(F.col("_a"), F.col("_b"), threshold)
        sketches = [wide.select(F.col("ord").alias(end), F.col("wide").alias(f"_{end}")) for end in ("first", "later")]
        likely = pairs.join(sketches[0], "first").join(sketches[1], "later").where(
            may_be_similar(F.col("_first"), F.col("_later"), threshold, WIDE_WORDS))
        return likely.select("first", "later").join(first, "first").join(later, "later").where(alike).select("first", "later")

    nodes = sets.select("ord", sketch.alias("payload"))
    dropped = keep_first(nodes, buckets, joined_where(similar), short_rows, head_rows, verify=verify, growth=TITLE_GROWTH)
    return _without(once, dropped, order)


def _without(df: DataFrame, dropped: DataFrame, order: Sequence[str]) -> DataFrame:
    keys = dropped.select(*[F.col("ord")[c].alias(c) for c in order])
    return df.join(small_side(keys), list(order), "left_anti")


# --- vectors: cosine similarity ----------------------------------------------------


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector can be compared: of the right length, finite and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vector: Column) -> Column:
    doubles = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(doubles, lambda x: F.try_divide(x, norm))


def close_pairs(threshold: float, dim: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """(first, later) of slices and heads whose vectors are close, block by block in double precision.

    A group is one slice of a bucket with the bucket's head, so its size is bounded
    whatever the bucket holds.
    """

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        late, early = left.column("later").combine_chunks(), right.column("first").combine_chunks()
        b, a = left.column("_b").combine_chunks(), right.column("_a").combine_chunks()
        vectors = [np.asarray(p.field("v").flatten()).reshape(-1, dim) for p in (a, b)]
        found = [np.zeros((2, 0), np.int64)]
        for i in range(0, len(a), SLICE_ROWS):
            for j in range(0, len(b), SLICE_ROWS):
                near = vectors[0][i : i + SLICE_ROWS] @ vectors[1][j : j + SLICE_ROWS].T >= threshold
                found.append(np.stack(np.nonzero(near)) + np.array([[i], [j]]))
        x, y = np.concatenate(found, axis=1)
        keep = np.ones(len(x), bool)
        here = [f.name for f in a.type if f.name not in ("v", "own", "home")]
        for name in here:  # what the bucket stands for, should two have one hash
            keep &= np.asarray(a.field(name))[x] == np.asarray(b.field(name))[y]
        if "own" in [f.name for f in a.type]:
            own = [np.asarray(p.field("own").cast(pa.int8())).astype(bool) for p in (a, b)]
            keep &= own[0][x] | own[1][y]
        x, y = x[keep], y[keep]
        parts = [pa.concat_arrays([early.field(k), late.field(k)]) for k in range(early.type.num_fields)]
        both = pa.table(parts, names=[str(k) for k in range(len(parts))])
        rank = np.empty(both.num_rows, np.int64)
        rank[np.asarray(pc.sort_indices(both, [(n, "ascending") for n in both.column_names], null_placement="at_start"))] = (
            np.arange(both.num_rows))
        before = rank[x] < rank[y + len(a)]
        x, y = pa.array(x[before]), pa.array(y[before])
        pairs = pa.table([early.take(x), late.take(y)], names=["first", "later"])
        same = [pc.fill_null(pc.equal(early.field(k).take(x), late.field(k).take(y)), False) for k in range(early.type.num_fields)]
        return pairs.filter(pc.invert(reduce(pc.and_, same)))

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        schema = T.StructType([
            T.StructField("first", right.schema["first"].dataType), T.StructField("later", left.schema["later"].dataType)])
        keys = ["bucket", "slice"]
        other = right.toDF(*right.columns)  # columns of its own, where both sides come from one table
        return left.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInArrow(compare, schema)

    return pairs


def choose_bands(threshold: float, max_miss: float) -> int | None:
    """How many bands of BITS signs miss a pair at the threshold with at most `max_miss`.

    Two vectors at the threshold agree on one random hyperplane with
    probability p; all bands miss them with probability (1 - p^BITS)^bands.
    The answer depends on the threshold alone; None is more than MAX_BANDS.
    """
    p = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    agree = p**BITS
    bands = 1 if agree >= 1 else math.ceil(math.log(max_miss) / math.log1p(-agree))
    return bands if bands <= MAX_BANDS else None


def sign_buckets(vector: Column, dim: int, bands: int, seed: int = 7) -> Column:
    """Bucket keys of a vector: per band, the signs against BITS random hyperplanes."""
    planes = np.random.default_rng(seed).standard_normal((bands * BITS, dim))
    weights = 2 ** np.arange(BITS, dtype=np.int64)

    @F.pandas_udf("array<bigint>")
    def keys(batch: pd.Series) -> pd.Series:
        found = []
        for at in range(0, len(batch), SLICE_ROWS):  # bounds what one step holds
            signs = (np.stack(batch.iloc[at : at + SLICE_ROWS].to_numpy()) @ planes.T > 0).reshape(-1, bands, BITS)
            found += list(signs @ weights + (np.arange(bands, dtype=np.int64) << BITS))
        return pd.Series(found, dtype=object)

    return keys(vector)


def choose_pivots(units: DataFrame, dim: int, theta: float) -> np.ndarray:
    """At most PIVOTS vectors far from each other, out of a sample of PIVOT_SAMPLE by hash.

    As many as make least of the cells a vector visits times the pairs compared,
    both in the sample: one, where vectors are spread so that cells tell nothing
    apart. The choice decides how much is compared, never what is found.
    """
    rows = units.select("v").orderBy(F.xxhash64("v"), "v").limit(PIVOT_SAMPLE).collect()
    sample = np.array([r["v"] for r in rows]).reshape(-1, dim)
    chosen, nearest = [], np.full(len(sample), np.inf)
    while len(chosen) < min(PIVOTS, len(sample)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.arccos(np.clip(sample @ sample[chosen[-1]], -1, 1)))
        if not nearest.max() > ANGLE_SLACK:
            break
    angles = np.arccos(np.clip(sample @ sample[chosen].T, -1, 1))

    def cost(count: int) -> float:
        here = angles[:, :count]
        visits = here <= here.min(axis=1, keepdims=True) + 2 * theta
        home = np.bincount(here.argmin(axis=1), minlength=count)
        return visits.sum() * float(home @ visits.sum(axis=0))

    best = min(range(1, len(chosen) + 1), key=cost) if chosen else 0
    return sample[chosen[:best]]


def angles_to(vector: Column, pivots: np.ndarray) -> Column:
    @F.pandas_udf("array<double>")
    def angles(batch: pd.Series) -> pd.Series:
        found = []
        for at in range(0, len(batch), SLICE_ROWS):
            found += list(np.arccos(np.clip(np.stack(batch.iloc[at : at + SLICE_ROWS].to_numpy()) @ pivots.T, -1, 1)))
        return pd.Series(found, dtype=object)

    return angles(vector)


def ring_buckets(nodes: DataFrame, theta: float) -> DataFrame:
    """(bucket, ord, there): cells of pivots, cut into rings, such that all vectors within `theta` meet.

    A vector is at home with its nearest pivot and visits any other that is at
    most 2 theta further: whoever is within theta of it is then in its home
    cell, by the triangle inequality. Inside a cell angles to the pivot differ by
    theta at most, so neighbouring rings of that width are enough.
    """
    angles = F.col("angles")
    cells = nodes.select(
        "ord", "scope", F.array_min(angles).alias("nearest"), F.posexplode(angles).alias("cell", "angle")
    ).where(F.col("angle") <= F.col("nearest") + 2 * theta)
    ring = F.floor(F.col("angle") / theta)
    return cells.select(
        "ord", "scope", "cell", (F.col("angle") == F.col("nearest")).alias("home"), ring.alias("ring"),
        F.explode(F.array(ring, ring + 1)).alias("shown"),
    ).select(
        F.xxhash64("scope", "cell", "shown").alias("bucket"), "ord",
        F.struct("home", "cell", (F.col("ring") == F.col("shown")).alias("own"), "shown").alias("there"),
    )


def dedup_vectors(
    df: DataFrame,
    order: Sequence[str],
    dim: int,
    vector: str = "vector",
    within: Sequence[str] = (),
    threshold: float = THRESHOLD,
    short_rows: int = RING_ROWS,
    head_rows: int = RING_HEADS * RING_ROWS,
    max_miss: float = 0.0,
) -> DataFrame:
    """Rows left after removing those whose vector is close to a kept earlier one.

    Exact at any threshold: pivots and the triangle inequality leave out only
    pairs that cannot be close. What they save depends on how the vectors lie; where
    a chance of `max_miss` to miss a pair at the threshold is allowed, buckets
    of signs, whose size does not depend on that, take their place if they can keep it.

    Rows whose vector is null, zero, of another length or not finite are kept
    and rule nothing out.
    """
    scope = F.xxhash64(*within) if within else F.lit(0).cast("bigint")
    fit = df.where(usable(F.col(vector), dim)).select(
        F.struct(*order).alias("ord"), scope.alias("scope"), unit(F.col(vector)).alias("v"))
    bands = choose_bands(threshold, max_miss) if max_miss > 0 else None
    if bands is not None:
        nodes = checkpointed(fit.select("ord", F.struct("scope", "v").alias("payload")))
        keys = sign_buckets(F.col("payload.v"), dim, bands)
        buckets = nodes.select("ord", "payload.scope", F.explode(keys).alias("_key")).select(
            F.xxhash64("scope", "_key").alias("bucket"), "ord"
        )

        return _without(df, keep_first(nodes, buckets, close_pairs(threshold, dim), short_rows, head_rows), order)

    fit = checkpointed(fit)
    theta = math.acos(max(-1.0, min(1.0, threshold))) + ANGLE_SLACK
    pivots = choose_pivots(fit, dim, theta)
    if not len(pivots):
        return df
    nodes = checkpointed(fit.withColumn("angles", angles_to(F.col("v"), pivots)))
    buckets = ring_buckets(nodes, theta)
    nodes = nodes.select("ord", F.struct("scope", "v").alias("payload"))
    # Of all cells and rings that two vectors share, the first one's home and the outer ring is theirs.
    dropped = keep_first(
        nodes, buckets, close_pairs(threshold, dim), short_rows, head_rows,
        leads=lambda payload: payload["home"], slice_rows=RING_SLICES * RING_ROWS, growth=RING_GROWTH)
    return _without(df, dropped, order)


def dedup_with_fallback(
    df: DataFrame,
    order: Sequence[str],
    dim: int,
    vector: str = "vector",
    title: str = "title",
    within: Sequence[str] = (),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per title; rows that have a vector also lose their near copies."""
    once = checkpointed(dedup_exact(df, order, title, within))
    known = usable(F.col(vector), dim)
    near = dedup_vectors(once.where(known), order, dim, vector, within, threshold)
    return near.unionByName(once.where(~known))
