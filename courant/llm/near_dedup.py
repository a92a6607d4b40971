"""Near duplicates by word shingles: b-bit MinHash signatures and a multi-index Hamming join.

A signature has `chunks` x 4 symbols of 16 bits. Two signatures at a distance of
at most `2 * chunks - 1` symbols agree, by pigeonhole, in some chunk up to one
symbol; so each chunk is indexed with every one of its symbols left out, and
all such pairs meet in a bucket. `chunks_for` takes as many chunks as hold the
chance of missing a pair at the threshold below MISS.

A bucket is never paired with itself as a whole. Its smallest and its largest id
are compared with every member. What is not yet in one component is compared
once more, where two members of a bucket share one of their rarest shingles.

Before a pair is confirmed on the full shingle sets of its texts, their parity
bitmaps must allow it: every shingle turns one of BITS bits over, so two bitmaps
differ in at most as many bits as the sets in members, and a pair whose bitmaps
differ in more than a link may have cannot be one. No link is lost by that,
whatever the sizes, and families of copies that each were changed too much to be
links are never confirmed pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courant.llm.common import U64, WordHashes, mix, written
from courant.llm.components import components

SYMBOLS = 4  # of 16 bits, in a chunk; one of them may differ
MISS = 1e-7  # bound on the chance that a pair at the threshold meets in no bucket
SLAB = 1 << 18  # shingles hashed at a time
BITS = 2048  # of a parity bitmap, a power of two
_RANDOM = np.random.default_rng(20240501)
_PLACES = _RANDOM.integers(1, 1 << 63, 64, dtype=U64) * U64(2) + U64(1)
_XORS = _RANDOM.integers(0, 1 << 63, 256, dtype=U64)
_FACTORS = _RANDOM.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)


def chunks_for(threshold: float) -> int:
    """Chunks needed so that a pair at the threshold is missed with a chance below MISS."""
    p = float(threshold)
    fails = 1 - p**SYMBOLS - SYMBOLS * (1 - p) * p ** (SYMBOLS - 1)
    chunks = max(2, math.ceil(math.log(MISS) / math.log(fails))) if fails > 0 else 2
    if chunks * SYMBOLS > len(_XORS):
        raise ValueError(f"threshold {threshold} is too low to be indexed")
    return chunks


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of `size` consecutive words (all, if fewer), sorted; none without words."""
    if not len(words):
        return words
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, U64)
    for i in range(width):
        total += words[i : i + len(total)] * _PLACES[i]
    return np.unique(mix(total))


def _sets(size: int):
    hashes = WordHashes()

    def of(text: bytes | None) -> np.ndarray:
        return shingles(hashes.of((text or b"").lower().split()), size)

    return of


def signatures(sets: list[np.ndarray], symbols: int) -> np.ndarray:
    """Symbols of each non-empty set: 16 mixed bits of its smallest value under each hash."""
    out = np.zeros((len(sets), symbols), U64)
    start = 0
    while start < len(sets):
        stop, held = start, 0
        while stop < len(sets) and (stop == start or held + len(sets[stop]) <= SLAB):
            held += len(sets[stop])
            stop += 1
        flat = np.concatenate(sets[start:stop])
        starts = np.cumsum([0, *[len(s) for s in sets[start : stop - 1]]])
        for k in range(symbols):
            out[start:stop, k] = np.minimum.reduceat((flat ^ _XORS[k]) * _FACTORS[k], starts)
        start = stop
    return (mix(out) >> U64(48)).astype(np.uint16)


def parity(items: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set, as 64-bit words: which bits an odd number of members fall on."""
    places = (items * U64(0x9E3779B97F4A7C15)) >> U64(65 - BITS.bit_length())
    odd = np.bincount(places.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def unequal_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """Bucket keys of each row: every chunk with every one of its symbols left out."""
    rows, symbols = signature.shape
    wide, keys = signature.astype(np.int64), []
    for chunk in range(0, symbols, SYMBOLS):
        for left_out in range(SYMBOLS):
            key = np.full(rows, chunk + left_out, np.int64)
            for i in range(SYMBOLS):
                if i != left_out:
                    key = (key << 16) | wide[:, chunk + i]
            keys.append(key)
    return np.stack(keys, axis=1)


def _sketch(size: int, symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _sets(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [of(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                signs: list = [None] * len(sets)
                keys: list = [None] * len(sets)
                bits: list = [None] * len(sets)
                for i, row in zip(full, signatures([sets[i] for i in full], symbols)):
                    signs[i] = row.tobytes()
                    keys[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    bits[i] = parity(sets[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.binary()), pa.array(signs, pa.binary()), pa.array(bits, pa.list_(pa.int64())),
                    ],
                    ["id", "n", "set_key", "sign", "bits"],
                )

    return run


def _keys(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16)
                keys = chunk_keys(signs.reshape(-1, symbols))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1])),
                        pa.array(keys.ravel()),
                    ],
                    ["id", "key"],
                )

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _sets(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [of(t).tobytes() for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["id", "items"])

    return run


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each member of a set."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [np.frombuffer(s, np.int64) for s in part.column(1).to_pylist()]
            ids = np.repeat(part.column(0).to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets))], ["id", "item"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of the intersection of two sorted sets and of either, row by row."""
    for batch in batches:
        counts = []
        for x, y in zip(batch.column(2), batch.column(3)):
            left, right = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
            counts.append((len(np.intersect1d(left, right, True)), len(left), len(right)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1)] + [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)],
            ["a", "b", "common", "na", "nb"],
        )


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, na, nb) of each pair, from the full sets of the two texts."""
    first = sets.select(F.col("id").alias("a"), F.col("items").alias("left"))
    second = sets.select(F.col("id").alias("b"), F.col("items").alias("right"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "left", "right")
    return both.mapInArrow(_common, "a long, b long, common long, na long, nb long")


def _share_prefix(sets: DataFrame, nodes: DataFrame, limit: Fraction) -> DataFrame:
    """Pairs of nodes in different components that share a shingle among their rarest ones.

    Of two sets with a Jaccard similarity of at least `limit`, the first
    n - ceil(limit * n) + 1 members in one common order always meet. With the
    rarest first, copies that each were changed a lot have prefixes of their own.
    """
    wanted = sets.join(nodes.select("id"), "id", "left_semi").select("id", "items")
    items = written(wanted.mapInArrow(_items, "id long, item long"), "items")
    ranks = items.join(items.groupBy("item").agg(F.count("*").alias("docs")), "item")
    rarest = ranks.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("docs", "item"))).alias("items"))
    prefix = (
        rarest.join(nodes.select("id", "component", "n"), "id")
        .withColumn("taken", F.expr(
            f"cast(n - (n * {limit.numerator} + {limit.denominator - 1}) div {limit.denominator} + 1 as int)"
        ))
        .select("id", "component", "n", F.posexplode(F.slice("items", F.lit(1), F.col("taken"))))
        .where("col.docs > 1")
        .select("id", "component", "n", (F.col("n") - F.col("pos")).alias("left"), F.col("col.item").alias("item"))
    )
    prefix = written(prefix, "prefix")  # both sides of the join below read it
    x, y = (
        prefix.select("item", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "component", "n", "left")])
        for side in "ab"
    )
    # What can still be shared from the first common member on; a later one leaves less.
    room = f"least(left_a, left_b) * {limit.numerator + limit.denominator} >= (n_a + n_b) * {limit.numerator}"
    return (
        x.join(y, "item").where("id_a < id_b AND component_a <> component_b").where(room)
        .select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.col("n_a").alias("na"), F.col("n_b").alias("nb"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = 0.8, size: int = 5,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id and kept.

    Two texts are linked where the Jaccard similarity of their sets of `size`
    consecutive words (lower-cased A-Z, split at ASCII white space) is at least
    `threshold`; component_id is the smallest id reachable by links, kept marks
    it. Fewer words than `size` make one shingle; a null or wordless text has
    none and is linked with nothing. Rows that share an id count as one
    document. A row without id is linked with nothing, has no component and is
    kept. Other columns of `docs` are not looked at.
    """
    limit = Fraction(str(threshold))
    chunks = chunks_for(threshold)
    symbols = chunks * SYMBOLS
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = written(
        texts.mapInArrow(_sketch(size, symbols), "id long, n long, set_key binary, sign binary, bits array<long>"),
        "sketch",
    )
    full = sketch.where("id IS NOT NULL AND n > 0")
    classes = written(full.groupBy("set_key").agg(F.min("id").alias("id"), F.min("sign").alias("sign"),
                                                  F.min("n").alias("n"), F.min("bits").alias("bits")), "classes")
    entries = classes.select("id", "sign").mapInArrow(_keys(symbols), "id long, key long")
    heads = entries.groupBy("key").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("held")
    ).where("low < high")
    members = written(entries.join(heads, "key"), "members")
    length = f"least(na, nb) * {limit.denominator} >= greatest(na, nb) * {limit.numerator}"
    facts = classes.select("id", "n", "bits")
    # A link leaves at most (na + nb) * (1 - limit) / (1 + limit) members that are not common.
    close = unequal_bits(F.col("bits_a"), F.col("bits_b")) * (limit.denominator + limit.numerator) <= (
        F.col("na") + F.col("nb")) * (limit.denominator - limit.numerator)

    def may_link(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(facts.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a")), "a")
            .join(facts.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b")), "b")
            .where(length).where(close).select("a", "b")
        )

    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.where(f"common * {limit.denominator} >= (na + nb - common) * {limit.numerator}")

    with_head = members.select(F.explode(F.array("low", "high")).alias("a"), F.col("id").alias("b"))
    ids = members.select("id").distinct()
    sets = written(
        texts.join(ids, "id", "left_semi").mapInArrow(_full_sets(size), "id long, items binary"), "sets"
    )
    first = may_link(
        with_head.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    first = written(first, "first")
    found = written(linked(_compared(first, sets)).select("a", "b"), "found")
    label = components(found)
    # Buckets whose members are not in one component yet.
    placed = members.where("held > 2").join(label, "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    open_keys = placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
    placed = placed.join(open_keys.where("c1 < c2").select("key"), "key", "left_semi")
    nodes = written(
        placed.groupBy("id").agg(F.min("component").alias("component"), F.collect_list("key").alias("keys"))
        .join(facts, "id"), "open",
    )
    rest = _share_prefix(sets, nodes, limit).where(length)
    for side in "ab":
        rest = rest.join(nodes.select(
            F.col("id").alias(side), F.col("keys").alias(f"keys_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    rest = rest.where(close).where(F.arrays_overlap("keys_a", "keys_b")).select("a", "b").join(
        first, ["a", "b"], "left_anti"
    )
    more = written(linked(_compared(written(rest, "rest"), sets)).select("a", "b"), "more")
    if not more.isEmpty():
        label = components(found.unionByName(more))
    placed = written(
        classes.join(label, "id", "left")
        .select("set_key", F.coalesce("component", "id").alias("component")), "class-components",
    )
    return (
        sketch.join(placed, "set_key", "left")
        .withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
        .select(
            F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
            F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )
