import random

import numpy as np
import pytest
from llm_helpers import COLUMNS, corpus, near_components

from courant.llm import near_dedup as N
from courant.llm.components import components


@pytest.mark.parametrize("threshold, num, den", [(0.85, 85, 100), (0.8, 4, 5), (0.6, 3, 5)])
def test_like_brute_force(spark, threshold, num, den):
    rows = corpus(1, 150)
    want, sizes = near_components([(r[0], r[1]) for r in rows], num, den)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = {r.doc_id: r for r in N.near_duplicates(df, threshold=threshold).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_many_near_copies_with_chains(spark):
    """Copies of copies: members of one bucket that only other members link."""
    rnd = random.Random(4)
    texts = [[f"w{i}" for i in range(90)]]
    for _ in range(160):
        words = list(texts[max(0, len(texts) - 1 - rnd.randrange(12))])
        for _ in range(rnd.randrange(1, 3)):
            words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
        texts.append(words)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want, _ = near_components(rows, 17, 20)
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.85)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, "a b c d e f", 1), (5, "a b c d e f", 2), (5, "a b c d e f", 3), (2, "A B c d e f", 4), (9, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in N.near_duplicates(df).collect())
    assert got == [(0, None, True), (2, 2, True), (5, 2, False), (5, 2, False), (9, 9, True)]


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], COLUMNS)).collect() == []


def test_pairs_within_the_distance_share_a_key():
    rng = np.random.default_rng(0)
    chunks = N.chunks_for(0.85)
    symbols = chunks * N.SYMBOLS
    for _ in range(300):
        a = rng.integers(0, 1 << 16, symbols).astype(np.uint16)
        b = a.copy()
        at = rng.choice(symbols, 2 * chunks - 1, replace=False)
        b[at] ^= 1
        one, two = N.chunk_keys(np.stack([a, b]))
        assert set(one.tolist()) & set(two.tolist())


def test_components(spark):
    links = [(i, i + 1) for i in range(20, 60)] + [(100, 7), (7, 100), (8, 8), (None, 3), (300, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 20 for i in range(21, 61)} | {100: 7, 300: 7}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_parity_bitmaps_bound_the_difference():
    rng = np.random.default_rng(5)
    for n, changed in [(1, 0), (200, 10), (200, 200), (9000, 700)]:
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64)])
        unequal = int(np.bitwise_count((N.parity(a) ^ N.parity(b)).view(np.uint64)).sum())
        assert unequal <= 2 * changed and (changed > N.BITS / 8 or unequal >= 1.5 * changed)


@pytest.mark.parametrize("count", [200, 2000])
def test_a_family_of_loose_copies_is_not_confirmed_pair_by_pair(spark, monkeypatch, count):
    """Copies of a text with three words changed each: alike, but none a link."""
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(200)]

    def copy(i):
        words = list(base)
        for k, at in enumerate(rnd.sample(range(0, 200, 10), 3)):
            words[at + 4] = f"new{i}-{k}"
        return " ".join(words)

    texts = [copy(i) for i in range(count)]
    confirmed, compared = [], N._compared

    def counted(pairs, sets):
        confirmed.append(pairs.count())
        return compared(pairs, sets)

    monkeypatch.setattr(N, "_compared", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = N.near_duplicates(df, threshold=0.85).collect()
    want, _ = near_components(list(enumerate(texts[:200])), 85, 100)
    assert count > 200 or {r.doc_id: r.component_id for r in got} == want
    assert sum(confirmed) <= count
