import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from courant.operators import dedup as D


def greedy(rows, alike):
    kept = []
    for row in rows:
        if not any(alike(k, row) for k in kept):
            kept.append(row)
    return [r[0] for r in kept]


def gram_set(title, n=3):
    low = title.lower()
    return {low[i:i + n] for i in range(max(len(low) - n + 1, 1))}


def titles(seed, count):
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(40)]
    base = [" ".join(rnd.choices(words, k=10)) for _ in range(count // 4)]
    out = []
    for _ in range(count):
        text = list(rnd.choice(base))
        for _ in range(rnd.randrange(6)):
            text[rnd.randrange(len(text))] = rnd.choice("abcdef")
        out.append("".join(text))
    # a third of all rows are variants of one title
    hot = "the one title that everybody copies with small changes at its end"
    out += [f"{hot} {i}" for i in range(count // 2)] + ["", "ab", "abc", "ABC"]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("threshold, head", [(0.85, 256), (0.85, 4), (0.6, 8)])
def test_titles_like_brute_force(spark, threshold, head):
    rows = list(enumerate(titles(3, 120)))
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    once = [(i, t, gram_set(t)) for i, t in rows if first[t] == i]
    want = greedy(once, lambda a, b: len(a[2] & b[2]) / len(a[2] | b[2]) >= threshold)
    df = spark.createDataFrame(rows, "n int, title string").repartition(5)
    got = D.dedup_titles(df, ["n"], threshold=threshold, short_rows=head, head_rows=head)
    assert sorted(r.n for r in got.collect()) == sorted(want)


def test_titles_within_an_industry(spark):
    rows = [(1, "a", "Prices rise again in the north"), (2, "b", "Prices rise again in the north"),
            (3, "a", "Prices rise again in the North."), (4, "b", "Something else")]
    df = spark.createDataFrame(rows, "n int, industry string, title string")
    assert sorted(r.n for r in D.dedup_titles(df, ["n"], within=["industry"], threshold=0.8).collect()) == [1, 2, 4]


def vectors(seed, count, dim):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((count // 3, dim))
    picks = centres[rng.integers(0, len(centres), count)]
    picks[: count // 3] = centres[0]
    return picks + 0.35 * rng.standard_normal((count, dim))


@pytest.mark.parametrize("threshold, head, miss", [
    (0.85, 2048, 0), (0.85, 16, 0), (0.7, 64, 0), (0.4, 64, 0), (1.0, 64, 0), (0.95, 64, 1e-6)])
def test_vectors_like_brute_force(spark, threshold, head, miss):
    v = vectors(5, 240, 16)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = greedy(list(enumerate(u)), lambda a, b: float(a[1] @ b[1]) >= threshold)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "n int, vector array<double>")
    got = D.dedup_vectors(df.repartition(7), ["n"], 16, threshold=threshold, short_rows=head, head_rows=head, max_miss=miss)
    assert sorted(r.n for r in got.collect()) == want


@pytest.mark.parametrize("threshold", [0.4, 0.7, 0.85])
def test_a_hot_ring_is_split(spark, monkeypatch, threshold):
    """Half of all vectors lie in one ring; slices of it are joined with its head in tasks of their own."""
    monkeypatch.setattr(D, "RING_ROWS", 16)
    monkeypatch.setattr(D, "SLICE_ROWS", 16)
    rng = np.random.default_rng(9)
    v = rng.standard_normal((300, 16))
    v[:150] = v[0] + 0.4 * rng.standard_normal((150, 16))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = greedy(list(enumerate(u)), lambda a, b: float(a[1] @ b[1]) >= threshold)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "n int, vector array<double>")
    slices = []
    edges = D._edges
    monkeypatch.setattr(D, "_edges", lambda e, *a: slices.append(e.agg(F.max(F.ceil(F.col("n") / 16))).first()[0]) or edges(e, *a))
    got = D.dedup_vectors(df, ["n"], 16, threshold=threshold, short_rows=8, head_rows=8)
    assert sorted(r.n for r in got.collect()) == want
    assert slices[0] > 4


def test_unlike_vectors_take_few_rounds(spark, monkeypatch):
    v = np.random.default_rng(6).standard_normal((18_000, 16))
    v[9000:9100] = v[:100]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "n int, vector array<double>").repartition(4)
    taken, real = [], D._edges
    monkeypatch.setattr(D, "_edges", lambda *a: taken.append(1) or real(*a))
    got = {r.n for r in D.dedup_vectors(df, ["n"], 16, threshold=0.99).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    close = [np.flatnonzero(u[i:] @ u[i] >= 0.99) + i for i in range(100)]
    assert len(taken) <= 4 and not got & set(range(9000, 9100)) and all(set(c) & got for c in close)


def test_rings_leave_out_what_is_far(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((8, 32))
    v = centres[rng.integers(0, 8, 400)] + 0.05 * rng.standard_normal((400, 32))
    fit = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "n int, vector array<double>").select(
        F.struct("n").alias("ord"), F.lit(0).alias("scope"), D.unit(F.col("vector")).alias("v"))
    theta = float(np.arccos(0.95))
    pivots = D.choose_pivots(fit, 32, theta)
    nodes = fit.withColumn("angles", D.angles_to(F.col("v"), pivots))
    sizes = [r["count"] for r in D.ring_buckets(nodes, theta).groupBy("bucket").count().collect()]
    assert len(pivots) >= 8 and sum(n * n for n in sizes) < 400 * 400
    spread = D.choose_pivots(fit, 32, float(np.arccos(-0.5)))
    assert len(spread) == 1


def test_choose_bands():
    p = 1 - np.arccos(0.85) / np.pi
    assert (1 - p**D.BITS) ** D.choose_bands(0.85, 1e-6) <= 1e-6
    assert D.choose_bands(1.0, 1e-6) == 1 and D.choose_bands(0.4, 1e-6) is None


def test_rounds_do_not_grow_with_unlike_titles(spark, monkeypatch):
    taken = []
    real = D._settle
    monkeypatch.setattr(D, "_settle", lambda *a: taken.append(1) or real(*a))
    rounds = []
    for count in (2_000, 8_000):
        taken.clear()
        df = spark.range(count).select(F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("title"))
        assert D.dedup_titles(df, ["n"]).count() == count
        rounds.append(len(taken))
    assert rounds[0] == rounds[1]


def test_unusable_vectors_stay(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "b", [0.0, 0.0]), (3, "c", [float("nan"), 1.0]), (4, "d", [1.0]),
            (5, "e", [2.0, 0.0]), (6, "f", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "n int, title string, vector array<double>")
    assert sorted(r.n for r in D.dedup_with_fallback(df, ["n"], 2).collect()) == [1, 2, 3, 4, 6]


def test_exact_keeps_the_first(spark):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (4, "a")], "n int, title string")
    for parts in (1, 17):
        got = D.dedup_exact(df.repartition(parts), ["n"]).orderBy("n").collect()
        assert [(r.n, r.title) for r in got] == [(1, "a"), (2, "b")]


def test_fallback_without_vectors(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.01]), (3, "c", None), (4, "c", [1.0, 0.0]), (5, "d", None)]
    df = spark.createDataFrame(rows, "n int, title string, vector array<double>")
    assert sorted(r.n for r in D.dedup_with_fallback(df, ["n"], 2).collect()) == [1, 3, 5]


def test_grams_of_a_long_title_take_time_in_proportion(spark):
    began = time.monotonic()
    n = spark.range(1).select(F.size(D.grams(F.repeat(F.lit("wörter é "), 60_000)))).first()[0]
    assert n == 9 and time.monotonic() - began < 30
    texts = ["", "a", "Ab", "abc", "a😀bé", None, "Many Words here"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    by_place = F.expr("array_distinct(transform(sequence(1, greatest(length(t) - 2, 1)), i -> xxhash64(substr(lower(t), i, 3))))")
    for r in rows.select(D.grams(F.col("t")).alias("got"), by_place.alias("want")).collect():
        assert r.got == r.want


def test_unlike_long_titles_are_not_compared_by_all_their_grams(spark):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2500))) for i in range(12)]
    rows += [(12, rows[3][1] + "abc"), (13, None)]
    df = spark.createDataFrame(rows, "doc_id int, title string")
    assert sorted(r.doc_id for r in D.dedup_titles(df, ["doc_id"]).collect()) == [*range(12), 13]
    grams = df.select("doc_id", D.grams("title").alias("g")).localCheckpoint()
    sets = grams.select(
        "doc_id", F.struct(F.size("g").alias("size"), D.wide_bits("g").alias("bits")).alias("s")).localCheckpoint()
    likely = sets.alias("a").join(sets.alias("b"), F.col("a.doc_id") < F.col("b.doc_id")).where(
        D.may_be_similar(F.col("a.s"), F.col("b.s"), 0.85, D.WIDE_WORDS))
    assert [tuple(r) for r in likely.select("a.doc_id", "b.doc_id").collect()] == [(3, 12)]


def test_wide_bitmaps_are_compared_by_a_short_expression(spark):
    rnd = random.Random(12)
    sets = [sorted(rnd.sample(range(1 << 40), rnd.randrange(1, 400))) for _ in range(30)]
    sets += [s[: len(s) - 3] + [7, 8] for s in sets if len(s) > 3]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i long, s array<long>")
    bits = F.struct(F.size("s").alias("size"), D.wide_bits(F.col("s")).alias("bits"))
    a, b = df.select("i", bits.alias("a")), df.select(F.col("i").alias("j"), bits.alias("b"))
    got = a.crossJoin(b).select(
        "i", "j", D.may_be_similar(F.col("a"), F.col("b"), 0.85, D.WIDE_WORDS).alias("may"))
    cells = [{x % (D.WIDE_WORDS * 64) for x in s} for s in sets]
    for r in got.collect():
        both = len(sets[r.i]) + len(sets[r.j])
        assert r.may == (len(cells[r.i] ^ cells[r.j]) <= both * (0.15 / 1.85) + 1e-6)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bit_count") <= D.BITMAP_WORDS  # a term for each word is too long a method to be compiled
