"""Fill-in-middle against a plain loop over units."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from llm_helpers import COLUMNS, corpus
from pyspark.sql import functions as F

from courant.llm import fim, queries

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from("aZ@[`{é漢😀\n\0")), min_size=1),
       st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts_of_a_batch(texts, h1, h2):
    array = pa.array(["skipped"] + texts, pa.string()).slice(1)
    n, a, b = fim.cuts(array, np.full(len(texts), h1), np.full(len(texts), h2))
    for i, text in enumerate(texts):
        units = UNIT.findall(text)
        low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        assert (n[i], a[i], b[i]) == (len(units), len("".join(units[:low])), len("".join(units[:high])))


@pytest.mark.parametrize("block", [1 << 18, 3, 1])
def test_blocks_of_words(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    rnd = random.Random(block)
    texts = ["".join(rnd.choice("abZ. é漢😀\n") for _ in range(rnd.randrange(60))) for _ in range(50)]
    n, a, _ = fim.cuts(pa.array(texts, pa.large_string()), np.full(50, 10**9), np.full(50, 10**9))
    for i, text in enumerate(texts):
        units = UNIT.findall(text)
        assert n[i] == len(units) and a[i] == len("".join(units[: 10**9 % (len(units) + 1)]))


def test_like_plain_loop(spark):
    rows = corpus(4, 150)
    rows += [(5000 + i, t, None, None, 0) for i, t in enumerate(
        ["<P>", "a <S> b", "x<M", "<", "<S", "P>", "😀" * 9, "é" * 40, "word " * 200_000, "a" * 300_000, "\0\n\r ", "a"])]
    rows += [(None, "no id at all", None, None, 0), rows[0], rows[0]]
    df = spark.createDataFrame(rows, COLUMNS).withColumns({"output": F.lit(1), "N": F.lit(2), "t": F.lit("x"), "c": F.lit(3)})
    out = fim.fill_in_middle(df.repartition(3))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "t", "c", *fim.COLUMNS]
    got = out.withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    assert sorted((str(r.doc_id), r.text or "", r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in got) == sorted(
        (str(i), t or "", n, form, str(p), str(m), o) for i, t, *_ in rows for n, form, p, m, o in [plain_fim(i, t)])
    assert all(r.back == (r.text or "") and r.t == "x" for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_digests(spark):
    rows = corpus(5, 60)
    for r in queries.fim_digests(fim.fill_in_middle(spark.createDataFrame(rows, COLUMNS))).collect():
        text = {i: t or "" for i, t, *_ in rows}[r.doc_id]
        assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(plain_fim(r.doc_id, text)[4].encode()).hexdigest()
    empty = fim.fill_in_middle(spark.createDataFrame([], COLUMNS))
    assert queries.fim_digests(empty).collect() == []
