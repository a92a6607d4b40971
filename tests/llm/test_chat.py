"""Chat formatting against plain loops, and read back."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from courant.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = [*chat.CONTROLS, *[c[1:] for c in chat.CONTROLS], "<", "[", "\\", "<\\", "a", "\n", "é😀", "$1", "|", ">"]


def conversations(seed, count, turns):
    rnd = random.Random(seed)
    rows = []
    for c in range(count):
        for t in range(rnd.randrange(1, turns)):
            role = rnd.choice(["user", "assistant", "assistant", "system", "<|says|>", None, ""])
            text = None if rnd.random() < 0.05 else "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(12)))
            rows.append((c, t * rnd.choice([1, 1, 1, 3]), role, text))
    return rows


def order(row):
    return row[1] is not None, row[1] or 0, row[2] or "", row[3] or ""


def by_conversation(rows):
    found = {}
    for r in sorted(rows, key=order):
        found.setdefault(r[0], []).append((r[1], r[2] or "", r[3] or ""))
    return found


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


AWKWARD = [
    (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"),
    (None, 0, "user", "no id"), (None, None, "assistant", "no turn"), (901, 5, "user", "only a question"),
    (902, 1, "assistant", ""), (902, 1, "assistant", ""), (902, -40, "user", "early"), (903, None, None, None),
    (904, 0, "user", "word " * 100_000), (904, 1, "assistant", "w" * 300_000),
]


@pytest.mark.parametrize("bits", [5, 1, 0])
def test_read_back(spark, monkeypatch, bits):
    monkeypatch.setattr(chat, "BLOCK_BITS", bits)
    rows = conversations(bits, 40, 20) + AWKWARD
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"block": F.lit(1), "Target": F.lit("x"), "t": F.lit(0)})
    out = chat.expand(df)
    got = {r.conv_id: r for r in queries.chat_digests(out).collect()}
    want = by_conversation(rows)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(x for _, role, x in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{x}\n" for _, role, x in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    full = {}
    for r in chat.in_full(out).collect():
        full.setdefault(r.conv_id, []).append((r.text, r.target, r.loss_start, r.loss_end))
    parsed = spark.createDataFrame([(c, t, a, b) for c, ex in full.items() for t, _, a, b in ex], "c long, text string, a int, b int")
    back = parsed.select("c", F.length("text").alias("n"), chat.turns_of(F.col("text")).alias("turns"),
                         chat.reply(F.col("text"), F.col("a"), F.col("b")).alias("reply")).collect()
    seen = {}
    for r in sorted(back, key=lambda r: r.n):
        seen.setdefault(r.c, []).append((r.reply, [tuple(t) for t in r.turns]))
    for c, turns in want.items():  # every assistant turn once, with all turns before it
        plain = [(role, x) for _, role, x in turns]
        assert seen.get(c, []) == [(x, plain[: i + 1]) for i, (role, x) in enumerate(plain) if role == "assistant"]
    longest = max(len(r.text) for r in out.collect() if r.conv_id in range(40))
    assert bits > 0 or longest < 12 * 30


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES)), min_size=1))
def test_escapes(spark, made):
    texts = ["".join(m) for m in made]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select("s", chat.escaped(F.col("s")).alias("e"))
    for r in df.select("*", chat.unescaped(F.col("e")).alias("u")).collect():
        assert r.u == r.s and not any(c in r.e for c in chat.CONTROLS)


def test_template_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "a<s>"), (1, 1, "assistant", "b"), (1, 2, "user", "c")], SCHEMA)
    got = sorted((r.text, r.target, r.loss_start, r.loss_end, r.whole_block) for r in chat.expand(df).collect())
    first = "<|turn|>user<|says|>a<\\s><|end|><|turn|>assistant<|says|>b<|end|>"
    assert got == [(first, 1, len(first) - 8, len(first) - 7, False), (first + "<|turn|>user<|says|>c<|end|>", None, None, None, True)]
    assert chat.expand(df.limit(0)).collect() == [] and queries.chat_digests(chat.expand(df.limit(0))).collect() == []


def test_a_long_conversation_grows_linearly(spark):
    rows = spark.range(4000).select(
        F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("x" * 50).alias("text"))
    out = chat.expand(rows)
    total, longest = out.agg(F.sum(F.length("text")), F.max(F.length("text"))).first()
    assert longest <= 32 * 90 and total <= 4000 / 2 * longest


def test_the_query_reads_replies_from_whole_examples(spark, tmp_path, monkeypatch):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} says {t} <s>é") for c in (1, 2, None) for t in range(150 if c != 2 else 4)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    made, in_full = [], chat.in_full
    monkeypatch.setattr(chat, "in_full", lambda df: made.append(in_full(df)) or made[-1])
    got = {r.conv_id: r for r in queries.QUERIES["op12_chat_format"](spark, str(tmp_path)).collect()}
    want = by_conversation(rows)
    assert got.keys() == {*want, -1}
    for c, turns in want.items():
        assert (got[c].n_turns, got[c].loss_sha256) == (len(turns), sha("".join(x for _, role, x in turns if role == "assistant")))
    texts = {(r.conv_id, r.target): (r.text, r.loss_start, r.loss_end) for r in made[0].collect()}
    assert texts.keys() == {(r[0], r[1]) for r in rows if r[2] == "assistant"} | {(-1, 1)}
    for c, turns in want.items():
        parts = [f"<|turn|>{role}<|says|>{x.replace('<s>', '<' + chr(92) + 's>')}<|end|>" for _, role, x in turns]
        for i in range(1, len(turns), 2):  # all turns before, beyond the block of 32 too
            text, start, end = texts[c, i]
            assert text == "".join(parts[: i + 1]) and text[start:end] == parts[i][25:-7]
