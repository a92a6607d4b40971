"""Language ID, personal data, lines, licenses, BPE and token files."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_helpers import COLUMNS, corpus
from tokenizers import Tokenizer

import corpus_pipeline
from courant.llm import bpe, langid, licenses, line_dedup, pii, queries, rangecoder, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    (1, ""), (2, None), (3, "  a  b \n c<|endoftext|> d\t e "), (None, "x y"), (4, "x y"), (4, "　 a  b\x1c c 's don't"),
    (5, "a" * 5000 + " 你好 世界\r\n\r\n 1234567 _ !!! \U0001f600 é́"), (6, " <|endoftext|> <|endoftext|>x"),
    (7, "x y"), (7, "x y"), (8, " "), (9, "\n"), (10, "long " * 9000),
]


def frame(spark, rows):
    """Rows with extra columns named like those of results."""
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, ids int, part string")


# --- BPE and token files ------------------------------------------------------------


@pytest.mark.parametrize("part_chars", [16_000_000, 700])
def test_bpe_like_the_library(spark, monkeypatch, part_chars):
    monkeypatch.setattr(bpe, "PART_CHARS", part_chars)
    rows = ODD + [(20 + r[0], r[1]) for r in corpus(3, 60)]
    plain = Tokenizer.from_file(PATH)
    ids = [plain.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    want = sorted(
        (str(i), x, plain.decode(x, skip_special_tokens=False)) for (i, _), x in zip(rows, ids)
    )
    got = bpe.decode(bpe.encode(frame(spark, rows).repartition(3), PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.ids, r.text) for r in got) == want


def test_bpe_of_nothing(spark):
    assert bpe.encode(frame(spark, []), PATH).collect() == []
    rows = spark.createDataFrame([(1, None), (2, []), (3, [50256])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(rows, PATH).collect()} == {1: None, 2: "", 3: "<|endoftext|>"}


def test_word_borders():
    pre = Tokenizer.from_file(PATH)
    rnd = random.Random(2)
    signs = "a1 \n\t'.s　\x1c\x85é你 "
    for _ in range(3000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randrange(12)))
        words = [bpe.word_of(k) for k in bpe.keys_of(text)]
        assert "".join(words) == text
        apart = [i for w in words for i in pre.encode(w, add_special_tokens=False).ids]
        assert apart == pre.encode(text, add_special_tokens=False).ids, repr(text)


def test_range_coder_round_trip():
    rng = np.random.default_rng(1)
    sizes = [700, 700, 300, 299, 1]
    kinds = [lambda n: rng.integers(0, 1 << 16, n), lambda n: rng.integers(0, 7, n), lambda n: np.zeros(n, int),
             lambda n: np.arange(n) % 50 * 1000, lambda n: np.full(n, 65535)]
    for shift in range(len(kinds)):
        blocks = [kinds[(i + shift) % 5](n) for i, n in enumerate(sizes)]
        coded = rangecoder.encode(blocks)
        assert all((a == b).all() for a, b in zip(blocks, rangecoder.decode(coded)))
    assert len(rangecoder.encode([np.arange(4096) % 50 * 1000])[0][2]) < 1500
    n, crc, data = rangecoder.encode([np.arange(500)])[0]
    with pytest.raises(ValueError):
        rangecoder.decode([(n, crc ^ 1, data)])
    assert rangecoder.encode([]) == [] and rangecoder.decode([]) == []


@pytest.mark.parametrize("segment", [1 << 22, 900])
def test_token_files(spark, monkeypatch, segment):
    monkeypatch.setattr(token_files, "SEGMENT", segment)
    rows = [r for r in ODD if r[0] not in (4, 7)] + [(20 + r[0], r[1]) for r in corpus(5, 40)]
    folder = token_files.write_tokens(frame(spark, rows).repartition(4), PATH, end_id=2)
    got = token_files.read_tokens(spark, folder).orderBy("start").collect()
    plain, at = Tokenizer.from_file(PATH), 0
    assert len(got) == len(rows)
    for (i, text), r in zip(sorted(rows, key=lambda r: -1 if r[0] is None else r[0]), got):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (r.doc_id, r.start, r.ids, r.ids_crc32) == (i, at, ids, crc)
        at += len(ids)


def test_token_files_of_nothing(spark):
    folder = token_files.write_tokens(frame(spark, []), PATH, end_id=2)
    assert token_files.read_tokens(spark, folder).collect() == []


def chain(n):
    """Ids that depend on the two before them, and now and then on nothing."""
    rng = np.random.default_rng(4)
    after, noise, free = rng.integers(0, 300, (300, 300)), rng.random(n), rng.zipf(1.5, n) % 30_000
    out = [0, 0]
    for i in range(n):
        out.append(int(after[out[-2] % 300, out[-1] % 300] % 60 if noise[i] < 0.6 else free[i]))
    return np.array(out[2:], "<u4")


def test_range_coder_takes_fewer_bits_than_frequencies_alone():
    ids = chain(300_000)
    blocks = [ids[i : i + rangecoder.BLOCK] for i in range(0, len(ids), rangecoder.BLOCK)]
    coded = rangecoder.encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, rangecoder.decode(coded)))
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    taken = 8 * sum(len(c[2]) for c in coded) / len(ids)
    assert taken < 0.9 * -(share * np.log2(share)).sum()
    # With the model, which stands in front of the first block, a block can be read alone.
    assert (rangecoder.decode([coded[0], coded[7]])[1] == blocks[7]).all()


def test_contexts_of_any_ids_are_mixed():
    rng = np.random.default_rng(7)
    after, ids = rng.integers(0, 20_000, (4, 20_000)), [5, 6]  # rules for ids of which none is common
    for kind, free in zip((rng.random(400_000) < 0.1).tolist(), rng.integers(0, 20_000, 400_000).tolist()):
        ids.append(free if kind else int(after[ids[-2] % 4, ids[-1]]) % 3000)
    ids = np.array(ids, "<u4")

    def taken():
        coded = rangecoder.encode([ids[i : i + 4096] for i in range(0, len(ids), 4096)])
        assert (np.concatenate(rangecoder.decode(coded)) == ids).all()
        return 8 * sum(len(c[2]) for c in coded) / len(ids)

    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert taken() < 0.6 * -(share * np.log2(share)).sum()


def test_weights_follow_each_id(monkeypatch):
    rng = np.random.default_rng(8)
    rule = np.resize(rng.permutation(500), 200_000)  # after an id always the same one, and stretches of noise
    ids = np.where(np.arange(200_000) // 4096 % 2 == 0, rule, rng.integers(0, 5000, 200_000)).astype("<u4")
    blocks = [ids[i : i + 4096] for i in range(0, len(ids), 4096)]

    def taken():
        coded = rangecoder.encode(blocks)
        assert (np.concatenate(rangecoder.decode(coded)) == ids).all()
        return sum(len(c[2]) for c in coded)

    followed = taken()
    monkeypatch.setattr(rangecoder._Weights, "learn", lambda self, escaped: None)
    assert followed < 0.99 * taken()


def test_range_coder_of_all_ids_and_odd_lengths():
    rng = np.random.default_rng(5)
    for blocks in (
        list(np.arange(1 << 16).reshape(16, -1)), [rng.zipf(1.2, n) % (1 << 16) for n in (4096, 513, 512, 511, 1)],
        [np.full(4096, 65535), np.zeros(3, int), np.empty(0, int)], [np.empty(0, int)],
    ):
        assert [b.tolist() for b in rangecoder.decode(rangecoder.encode(blocks))] == [b.tolist() for b in blocks]


def test_range_coder_costs_little():
    ids = np.tile(chain(250_000), 8)
    blocks = [ids[i : i + rangecoder.BLOCK] for i in range(0, len(ids), rangecoder.BLOCK)]
    start, total = time.process_time(), 0
    for i in ids.tolist():
        total = (total * 31 + i) & 0xFFFFFFFF
    plain, start = time.process_time() - start, time.process_time()
    rangecoder.decode(rangecoder.encode(blocks))
    assert time.process_time() - start < 4 * plain  # measured: 0.9; with a model of its own in each block 10


def test_words_of_texts_like_the_library(monkeypatch):
    monkeypatch.setattr(token_files._Words, "LIMIT", 50)  # so that words are forgotten and met again
    words, plain, rnd = token_files._Words(PATH), Tokenizer.from_file(PATH), random.Random(6)
    assert words.splits
    signs = [*"aBzé Ø×÷ɏɐ \n\t'.,!*-_^`\\[]{}~|<>$1²ß\x1c\x85\u3000你\u0301\r", "<|endoftext|>", " the", "'s", "ing\n", "  "]
    for _ in range(60):
        texts = ["".join(rnd.choices(signs, k=rnd.randrange(30))) for _ in range(40)]
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        ids, sizes = words.of(pa.array(texts))
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w], texts


def test_words_are_encoded_once(monkeypatch):
    words, learned = token_files._Words(PATH), []
    learn = words.learn
    monkeypatch.setattr(words, "learn", lambda keys: learned.extend(keys) or learn(keys))
    texts = pa.array([t or "" for _, t, *_ in corpus(9, 30)])
    first = words.of(texts)[0]
    seen = len(learned)
    assert (words.of(texts)[0] == first).all() and seen > 0
    assert all("\n" in k or len(k) > words.LONGEST for k in learned[seen:])  # of these the pieces are kept
    assert token_files._words(PATH) is token_files._words(PATH)  # in later tasks of a process, too


@pytest.mark.parametrize("segment, size", [(1 << 22, 8 << 20), (700, 300), (1, 1)])
def test_segments_end_with_a_document(monkeypatch, segment, size):
    monkeypatch.setattr(token_files, "SEGMENT", segment)
    monkeypatch.setattr(token_files, "BYTES", size)
    rows = [(i, t) for i, t, *_ in corpus(11, 30)] + [(900, None), (901, ""), (None, "x y")]
    table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    table = table.append_column("part", pa.array([3] * len(rows), pa.int32()))
    out = [r for b in token_files._segments(PATH, 2)(iter(table.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    plain = Tokenizer.from_file(PATH)
    want = [plain.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows]
    assert [d for r in out for d in r["doc_ids"]] == [r[0] for r in rows]
    assert [n for r in out for n in r["lengths"]] == [len(w) for w in want]
    assert [(r["part"], r["segment"]) for r in out] == [(3, i) for i in range(len(out))]
    assert all(r["total"] >= segment and r["total"] - r["lengths"][-1] < segment for r in out[:-1])
    blocks = [rangecoder.decode([tuple(b.values()) for b in r["blocks"]]) for r in out]
    assert [i for r in blocks for b in r for i in b.tolist()] == [i for w in want for i in w]


# --- lines --------------------------------------------------------------------------


def test_lines_like_sql(spark):
    rows = corpus(7, 120)
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text").toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(queries.ORACLE["op3_line_dedup"]).df()
    key = ["doc_id"]
    a, b = (x.sort_values(key, ignore_index=True).astype(object).where(lambda v: v.notna(), None) for x in (got, want))
    assert a.to_dict("records") == b.to_dict("records")
    assert (got.n_removed > 0).sum() > 5


def test_lines_of_awkward_rows(spark):
    passage = "\n".join(f"line {i} of a passage that all share" for i in range(12))
    rows = [(None, passage, 1), (3, "top\n" + passage, 2), (3, passage + "\nend", 3), (8, passage, 4), (8, passage, 5),
            (9, None, 6), (10, "", 7), (11, passage + "\n" + passage, 8)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int"))
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed"]
    got = [(r.doc_id, r.n_lines, r.n_removed) for r in out.collect()]
    assert len(got) == len(rows)
    by = {k: sorted(x[1:] for x in got if x[0] == k) for k in {g[0] for g in got}}
    assert by[None] == [(12, 0)] and by[9] == [(None, None)] and by[10] == [(1, 0)]
    assert by[8][0] == by[8][1] and by[8][0][1] >= 8  # repeated rows get the same
    assert line_dedup.dedup_lines(spark.createDataFrame([], COLUMNS)).collect() == []


def pieces_of(lines):
    """(places of the lines with text, heads and tails of the chunks as pairs of places), by a plain loop."""
    at = [k for k, x in enumerate(lines) if x.strip(" \t\r\f\v")]
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    cut = [md5(md5(lines[a]) + md5(lines[b]))[0] < line_dedup.CUT_BELOW for a, b in zip(at, at[1:])]
    n = line_dedup.LONGEST
    cut = [c or (k % n == n - 1 and not any(cut[k - n + 1 : k])) for k, c in enumerate(cut)]
    found, start = set(), 0
    for end, border in enumerate(cut):
        if border or end == len(cut) - 1:
            for k in range(start, end + 1):
                found |= {(at[start], at[k + 1]), (at[k], at[end + 1])}
            start = end + 1
    return at, sorted(found)


def without_passages(rows):
    """Texts by id, each line in a piece that stands before left out; ids are unique here."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        if text is None:
            out[i] = (None, None)
            continue
        lines, gone = text.split("\n"), set()
        at, pieces = pieces_of(lines)
        for a, b in pieces:
            piece = "\n".join(lines[a : b + 1])
            if piece in seen:
                gone.update(range(a, b + 1))
            seen.add(piece)
        if gone and gone.issuperset(at):
            gone = set(range(len(lines)))
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


def test_passages_go(spark):
    rnd, lengths, copies = random.Random(3), (2, 3, 4, 5, 8, 12), 150
    rows = [(i, t) for i, t, *_ in corpus(7, 120)]
    for n in lengths:  # passages between differing lines, twice; some with a blank line
        for c in range(copies):
            passage = [f"line {k} of passage {c} of {n}" for k in range(n)]
            if c % 4 == 0:
                passage.insert(1, "")
            for copy in (0, 1):
                around = [[f"{side} {j} {n} {c} {copy}" for j in range(rnd.randrange(1, 5))] for side in ("top", "end")]
                rows.append((1000 * (n * copies + c) + copy, "\n".join([*around[0], *passage, *around[1]])))
    rows += [(900, "same\n" * 100), (901, "\nrow a\r\n\r\nrow b\r\n"), (902, "row a\r\n\r\nrow b\r\n\r\n"),
             (903, "one line\r\n\r\n"), (904, "one line\r\n\r\nother"), (905, "a\nb\n" * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == without_passages(rows)
    for n in lengths:
        gone = [got[1000 * (n * copies + c) + 1][1] - (c % 4 == 0) for c in range(copies)]
        share = sum(max(g, 0) for g in gone) / (n * copies)
        assert share >= (0.9 if n == 2 else 0.97), (n, share)
        assert all(got[1000 * (n * copies + c)][1] == 0 for c in range(copies))
    stage = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], COLUMNS)
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, stage, "").collect()}
    assert left == {i: t for i, (t, n) in got.items() if n is None or t or not n}


# --- language -----------------------------------------------------------------------

STEMS = {"en": "the ing tion and str".split(), "fr": "eau aux ment les é".split(), "de": "sch ung ein cht ü".split()}


def speech(rnd, lang, n):
    return " ".join("".join(rnd.choices(STEMS[lang], k=rnd.randrange(1, 4))) for _ in range(n))


def test_language_held_out(spark):
    rnd = random.Random(1)
    rows = [(i, speech(rnd, lang, rnd.randrange(3, 60)), lang) for i, lang in enumerate(list(STEMS) * 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 4 <> 2").repartition(3))
    assert model.languages == ("de", "en", "fr")
    again = langid.fit(df.where("doc_id % 4 <> 2").repartition(7))
    assert np.allclose(model.weights, again.weights)
    held = df.where("doc_id % 4 = 2").select("lang", model.column("text").alias("f")).collect()
    assert np.mean([r.f.lang_pred == r.lang for r in held]) >= 0.98
    assert all(0 <= r.f.score <= 1 for r in held) and np.mean([r.f.rejected for r in held]) <= 0.02
    for text in (None, "", "12 !? _", "½²Ⅷ"):
        assert model.predict(text) == ("und", 0.0, True)
    assert model.predict("the " * 50_000)[0] == "en"


def test_unlearned_languages_are_rejected(spark):
    rnd = random.Random(4)
    rows = [(i, speech(rnd, lang, rnd.randrange(3, 60)), lang) for i, lang in enumerate(list(STEMS) * 120)]
    rows += rows[:5]  # repeated rows
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = langid.fit(df.repartition(4))
    foreign = {"ru": "при ста ние ого".split(), "pl": "szcz rzy ów kę wał".split(), "zh": "的 新闻 中国 市场".split()}
    for stems in foreign.values():
        texts = [" ".join("".join(rnd.choices(stems, k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(5, 60))) for _ in range(60)]
        assert np.mean([model.predict(t)[2] for t in texts]) >= 0.95
    known = [speech(rnd, lang, rnd.randrange(3, 60)) for lang in list(STEMS) * 200]
    assert np.mean([model.predict(t)[2] for t in known]) <= 0.005
    got = df.select("doc_id", model.column("text").alias("f")).collect()
    assert len({(r.doc_id, r.f) for r in got}) == len(got) - 5


def test_language_without_labels(spark):
    empty = spark.createDataFrame([(1, None, "en"), (2, "12", "en"), (3, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(empty)
    assert model.languages == () and model.predict("abc") == ("und", 0.0, True)


def test_the_driver_does_not_train(spark, monkeypatch):
    def trained_here(*_):
        raise AssertionError("the sample came to the driver")

    monkeypatch.setattr(langid, "train", trained_here)  # tasks import the module anew
    rows = [(i, speech(random.Random(i), lang, 20), lang) for i, lang in enumerate(list(STEMS) * 20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert model.languages == ("de", "en", "fr") and model.weights.shape == (langid.BUCKETS, 3)


# --- personal data ------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_plain_finders_like_the_patterns():
    rnd = random.Random(5)
    for _ in range(20_000):
        text = "".join(rnd.choice("a1@.-_% +é25") for _ in range(rnd.randrange(26)))
        want = [("email", *m.span()) for m in EMAIL.finditer(text)]
        want += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
        assert [s for s in pii.plain(text) if s[0] in ("email", "ip")] == want, text
    assert [s[0] for s in pii.plain("4111 1111-1111 1111 and 4111111111111112, +1 (743) 555-3824 +12")] == ["card", "phone"]


@pytest.mark.parametrize("text, kind, found", [
    ("write john.doe at example dot com now", "email", "john.doe at example dot com"),
    ("é john (at) example [dot] org", "email", "john (at) example [dot] org"),
    ("call plus one five five five one two three four five six seven!", "phone",
     "plus one five five five one two three four five six seven"),
    ("ip 192[.]168[.]0[.]1.", "ip", "192[.]168[.]0[.]1"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("a​b@c​.de", "email", "a​b@c​.de"),
    ("٤١١١١١١١١١١١١١١١ x", "card", "٤١١١١١١١١١١١١١١١"),
    ("ask name at example.com today", "email", "name at example.com"),
    ("ask name at mail.example.co.uk.", "email", "name at mail.example.co.uk"),
    ("ring +1 four one five 555 two six seven one, please", "phone", "+1 four one five 555 two six seven one"),
    ("host 192 dot 168 dot one dot one is down", "ip", "192 dot 168 dot one dot one"),
    ("host one nine two.168.0.one is down", "ip", "one nine two.168.0.one"),
    ("pay 4111-1111–1111-1111 now", "card", "4111-1111–1111-1111"),
])
def test_disguises_map_back(text, kind, found):
    base = pii.plain(text)
    assert [(k, text[s:e]) for k, s, e in pii.disguised(text, base)] == [(kind, found)]


@pytest.mark.parametrize("text, kind, part", [
    ("jоhn@example.com", "email", "hn@example.com"),
    ("john dot smith@example.com", "email", "smith@example.com"),
    ("john@mail.exаmple.com", "email", "john@mail.ex"),
    ("john@mail.example dot com", "email", "john@mail.example"),
    ("192.168.1.1０", "ip", "192.168.1.1"),
])
def test_whole_find_beside_a_plain_part(text, kind, part):
    base = pii.plain(f"see {text} now")
    assert [(k, f"see {text} now"[s:e]) for k, s, e in base] == [(kind, part)]
    assert pii.disguised(f"see {text} now", base) == [(kind, 4, 4 + len(text))]


@pytest.mark.parametrize("text", ["look at example.com", "we were at home dot", "one two three four", "plain (at) home", "a@b.de",
    "meet me at noon dot com", "we arrived at 5.30 today", "He looked at Mr.Smith", "in 1990–1995 one 2 or 3", "the one 5 of two",
    "chapters 1, 2, 3 and one", "see me—bob@example.com"])
def test_nothing_added(text):
    assert pii.disguised(text, pii.plain(text)) == []


CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_cards_and_phones_like_the_patterns():
    rnd, hits = random.Random(6), Counter()
    for _ in range(20_000):
        text = "".join(rnd.choice("0123456789012345678901234567890 -+(.x)") for _ in range(rnd.randrange(60)))
        want = [("card", *m.span()) for m in CARD.finditer(text)
                if 13 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and passes_luhn(d)]
        want += [("phone", *m.span()) for m in PHONE.finditer(text)
                 if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        assert [s for s in pii.plain(text) if s[0] in ("card", "phone")] == want, text
        hits.update(s[0] for s in want)
    assert min(hits["card"], hits["phone"]) > 200


def test_disguised_by_rule_come_back():
    """Identifiers disguised at random, put into prose: the spans are those of the disguised forms."""
    rnd = random.Random(8)
    spelled = dict(zip("0123456789", pii._DIGITS))
    for _ in range(3_000):
        kind = rnd.choice(["email", "ip", "phone"])
        if kind == "email":
            name = "".join(rnd.choices("bcdfghklmnpqrstvwxz", k=7))
            hidden = name + rnd.choice([" at ", " [at] ", "(at)", "@"]) + "example" + rnd.choice([" dot ", "[.]", " (dot) "]) + "org"
        elif kind == "ip":
            parts = [str(rnd.randrange(256)) for _ in range(4)]
            k = rnd.randrange(4)
            parts[k] = " ".join(spelled[d] for d in parts[k])
            hidden = " dot ".join(parts)
        else:
            digits = "".join(rnd.choices("123456789", k=11))
            at = rnd.randrange(2, 9)
            hidden = f"+{digits[:at]} " + " ".join(spelled[d] for d in digits[at:])
        text = f"Please note: {hidden}; thanks."
        found = [(k, text[s:e]) for k, s, e in pii.disguised(text, pii.plain(text))]
        assert (kind, hidden) in found, (text, found)


def test_personal_data_rows(spark):
    rows = [(1, "x a@b.de y 1.2.3.4"), (2, None), (None, "a@b.de"), (1, "q" * 200_000 + " a at b dot de"), (5, "")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, base int")
    got = queries.span_digests(pii.find_personal_data(df)).collect()
    assert len(got) == 5
    first = next(r for r in got if r.n_ip)
    assert (first.n_email, first.spans) == (1, "email:2:8,ip:11:18")
    assert first.base_sha256 == hashlib.sha256(b"email:2:8,ip:11:18").hexdigest()
    assert [r.spans for r in got if r.n_added] == ["email:200001:200014"]
    assert pii.find_personal_data(df.limit(0)).collect() == []


# --- licenses -----------------------------------------------------------------------


def scanned(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, base, found, best = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    for start in range(0, max(len(words) - licenses.STRIDE - 1, 0) + 1, licenses.STRIDE):
        block = set(words[start : start + licenses.WINDOW])
        for label, notice in licenses.NOTICES.items():
            own = set(licenses.plain_words(notice))
            if len(block & own) >= licenses.CONTAINMENT * len(own) - 1e-9:
                found.add(label)
                best = max(best, len(block & own) / len(own))
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if places else best)


def test_licenses_like_brute_force(spark):
    rnd = random.Random(9)
    rows = [(i, t) for i, t, *_ in corpus(11, 60)]
    for k, notice in enumerate(licenses.NOTICES.values()):
        words = notice.split()
        words.pop(rnd.randrange(len(words)))
        rows += [(1000 + 3 * k, f"{'é x ' * 45}{notice}. {'tail ' * 40}"), (1001 + 3 * k, " ".join(words)),
                 (1002 + 3 * k, " ".join(words[: len(words) // 2]))]
    rows += [(2000, "CC-BY cc by MIT\nLicense, Apache licenses; GNU general public license"), (2001, "cc"), (2002, "by cc")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, labels string").repartition(4)
    got = {r.doc_id: tuple(r)[1:8] for r in licenses.scan(df).collect()}
    assert got == {i: scanned(t) for i, t in rows}


def test_licenses_of_awkward_rows(spark):
    rows = [(None, "mit license"), (1, None), (1, ""), (2, "mit license"), (2, "mit license")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.labels, r.n_base) for r in got) == [
        (0, "mit", 1), (1, "", 0), (1, "", 0), (2, "mit", 1), (2, "mit", 1)]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    plan = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan.replace("ExistingRDD", ""))
