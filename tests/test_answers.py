import pandas as pd
from pyspark.sql import functions as F

from courant.functions import answers as A
from courant.plans.briefs import _answers, summarize_with, with_answers

LONG = "a single line that is longer than thirty characters"


def test_split_answer(spark):
    cases = [
        ("标题|摘要|more", ("标题", "摘要|more")), (" t | s ", ("t", "s")), ("\nline one\n\n line two \nthree", ("line one", "line two")),
        (LONG, ("orig", LONG)), ("short", ("short", "")), ("  \n ", ("orig", "")), ("|", ("", "")),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string")
    rows = df.select("i", A.split_answer(F.col("a"), F.lit("orig")).alias("p")).orderBy("i").collect()
    assert [(r.p.title, r.p.summary) for r in rows] == [want for _, want in cases]


def apply(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", fn(F.col("t"))).orderBy("i").collect()]


def test_prefixes(spark):
    assert apply(spark, A.strip_title_prefix, ["NewsNews x", "标题： 标题", "Natural Gas up", "plain"]) == [
        "News x", "标题", "up", "plain"]
    assert apply(spark, A.strip_summary_prefixes, ["摘要：本文 说", "文章本文x", "plain"]) == ["说", "本文x", "plain"]


def test_body_limits(spark):
    text = "".join(chr(97 + i % 26) for i in range(5001))
    cut, whole = apply(spark, A.head_and_tail, [text, text[:5000]])
    assert cut == text[:2500] + A.OMITTED + text[-2500:] and whole == text[:5000]
    df = spark.createDataFrame([("x" * 60, "en"), ("x" * 60, "zh"), ("x" * 100, "zh"), ("x" * 49, "en")], "t string, l string")
    assert [r[0] for r in df.select(A.long_enough(F.col("t"), F.col("l"))).collect()] == [True, False, True, False]


def articles(spark):
    body = "word " * 40
    return spark.createDataFrame(
        [("T1", "en", body, "ext1"), ("T2", "zh", body, "ext2"), ("T3", "zh", "too short", "ext3")],
        "title string, lang string, article_text string, extracted string",
    )


def test_summarize_with(spark):
    def answer(lang, title, text):
        assert all(len(t) >= 50 for t in text)
        return ["News 新标题|新摘要" if code == "en" else "摘要：中文" for code in lang]

    got = {r.extracted: (r.title, r.summary) for r in summarize_with(articles(spark), answer).collect()}
    assert got == {"ext1": ("新标题", "新摘要"), "ext2": ("T2", "中文"), "ext3": ("T3", "ext3")}


def test_summarize_falls_back(spark):
    def broken(lang, title, text):
        raise RuntimeError("no service")

    def silent(lang, title, text):
        return pd.Series([None] * len(lang))

    def picky(lang, title, text):
        if "T2" in list(title):
            raise RuntimeError("one bad row")
        return ["摘要：好" for _ in title]

    rows = spark.range(3000).select(
        F.when(F.col("id") == 1234, "T2").otherwise(F.col("id").cast("string")).alias("title"), F.lit("zh").alias("lang"),
        F.lit("word " * 40).alias("article_text"), F.lit("ext").alias("extracted")).coalesce(1)
    got = summarize_with(rows, picky).collect()
    assert [(r.title, r.summary, r.error) for r in got if r.error] == [("T2", "ext", "RuntimeError: one bad row")]
    assert all(r.summary == "好" for r in got if not r.error)

    for fn in (broken, silent):
        got = {r.title: r.summary for r in summarize_with(articles(spark), fn).collect()}
        assert got == {"T1": "ext1", "T2": "ext2", "T3": "ext3"}


def test_a_bad_row_costs_two_calls_for_each_halving():
    rows = pd.DataFrame({"lang": "zh", "title": [str(i) for i in range(4096)], "_body": "text"})
    calls = []

    def picky(lang, title, text):
        calls.append(len(title))
        if "1234" in list(title):
            raise RuntimeError("bad")
        return ["x"] * len(title)

    answers, errors = _answers(picky, rows)
    assert [i for i, e in enumerate(errors) if e] == [1234] and answers.count("x") == 4095
    assert len(calls) == 2 * 12 + 1
    assert _answers(lambda *_: ["one"], rows.iloc[:2]) == (["one", "one"], [None, None])
    assert _answers(lambda *_: [], rows.iloc[:1])[1] == ["ValueError: 0 answers to 1 texts"]


def test_answers_by_language_of_the_source(spark):
    links = spark.createDataFrame(
        [(1, 1, 0, "Same title", "u1"), (2, 2, 0, "Same title", "u1"), (2, 2, 1, "No page", "u2"), (3, 3, 0, "Bad", "u3"),
         (4, 4, 0, "No language", "u1"), (9, 9, 0, "No source", "u1")],
        "source_id int, page_id long, pos int, title string, url string")
    details = spark.createDataFrame(
        [(u, f"<article><p>{'a long text that goes on. ' * 8}</p></article>") for u in ("u1", "u3", "u9")], "url string, html string")
    sources = spark.createDataFrame([(1, "en"), (2, "zh"), (3, "zh"), (4, None)], "id int, language string")

    def answer(lang, title, text):
        assert len(set(zip(lang, title))) == len(title)
        if "Bad" in list(title):
            raise RuntimeError("no")
        return ["New|Short" if code == "en" else "Kurz" for code in lang]

    got = {(r.source_id, r.pos): (r.title, r.summary[:6], r.error) for r in with_answers(links, details, sources, answer).collect()}
    assert got == {
        (1, 0): ("New", "Short", None), (2, 0): ("Same title", "Kurz", None), (2, 1): ("No page", "", None),
        (3, 0): ("Bad", "a long", "RuntimeError: no"), (4, 0): ("No language", "Kurz", None)}


def test_whole_texts_need_not_go_through_python(spark):
    rows = spark.createDataFrame([], "title string, lang string, article_text string, extracted string")
    found = summarize_with(rows, lambda lang, title, text: list(text), keep_text=False)
    assert found.columns == ["title", "lang", "extracted", "error", "summary"]
