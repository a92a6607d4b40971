from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from courant.functions import keywords as K
from courant.functions import scores as S
from courant.operators import ranking as R
from courant.operators.topk import top_per_group

NOW = datetime(2024, 1, 31)


def parsed(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, keywords string")
    rows = df.select("i", K.parse_keywords(F.col("keywords")).alias("w")).orderBy("i").collect()
    return [(r.w.must, r.w.must_not, r.w.bonus) for r in rows]


def test_parse_keywords(spark):
    assert parsed(spark, ["", "+镍矿 +铁路", "!赞助 !招聘", "镍矿 产量", "+镍矿 !赞助 产量 出口", "+ ! A　+B +b", None]) == [
        ([], [], []), (["镍矿", "铁路"], [], []), ([], ["赞助", "招聘"], []), ([], [], ["镍矿", "产量"]),
        (["镍矿"], ["赞助"], ["产量", "出口"]), (["", "b", "b"], [""], ["a"]), ([], [], []),
    ]


SCORES = [
    (None, "随便什么", 0.5), ("", "随便什么", 0.5), ("+镍矿", "镍矿产量回升", 0.5), ("+镍矿", "球队今晚出战", None),
    ("!赞助", "本页含赞助栏目", None), ("!赞助", "镍矿产量回升简报", 0.5),
    ("镍矿 产量 出口", "镍矿 产量 出口简报", 1.0), ("镍矿 产量 出口", "镍矿简报", 1 / 3), ("镍矿 产量", "剧院本周开幕", 0.0),
    ("+a +b", "only A here", None), ("!", "anything", None), ("+", "anything", 0.5), ("a a b", "A", 2 / 3),
]


def test_keyword_score(spark):
    df = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(SCORES)], "i int, keywords string, title string")
    df = R.with_parsed_keywords(df, "w").withColumn("s", K.keyword_score(F.col("title"), F.col("w")))
    got = [r.s for r in df.orderBy("i").collect()]
    for have, (_, _, want) in zip(got, SCORES):
        assert have == (None if want is None else pytest.approx(want))


def test_industry_filter_is_or(spark):
    cases = [("+a +b", "has B", True), ("+a +b", "none", False), ("!x", "with X", False), ("!x", "fine", True),
             ("bonus", "other", True), (None, "other", True), ("+a !x", "ax", False)]
    df = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(cases)], "i int, keywords string, text string")
    df = R.with_parsed_keywords(df, "w").withColumn("ok", K.industry_match(F.col("text"), F.col("w")))
    assert [r.ok for r in df.orderBy("i").collect()] == [want for _, _, want in cases]


@pytest.mark.parametrize("hours, want", [(0.5, 1 - 0.5 / 24), (12, 0.5), (24, 0.0), (48, 0.0), (-1, 1 + 1 / 24)])
def test_timeliness(spark, hours, want):
    df = spark.createDataFrame([(NOW - timedelta(hours=hours),)], "t timestamp")
    assert df.select(S.timeliness(F.col("t"), F.lit(NOW))).first()[0] == pytest.approx(want)


def test_weight_score(spark):
    df = spark.createDataFrame([(10,), (5,), (1,), (0,), (99,)], "w int")
    assert [r[0] for r in df.select(S.weight_score(F.col("w"))).collect()] == [1.0, 0.5, 0.1, 0.1, 1.0]


def ranked(spark, rows, top_n, keywords=None):
    """rows: (title, hours ago, weight, keywords)"""
    sources = spark.createDataFrame(
        [(i, f"s{i}", 1, w, k) for i, (_, _, w, k) in enumerate(rows)],
        "id int, name string, industry_id int, weight int, keywords string",
    )
    industries = spark.createDataFrame([(1, "i", top_n, keywords)], "id int, name string, top_n int, keywords string")
    articles = spark.createDataFrame(
        [(i, t, "", NOW - timedelta(hours=h)) for i, (t, h, _, _) in enumerate(rows)],
        "source_id int, title string, summary string, published_at timestamp",
    )
    known = R.attach_industry(R.attach_source(articles, sources), industries)
    scored = R.score_articles(known, F.lit(NOW))
    top = R.top_articles(scored, ["source_id"], R.largest_top_n(industries)).orderBy("rank").collect()
    return [r.title for r in top], R.filter_report(known, F.lit(NOW)).first()


def test_score_and_rank(spark):
    titles, report = ranked(spark, [(f"新闻{i}", 2, 5, None) for i in range(20)], 5)
    assert titles == [f"新闻{i}" for i in range(5)]  # equal scores keep input order
    assert (report.total, report.filtered, report.kept, report.top) == (20, 0, 20, 5)
    assert ranked(spark, [("赞助招聘内容", 2, 5, "!赞助"), ("正常行业新闻", 2, 5, "!赞助")], 10)[0] == ["正常行业新闻"]
    assert ranked(spark, [("A", 2, 2, None), ("B", 2, 9, None)], 2)[0][0] == "B"
    assert ranked(spark, [("旧新闻", 20, 5, None), ("新新闻", 1, 5, None)], 2)[0][0] == "新新闻"
    assert ranked(spark, [("唯一新闻", 2, 5, None)], 10)[0] == ["唯一新闻"]


@pytest.mark.parametrize("parts", [1, 17])
def test_top_per_group_with_a_hot_group(spark, parts):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 101).alias("v")
    ).repartition(parts)
    got = {(r.g, r.rank): r.id for r in top_per_group(
        df, ["g"], [F.desc("v"), F.asc("id")], spread=["id"], limit=5).collect()}
    groups = {}
    for i in range(3000):
        groups.setdefault(0 if i % 3 else i % 7, []).append((-(i * 7919 % 101), i))
    want = {(g, n + 1): i for g, rows in groups.items() for n, (_, i) in enumerate(sorted(rows)[:5])}
    assert got == want
