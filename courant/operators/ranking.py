"""Filter, score and rank articles, for all industries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courant.functions import keywords as K
from courant.functions import scores as S
from courant.operators.topk import top_per_group
from courant.session import small_side


def with_parsed_keywords(config: DataFrame, name: str, keywords: str = "keywords") -> DataFrame:
    """Parse keyword texts once per configuration row, before any join to articles."""
    given = F.when(F.col(keywords) != "", K.parse_keywords(F.col(keywords)))
    return config.withColumn(name, given)


def attach_source(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Copy name, weight, industry and parsed keywords of its source on each article.

    Sources are configuration: broadcast if small, so that a source with a
    third of the articles does not gather them in one task.
    """
    side = with_parsed_keywords(sources, "source_words").select(
        F.col("id").alias("source_id"), F.col("name").alias("source_name"),
        F.col("weight").alias("source_weight"), "industry_id", "source_words",
    )
    return articles.join(small_side(side), "source_id")


def attach_industry(articles: DataFrame, industries: DataFrame) -> DataFrame:
    side = with_parsed_keywords(industries, "industry_words").select(
        F.col("id").alias("industry_id"), F.col("name").alias("industry_name"),
        "top_n", "industry_words",
    )
    return articles.join(small_side(side), "industry_id")


def keyword_verdicts(articles: DataFrame, as_of: Column) -> DataFrame:
    """Add the verdict of the industry filter and the three partial scores.

    `keyword_part` is null when the source's keywords filter the article out.
    """
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    return articles.withColumns({
        "industry_ok": K.industry_match(text, F.col("industry_words")),
        "keyword_part": K.keyword_score(F.col("title"), F.col("source_words")),
        "time_part": S.timeliness(F.col("published_at"), as_of),
        "weight_part": S.weight_score(F.col("source_weight")),
    })


def score_articles(articles: DataFrame, as_of: Column) -> DataFrame:
    """Articles that pass both keyword levels, with their total score."""
    judged = keyword_verdicts(articles, as_of)
    kept = judged.where(F.col("industry_ok") & F.col("keyword_part").isNotNull())
    score = S.total_score(F.col("time_part"), F.col("weight_part"), F.col("keyword_part"))
    return kept.withColumn("score", score).drop("industry_ok")


def largest_top_n(industries: DataFrame) -> int:
    """The largest Top-N in the configuration: one number, from one small scan."""
    return industries.agg(F.coalesce(F.max("top_n"), F.lit(0))).first()[0]


def top_articles(scored: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Top-N per industry by score; equal scores keep input order."""
    return top_per_group(
        scored, ["industry_id"], [F.desc("score"), *[F.asc(c) for c in order]],
        spread=order, limit=limit, own_limit="top_n",
    )


def filter_report(articles: DataFrame, as_of: Column) -> DataFrame:
    """Per industry: articles in, filtered, kept, and how many make the Top-N."""
    judged = keyword_verdicts(articles, as_of)
    passes = F.col("industry_ok") & F.col("keyword_part").isNotNull()
    counts = judged.groupBy("industry_id", "top_n").agg(
        F.count("*").alias("total"), F.count_if(passes).alias("kept"),
    )
    return counts.select(
        "industry_id", "total", (F.col("total") - F.col("kept")).alias("filtered"), "kept",
        F.least("kept", F.col("top_n").cast("long")).alias("top"),
    )
