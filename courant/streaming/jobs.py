"""The memories of the batch jobs as streaming state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from courant.operators.ranking import attach_industry, attach_source, score_articles
from courant.operators.ratelimit import LIMIT, WINDOW_SECONDS
from courant.plans.briefs import ORDER, fresh_links, with_summary
from courant.sources.tables import first_per_key
from courant.streaming.inorder import Failures, RateLimit, in_order

SEEN_DAYS = 7
SEEN_FOR = f"{SEEN_DAYS} days"


def unseen_stream(articles: DataFrame, time: str = "published_at", key: str = "url") -> DataFrame:
    """Each url once in seven days. Rows later than that are dropped."""
    return articles.withWatermark(time, SEEN_FOR).dropDuplicatesWithinWatermark([key])


def failure_stream(
    checks: DataFrame, time: str = "checked_at", tie: str = "check_id", lateness_seconds: int = 3600,
) -> DataFrame:
    """Checks with their failures in a row, counted in the order of their times.

    A check comes out once the watermark, `lateness_seconds` behind the newest
    one, has passed it; until then earlier ones may arrive in any order. One that
    comes later still has null failures and counts for nothing.
    """
    processor = Failures(checks.columns, "failures", "source_id", tie, _bucket_ms(lateness_seconds))
    return in_order(checks, "source_id", time, T.StructField("failures", T.LongType()), lateness_seconds, processor)


def _bucket_ms(lateness_seconds: int) -> int:
    """An eighth of the lateness: what a row may wait longer than it has to."""
    return max(1, lateness_seconds * 125)


def rate_limit_stream(
    attempts: DataFrame, key: str, time: str, tie: str,
    limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS, lateness_seconds: int | None = None,
) -> DataFrame:
    """Attempts with their verdict, given in the order of their times.

    Verdicts come out as the watermark passes; it stays `lateness_seconds` (a
    window, if not given) behind the newest attempt. An attempt behind it, or
    without a time, has a null verdict and counts for nothing. State is the
    attempts that wait and the allowed times of the last window, which a timer
    clears.
    """
    lateness = window_seconds if lateness_seconds is None else lateness_seconds
    processor = RateLimit(attempts.columns, "allowed", key, tie, _bucket_ms(lateness), limit, window_seconds * 1_000_000)
    return in_order(attempts, key, time, T.StructField("allowed", T.BooleanType()), lateness, processor)


def briefing_stream(
    pages: DataFrame, details: DataFrame, seen: DataFrame, sources: DataFrame, industries: DataFrame,
    as_of: Column, out: str, selector: str | None = None,
) -> DataStreamWriter:
    """Scored fresh articles of each micro-batch of pages, appended under `out`.

    Where `sources` has `link_selector`, each source's pages are read with its own.

    What earlier micro-batches wrote in the last seven days counts as seen; only
    the url column of those days' folders is read. A micro-batch writes its own
    folder, so one that is run again after a failure replaces its rows.
    """

    def brief(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        today = spark.range(1).select(F.to_date(as_of)).first()[0]
        earlier = seen.select("url")
        if batch_id > 0:
            written = spark.read.schema("url string, day date, batch_id long").parquet(out)
            recent = (F.col("day") >= F.date_sub(F.lit(today), SEEN_DAYS)) & (F.col("batch_id") < batch_id)
            earlier = earlier.unionByName(written.where(recent).select("url"))
        scored_articles(batch, details, earlier, sources, industries, as_of, selector).write.mode(
            "overwrite"
        ).parquet(f"{out}/day={today}/batch_id={batch_id}")

    return pages.writeStream.foreachBatch(brief).trigger(availableNow=True)


def scored_articles(
    pages: DataFrame, details: DataFrame, seen: DataFrame, sources: DataFrame, industries: DataFrame,
    as_of: Column, selector: str | None = None,
) -> DataFrame:
    """The batch form: one row per fresh url that passes the keywords, with its score."""
    configured = sources if "link_selector" in sources.columns else None
    links = first_per_key(fresh_links(pages, seen, selector, configured), ["url"], ORDER)
    articles = with_summary(links, details).withColumn("published_at", as_of)
    return score_articles(attach_industry(attach_source(articles, sources), industries), as_of).select(
        "industry_id", *ORDER, "title", "url", "summary", "score"
    )
