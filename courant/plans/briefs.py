"""The two briefs, for all industries in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courant.functions import answers as A
from courant.functions import html as H
from courant.operators import delivery, quotes as Q, ranking as R
from courant.operators.dedup import dedup_titles
from courant.operators.links import extract_links, selector_faults
from courant.plans import reports
from courant.session import checkpointed, small_side
from courant.sources.tables import seen_rows, unseen

ORDER = ["source_id", "page_id", "pos"]


def fresh_links(
    pages: DataFrame, seen: DataFrame, selector: str | None = None, sources: DataFrame | None = None
) -> DataFrame:
    """Links of the pages that were fetched, without those pushed before.

    With `sources` (id, link_selector), each page is read with its source's own selector.

    `pages` holds all sources at once, and a source that failed has no good
    page, so it adds nothing and stops nothing.
    """
    ok, keep = pages.where("fetch_ok").select("source_id", "page_id", "url", "html"), ("source_id", "page_id")
    if sources is None:
        return unseen(extract_links(ok, selector, keep=keep), seen)
    own = small_side(sources.select(F.col("id").alias("source_id"), "link_selector"))
    found = extract_links(ok.join(own, "source_id", "left"), keep=keep, selector_col="link_selector")
    return unseen(found, seen)


def with_summary(links: DataFrame, details: DataFrame) -> DataFrame:
    """Add the extracted summary of each link's own page, the empty text if it has none.

    `details` holds one row per url. Only the pages of these links are read; they
    are cut down to their summaries before the join, so that the join moves a
    line of text and not a page.
    """
    wanted = details.join(links.select("url").distinct(), "url", "left_semi")
    pages = wanted.select("url", H.extract_summary(F.col("html")).alias("_summary"))
    given = F.lit(None).cast("string")
    return links.join(pages, "url", "left").withColumn(
        "summary", A.or_extract(given, F.col("_summary"))
    ).drop("_summary")


def with_answers(
    links: DataFrame, details: DataFrame, sources: DataFrame, summarizer: Callable, default_lang: str = "zh"
) -> DataFrame:
    """Links with title, `summary` and `error` as the summarizer and the source's language make them.

    A page is asked about once for each title and language it is linked with. What
    was answered is written to the shared folder: a summarizer is dear and need
    not say the same twice, so nothing that reads the result calls it again.
    """
    lang = sources.select(F.col("id").alias("source_id"), F.coalesce("language", F.lit(default_lang)).alias("lang"))
    routed = links.join(small_side(lang), "source_id")
    asked = routed.select("url", "lang", "title").distinct()
    wanted = details.join(asked.select("url").distinct(), "url", "left_semi")
    texts = wanted.select(
        "url", H.extract_article_text(F.col("html")).alias("article_text"),
        H.extract_summary(F.col("html")).alias("extracted"),
    )
    answered = checkpointed(
        summarize_with(asked.withColumn("asked", F.col("title")).join(texts, "url"), summarizer, keep_text=False)
        .select("url", "lang", "asked", F.col("title").alias("_title"), "summary", "error")
    )
    return (
        routed.withColumnRenamed("title", "asked").join(answered, ["url", "lang", "asked"], "left")
        .withColumns({"title": F.coalesce("_title", "asked"), "summary": F.coalesce("summary", F.lit(""))})
        .select(*links.columns, "summary", "error")
    )


def _answers(summarizer: Callable, rows: pd.DataFrame) -> tuple[list[str | None], list[str | None]]:
    """Answers and errors of a batch; a failing one is halved until its bad rows stand alone."""
    if rows.empty:
        return [], []
    try:
        answers = list(summarizer(rows["lang"], rows["title"], rows["_body"]))
        if len(answers) != len(rows):
            raise ValueError(f"{len(answers)} answers to {len(rows)} texts")
        return answers, [None] * len(rows)
    except Exception as e:  # any failure of the user's function is reported with its row
        if len(rows) == 1:
            return [None], [f"{type(e).__name__}: {e}"]
    half = len(rows) // 2
    parts = [_answers(summarizer, part) for part in (rows.iloc[:half], rows.iloc[half:])]
    return [a for p, _ in parts for a in p], [e for _, q in parts for e in q]


def summarize_with(
    articles: DataFrame,
    summarizer: Callable[[pd.Series, pd.Series, pd.Series], Sequence[str | None]],
    limit: int = H.SUMMARY_CHARS,
    keep_text: bool = True,
) -> DataFrame:
    """Run a summarizer over `article_text`, batch by batch, and read its answers.

    Where a batch fails, its halves are tried, so that a bad row costs its own
    answer only and some calls more, two for each halving. `error` says why a row failed.

    `articles` has title, lang, article_text and extracted (the fallback). The
    function gets (lang, title, text) as Series and returns one answer per row,
    or None where it failed. Texts too short to summarize are not passed on. A
    row without an answer keeps its title and gets the extracted summary.
    Without `keep_text` the result has no article_text, and no whole text goes to Python.
    """
    ready = articles.withColumn("_body", F.when(
        A.long_enough(F.col("article_text"), F.col("lang")), A.head_and_tail(F.col("article_text"))
    ))
    if not keep_text:
        articles, ready = articles.drop("article_text"), ready.drop("article_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chosen = batch[batch["_body"].notna()]
            batch["_answer"], batch["error"] = None, None
            answered, errors = _answers(summarizer, chosen)
            batch.loc[chosen.index, "_answer"] = pd.Series(answered, chosen.index, dtype=object)
            batch.loc[chosen.index, "error"] = pd.Series(errors, chosen.index, dtype=object)
            yield batch.drop(columns="_body")

    schema = T.StructType([
        *(T.StructField(f.name, f.dataType) for f in articles.schema), T.StructField("_answer", T.StringType()),
        T.StructField("error", T.StringType()),
    ])
    answered = ready.mapInPandas(run, schema)
    parts = F.when(
        F.col("_answer").isNotNull(), A.read_answer(F.col("lang"), F.col("_answer"), F.col("title"), limit)
    )
    return (
        answered.withColumn("_parts", parts)
        .withColumn("title", F.coalesce("_parts.title", "title"))
        .withColumn("summary", A.or_extract(F.col("_parts.summary"), F.col("extracted")))
        .drop("_answer", "_parts")
    )


@dataclass
class Brief:
    """What a brief yields: ranked rows, mails, log rows, rows to remember, failed sources and summaries."""

    rows: DataFrame
    reports: DataFrame
    log: DataFrame
    seen: DataFrame | None = None
    failed: DataFrame | None = None  # sources that could not be read, and why
    unanswered: DataFrame | None = None  # links whose summarizer failed, and why


def rank_articles(
    articles: DataFrame, sources: DataFrame, industries: DataFrame, as_of: Column,
    order: Sequence[str] = tuple(ORDER),
    dedup: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None,
) -> DataFrame:
    """Deduplicate per industry, then filter, score and take the Top-N.

    Titles are deduplicated before the keyword filter, so a copy that would
    pass can be lost to an earlier one that does not; that order is kept.
    """
    if dedup is None:
        dedup = lambda df, o: dedup_titles(df, o, within=["industry_id"])
    known = R.attach_source(articles, sources)
    once = dedup(known, list(order))
    scored = R.score_articles(R.attach_industry(once, industries), as_of)
    return R.top_articles(scored, list(order), R.largest_top_n(industries))


def read_links(
    pages: DataFrame, details: DataFrame, seen: DataFrame, sources: DataFrame,
    selector: str | None = None, summarizer: Callable | None = None,
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Fresh links with their summaries; links whose summarizer failed and why; sources that could not be read and why."""
    configured = sources if "link_selector" in sources.columns else None
    fresh = fresh_links(pages, seen, selector, configured)
    failed = None if configured is None else selector_faults(configured)
    if summarizer is None:
        return with_summary(fresh, details), None, failed
    links = with_answers(fresh, details, sources, summarizer)
    unanswered = links.where("error IS NOT NULL").select(*ORDER, "url", "error")
    return links.drop("error"), unanswered, failed


def morning_brief(
    pages: DataFrame, details: DataFrame, seen: DataFrame, sources: DataFrame,
    industries: DataFrame, recipients: DataFrame, smtp: DataFrame, as_of: Column,
    selector: str | None = None, triggered_by: str = "scheduler", errors: DataFrame | None = None,
    summarizer: Callable | None = None,
) -> Brief:
    """Pages to mails. One snapshot of what was seen serves all industries of a run.

    Where `sources` has `link_selector`, each source is read with its own. With a
    `summarizer` (as in `summarize_with`), titles and summaries are its answers,
    by the `language` of the source; titles are deduplicated after that.
    `errors` (industry_id, message) tells which mails could not be sent, so that the log says so.
    """
    ready = delivery.readiness(industries, sources, recipients, smtp, "morning")
    able = ready.where("reason IS NULL").select(F.col("industry_id").alias("id"))
    links, unanswered, failed = read_links(pages, details, seen, sources, selector, summarizer)
    links = links.withColumn("published_at", as_of)
    top = rank_articles(links, sources, industries.join(able, "id"), as_of)
    mails = reports.morning_report(top, smtp)
    log = delivery.log_rows(delivery.outcomes(ready, top, errors), mails, as_of, triggered_by)
    return Brief(top, mails, log, seen_rows(top, seen, ["industry_id", "rank"], as_of), failed, unanswered)


def evening_brief(
    items: DataFrame, snapshot: DataFrame, industries: DataFrame, recipients: DataFrame,
    smtp: DataFrame, as_of: Column, words: Mapping[str, Sequence[str]] = Q.COMMODITY_WORDS,
    preferred: str = Q.PREFERRED_WORD, triggered_by: str = "scheduler", errors: DataFrame | None = None,
) -> Brief:
    """Watch-lists to mails, from one scan of the market snapshot; `errors` as in `outcomes`."""
    ready = delivery.readiness(industries, items, recipients, smtp, "evening")
    able = ready.where("reason IS NULL").select("industry_id")
    found = Q.fetch_quotes(items.join(able, "industry_id", "left_semi"), snapshot, as_of, words, preferred)
    mails = reports.evening_report(found, industries, smtp)
    log = delivery.log_rows(delivery.outcomes(ready, found, errors), mails, as_of, triggered_by)
    return Brief(found, mails, log)
