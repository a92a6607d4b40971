"""Pages to link rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courant.functions import html as H
from courant.functions.selectors import own_anchors, own_count, selector_fault
from courant.functions.urls import split_base


def selector_faults(sources: DataFrame, selector_col: str = "link_selector") -> DataFrame:
    """(id, error) of the sources whose selector is not supported: they fail, the others go on."""
    return sources.select("id", selector_fault(F.col(selector_col)).alias("error")).where("error IS NOT NULL")


def extract_links(
    pages: DataFrame, selector: str | None = None, base: str = "url", keep: tuple[str, ...] = ("page_id",),
    selector_col: str | None = None,
) -> DataFrame:
    """One row (page columns, pos, title, url) per article link of each page.

    One selector serves all pages or, with `selector_col`, each page names its
    own in that column; a page with one that is not supported has no links.

    Repeats of a url are dropped before short titles are, so a first occurrence
    with a poor title hides a later good one. Everything happens inside the
    page's row: no shuffle.
    """
    html = F.col("html")
    found = H.anchors(html, selector) if selector_col is None else own_anchors(html, F.col(selector_col))
    staged = pages.select(*keep, split_base(F.col(base)).alias("_base"), found.alias("_a"))
    staged = staged.select(*keep, H.link_targets(F.col("_a"), F.col("_base")).alias("_links"))
    staged = staged.select(*keep, "_links", F.col("_links")["url"].alias("_urls"))
    first = F.filter(
        F.col("_links"),
        lambda a, i: (F.array_position(F.col("_urls"), a["url"]) == i + 1)
        & (F.length(a["title"]) >= H.MIN_TITLE),
    )
    return (
        staged.select(*keep, F.explode(first).alias("_link"))
        .select(*keep, "_link.pos", "_link.title", "_link.url")
    )


def count_anchors(pages: DataFrame, selector: str | None = None, selector_col: str | None = None) -> DataFrame:
    """Pages with the number of elements the selector matches, before any link rule.

    With `selector_col`, each row's own one counts; null where it is not supported.
    """
    html = F.col("html")
    found = H.count_selected(html, selector) if selector_col is None else own_count(html, F.col(selector_col))
    return pages.withColumn("n_links", found)


def page_texts(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Summary and full article text of each page."""
    return pages.select(
        *keep,
        H.extract_summary(F.col("html")).alias("summary"),
        H.extract_article_text(F.col("html")).alias("article_text"),
    )


def paragraph_faults(pages: DataFrame, for_summary: bool) -> DataFrame:
    """How many paragraphs are kept and how many dropped, by reason."""
    area = H.summary_area if for_summary else H.article_area
    return (
        pages.select(F.explode(H.paragraphs(area(F.col("html")))).alias("text"))
        .select(F.coalesce(H.paragraph_fault(F.col("text"), for_summary), F.lit("kept")).alias("reason"))
        .groupBy("reason").agg(F.count("*").alias("n"))
    )
