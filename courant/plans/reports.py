"""Report bodies, one row per mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courant.functions.display import quote_display
from courant.session import small_side

# Subjects and section headings.
MORNING_SUBJECT, EVENING_SUBJECT = "【%s】行业早报 - 今日要闻", "【%s】行业晚报 - 今日行情"
STOCK_HEADING, FUTURES_HEADING = "行业龙头股价", "大宗商品行情"


def contact(smtp: DataFrame) -> Column:
    """The address named in the footer, from the first configuration row."""
    address = F.coalesce(F.nullif("contact_email", F.lit("")), "username")
    return F.coalesce(smtp.orderBy("id").limit(1).select(address).scalar(), F.lit(""))


def _footer(bodies: DataFrame, smtp: DataFrame) -> DataFrame:
    end = F.concat(F.lit('<p class="contact">'), "contact", F.lit("</p>"))
    return bodies.withColumn("contact", contact(smtp)).withColumn("body", F.concat("body", end))


def morning_report(top: DataFrame, smtp: DataFrame) -> DataFrame:
    """Per industry with articles: subject, count and body, articles in rank order.

    At most Top-N rows of an industry come together here.
    """
    summary = F.when(
        F.col("summary") != "", F.concat(F.lit("<div>"), "summary", F.lit("</div>"))
    ).otherwise(F.lit(""))
    item = F.format_string(
        '<li><a href="%s">%s</a>%s<i>%s · %s</i></li>',
        "url", "title", summary, "source_name", F.date_format("published_at", "yyyy-MM-dd HH:mm"),
    )
    bodies = (
        top.select("industry_id", "industry_name", "rank", item.alias("item"))
        .groupBy("industry_id", "industry_name")
        .agg(
            F.count("*").alias("n_items"),
            F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("_items"),
        )
        .select(
            "industry_id", F.format_string(MORNING_SUBJECT, "industry_name").alias("subject"), "n_items",
            F.concat(F.lit("<ol>"), F.array_join("_items.item", ""), F.lit("</ol>")).alias("body"),
        )
    )
    return _footer(bodies, smtp).select("industry_id", "subject", "n_items", "contact", "body")


def report_lines(quotes: DataFrame) -> DataFrame:
    """One table line per quote, with its section; nothing is grouped."""
    line = F.format_string(
        '<tr><td>%s</td><td>%s</td><td>%s</td><td class="%s">%s</td><td>%s</td></tr>',
        "name", "symbol", "price_text", "direction", "change_text", "time_text",
    )
    section = F.when(F.col("item_type") == "stock", 0).otherwise(1)
    return quote_display(quotes).select("industry_id", "item_pos", section.alias("section"), line.alias("line"))


def evening_report(quotes: DataFrame, industries: DataFrame, smtp: DataFrame) -> DataFrame:
    """Per industry with quotes, one whole body: a table of stocks, then one of futures.

    A mail is one value, so the lines of an industry come together here; whoever
    needs them as rows, of any number, takes `evening_lines`.
    """
    names = industries.select(F.col("id").alias("industry_id"), F.col("name").alias("industry_name"))

    def table(section: int, heading: str) -> Column:
        lines = F.transform(
            F.filter(F.col("_lines"), lambda x: x["section"] == section), lambda x: x["line"]
        )
        text = F.concat(F.lit(f"<h2>{heading}</h2><table>"), F.array_join(lines, ""), F.lit("</table>"))
        return F.when(F.size(lines) > 0, text).otherwise(F.lit(""))

    bodies = (
        report_lines(quotes)
        .groupBy("industry_id")
        .agg(
            F.count("*").alias("n_items"),
            F.array_sort(F.collect_list(F.struct("section", "item_pos", "line"))).alias("_lines"),
        )
        .join(small_side(names), "industry_id")
        .select(
            "industry_id", F.format_string(EVENING_SUBJECT, "industry_name").alias("subject"), "n_items",
            F.concat(table(0, STOCK_HEADING), table(1, FUTURES_HEADING)).alias("body"),
        )
    )
    return _footer(bodies, smtp).select("industry_id", "subject", "n_items", "contact", "body")


LINE_ORDER = ["industry_id", "section", "part", "item_pos"]


def evening_lines(quotes: DataFrame, industries: DataFrame, smtp: DataFrame) -> DataFrame:
    """All evening bodies as one ordered table: (industry_id, section, part, item_pos, line).

    Read in order, the lines of an industry are its body: each section has its
    heading (part 0), its quotes (part 1) and its end (part 2), then comes the
    contact (section 2). Ranges of rows are sorted in tasks of their own, so an
    industry may have any number of lines; no value holds them all.
    """
    known = industries.select(F.col("id").alias("industry_id"))
    quoted = report_lines(quotes).join(small_side(known), "industry_id", "left_semi").select(
        "industry_id", "section", F.lit(1).alias("part"), "item_pos", "line")
    none = F.lit(None).cast(quoted.schema["item_pos"].dataType).alias("item_pos")
    heading = F.when(F.col("section") == 0, STOCK_HEADING).otherwise(FUTURES_HEADING)
    frame = quoted.select("industry_id", "section").distinct().select("industry_id", "section", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit("<h2>"), heading, F.lit("</h2><table>")).alias("line")),
        F.struct(F.lit(2).alias("part"), F.lit("</table>").alias("line")),
    )).alias("f")).select("industry_id", "section", "f.part", none, "f.line")
    footer = quoted.select("industry_id").distinct().select(
        "industry_id", F.lit(2).alias("section"), F.lit(0).alias("part"), none,
        F.concat(F.lit('<p class="contact">'), contact(smtp), F.lit("</p>")).alias("line"))
    return quoted.unionByName(frame).unionByName(footer).repartitionByRange(*LINE_ORDER).sortWithinPartitions(*LINE_ORDER)


def evening_totals(lines: DataFrame, industries: DataFrame) -> DataFrame:
    """Per industry: subject, quotes and characters of its body, added up in part before the shuffle."""
    names = industries.select(F.col("id").alias("industry_id"), F.format_string(EVENING_SUBJECT, "name").alias("subject"))
    totals = lines.groupBy("industry_id").agg(
        F.count_if((F.col("part") == 1) & (F.col("section") < 2)).alias("n_items"),
        F.sum(F.length("line")).alias("n_chars"),
    )
    return totals.join(small_side(names), "industry_id").select("industry_id", "subject", "n_items", "n_chars")


def body_lines(lines: DataFrame, industry_id: int) -> DataFrame:
    """The lines of one mail in order, for a sender that writes them out as they come."""
    return lines.where(F.col("industry_id") == industry_id).orderBy(*LINE_ORDER).select("line")
