"""Readiness, outcome and failure history of the pushes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courant.operators.streaks import running_streak
from courant.session import small_side

# Reasons, limits and formats in the push log.
NO_SOURCES, NO_ITEMS = "未配置新闻源", "未配置金融数据项"
NO_RECIPIENTS, NO_SMTP = "未配置收件人", "未配置 SMTP"
NO_NEWS, NO_QUOTES = "无新增文章（所有文章已在历史记录中）", "无金融行情数据"
LOG_ERROR_CHARS, ALERT_ERROR_CHARS, ALERT_AFTER = 1000, 500, 3
PUSH_LABELS = {"morning": "早报", "evening": "晚报"}
ALERT_SUBJECT = "【告警】%s %s已连续失败 %d 次"


def _counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("industry_id").agg(F.count("*").alias(name))


def readiness(
    industries: DataFrame, inputs: DataFrame, recipients: DataFrame, smtp: DataFrame, push_type: str
) -> DataFrame:
    """Per industry, the first thing that is missing for a push; null means ready."""
    no_input = NO_SOURCES if push_type == "morning" else NO_ITEMS
    has_smtp = smtp.agg(F.count("*") > 0).scalar()
    joined = (
        industries.select(F.col("id").alias("industry_id"), F.col("name").alias("industry_name"))
        .join(_counts(inputs, "n_inputs"), "industry_id", "left")
        .join(_counts(recipients, "n_recipients"), "industry_id", "left")
        .fillna(0, ["n_inputs", "n_recipients"])
        .withColumn("has_smtp", has_smtp)
    )
    reason = (
        F.when(F.col("n_inputs") == 0, no_input)
        .when(F.col("n_recipients") == 0, NO_RECIPIENTS)
        .when(~F.col("has_smtp"), NO_SMTP)
    )
    return joined.select(
        "industry_id", "industry_name", F.lit(push_type).alias("push_type"),
        "n_recipients", reason.alias("reason"),
    )


def outcomes(ready: DataFrame, results: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One log row per industry.

    `results` are the rows of the reports, with their industry; `errors`
    (industry_id, message) says which pushes broke while being sent.
    """
    joined = ready.join(_counts(results, "n_rows"), "industry_id", "left").fillna(0, ["n_rows"])
    if errors is None:
        joined = joined.withColumn("message", F.lit(None).cast("string"))
    else:
        joined = joined.join(errors.select("industry_id", "message"), "industry_id", "left")
    not_ready, broke = F.col("reason").isNotNull(), F.col("message").isNotNull()
    nothing = F.when(F.col("push_type") == "morning", NO_NEWS).otherwise(F.lit(NO_QUOTES))
    return joined.select(
        "industry_id", "push_type",
        F.when(not_ready, "skipped").when(broke, "failed")
        .when(F.col("n_rows") == 0, "skipped").otherwise("success").alias("status"),
        F.when(not_ready | broke, 0).otherwise(F.col("n_rows")).cast("long").alias("article_count"),
        F.when(not_ready, 0).otherwise(F.col("n_recipients")).cast("long").alias("recipient_count"),
        F.when(not_ready, F.col("reason"))
        .when(broke, F.substring("message", 1, LOG_ERROR_CHARS))
        .when(F.col("n_rows") == 0, nothing).alias("error_msg"),
    )


def log_rows(outcome: DataFrame, bodies: DataFrame, as_of: Column, triggered_by: str) -> DataFrame:
    """Rows for the push log, with the report of each successful push as snapshot."""
    return (
        outcome.join(bodies.select("industry_id", F.col("body").alias("html_snapshot")), "industry_id", "left")
        .withColumn("html_snapshot", F.when(F.col("status") == "success", F.col("html_snapshot")))
        .withColumns({"triggered_by": F.lit(triggered_by), "created_at": as_of})
    )


def failure_streaks(log: DataFrame, tie: str = "id", **chunking) -> DataFrame:
    """Each log row with the failures in a row of its industry and push type.

    A success ends the streak, and so does a push that had nothing to send. A
    push skipped for its configuration neither adds nor ends anything.
    """
    config_skip = (F.col("status") == "skipped") & F.col("error_msg").isin(
        NO_SOURCES, NO_ITEMS, NO_RECIPIENTS, NO_SMTP
    )
    failed = F.col("status") == "failed"
    return running_streak(
        log, ["industry_id", "push_type"], "created_at", tie,
        add=failed, reset=~failed & ~F.coalesce(config_skip, F.lit(False)), name="streak", **chunking,
    )


def failure_alerts(counted: DataFrame, industries: DataFrame, threshold: int = ALERT_AFTER) -> DataFrame:
    names = industries.select(F.col("id").alias("industry_id"), F.col("name").alias("industry_name"))
    label = F.when(F.col("push_type") == "morning", PUSH_LABELS["morning"]).otherwise(PUSH_LABELS["evening"])
    due = counted.where((F.col("status") == "failed") & (F.col("streak") >= threshold))
    return due.join(small_side(names), "industry_id").withColumns({
        "subject": F.format_string(ALERT_SUBJECT, "industry_name", label, "streak"),
        "error": F.substring("error_msg", 1, ALERT_ERROR_CHARS),
    })


def recipients_of(reports: DataFrame, recipients: DataFrame) -> DataFrame:
    """One row per report and recipient. Bodies stay out: they join by industry when sent."""
    return reports.select("industry_id", "subject").join(
        recipients.select("industry_id", "email"), "industry_id"
    )
