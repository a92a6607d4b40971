"""Health of the news sources, from the log of their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courant.operators.streaks import running_streak
from courant.session import small_side

# Thresholds, message formats and display labels.
ALERT_AFTER = 3
ERROR_CHARS = 200
TIMEOUT_SECONDS = 10.0
NO_LINKS = "页面正常但未找到链接（选择器: %s）"
TIMED_OUT = f"请求超时（>{TIMEOUT_SECONDS}s）"
LABELS = {"healthy": "✓ 正常", "warning": "⚠ 警告", "error": "✗ 异常", "unknown": "? 未知"}
ALERT_SUBJECT = "【告警】新闻源「%s」已连续检查失败 %d 次"


def classify(fetched: DataFrame) -> DataFrame:
    """Status and error of each check.

    Input columns: `outcome` (ok, timeout, http, other), `http_status`,
    `message`, `n_links`, `link_selector`.
    """
    outcome = F.col("outcome")
    status = F.when(outcome != "ok", "error").when(F.col("n_links") > 0, "healthy").otherwise("warning")
    selector = F.coalesce(F.nullif("link_selector", F.lit("")), F.lit("a"))
    error = (
        F.when(outcome == "timeout", TIMED_OUT)
        .when(outcome == "http", F.format_string("HTTP %d", "http_status"))
        .when(outcome == "other", F.substring("message", 1, ERROR_CHARS))
        .when(F.col("n_links") == 0, F.format_string(NO_LINKS, selector))
    )
    return fetched.withColumns({"status": status, "error": error})


def consecutive_failures(checks: DataFrame, tie: str = "check_id", **chunking) -> DataFrame:
    """Each check with the failures in a row up to it: +1 on error, else back to 0."""
    is_error = F.col("status") == "error"
    return running_streak(
        checks, ["source_id"], "checked_at", tie,
        add=is_error, reset=~is_error, name="failures", **chunking,
    )


def alerts(counted: DataFrame, sources: DataFrame, threshold: int = ALERT_AFTER) -> DataFrame:
    """An alert for every failed check from the threshold on, not only the first."""
    due = counted.where((F.col("status") == "error") & (F.col("failures") >= threshold))
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "url")
    subject = F.format_string(ALERT_SUBJECT, "source_name", "failures")
    body = F.format_string(
        "<p><b>%s</b>: %d</p><p><code>%s</code></p><p><code>%s</code></p>",
        "source_name", "failures", "url", F.coalesce("error", F.lit("")),
    )
    return due.join(small_side(names), "source_id").withColumns({"subject": subject, "body": body})


def rollup(checks: DataFrame) -> DataFrame:
    """Totals by status."""
    return checks.agg(*[
        F.count_if(F.col("status") == s).alias(s) for s in ("healthy", "warning", "error")
    ])


def latest(checks: DataFrame, sources: DataFrame, tie: str = "check_id") -> DataFrame:
    """Current state of each source; one never checked is unknown.

    Only aggregates with a map-side part: the last check, the last good check,
    and a count of the errors after that. No history is sorted.
    """
    when_ = F.struct("checked_at", tie)
    is_error = F.col("status") == "error"
    last = checks.groupBy("source_id").agg(
        F.max(F.struct("checked_at", tie, "status", "error")).alias("_last"),
        F.max(F.when(~is_error, when_)).alias("_good"),
    )
    errors = checks.where(is_error).select("source_id", when_.alias("_when"))
    trailing = (
        errors.join(last.select("source_id", "_good"), "source_id")
        .where(F.col("_good").isNull() | (F.col("_when") > F.col("_good")))
        .groupBy("source_id").agg(F.count("*").alias("_failures"))
    )
    return (
        sources.select(F.col("id").alias("source_id"), "name")
        .join(last.drop("_good"), "source_id", "left")
        .join(trailing, "source_id", "left")
        .select(
            "source_id", "name",
            F.coalesce("_last.status", F.lit("unknown")).alias("health_status"),
            F.col("_last.checked_at").alias("last_check_at"),
            F.col("_last.error").alias("last_error"),
            F.coalesce("_failures", F.lit(0)).alias("consecutive_failures"),
        )
    )


def next_state(state: DataFrame, new: DataFrame, tie: str = "check_id", **chunking) -> tuple[DataFrame, DataFrame]:
    """(counted, state): new checks with their failures in a row, and the state after them.

    `state` has source_id, checked_at, the tie, status, error and failures of the
    last check of each source; it stands for the whole log. All checks of `new`
    are later than those. Nothing but the state and the new checks is read: a
    streak without a break since the first new check goes on from the stored one.
    """
    is_error = F.col("status") == "error"
    order = ["source_id"], "checked_at", tie
    local = running_streak(new, *order, add=is_error, reset=~is_error, name="_run", **chunking)
    local = running_streak(local, *order, add=F.lit(True), reset=F.lit(False), name="_nth", **chunking)
    before = state.select(F.col("source_id").alias("_source"), F.col("failures").alias("_failures"))
    unbroken = F.col("_run") == F.col("_nth")
    counted = local.join(before, F.col("source_id") == F.col("_source"), "left").withColumn(
        "failures", F.col("_run") + F.when(unbroken, F.coalesce("_failures", F.lit(0))).otherwise(0)
    ).drop("_run", "_nth", "_source", "_failures")
    columns = ["checked_at", tie, "status", "error", "failures"]
    both = state.select("source_id", *columns).unionByName(counted.select("source_id", *columns))
    last = both.groupBy("source_id").agg(F.max(F.struct(*columns)).alias("_last"))
    return counted, last.select("source_id", "_last.*")


def state_of(state: DataFrame, sources: DataFrame) -> DataFrame:
    """A stored state as `latest` gives it: a row for each source, one never checked is unknown."""
    return (
        sources.select(F.col("id").alias("source_id"), "name").join(state, "source_id", "left").select(
            "source_id", "name", F.coalesce("status", F.lit("unknown")).alias("health_status"),
            F.col("checked_at").alias("last_check_at"), F.col("error").alias("last_error"),
            F.coalesce("failures", F.lit(0)).alias("consecutive_failures"),
        )
    )


def status_label(status: Column) -> Column:
    label = F.lit(None).cast("string")
    for value, text in LABELS.items():
        label = F.when(status == value, text).otherwise(label)
    return F.coalesce(label, status)


def digest_lines(state: DataFrame) -> DataFrame:
    """One line per source: name, label, and the error if there is one."""
    line = F.concat(
        F.col("name"), F.lit(": "), status_label(F.col("health_status")),
        F.when(F.col("last_error") != "", F.concat(F.lit("（"), "last_error", F.lit("）"))).otherwise(F.lit("")),
    )
    return state.withColumn("line", line)


def digest(lines: DataFrame, ids: list[int]) -> DataFrame:
    """The lines of the sources a person asked for, in that order, as one text."""
    from courant.sources.tables import by_ids

    chosen = by_ids(lines, ids, "source_id").agg(
        F.array_sort(F.collect_list(F.struct("request_pos", "line"))).alias("_lines")
    )
    return chosen.select(
        F.concat(F.lit("健康检查完成："), F.array_join("_lines.line", "；")).alias("digest")
    )
