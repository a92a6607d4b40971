"""One health run over all sources: checks, streaks, alerts and new states in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courant.operators import health
from courant.operators.links import count_anchors

UNSUPPORTED = "selector not supported"
COLUMNS = ["check_id", "source_id", "checked_at", "status", "error"]


@dataclass
class HealthRun:
    """Rows for the check log with their streak, alerts to send, and the state of each source."""

    checks: DataFrame
    alerts: DataFrame
    states: DataFrame


def classified(fetched: DataFrame, as_of: Column) -> DataFrame:
    """The checks of what was fetched, as rows of the log."""
    counted = count_anchors(fetched, selector_col="link_selector")
    broken = (F.col("outcome") == "ok") & F.col("n_links").isNull() & F.col("html").isNotNull()
    counted = counted.withColumns({
        "message": F.when(broken, UNSUPPORTED).otherwise(F.col("message")),
        "outcome": F.when(broken, "other").otherwise(F.col("outcome")),
    })
    return health.classify(counted).withColumn("checked_at", as_of).select(*COLUMNS)


def health_check(fetched: DataFrame, history: DataFrame, sources: DataFrame, as_of: Column) -> HealthRun:
    """Classify what was fetched and carry the history of each source on.

    `fetched` has check_id, source_id, html, outcome, http_status, message and
    link_selector; `history` is the log of earlier checks. A source whose
    selector is not supported fails, the others go on.
    """
    new = classified(fetched, as_of)
    every = history.select(*COLUMNS, F.lit(False).alias("_new")).unionByName(new.withColumn("_new", F.lit(True)))
    failures = health.consecutive_failures(every).where("_new").drop("_new")
    return HealthRun(failures, health.alerts(failures, sources), health.latest(every.drop("_new"), sources))


def health_step(fetched: DataFrame, state: DataFrame, sources: DataFrame, as_of: Column) -> tuple[HealthRun, DataFrame]:
    """As `health_check`, from the stored state of each source instead of the log; also the state to store next."""
    counted, after = health.next_state(state, classified(fetched, as_of))
    return HealthRun(counted, health.alerts(counted, sources), health.state_of(after, sources)), after
