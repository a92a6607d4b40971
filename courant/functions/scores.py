"""Row-level scores of an article."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the three parts, and the hours after which news is old.
TIMELINESS_SHARE, WEIGHT_SHARE, KEYWORD_SHARE = 0.4, 0.3, 0.3
HOURS_FRESH = 24.0


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def timeliness(published_at: Column, as_of: Column) -> Column:
    """1 at publication, falling to 0 after a day; a future time gives more than 1."""
    age_hours = (micros(as_of) - micros(published_at)) / F.lit(3.6e9)
    return F.greatest(F.lit(0.0), F.lit(1.0) - age_hours / F.lit(HOURS_FRESH))


def weight_score(weight: Column) -> Column:
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), weight / F.lit(10.0)))


def total_score(time_part: Column, weight_part: Column, keyword_part: Column) -> Column:
    return (
        time_part * F.lit(TIMELINESS_SHARE)
        + weight_part * F.lit(WEIGHT_SHARE)
        + keyword_part * F.lit(KEYWORD_SHARE)
    )
