"""Push schedules: defaults, validity, and which jobs are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed hours, defaults, daily jobs and the wall clock's zone.
ALLOWED_HOURS = {"morning": (6, 12), "evening": (16, 21)}
DEFAULT_HOUR, EVENING_HOUR = 9, 18
DAILY_JOBS = (("daily_cleanup", 2, 0), ("daily_health_check", 6, 0))
ZONE = "Asia/Shanghai"


def is_valid(push_type: Column, hour: Column) -> Column:
    ok = F.lit(False)
    for kind, (low, high) in ALLOWED_HOURS.items():
        ok = ok | ((push_type == kind) & hour.between(low, high))
    return F.coalesce(ok, F.lit(False))


def validate(schedules: DataFrame) -> DataFrame:
    return schedules.withColumn("is_valid", is_valid(F.col("push_type"), F.col("hour")))


def with_default_time(schedules: DataFrame) -> DataFrame:
    """An hour that is missing or still the default becomes the push type's default.

    Only then does a missing minute become 0.
    """
    unset = F.col("hour").isNull() | (F.col("hour") == DEFAULT_HOUR)
    default = F.when(F.col("push_type") == "evening", EVENING_HOUR).otherwise(DEFAULT_HOUR)
    return schedules.withColumns({
        "hour": F.when(unset, default).otherwise(F.col("hour")),
        "minute": F.when(unset, F.coalesce("minute", F.lit(0))).otherwise(F.col("minute")),
    })


def move_early_evenings(schedules: DataFrame) -> DataFrame:
    """Evening pushes before noon move to 18:00; `changed` marks them."""
    early = (F.col("push_type") == "evening") & (F.col("hour") < 12)
    return schedules.withColumns({
        "changed": F.coalesce(early, F.lit(False)),
        "hour": F.when(early, EVENING_HOUR).otherwise(F.col("hour")),
        "minute": F.when(early, 0).otherwise(F.col("minute")),
    })


def active_jobs(schedules: DataFrame) -> DataFrame:
    """Enabled schedules by job id; of several with one id the last counts."""
    job = F.concat_ws("_", "push_type", "industry_id")
    last = (
        schedules.where("enabled")
        .groupBy(job.alias("job_id"))
        .agg(F.max(F.struct("id", "industry_id", "push_type", "hour", "minute")).alias("_last"))
    )
    return last.select("job_id", "_last.industry_id", "_last.push_type", "_last.hour", "_last.minute")


def daily_jobs(like: DataFrame) -> DataFrame:
    """The fixed jobs, with the columns of `active_jobs`."""
    spark = like.sparkSession
    rows = [(job, None, None, hour, minute) for job, hour, minute in DAILY_JOBS]
    return spark.createDataFrame(rows, like.schema)


def due_jobs(jobs: DataFrame, after: Column, until: Column) -> DataFrame:
    """Times in (after, until] at which each job fires, in UTC."""
    local = lambda ts: F.to_date(F.from_utc_timestamp(ts, ZONE))
    days = jobs.withColumn("_day", F.explode(F.sequence(local(after), local(until))))
    clock = F.col("_day").cast("timestamp") + F.make_dt_interval(
        hours=F.col("hour"), mins=F.col("minute")
    )
    fires = days.withColumn("fires_at", F.to_utc_timestamp(clock, ZONE)).drop("_day")
    return fires.where((F.col("fires_at") > after) & (F.col("fires_at") <= until))
