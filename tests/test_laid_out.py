from datetime import date, datetime, timedelta
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from courant.operators.retention import prune_seen
from courant.sources import history
from courant.sources.tables import unseen

T0 = datetime(2024, 1, 10, 12)


@pytest.fixture
def laid(spark):
    table = f"seen_{uuid4().hex}"
    rows = [(f"u{i}", f"t{i}", i % 3, T0 - timedelta(days=i % 12)) for i in range(240)]
    seen = spark.createDataFrame(rows, "url string, title string, source_id int, first_seen_at timestamp")
    history.store_days(seen, table, F.col("first_seen_at"), "url", buckets=4)
    yield table, seen
    spark.sql(f"DROP TABLE {table}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_wanted_days_are_listed_and_the_seen_side_stays(spark, laid):
    table, seen = laid
    fresh = spark.createDataFrame([(f"u{i}", i) for i in range(100, 400)], "url string, n int")
    first = (T0 - timedelta(days=7)).date()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = history.unseen_since(fresh, table, first)
        text = plan(got)
        rows = {r.url for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "PartitionFilters: [isnotnull(day" in text and f"(day#" in text and "SelectedBucketsCount: 4 out of 4" in text
    assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text
    kept = seen.where(F.col("first_seen_at") >= F.lit(datetime.combine(first, datetime.min.time())))
    assert rows == {r.url for r in unseen(fresh, kept).collect()} and len(rows) < 300


def test_a_day_written_again_replaces_itself(spark, laid):
    table, seen = laid
    before = sorted(map(tuple, spark.table(table).collect()))
    day = seen.where(F.to_date("first_seen_at") == F.lit(T0.date()))
    history.store_days(day, table, F.col("first_seen_at"), "url")
    assert sorted(map(tuple, spark.table(table).collect())) == before
    more = day.limit(1).withColumns({"url": F.lit("new"), "first_seen_at": F.lit(T0 + timedelta(days=1))})
    history.store_days(more, table, F.col("first_seen_at"), "url")
    assert spark.table(table).count() == len(before) + 1
    assert history.stored_days(spark, table)[-1] == date(2024, 1, 11)


def test_old_days_go_as_a_whole(spark, laid):
    table, seen = laid
    gone = history.drop_days(spark, table, (T0 - timedelta(days=7)).date())
    assert len(gone) == 4 and max(gone) < (T0 - timedelta(days=7)).date()
    midnight = F.lit(datetime.combine(T0.date(), datetime.min.time()))
    want = prune_seen(seen, midnight).collect()
    assert sorted(r.url for r in spark.table(table).collect()) == sorted(r.url for r in want)
    assert history.drop_days(spark, table, date(2000, 1, 1)) == []
