from datetime import datetime

import pytest
from pyspark.sql import functions as F

from courant.operators import schedules as S
from courant.sources import schemas, tables

NOW = datetime(2024, 1, 31)


def test_seen_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "seen")
    old = spark.createDataFrame([("u1", "t1", 1, NOW)], "url string, title string, source_id int, first_seen_at timestamp")
    tables.publish(old, path)
    seen = spark.read.parquet(path)
    pushed = spark.createDataFrame([(1, "u1", "t", 1), (2, "u2", "later", 2), (0, "u2", "first", 1), (3, "u3", "x", None)],
                                   "n int, url string, title string, source_id int")
    tables.publish(tables.seen_rows(pushed, seen, ["n"], F.lit(NOW)), path)
    rows = {r.url: r.title for r in spark.read.parquet(path).collect()}
    assert rows == {"u1": "t1", "u2": "first", "u3": "x"} and spark.read.parquet(path).count() == 3


def test_replace_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "items")
    tables.publish(spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "industry_id int, symbol string"), path, partition_by=["industry_id"])
    tables.publish(spark.createDataFrame([(2, "d")], "industry_id int, symbol string"), path, "replace", ["industry_id"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("industry_id", "symbol").collect()) == [(1, "a"), (2, "d")]
    with pytest.raises(ValueError):
        tables.publish(spark.range(1), path, "replace")


def test_replace_rows_with_nothing_deletes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "industry_id int, symbol string")
    keys = spark.createDataFrame([(2,)], "industry_id int")
    assert [r.symbol for r in tables.replace_rows(df, df.limit(0), keys, "industry_id").collect()] == ["a"]


def test_lookups(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id int, name string")
    assert [r.name for r in tables.by_ids(df, [2, 9, 3]).collect()] == ["b", "c"]
    assert tables.first_config(df).first().name == "a"
    assert tables.by_id(df, 9).count() == 0


def test_schema_evolution(spark, tmp_path):
    path = str(tmp_path / "news_source")
    old = spark.createDataFrame([(1, 1, "n", "u", 5, "en")], "id int, industry_id int, name string, url string, weight int, language string")
    row = tables.add_columns(old, schemas.ADDED_COLUMNS["news_source"]).first()
    assert (row.language, row.health_status, row.consecutive_failures, row.link_selector) == ("en", "unknown", 0, None)
    tables.publish(old, path)
    assert tables.read_table(spark, "news_source", path).first().health_status is None


def test_schedule_times(spark):
    cases = [("evening", None, None, 18, 0), ("evening", 9, 0, 18, 0), ("evening", 18, 30, 18, 30),
             ("morning", None, None, 9, 0), ("morning", 9, 15, 9, 15), ("morning", 8, 0, 8, 0), ("morning", 8, None, 8, None)]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "id int, push_type string, hour int, minute int")
    got = [(r.hour, r.minute) for r in S.with_default_time(df).orderBy("id").collect()]
    assert got == [c[3:] for c in cases]
    limits = spark.createDataFrame([("morning", h) for h in (5, 6, 12, 13)] + [("evening", h) for h in (15, 16, 21, 22)] + [("noon", 8)],
                                   "push_type string, hour int")
    assert [r.is_valid for r in S.validate(limits).collect()] == [False, True, True, False, False, True, True, False, False]


def test_jobs(spark):
    rows = [(1, 7, "morning", 8, 30, True), (2, 7, "morning", 9, 0, True), (3, 7, "evening", 18, 0, False), (4, 8, "evening", 18, 0, True)]
    df = spark.createDataFrame(rows, "id int, industry_id int, push_type string, hour int, minute int, enabled boolean")
    jobs = S.active_jobs(df)
    assert {r.job_id: r.hour for r in jobs.collect()} == {"morning_7": 9, "evening_8": 18}
    both = jobs.unionByName(S.daily_jobs(jobs))
    after = F.lit(datetime(2024, 1, 30, 1, 0))
    due = S.due_jobs(both, after, F.lit(datetime(2024, 1, 31, 1, 0))).collect()
    assert {(r.job_id, r.fires_at) for r in due} == {
        ("morning_7", datetime(2024, 1, 31, 1, 0)), ("evening_8", datetime(2024, 1, 30, 10, 0)),
        ("daily_cleanup", datetime(2024, 1, 30, 18, 0)), ("daily_health_check", datetime(2024, 1, 30, 22, 0))}


def test_early_evenings(spark):
    df = spark.createDataFrame([(1, "evening", 9, 5), (2, "evening", 12, 5), (3, "morning", 9, 5)], "id int, push_type string, hour int, minute int")
    assert [(r.hour, r.minute, r.changed) for r in S.move_early_evenings(df).orderBy("id").collect()] == [
        (18, 0, True), (12, 5, False), (9, 5, False)]
