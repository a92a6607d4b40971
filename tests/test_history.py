import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from courant.operators import delivery as D
from courant.operators import health as H
from courant.operators import retention as R
from courant.operators.streaks import running_streak

T0 = datetime(2024, 1, 1)


def history(seed, rows):
    """A third of the rows belongs to key 0; many equal times; one key is null."""
    rnd = random.Random(seed)
    out = []
    for i in range(rows):
        key = 0 if rnd.random() < 0.33 else rnd.choice([1, 2, None])
        out.append((i, key, T0 + timedelta(minutes=rnd.randrange(0, 3000, 20)), rnd.choice(["add", "add", "add", "reset", "other"])))
    return out


@pytest.mark.parametrize("chunk, parts", [(3600, 1), (600, 9), (10**7, 3)])
def test_streak_like_a_loop(spark, chunk, parts):
    rows = history(1, 600)
    counts, want = {}, {}
    for i, key, at, kind in sorted(rows, key=lambda r: (r[2], r[0])):
        counts[key] = {"add": counts.get(key, 0) + 1, "reset": 0, "other": counts.get(key, 0)}[kind]
        want[i] = counts[key]
    df = spark.createDataFrame(rows, "i int, key int, at timestamp, kind string").repartition(parts)
    got = running_streak(df, ["key"], "at", "i", F.col("kind") == "add", F.col("kind") == "reset", chunk)
    assert {r.i: r.streak for r in got.collect()} == want


def checks(spark):
    rows = [(1, 1, "error"), (2, 1, "error"), (3, 1, "error"), (4, 1, "error"), (5, 2, "error"), (6, 2, "warning"), (7, 2, "error")]
    return spark.createDataFrame(
        [(i, s, st, "e%d" % i if st == "error" else None, T0 + timedelta(hours=i)) for i, s, st in rows],
        "check_id int, source_id int, status string, error string, checked_at timestamp",
    )


def test_health(spark):
    sources = spark.createDataFrame([(1, "one", "u1"), (2, "two", "u2"), (3, "three", "u3")], "id int, name string, url string")
    counted = H.consecutive_failures(checks(spark))
    assert {r.check_id: r.failures for r in counted.collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 0, 7: 1}
    alerts = H.alerts(counted, sources).orderBy("check_id").collect()
    assert [(r.check_id, r.subject) for r in alerts] == [
        (3, "【告警】新闻源「one」已连续检查失败 3 次"), (4, "【告警】新闻源「one」已连续检查失败 4 次")]
    latest = H.latest(checks(spark), sources)
    assert [(r.source_id, r.health_status, r.last_error, r.consecutive_failures) for r in latest.orderBy("source_id").collect()] == [
        (1, "error", "e4", 4), (2, "error", "e7", 1), (3, "unknown", None, 0)]
    total = H.rollup(checks(spark)).first()
    assert (total.healthy, total.warning, total.error) == (0, 1, 6)
    digest = H.digest(H.digest_lines(latest), [3, 99, 1]).first().digest
    assert digest == "健康检查完成：three: ? 未知；one: ✗ 异常（e4）"


def test_classify(spark):
    rows = [("ok", None, None, 3, None), ("ok", None, None, 0, ""), ("timeout", None, None, 0, "a"), ("http", 503, None, 9, "a"),
            ("other", None, "x" * 300, 0, "a")]
    df = spark.createDataFrame(rows, "outcome string, http_status int, message string, n_links int, link_selector string")
    got = [(r.status, r.error) for r in H.classify(df).collect()]
    assert got == [("healthy", None), ("warning", "页面正常但未找到链接（选择器: a）"), ("error", "请求超时（>10.0s）"),
                   ("error", "HTTP 503"), ("error", "x" * 200)]


def test_push_streak_carries_over_configuration_skips(spark):
    rows = [("failed", "x"), ("failed", "x"), ("skipped", D.NO_SMTP), ("failed", "y"), ("skipped", D.NO_NEWS), ("failed", "z"), ("success", None)]
    log = spark.createDataFrame(
        [(i, 1, "morning", s, e, T0 + timedelta(days=i)) for i, (s, e) in enumerate(rows)],
        "id int, industry_id int, push_type string, status string, error_msg string, created_at timestamp",
    )
    counted = D.failure_streaks(log)
    assert [r.streak for r in counted.orderBy("id").collect()] == [1, 2, 2, 3, 0, 1, 0]
    industries = spark.createDataFrame([(1, "能源")], "id int, name string")
    alert = D.failure_alerts(counted, industries).collect()
    assert [(r.id, r.subject) for r in alert] == [(3, "【告警】能源 早报已连续失败 3 次")]


def test_readiness_and_outcome(spark):
    industries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id int, name string")
    inputs = spark.createDataFrame([(1,), (2,), (4,), (4,)], "industry_id int")
    people = spark.createDataFrame([(1,), (1,), (4,), (3,)], "industry_id int")
    smtp = spark.createDataFrame([(1,)], "id int")
    ready = D.readiness(industries, inputs, people, smtp, "morning")
    assert {r.industry_id: r.reason for r in ready.collect()} == {1: None, 2: D.NO_RECIPIENTS, 3: D.NO_SOURCES, 4: None}
    no_mail = D.readiness(industries, inputs, people, smtp.limit(0), "morning").where("industry_id = 1").first()
    assert no_mail.reason == D.NO_SMTP
    found = spark.createDataFrame([(4,)] * 3, "industry_id int")
    broken = spark.createDataFrame([(4, "m" * 1200)], "industry_id int, message string")
    got = {r.industry_id: (r.status, r.article_count, r.recipient_count, r.error_msg) for r in D.outcomes(ready, found).collect()}
    assert got[1] == ("skipped", 0, 2, D.NO_NEWS) and got[4] == ("success", 3, 1, None) and got[2] == ("skipped", 0, 0, D.NO_RECIPIENTS)
    failed = D.outcomes(ready, found, broken).where("industry_id = 4").first()
    assert (failed.status, failed.article_count, len(failed.error_msg)) == ("failed", 0, 1000)


def test_retention(spark):
    seen = spark.createDataFrame([("a", T0, 1), ("b", T0 + timedelta(days=8), 2), ("c", T0 + timedelta(days=1), None)],
                                 "url string, first_seen_at timestamp, source_id int")
    now = F.lit(T0 + timedelta(days=8))
    assert sorted(r.url for r in R.prune_seen(seen, now).collect()) == ["b", "c"]  # exactly seven days is kept
    sources = spark.createDataFrame([(1, 5), (2, 6)], "id int, industry_id int")
    assert sorted(r.url for r in R.reset_seen(seen, sources, [5]).collect()) == ["b", "c"]
    log = spark.createDataFrame([(1, T0, "h"), (2, T0 + timedelta(days=39), "h"), (3, T0 + timedelta(days=20), "h"), (4, T0, None)],
                                "id int, created_at timestamp, html_snapshot string")
    now = F.lit(T0 + timedelta(days=40))
    assert {r.id: r.html_snapshot for r in R.expire_snapshots(log, now).collect()} == {1: None, 2: "h", 3: None, 4: None}
    assert sorted(r.id for r in R.prune_log(log, now).collect()) == [2, 3]
    report = R.cleanup_report(seen, log, now).first()
    assert (report.seen_deleted, report.snapshots_cleared, report.log_deleted) == (3, 2, 2)
