import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from courant.operators import health
from courant.plans.health import COLUMNS, UNSUPPORTED, health_check, health_step

NOW = datetime(2024, 1, 31)


def test_one_run(spark):
    page = '<div class="list"><a href="/a/b">x</a></div>'
    fetched = spark.createDataFrame(
        [(101, 1, page, "ok", None, None, ".list a"), (102, 2, None, "timeout", None, None, None),
         (103, 3, page, "ok", None, None, "a:hover"), (104, 4, "<p>none</p>", "ok", None, None, "")],
        "check_id long, source_id long, html string, outcome string, http_status int, message string, link_selector string")
    history = spark.createDataFrame(
        [(i, 2, NOW - timedelta(days=9 - i), "error", "e") for i in range(2)] + [(7, 4, NOW - timedelta(days=1), "error", "e")],
        "check_id long, source_id long, checked_at timestamp, status string, error string")
    sources = spark.createDataFrame([(i, f"s{i}", f"https://s{i}.example/") for i in range(1, 6)], "id long, name string, url string")
    run = health_check(fetched, history, sources, F.lit(NOW))
    got = {r.source_id: (r.status, r.failures) for r in run.checks.collect()}
    assert got == {1: ("healthy", 0), 2: ("error", 3), 3: ("error", 1), 4: ("warning", 0)}
    assert [(r.source_id, r.failures) for r in run.alerts.collect()] == [(2, 3)]
    state = health.next_state(history.limit(0).withColumn("failures", F.lit(0).cast("long")), history)[1]
    step, after = health_step(fetched, state, sources, F.lit(NOW))
    for one, other in ((run.checks, step.checks), (run.alerts, step.alerts), (run.states, step.states)):
        assert sorted(map(repr, one.collect())) == sorted(map(repr, other.select(*one.columns).collect()))
    assert {r.source_id for r in after.collect()} == {1, 2, 3, 4}
    states = {r.source_id: (r.health_status, r.last_error) for r in run.states.collect()}
    assert states[3] == ("error", UNSUPPORTED) and states[5] == ("unknown", None) and states[1] == ("healthy", None)


def test_steps_equal_the_whole_log_on_every_day(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.randrange(5), rnd.choice(["error", "error", "error", "healthy", "warning"]),
             NOW + timedelta(hours=6 * i // 3), rnd.choice(["e1", None])) for i in range(90)]
    log = spark.createDataFrame(rows, "check_id long, source_id long, status string, checked_at timestamp, error string").select(*COLUMNS)
    sources = spark.createDataFrame([(i, f"s{i}") for i in range(6)], "id long, name string")
    state = log.limit(0).withColumn("failures", F.lit(0).cast("long"))
    whole = {r.check_id: r.failures for r in health.consecutive_failures(log).collect()}
    for day in range(0, 8, 2):
        new = log.where((F.col("checked_at") >= F.lit(NOW + timedelta(days=day))) & (F.col("checked_at") < F.lit(NOW + timedelta(days=day + 2))))
        counted, state = health.next_state(state, new)
        state = spark.createDataFrame(state.collect(), state.schema)
        assert all(whole[r.check_id] == r.failures for r in counted.collect()) and counted.columns[:5] == COLUMNS
        upto = log.where(F.col("checked_at") < F.lit(NOW + timedelta(days=day + 2)))
        assert sorted(map(repr, health.state_of(state, sources).collect())) == sorted(map(repr, health.latest(upto, sources).collect()))
