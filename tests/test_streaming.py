import random
from datetime import datetime, timedelta
from glob import glob

import pytest
from pyspark.sql import functions as F

from checks.queries import registered
from checks.views import Views
from courant.operators.health import consecutive_failures
from courant.operators.ratelimit import rate_limit
from courant.session import shared_folder
from courant.streaming import jobs

T0 = datetime(2024, 1, 1)


def in_files(df, order, files, path):
    """Write rows in order into `files` files that are read one per micro-batch."""
    rows, step = df.orderBy(order).collect(), -(-df.count() // files)
    for i in range(0, len(rows), step):
        df.sparkSession.createDataFrame(rows[i:i + step], df.schema).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark, stream, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "state")).format("parquet").start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def arriving(rows, columns, spark, seed, delay):
    """Rows numbered as they arrive, each up to `delay` seconds after its time, then one that closes all before it."""
    rnd = random.Random(seed)
    came = sorted(rows, key=lambda r: r[-1] + timedelta(seconds=rnd.uniform(0, delay)))
    last = (None,) * (len(rows[0]) - 1) + (T0 + timedelta(days=30),)
    return spark.createDataFrame([(n, *r) for n, r in enumerate([*came, last])], "n int, " + columns)


@pytest.mark.parametrize("files, delay", [(2, 0), (7, 600), (7, 7200)])
def test_failures_in_any_order(spark, tmp_path, files, delay):
    rnd = random.Random(files)
    rows = [(i, rnd.randrange(4), rnd.choice(["error", "error", "healthy", "warning"]), T0 + timedelta(minutes=i // 2)) for i in range(160)]
    columns = "check_id int, source_id int, status string, checked_at timestamp"
    stream = in_files(arriving(rows, columns, spark, 5, delay), "n", files, str(tmp_path / "in")).drop("n")
    got = drained(spark, jobs.failure_stream(stream, lateness_seconds=max(60, delay)), tmp_path).collect()
    want = consecutive_failures(spark.createDataFrame(rows, columns)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("files, delay", [(2, 0), (8, 15), (8, 120)])
def test_rate_limit_in_any_order(spark, tmp_path, monkeypatch, files, delay):
    monkeypatch.setattr("courant.streaming.inorder.CHUNK_ROWS", 3)
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "a", "b", None]), T0 + timedelta(seconds=i + rnd.random())) for i in range(150)]
    columns = "i int, key string, at timestamp"
    stream = in_files(arriving(rows, columns, spark, 6, delay), "n", files, str(tmp_path / "in")).drop("n")
    decided = jobs.rate_limit_stream(stream, "key", "at", "i", 3, 20, max(20, delay))
    got = drained(spark, decided, tmp_path).collect()
    want = rate_limit(spark.createDataFrame(rows, columns), "key", "at", "i", 3, 20).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


@pytest.mark.parametrize("files", [4, 7])
def test_late_attempts_come_out_without_verdict(spark, tmp_path, files):
    rnd, late = random.Random(3), {80, 81, 120, 149}
    rows = [(i, rnd.choice("aab"), T0 + timedelta(seconds=1 if i in late else 2 * i)) for i in range(150)]
    rows[120] = (120, "only late", rows[120][2])
    rows += [(150, "a", None), (151, None, T0 + timedelta(days=1))]
    tries = spark.createDataFrame(rows, "i int, key string, at timestamp")
    stream = jobs.rate_limit_stream(in_files(tries, "i", files, str(tmp_path / "in")), "key", "at", "i", 3, 20)
    got = {r.i: r.allowed for r in drained(spark, stream, tmp_path).collect()}
    in_time = tries.where(~F.col("i").isin(*late, 151))
    want = {r.i: r.allowed for r in rate_limit(in_time, "key", "at", "i", 3, 20).collect()}
    assert got == want | dict.fromkeys([*late, 150])


def test_unseen(spark, tmp_path):
    rows = [(f"u{i % 5}", T0 + timedelta(hours=i)) for i in range(20)] + [("u1", T0 + timedelta(days=30)), ("u9", T0 + timedelta(days=30))]
    articles = spark.createDataFrame(rows, "url string, published_at timestamp")
    stream = jobs.unseen_stream(in_files(articles, "published_at", 4, str(tmp_path / "in")))
    got = [r.url for r in drained(spark, stream, tmp_path).collect()]
    assert sorted(set(got)) == ["u0", "u1", "u2", "u3", "u4", "u9"]
    assert all(got.count(u) == 1 for u in ("u0", "u2", "u9"))


@pytest.mark.parametrize("files", [1, 3])
def test_briefing(spark, tmp_path, files):
    def html(i):
        return f'<a href="/story/{i}">Story number {i}</a><a href="/story/{i + 1}">Story number {i + 1}</a>' \
               f'<a href="/spam/{i}">Story spam {i}</a>'

    pages = spark.createDataFrame(
        [(i, i % 2, f"https://s{i % 2}.example/", html(i), i != 4) for i in range(9)],
        "page_id long, source_id int, url string, html string, fetch_ok boolean",
    )
    # sources are in page order here, so that streaming and batch meet the same first page
    pages = pages.withColumn("source_id", F.lit(0)).withColumn("url", F.lit("https://s0.example/"))
    details = spark.createDataFrame(
        [("https://s0.example/story/1", "<article><p>The text of story one</p></article>")], "url string, html string")
    seen = spark.createDataFrame([("https://s0.example/story/2",)], "url string")
    sources = spark.createDataFrame([(0, "s0", 7, 5, "!spam")], "id int, name string, industry_id int, weight int, keywords string")
    industries = spark.createDataFrame([(7, "i", 5, None)], "id int, name string, top_n int, keywords string")
    now, out = F.lit(T0), str(tmp_path / "out")
    stream = in_files(pages, "page_id", files, str(tmp_path / "in"))
    jobs.briefing_stream(stream, details, seen, sources, industries, now, out).option(
        "checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    got = sorted((r.url, r.summary, round(r.score, 6)) for r in spark.read.parquet(out).collect())
    batch = jobs.scored_articles(pages, details, seen, sources, industries, now)
    assert got == sorted((r.url, r.summary, round(r.score, 6)) for r in batch.collect())
    assert len(got) == 9 and got[1] == ("https://s0.example/story/1", "The text of story one", 0.7)


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_tables_in_one_file_or_many(spark, tmp_path, files):
    pages = spark.range(30).selectExpr(
        "id AS page_id", "concat('https://p.example/', id) AS url", "'<body><p>text</p></body>' AS html", "'en' AS lang")
    documents = spark.range(4).selectExpr("id AS doc_id", "concat('src', id) AS source", "'en' AS lang", "'a title' AS text")
    for name, df in (("pages", pages), ("documents", documents)):
        df.repartition(files).write.parquet(str(tmp_path / f"{name}.parquet"))
    views = Views(spark, str(tmp_path))
    want = jobs.scored_articles(
        views.pages, views.details, views.seen, views.sources, views.industries, F.to_timestamp(F.lit("2024-01-31")))
    urls = {r.url for r in want.collect()}
    for name in ("stream_briefing", "stream_briefing_by_source"):
        got = registered()[name](spark, str(tmp_path)).collect()
        assert got and {r.url for r in got} <= urls
        if name == "stream_briefing":
            assert {r.url for r in got} == urls
    events = spark.range(9).selectExpr("id AS event_id", "id % 3 AS user_id", "timestamp'2024-01-01' AS ts")
    events.repartition(files).write.parquet(str(tmp_path / "events.parquet"))
    assert registered()["stream_unseen"](spark, str(tmp_path)).count() == 3


def test_a_span_of_events_is_one_micro_batch(spark, tmp_path):
    spark.range(0, 300, 1, 4).selectExpr(
        "id AS event_id", "timestamp'2024-01-01' + make_dt_interval(0, id * 2) AS ts", "id % 5 AS user_id",
        "'view' AS event_type", "1.0 AS value", "'' AS props",
    ).write.parquet(str(tmp_path / "events.parquet"))
    commits = f"{shared_folder(spark).removeprefix('file:')}/attempts-*/state/commits/[0-9]*"
    before = len(glob(commits))
    assert registered()["stream_rate_limit"](spark, str(tmp_path)).where("allowed IS NOT NULL").count() == 300
    assert len(glob(commits)) - before <= 10  # six spans, one that closes, and what follows without new rows
