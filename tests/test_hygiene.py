import ipaddress
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from courant.functions import hygiene as Y
from courant.operators.ratelimit import admit, follow, rate_limit


def verdicts(spark, urls, names):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    known = spark.createDataFrame(names, "host string, ip string")
    return {r.url: r.reason for r in Y.check_urls(df, known).collect()}


def test_urls(spark):
    names = [("localhost", "127.0.0.1"), ("internal-service", "10.0.0.1"), ("router.local", "192.168.1.1"),
             ("feeds.example.com", "8.8.8.8"), ("mixed.example", "8.8.8.8"), ("mixed.example", "169.254.1.1")]
    want = {
        "file:///etc/passwd": "scheme", "ftp://example.com/feed": "scheme", "http://localhost/feed": "private",
        "http://internal-service/feed": "private", "http://ROUTER.local:8080/feed": "private", "http://172.16.0.1/feed": "private",
        "https://feeds.example.com/rss": None, "http:///feed": "no host", "http://mixed.example/": "private",
        "https://unknown.example/": "unresolved", "http://172.32.0.1/": None, "http://user@[::1]:80/": "private",
        "http://[fd00::1]/": "private", "http://[2001:db8::1]/": None, "no scheme": "scheme", "http://2130706433/": "unresolved",
    }
    assert verdicts(spark, want, names) == want


def test_private_like_the_standard_library(spark):
    nets = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16")]
    rnd = random.Random(2)
    ips = [".".join(str(rnd.choice([rnd.randrange(256), 10, 127, 168, 169, 172, 192, 254])) for _ in range(4)) for _ in range(300)]
    ips += ["10.0.0.0", "9.255.255.255", "172.31.255.255", "172.32.0.0", "192.167.255.255", "11.0.0.0"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    got = {r.ip: r.p for r in df.select("ip", Y.is_private(F.col("ip")).alias("p")).collect()}
    assert got == {i: any(ipaddress.ip_address(i) in n for n in nets) for i in ips}


def test_mask(spark):
    texts = {
        "mail bob.x+1@mail.example.com now": "mail ***@***.*** now", 'password: "hunter2!" x': "password: *** x",
        "Authorization: Basic abc=": "Authorization: Basic ***", "api_key=abc-1, API-KEY: 'z'": "api_key=***, API-KEY: ***",
        "token = t1 secret:s2": "token = *** secret:***", "bearer a.b.c": "bearer ***",
        "gAAAAA" + "x" * 25: "gAAAAA***", "nothing here": "nothing here", "élan é@ü.fr": "élan ***@***.***",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.m for r in df.select("t", Y.mask(F.col("t")).alias("m")).collect()} == texts


def test_encryption(spark):
    df = spark.createDataFrame([("my-smtp-password-123",), ("same",), ("same",), ("",), ("gAAAAAold",)], "s string")
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    sealed = df.select("s", Y.encrypt(F.col("s"), key).alias("e"))
    rows = sealed.select("s", "e", Y.decrypt(F.col("e"), key).alias("d"), Y.encrypt(F.col("e"), key).alias("again")).collect()
    assert all(r.d == r.s and r.again == r.e for r in rows)
    same = [r.e for r in rows if r.s == "same"]
    assert same[0] != same[1] and same[0].startswith(Y.SEALED)
    with pytest.raises(PySparkException):
        sealed.where("s = 'same'").select(Y.decrypt(F.col("e"), other)).collect()


@pytest.mark.parametrize("limit, window, parts", [(10, 60, 1), (3, 60, 9), (1, 7, 4)])
def test_rate_limit_like_a_loop(spark, limit, window, parts):
    rnd, start, rows = random.Random(4), datetime(2024, 1, 1), []
    for i in range(900):
        key = "hot" if i % 3 == 0 else rnd.choice(["k0", "k1", "k2", None])
        rows.append((i, key, start + timedelta(milliseconds=rnd.randrange(0, 900_000, 250))))
    kept, want = {}, {}
    for i, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        micros = int((at - start).total_seconds() * 1e6)
        want[i] = admit(kept.setdefault(key, []), micros, limit, window * 10**6)
    df = spark.createDataFrame(rows, "i int, key string, at timestamp").repartition(parts)
    got = rate_limit(df, "key", "at", "i", limit, window)
    assert {r.i: r.allowed for r in got.collect()} == want
    assert not all(want.values()) and re.fullmatch("i,key,at,allowed", ",".join(got.columns))


def looped(rows, limit, window):
    kept, want = {}, {}
    for i, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        micros = int((at - datetime(2024, 1, 1)).total_seconds() * 1e6)
        want[i] = admit(kept.setdefault(key, []), micros, limit, window * 10**6)
    return want


@pytest.mark.parametrize("limit, step, slots", [(10, 3, 4), (3, 1, 2), (2, 5, 1), (7, 2, 64)])
def test_rate_limit_of_a_key_that_is_never_quiet(spark, monkeypatch, limit, step, slots):
    rnd, start = random.Random(limit), datetime(2024, 1, 1)
    rows = [(i, "one", start + timedelta(seconds=step * i + rnd.random())) for i in range(3000)]
    rows += [(9000 + i, "one", rows[500][2]) for i in range(40)] + [(9900, None, start), (9901, "two", start)]
    df = spark.createDataFrame(rows, "i int, key string, at timestamp").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rate_limit(df, "key", "at", "i", limit, 60, slots).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = looped(rows, limit, 60)
    assert {r.i: r.allowed for r in got} == want
    assert sum(want.values()) < 2000 or slots == 64
    assert slots == 64 or len({r.task for r in got if r.key == "one"}) > 1


def test_rate_limit_without_time_or_rows(spark):
    rows = [(1, "a", None), (2, "a", datetime(2024, 1, 1)), (3, None, datetime(2024, 1, 1)), (4, None, datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "i int, key string, at timestamp")
    got = rate_limit(df, "key", "at", "i", 1, 60)
    assert {r.i: r.allowed for r in got.collect()} == {1: None, 2: True, 3: True, 4: False}
    assert rate_limit(df.limit(0), "key", "at", "i").collect() == []


def test_follow_jumps(monkeypatch):
    times, seen = np.sort(np.random.default_rng(1).integers(0, 10**6, 20_000)), []
    allowed, want = [], []
    for t in times.tolist():
        admit(want, t, 5, 1000)
    monkeypatch.setattr("courant.operators.ratelimit.admit", lambda *a: seen.append(1) or admit(*a))
    follow(allowed, times, 5, 1000)
    assert allowed == want and len(seen) < 11_000
