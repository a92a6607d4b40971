"""The given tables, seen as the inputs of a briefing service."""

from __future__ import annotations

from functools import cached_property
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courant.functions.html import SUMMARY_CHARS, clip
from courant.session import configure, shared_folder

AS_OF_TEXT = "2024-01-31 00:00:00"
DAY_LIMIT = 3
ARRIVALS, LATENESS = 6, 8 * 86400  # arrivals of a stream, and seconds that cover one and two days
ARRIVAL_FILES = 8  # what one arrival, and one micro-batch, has at most
WORDS = {"ri": ["ring"], "bo": ["bolt", "rod"], "gi": ["gizmo", "gear"]}
PREFERRED = "red"

INDUSTRIES = [
    (0, "energy", 5, None), (1, "metals", 10, "+the +de"),
    (2, "media", 3, "!license"), (3, "retail", 20, "+zzz"),
]
FUTURES = [(1, 1, "", "ri2505"), (2, 2, "bolts", "bo2505"), (3, 3, "", "gi2506"), (4, 0, "none", "zz2501")]

# Links put into every page, so that each link rule has something to do.
BLOCK = (
    '<div class="extra"><a href="#x">anchor here</a><a href="javascript:void(0)">script link</a>'
    '<a href="mailto:x@example.com">mail to us</a>'
    '<a href="https://abs.example.org/story/1">Absolute story</a>'
    '<a href="//cdn.example.org/media/2">Protocol &amp; relative</a>'
    '<a href="../up/three">  Parent <b>folder</b> story </a>'
    '<a href="/dup/story">no</a><a href="/dup/story">Good title here</a>'
    '<a href="/titled/story" title="From the attribute"><img src="x.png"></a>'
    '<a href="?page=9&amp;q=1">Query only link</a><a href="/en">Short path</a>'
)


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF_TEXT))


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream_of(self, name: str) -> DataFrame:
        """A table's files as a stream; it may be one file or a folder of them, and only a pattern names both."""
        return self.spark.readStream.schema(self.table(name).schema).parquet(f"{self.folder}/[{name[0]}]{name[1:]}.parquet")

    @cached_property
    def sources(self) -> DataFrame:
        n = F.regexp_extract("source", "[0-9]+", 0).cast("int")
        keywords = (
            F.when(n % 5 == 1, "+the !token tion").when(n % 5 == 2, "!license")
            .when(n % 5 == 3, "tion ment ung").when(n % 5 == 4, "+de la")
        )
        return self.table("documents").select("source").distinct().select(
            n.alias("id"), (n % 4).alias("industry_id"), F.col("source").alias("name"),
            F.concat(F.lit("https://"), "source", F.lit(".example/")).alias("url"),
            (n % 12).alias("weight"), keywords.alias("keywords"),
            F.when(n % 2 == 0, "zh").otherwise("en").alias("language"),
        )

    @cached_property
    def selecting_sources(self) -> DataFrame:
        """Sources with selectors of their own: a path, a class on containers, one not supported."""
        own = F.when(F.col("id") % 4 == 1, "nav a").when(F.col("id") % 4 == 2, "div.extra").when(F.col("id") == 7, "div > a")
        return self.sources.withColumn("link_selector", own)

    @cached_property
    def industries(self) -> DataFrame:
        return self.spark.createDataFrame(INDUSTRIES, "id int, name string, top_n int, keywords string")

    @cached_property
    def articles(self) -> DataFrame:
        age = F.when(F.col("doc_id") % 60 == 0, -1).otherwise(F.col("doc_id") % 60)
        return self.table("documents").select(
            "doc_id", "lang",
            F.regexp_extract("source", "[0-9]+", 0).cast("int").alias("source_id"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.concat(F.lit("https://"), "source", F.lit(".example/doc/"), "doc_id").alias("url"),
            clip(F.col("text"), SUMMARY_CHARS).alias("summary"),
            (as_of() - F.make_dt_interval(mins=(age * 30).cast("int"))).alias("published_at"),
        )

    @cached_property
    def seen(self) -> DataFrame:
        a = self.articles.where("doc_id % 7 = 0")
        return a.select(
            "url", "title", F.when(F.col("doc_id") % 35 != 0, F.col("source_id")).alias("source_id"),
            (as_of() - F.make_dt_interval(days=(F.col("doc_id") % 15).cast("int"))).alias("first_seen_at"),
        )

    @cached_property
    def pages(self) -> DataFrame:
        return self.pages_of(self.table("pages"))

    @cached_property
    def page_stream(self) -> DataFrame:
        return self.pages_of(self.stream_of("pages"))

    def pages_of(self, raw: DataFrame) -> DataFrame:
        own = F.concat(
            F.lit(BLOCK), F.lit('<a href="'), F.col("url"), F.lit('">Story number '),
            F.col("page_id"), F.lit("</a></div>"),
        )
        html = F.when(
            F.contains("html", F.lit("</body>")),
            F.replace(F.col("html"), F.lit("</body>"), F.concat(own, F.lit("</body>"))),
        ).otherwise(F.concat("html", own))
        return raw.select(
            "page_id", "url", html.alias("html"),
            (F.col("page_id") % 20).cast("int").alias("source_id"),
            (F.col("page_id") % 10 != 9).alias("fetch_ok"),
        )

    @cached_property
    def details(self) -> DataFrame:
        return self.table("pages").groupBy("url").agg(F.min_by("html", "page_id").alias("html"))

    @cached_property
    def fetched(self) -> DataFrame:
        n = F.col("page_id") % 10
        return self.table("pages").select(
            "page_id", "html", F.lit("nav a").alias("link_selector"),
            F.when(n == 6, "timeout").when(n == 7, "http").when(n == 8, "other").otherwise("ok").alias("outcome"),
            F.when(n == 7, F.when(F.col("page_id") % 20 == 7, 404).otherwise(503)).alias("http_status"),
            F.when(n == 8, F.col("html")).alias("message"),
        )

    @cached_property
    def snapshot(self) -> DataFrame:
        k = F.col("p_partkey")
        change = F.format_string("%.1f", (F.col("p_size") - 25) / 10)
        return self.table("part").select(
            F.when(k % 3 == 0, "cn").when(k % 3 == 1, "hk").otherwise("global").alias("market"),
            k.alias("pos"),
            F.when(k % 10 == 3, k - 3).otherwise(k).cast("string").alias("code"),
            F.col("p_name").alias("name"),
            F.when(k % 97 == 0, 0.0).when(k % 89 == 0, float("nan")).otherwise(F.col("p_retailprice")).alias("last"),
            F.when(k % 53 == 0, "-").when(F.col("p_size") % 2 == 0, F.concat(change, F.lit("%")))
            .otherwise(change).alias("change_pct"),
        )

    @cached_property
    def items(self) -> DataFrame:
        k = F.col("p_partkey")
        group = F.floor(k / 20)
        listed = self.table("part").select(
            k.alias("item_pos"), (group % 4).cast("int").alias("industry_id"),
            F.when(group % 5 == 0, "").otherwise(F.concat(F.lit("item "), k)).alias("name"),
            F.when(group % 7 == 0, k + 1000000000).otherwise(k).cast("string").alias("symbol"),
            F.when(k % 3 == 0, "stock").when(k % 3 == 1, "stock_hk").otherwise("futures").alias("item_type"),
        )
        futures = self.spark.createDataFrame(
            FUTURES, "item_pos long, industry_id int, name string, symbol string"
        ).withColumn("item_type", F.lit("futures"))
        return listed.unionByName(futures)

    @cached_property
    def event_stream(self) -> DataFrame:
        return self.stream_of("events")

    @cached_property
    def arriving_events(self) -> DataFrame:
        """Events as they might come in: each up to two days after its time, span by span; one more closes the stream.

        A span lies in as many files as a micro-batch takes, whatever number of tasks reads the table.
        """
        path = f"{shared_folder(self.spark)}/arriving-{uuid4().hex}"
        events = self.table("events")
        came = F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(2 * 86400))
        first, last, newest = events.agg(F.min(came), F.max(came), F.max("ts")).first()
        step = (last - first) // ARRIVALS + 1
        for start in range(first, last + 1, step):
            events.where((came >= start) & (came < start + step)).repartition(ARRIVAL_FILES).write.mode("append").parquet(path)
        closing = {"ts": F.lit(newest) + F.expr("INTERVAL 60 DAYS")}
        self.spark.range(1).select(
            *[closing.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]
        ).write.mode("append").parquet(path)
        return self.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", ARRIVAL_FILES).parquet(path)

    @cached_property
    def checks(self) -> DataFrame:
        return self.checks_of(self.table("events"))

    def checks_of(self, events: DataFrame) -> DataFrame:
        kind = F.col("event_type")
        status = F.when(kind == "error", "error").when(kind == "view", "warning").otherwise("healthy")
        return events.select(
            F.col("event_id").alias("check_id"), F.col("user_id").alias("source_id"),
            F.col("ts").cast("timestamp").alias("checked_at"), status.alias("status"),
            F.when(kind == "error", F.concat(F.lit("HTTP "), F.lit(500) + F.col("event_id") % 4)).alias("error"),
        )

    @cached_property
    def check_sources(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
            F.concat(F.lit("https://"), F.col("c_custkey"), F.lit(".example/")).alias("url"),
            F.lit("old").alias("link_selector"),
        )

    @cached_property
    def push_log(self) -> DataFrame:
        from courant.operators import delivery as D

        kind, n = F.col("event_type"), F.col("event_id")
        push = F.when(F.hour("ts") < 12, "morning").otherwise("evening")
        status = (
            F.when(kind == "error", "failed").when(kind.isin("signup", "purchase"), "skipped").otherwise("success")
        )
        message = (
            F.when(kind == "error", F.concat(F.lit("error "), n, F.lit(" "), F.repeat(F.lit("x"), (n % 700).cast("int"))))
            .when(kind == "signup", D.NO_RECIPIENTS).when(kind == "purchase", D.NO_NEWS)
        )
        return self.table("events").select(
            n.alias("id"), (F.col("user_id") % 10).cast("int").alias("industry_id"),
            push.alias("push_type"), status.alias("status"), message.alias("error_msg"),
            F.when(status == "success", F.concat(F.lit("<html>"), n)).alias("html_snapshot"),
            (F.col("ts").cast("timestamp") - F.make_dt_interval(days=(n % 10).cast("int"))).alias("created_at"),
        )

    @cached_property
    def schedules(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("id"), F.col("c_nationkey").alias("industry_id"),
            F.when(k % 2 == 0, "morning").otherwise("evening").alias("push_type"),
            F.when(k % 24 != 5, (k % 24).cast("int")).alias("hour"),
            F.when(k % 7 != 3, (k % 60).cast("int")).alias("minute"),
            (k % 3 != 0).alias("enabled"),
        )

    @cached_property
    def recipients(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).cast("int").alias("industry_id"),
            F.concat(F.lit("c"), F.col("c_custkey"), F.lit("@example.com")).alias("email"),
        ).where("industry_id <> 2")

    @cached_property
    def smtp(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("id"), F.concat(F.lit("mail"), k, F.lit(".example.com")).alias("host"),
            F.concat(F.lit("u"), k, F.lit("@example.com")).alias("username"),
            F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("c"), k, F.lit("@example.com"))).alias("contact_email"),
            F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit("gAAAAA"), k))
            .otherwise(F.concat(F.lit("secret-"), k)).alias("password"),
        )

    @cached_property
    def urls(self) -> DataFrame:
        k = F.col("page_id")
        host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
        low = k % 256
        forms = [
            F.col("url"), F.concat(F.lit("file:///data/"), k), F.concat(F.lit("ftp://example.com/"), k),
            F.concat(F.lit("http:///feed/"), k), F.concat(F.lit("http://10.0.0."), low, F.lit("/x")),
            F.concat(F.lit("http://172."), k % 40, F.lit(".0.1/x")),
            F.concat(F.lit("https://8.8.8."), low, F.lit(":8443/x")),
            F.concat(F.lit("http://[::1]/x"), k), F.concat(F.lit("http://[fd00::"), k % 10, F.lit("]/x")),
            F.concat(F.lit("http://[2001:db8::1]/"), k),
            F.concat(F.lit("https://user:pw@"), host, F.lit("/p")),
            F.concat(F.lit("HTTP://192.168.1."), low, F.lit("/x")),
        ]
        chosen = F.lit(None).cast("string")
        for i, form in enumerate(forms):
            chosen = F.when(k % len(forms) == i, form).otherwise(chosen)
        return self.table("pages").select("page_id", chosen.alias("url"))

    @cached_property
    def resolved(self) -> DataFrame:
        host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
        return self.table("pages").where("page_id % 3 <> 2").select(
            host.alias("host"), F.when(F.col("page_id") % 9 == 0, "10.1.2.3").otherwise("93.184.216.34").alias("ip"),
        )

    @cached_property
    def answers(self) -> DataFrame:
        c = F.col("conv_id")
        barred = F.when(
            (c % 3 == 0) & F.contains("text", F.lit(". ")),
            F.concat(F.substring_index("text", ". ", 1), F.lit("|"),
                     F.expr("substring(text, locate('. ', text) + 2)")),
        ).otherwise(F.col("text"))
        prefixed = (
            F.when(c % 5 == 1, F.concat(F.lit("News: "), barred))
            .when(c % 5 == 2, F.concat(F.lit("摘要：本文 "), barred))
            .when(c % 5 == 3, F.replace(barred, F.lit(". "), F.lit(".\n"))).otherwise(barred)
        )
        return self.table("conversations").where("role = 'assistant'").select(
            "conv_id", "turn", prefixed.alias("answer"),
            F.when(c % 2 == 0, "en").otherwise("zh").alias("lang"),
            F.concat(F.lit("Original "), c).alias("original"),
        )

    @cached_property
    def attempts(self) -> DataFrame:
        return self.attempts_of(self.table("events"))

    def attempts_of(self, events: DataFrame) -> DataFrame:
        return events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))

    @cached_property
    def near_vectors(self) -> DataFrame:
        """All vectors; every fourth is a near copy of the one before it."""
        own = self.table("embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
        before = own.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("_before"))
        moved = F.transform("_before", lambda x, i: F.when(i == 0, x + 0.3).otherwise(x))
        return own.join(before.where("vec_id % 4 = 1"), "vec_id", "left").withColumn(
            "embedding", F.coalesce(moved, "embedding")
        ).drop("_before")

    @cached_property
    def vectors(self) -> DataFrame:
        """Articles with the vector of the same number, where there is one."""
        vec = self.near_vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
        return self.articles.select("doc_id", "source_id", "title").join(vec, "doc_id", "left")

    @cached_property
    def keyword_texts(self) -> DataFrame:
        marked = F.replace(F.replace(F.col("title"), F.lit(" t"), F.lit(" +T")), F.lit(" d"), F.lit(" !d"))
        return self.articles.select("doc_id", marked.alias("keywords"))
