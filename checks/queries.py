"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import AS_OF_TEXT, DAY_LIMIT, LATENESS, PREFERRED, WORDS, Views, as_of
from courant.functions import answers as A
from courant.functions import html as H
from courant.functions import hygiene as Y
from courant.functions import keywords as K
from courant.functions import scores as S
from courant.functions.display import quote_display
from courant.operators import dedup, delivery, health, quotes, ranking, retention, schedules
from courant.operators.links import count_anchors, extract_links, page_texts, paragraph_faults
from courant.operators.ratelimit import rate_limit
from courant.plans import briefs, reports
from courant.plans import health as health_plan
from courant.session import checkpointed, shared_folder
from courant.sources import history, schemas, tables
from courant.streaming import jobs

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
ART = ["source_id", "doc_id"]
KEY = "0123456789abcdef"


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def r6(name: str) -> F.Column:
    return F.round(name, 6).alias(name)


# --- tables ------------------------------------------------------------------------


@query
def scan_by_industry(v):
    return tables.of_industry(v.items, 1).select("item_pos", "industry_id", "name", "symbol", "item_type")


@query
def scan_projected(v):
    return v.check_sources.select("id", "name", "url", "link_selector")


@query
def lookup_by_id(v):
    return tables.by_id(v.check_sources, 77).select("id", "name", "url")


@query
def select_by_ids(v):
    return tables.by_ids(v.check_sources, [42, 7, 100000000, 19]).select("id", "name", "request_pos")


@query
def first_config(v):
    return tables.first_config(v.smtp).select("id", "host", "username")


@query
def append_seen(v):
    pushed = v.articles.withColumn("url", F.regexp_replace("url", "[0-9]$", "0"))
    new = tables.seen_rows(pushed, v.seen, ART, as_of())
    return v.seen.unionByName(new)


@query
def append_push_log(v):
    ready = delivery.readiness(v.industries, v.sources, v.recipients, v.smtp, "evening")
    found = _quotes(v)
    mails = reports.evening_report(found, v.industries, v.smtp)
    rows = delivery.log_rows(delivery.outcomes(ready, found), mails, as_of(), "manual")
    return rows.withColumn("html_snapshot", F.length("html_snapshot").cast("long"))


@query
def evolve_schema(v):
    old = v.sources.select("id", "industry_id", "name", "url", "weight", "keywords")
    return tables.add_columns(old, schemas.ADDED_COLUMNS["news_source"])


@query
def replace_by_key(v):
    new = v.items.where("industry_id = 3 AND item_type = 'stock'").withColumn("item_pos", F.col("item_pos") + 1)
    keys = v.industries.where("id IN (2, 3)").select(F.col("id").alias("industry_id"))
    return tables.replace_rows(v.items, new, keys, "industry_id")


@query
def fix_schedule_hours(v):
    return schedules.move_early_evenings(v.schedules).select(
        "id", "push_type", F.col("hour").cast("long"), F.col("minute").cast("long"), "changed"
    )


@query
def fix_schedule_count(v):
    return schedules.move_early_evenings(v.schedules).agg(F.count_if("changed").alias("n_fixed"))


@query
def scan_snapshot(v):
    return v.snapshot.groupBy("market").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )


@query
def delete_selected(v):
    chosen = v.push_log.where("status = 'failed'").select("id")
    return tables.without_ids(v.push_log, chosen).select("id", "industry_id", "status")


# --- pages -------------------------------------------------------------------------


@query
def extract_links_(v):
    return extract_links(v.pages)


@query
def extract_links_raw(v):
    return extract_links(v.table("pages"))


@query
def extract_links_scoped(v):
    return extract_links(v.pages, "nav a")


@query
def extract_links_nested(v):
    return extract_links(v.pages, "nav li")


@query
def extract_links_class(v):
    return extract_links(v.pages, "div.extra")


@query
def extract_links_by_source(v):
    """Selectors of the sources themselves: none, a path, a class on containers, one not supported."""
    own = F.when(F.col("page_id") % 4 == 1, "nav a").when(F.col("page_id") % 4 == 2, "div.extra")
    own = own.when(F.col("page_id") % 4 == 3, "div > a")
    chosen = v.pages.withColumn("link_selector", own)
    return extract_links(chosen, selector_col="link_selector")


@query
def extract_summary(v):
    return v.pages.select("page_id", H.extract_summary(F.col("html")).alias("summary"))


@query
def extract_article_text(v):
    return v.pages.select("page_id", H.extract_article_text(F.col("html")).alias("article_text"))


@query
def paragraph_filter(v):
    return paragraph_faults(v.pages, True).withColumn("kind", F.lit("summary")).unionByName(
        paragraph_faults(v.pages, False).withColumn("kind", F.lit("article"))
    )


@query
def truncate_head_tail(v):
    return v.table("documents").select("doc_id", A.head_and_tail(F.col("text")).alias("body"))


@query
def min_length_gate(v):
    return v.table("documents").select("doc_id", A.long_enough(F.col("text"), F.col("lang")).alias("long_enough"))


# --- answers -----------------------------------------------------------------------


@query
def split_title_summary(v):
    parts = A.split_answer(F.col("answer"), F.col("original"))
    return v.answers.withColumn("p", parts).select("conv_id", "turn", "p.title", "p.summary")


@query
def strip_title_prefix(v):
    return v.answers.select("conv_id", "turn", A.strip_title_prefix(F.col("answer")).alias("title"))


@query
def strip_summary_prefix(v):
    return v.answers.select("conv_id", "turn", A.strip_summary_prefixes(F.col("answer")).alias("summary"))


@query
def clip_text(v):
    return v.table("documents").select("doc_id", H.clip(F.col("text"), 140).alias("clipped"))


@query
def summary_fallback(v):
    given = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, "Given summary")
    return v.pages.select(
        "page_id", A.or_extract(given, H.extract_summary(F.col("html"))).alias("summary")
    )


@query
def read_answers(v):
    parts = A.read_answer(F.col("lang"), F.col("answer"), F.col("original"))
    return v.answers.withColumn("p", parts).select("conv_id", "turn", "p.title", "p.summary")


@query
def build_prompt(v):
    a = v.articles.join(v.table("documents").select("doc_id", "text"), "doc_id")
    return a.select("doc_id", A.prompt(F.col("lang"), F.col("title"), F.col("text")).alias("prompt"))


def lead_sentence(lang, title, text):
    """A summarizer for checks: the first sentence, with a title for English."""
    lead = text.str.split(".").str[0]
    return [f"{t}|{s}" if code == "en" else s for code, t, s in zip(lang, title, lead)]


@query
def summarize_with(v):
    texts = page_texts(v.pages).select(
        "page_id", F.when(F.col("page_id") % 2 == 0, "en").otherwise("zh").alias("lang"),
        F.concat(F.lit("Page "), "page_id").alias("title"), "article_text", F.col("summary").alias("extracted"),
    )
    return briefs.summarize_with(texts, lead_sentence).select("page_id", "title", "summary")


# --- keywords and ranking ----------------------------------------------------------


@query
def parse_keywords(v):
    words = K.parse_keywords(F.col("keywords"))
    return v.keyword_texts.withColumn("w", words).select(
        "doc_id", F.array_join("w.must", " ").alias("must"),
        F.array_join("w.must_not", " ").alias("must_not"), F.array_join("w.bonus", " ").alias("bonus"),
    )


def _attached(v):
    return ranking.attach_industry(ranking.attach_source(v.articles, v.sources), v.industries)


@query
def keyword_score(v):
    score = K.keyword_score(F.col("title"), F.col("source_words"))
    return ranking.attach_source(v.articles, v.sources).select(
        "doc_id", F.round(score, 6).alias("keyword_score")
    )


@query
def industry_filter(v):
    return ranking.keyword_verdicts(_attached(v), as_of()).where("industry_ok").select("doc_id", "industry_id")


@query
def timeliness(v):
    return v.articles.select("doc_id", F.round(S.timeliness(F.col("published_at"), as_of()), 6).alias("time_part"))


@query
def weight_score(v):
    return v.sources.select("id", F.round(S.weight_score(F.col("weight")), 6).alias("weight_part"))


@query
def score_articles(v):
    return ranking.score_articles(_attached(v), as_of()).select("doc_id", "industry_id", r6("score"))


@query
def top_n_per_industry(v):
    scored = ranking.score_articles(_attached(v), as_of())
    return ranking.top_articles(scored, ART, ranking.largest_top_n(v.industries)).select(
        "industry_id", "rank", "doc_id", "title", r6("score")
    )


@query
def filter_report(v):
    return ranking.filter_report(_attached(v), as_of())


# --- joins -------------------------------------------------------------------------


@query
def unseen_articles(v):
    return tables.unseen(v.articles, v.seen).select("doc_id", "url")


@query
def attach_source(v):
    return ranking.attach_source(v.articles, v.sources).select(
        "doc_id", "source_id", "source_name", "source_weight", "industry_id"
    )


@query
def union_ok_sources(v):
    return briefs.fresh_links(v.pages, v.seen).select("source_id", "page_id", "pos", "url")


@query
def recipients_fanout(v):
    mails = reports.evening_report(_quotes(v), v.industries, v.smtp)
    return delivery.recipients_of(mails, v.recipients)


# --- deduplication -----------------------------------------------------------------


@query
def dedup_exact(v):
    return dedup.dedup_exact(v.articles, ART).select("doc_id", "source_id", "title")


@query
def dedup_exact_per_industry(v):
    known = ranking.attach_source(v.articles, v.sources)
    return dedup.dedup_exact(known, ART, within=["industry_id"]).select("doc_id", "industry_id", "title")


@query
def dedup_semantic(v):
    return dedup.dedup_vectors(v.near_vectors, ["vec_id"], 64, vector="embedding").select(
        "vec_id", "label"
    )


@query
def dedup_titles(v):
    return dedup.dedup_titles(v.articles, ART).select("doc_id", "title")


@query
def dedup_with_fallback(v):
    return dedup.dedup_with_fallback(v.vectors, ART, 64).select(
        "doc_id", "title", F.col("vector").isNotNull().alias("has_vector")
    )


# --- quotes ------------------------------------------------------------------------


def _quotes(v):
    return quotes.fetch_quotes(v.items, v.snapshot, as_of(), WORDS, PREFERRED)


def _nan_as_text(name):
    return F.when(F.isnan(name), "nan").otherwise(F.format_string("%.2f", name)).alias(name)


@query
def quotes_stock(v):
    found = quotes.stock_quotes(v.items.where("item_type = 'stock'"), v.snapshot, quotes.A_SHARE)
    return found.select("item_pos", "symbol", "found_name", _nan_as_text("last"), "change_pct")


@query
def quotes_stock_hk(v):
    found = quotes.stock_quotes(v.items.where("item_type = 'stock_hk'"), v.snapshot, quotes.HONG_KONG)
    return found.select("item_pos", "symbol", "found_name", _nan_as_text("last"), "change_pct")


@query
def quotes_futures_exact(v):
    found = quotes.commodity_by_code(v.items.where("item_type = 'futures'"), v.snapshot)
    return found.select("item_pos", "symbol", "found_name", _nan_as_text("last"))


@query
def quotes_futures_match(v):
    found = quotes.commodity_quotes(v.items.where("item_type = 'futures'"), v.snapshot, WORDS, PREFERRED)
    return found.select("item_pos", "symbol", "method", "found_name", _nan_as_text("last"))


@query
def parse_pct(v):
    return v.snapshot.select("pos", F.round(quotes.parse_pct(F.col("change_pct")), 6).alias("pct"))


@query
def valid_price(v):
    return v.snapshot.where(quotes.valid_price(F.col("last"))).select("pos", "last")


@query
def display_name(v):
    found = quotes.stock_quotes(v.items, v.snapshot, quotes.A_SHARE)
    name = quotes.display_name(F.col("name"), F.col("found_name"), F.col("symbol"))
    return found.select("item_pos", name.alias("shown"))


@query
def fetch_quotes(v):
    return _quotes(v).select(
        "item_pos", "industry_id", "name", "symbol", _nan_as_text("price"), "change_pct", "item_type", "quoted_at"
    )


@query
def quote_coverage(v):
    return quotes.coverage(v.items, _quotes(v))


@query
def quotes_missing(v):
    return quotes.missing_items(v.items, _quotes(v)).select("item_pos", "symbol")


# --- health ------------------------------------------------------------------------


@query
def classify_health(v):
    counted = count_anchors(v.fetched, "nav a")
    return health.classify(counted).select("page_id", "status", "error")


@query
def consecutive_failures(v):
    return health.consecutive_failures(v.checks).select("check_id", "source_id", "status", "failures")


@query
def health_alerts(v):
    counted = health.consecutive_failures(v.checks)
    return health.alerts(counted, v.check_sources).select("check_id", "source_id", "failures", "subject")


@query
def health_rollup(v):
    return health.rollup(v.checks)


@query
def latest_health(v):
    return health.latest(v.checks, v.check_sources)


@query
def health_labels(v):
    return health.digest_lines(health.latest(v.checks, v.check_sources)).select("source_id", "line")


def _health_run(v):
    source = (F.col("page_id") % 40).alias("source_id")
    fetched = v.fetched.select("*", (F.col("page_id") + 1_000_000_000).alias("check_id"), source)
    return health_plan.health_check(fetched, v.checks, v.check_sources, as_of())


@query
def health_check(v):
    run = _health_run(v)
    return run.checks.join(run.alerts.select("check_id", "subject"), "check_id", "left").select(
        "check_id", "source_id", "status", "error", "failures", "subject"
    )


@query
def health_check_states(v):
    return _health_run(v).states


@query
def health_states_by_step(v):
    """The log taken in spans of four days, each from the state the one before it stored."""
    day = F.to_date("checked_at")
    first, last = v.checks.agg(F.min(day), F.max(day)).first()
    state = v.checks.select(*health_plan.COLUMNS, F.lit(0).cast("long").alias("failures")).limit(0)
    for start in range(0, (last - first).days + 1, 4):
        since = F.datediff(day, F.lit(first))
        span = v.checks.select(*health_plan.COLUMNS).where((since >= start) & (since < start + 4))
        state = checkpointed(health.next_state(state, span)[1])
    return health.state_of(state, v.check_sources)


# --- delivery ----------------------------------------------------------------------


@query
def push_readiness(v):
    def ready(inputs, kind):
        return delivery.readiness(v.industries, inputs, v.recipients, v.smtp, kind)

    both = ready(v.sources, "morning").unionByName(ready(v.items, "evening"))
    return both.select("industry_id", "push_type", "n_recipients", "reason")


@query
def push_outcome(v):
    scored = ranking.score_articles(_attached(v), as_of())
    top = ranking.top_articles(scored, ART, ranking.largest_top_n(v.industries))
    ready = delivery.readiness(v.industries, v.sources, v.recipients, v.smtp, "morning")
    broken = v.push_log.where("status = 'failed'").groupBy("industry_id").agg(
        F.max_by("error_msg", "id").alias("message")
    ).where("industry_id = 1")
    return delivery.outcomes(ready, top, broken)


@query
def push_failure_streak(v):
    return delivery.failure_streaks(v.push_log).select("id", "industry_id", "push_type", "status", "streak")


@query
def push_alerts(v):
    counted = delivery.failure_streaks(v.push_log)
    return delivery.failure_alerts(counted, v.industries).select("id", "streak", "subject", "error")


# --- retention ---------------------------------------------------------------------


@query
def prune_seen(v):
    return retention.prune_seen(v.seen, as_of()).select("url", "first_seen_at")


def _laid_out_seen(v):
    name = f"seen_{uuid4().hex}"
    history.store_days(v.seen, name, F.col("first_seen_at"), "url", buckets=8)
    return name


@query
def unseen_laid_out(v):
    """As `unseen_articles`, against the history in days and buckets."""
    name = _laid_out_seen(v)
    return history.unseen_since(v.articles, name, date(1970, 1, 1)).select("doc_id", "url")


@query
def prune_laid_out(v):
    """As `prune_seen`: old days are dropped as a whole, of what is left one is read with a filter."""
    name = _laid_out_seen(v)
    cutoff = datetime.fromisoformat(AS_OF_TEXT) - timedelta(days=retention.SEEN_DAYS)
    history.drop_days(v.spark, name, cutoff.date())
    return retention.prune_seen(history.since(v.spark, name, cutoff.date()), as_of()).select("url", "first_seen_at")


@query
def expire_snapshots(v):
    return retention.expire_snapshots(v.push_log, as_of()).select("id", "html_snapshot")


@query
def prune_push_log(v):
    return retention.prune_log(v.push_log, as_of()).select("id", "created_at")


@query
def cleanup_report(v):
    return retention.cleanup_report(v.seen, v.push_log, as_of())


@query
def reset_seen(v):
    return retention.reset_seen(v.seen, v.sources, [1, 3]).select("url", "source_id")


# --- schedules ---------------------------------------------------------------------


@query
def validate_schedule(v):
    return schedules.validate(v.schedules).select("id", "push_type", "is_valid")


@query
def default_schedule_time(v):
    return schedules.with_default_time(v.schedules).select(
        "id", "push_type", F.col("hour").cast("long"), F.col("minute").cast("long")
    )


def _jobs(v):
    return schedules.active_jobs(schedules.with_default_time(v.schedules).fillna(0, ["minute"]))


@query
def active_jobs(v):
    return _jobs(v).select(
        "job_id", F.col("industry_id").cast("long"), F.col("hour").cast("long"), F.col("minute").cast("long")
    )


@query
def due_jobs(v):
    jobs = _jobs(v)
    both = jobs.unionByName(schedules.daily_jobs(jobs))
    after = F.to_timestamp(F.lit("2024-01-29 01:00:00"))
    return schedules.due_jobs(both, after, as_of()).select("job_id", "fires_at")


# --- reports -----------------------------------------------------------------------


@query
def morning_report(v):
    scored = ranking.score_articles(_attached(v), as_of())
    top = ranking.top_articles(scored, ART, ranking.largest_top_n(v.industries))
    return reports.morning_report(top, v.smtp)


@query
def evening_report(v):
    return reports.evening_report(_quotes(v), v.industries, v.smtp)


@query
def quote_display_(v):
    return quote_display(_quotes(v)).select("item_pos", "price_text", "change_text", "direction", "time_text")


@query
def morning_brief(v):
    brief = briefs.morning_brief(
        v.pages, v.details, v.seen, v.sources, v.industries, v.recipients, v.smtp, as_of()
    )
    return brief.rows.select("industry_id", "rank", "source_id", "page_id", "pos", "title", "url", "summary", r6("score"))


@query
def evening_report_lines(v):
    return reports.evening_lines(_quotes(v), v.industries, v.smtp)


@query
def evening_report_totals(v):
    return reports.evening_totals(reports.evening_lines(_quotes(v), v.industries, v.smtp), v.industries)


def failing_summarizer(lang, title, text):
    """The first sentence, with a title of its own in English; fails where a title ends in 3."""
    bad = [t for t in title if t.endswith("3")]
    if bad:
        raise ValueError(f"cannot read {bad[0]}")
    lead = [t.split(".")[0] for t in text]
    return [f"AI {t}|{s}" if code == "en" else s for code, t, s in zip(lang, title, lead)]


def _summarized_brief(v):
    return briefs.morning_brief(
        v.pages, v.details, v.seen, v.selecting_sources, v.industries, v.recipients, v.smtp, as_of(),
        summarizer=failing_summarizer,
    )


@query
def morning_brief_summarized(v):
    return _summarized_brief(v).rows.select(
        "industry_id", "rank", "source_id", "page_id", "pos", "title", "url", "summary", r6("score")
    )


@query
def morning_brief_errors(v):
    """What could not be read or summarized; known before anything is ranked."""
    _, unanswered, failed = briefs.read_links(
        v.pages, v.details, v.seen, v.selecting_sources, summarizer=failing_summarizer)
    nothing = F.lit(None)
    return unanswered.select("source_id", "page_id", "pos", "error").unionByName(
        failed.select(F.col("id").alias("source_id"), nothing.cast("long").alias("page_id"),
                      nothing.cast("int").alias("pos"), "error"))


@query
def evening_brief(v):
    brief = briefs.evening_brief(
        v.items, v.snapshot, v.industries, v.recipients, v.smtp, as_of(), WORDS, PREFERRED
    )
    return brief.log.withColumn("html_snapshot", F.length("html_snapshot").cast("long"))


# --- hygiene -----------------------------------------------------------------------


@query
def mask_sensitive(v):
    return v.table("documents").select("doc_id", Y.mask(F.col("text")).alias("masked"))


@query
def url_safety(v):
    return Y.check_urls(v.urls, v.resolved).select("page_id", "is_safe", "reason")


@query
def encrypt_column(v):
    # From a table, so that neither plans nor event logs show it.
    key = v.spark.createDataFrame([(KEY,)], "key string").select("key").scalar()
    sealed = v.smtp.withColumn("sealed", Y.encrypt(F.col("password"), key))
    return sealed.select(
        "id", Y.decrypt(F.col("sealed"), key).alias("password"),
        (F.col("sealed") != F.col("password")).alias("changed"),
    )


@query
def rate_limit_(v):
    return rate_limit(v.attempts, "user_id", "ts", "event_id", DAY_LIMIT, 86400).select(
        "event_id", "user_id", "allowed"
    )


# --- streams -----------------------------------------------------------------------


def _drained(v, stream, name):
    """Run a stream over what there is into the shared folder and read the rows back."""
    folder = f"{shared_folder(v.spark)}/{name}-{uuid4().hex}"
    query_ = stream.writeStream.trigger(availableNow=True).option(
        "checkpointLocation", f"{folder}/state"
    ).format("parquet").start(f"{folder}/rows")
    query_.awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query
def stream_unseen(v):
    visits = v.event_stream.select(
        F.concat(F.lit("https://e.example/"), "user_id").alias("url"), F.col("ts").cast("timestamp").alias("published_at")
    )
    return _drained(v, jobs.unseen_stream(visits), "unseen").select("url")


@query
def stream_briefing(v):
    folder = f"{shared_folder(v.spark)}/briefing-{uuid4().hex}"
    writer = jobs.briefing_stream(
        v.page_stream, v.details, v.seen, v.sources, v.industries, as_of(), f"{folder}/rows"
    )
    writer.option("checkpointLocation", f"{folder}/state").start().awaitTermination()
    rows = v.spark.read.parquet(f"{folder}/rows")
    return rows.select("industry_id", "source_id", "page_id", "pos", "title", "url", "summary", r6("score"))


@query
def stream_briefing_by_source(v):
    folder = f"{shared_folder(v.spark)}/briefing-{uuid4().hex}"
    writer = jobs.briefing_stream(
        v.page_stream, v.details, v.seen, v.selecting_sources, v.industries, as_of(), f"{folder}/rows"
    )
    writer.option("checkpointLocation", f"{folder}/state").start().awaitTermination()
    return v.spark.read.parquet(f"{folder}/rows").select("industry_id", "source_id", "page_id", "pos", "url", r6("score"))


@query
def stream_failures(v):
    counted = jobs.failure_stream(v.checks_of(v.arriving_events), lateness_seconds=LATENESS)
    return _drained(v, counted, "failures").select("check_id", "source_id", "status", "failures")


@query
def stream_rate_limit(v):
    tries = v.attempts_of(v.arriving_events)
    decided = jobs.rate_limit_stream(tries, "user_id", "ts", "event_id", DAY_LIMIT, 86400, LATENESS)
    return _drained(v, decided, "attempts").select("event_id", "user_id", "allowed")


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name.rstrip("_"): (lambda spark, folder, fn=fn: fn(Views(spark, folder)))
        for name, fn in QUERIES.items()
    }
