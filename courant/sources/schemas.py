"""Schemas of the stored tables and the defaults of their columns."""

from __future__ import annotations

from pyspark.sql import types as T

_int, _str, _bool = T.IntegerType(), T.StringType(), T.BooleanType()
_long, _dbl, _ts = T.LongType(), T.DoubleType(), T.TimestampType()


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


INDUSTRY = _schema(
    ("id", _int, False), ("name", _str, False), ("top_n", _int, False),
    ("keywords", _str, True), ("created_at", _ts, False),
)
NEWS_SOURCE = _schema(
    ("id", _int, False), ("industry_id", _int, False), ("name", _str, False),
    ("url", _str, False), ("link_selector", _str, True), ("weight", _int, False),
    ("keywords", _str, True), ("language", _str, False), ("health_status", _str, False),
    ("last_check_at", _ts, True), ("last_error", _str, True),
    ("consecutive_failures", _int, False), ("created_at", _ts, False),
)
FINANCE_ITEM = _schema(
    ("id", _int, False), ("industry_id", _int, False), ("name", _str, False),
    ("symbol", _str, False), ("item_type", _str, False), ("created_at", _ts, False),
)
RECIPIENT = _schema(
    ("id", _int, False), ("industry_id", _int, False), ("email", _str, False),
    ("name", _str, False), ("created_at", _ts, False),
)
SMTP_CONFIG = _schema(
    ("id", _int, False), ("host", _str, False), ("port", _int, False),
    ("username", _str, False), ("password_encrypted", _str, False),
    ("sender_name", _str, True), ("contact_email", _str, True), ("use_tls", _bool, False),
    ("created_at", _ts, False), ("updated_at", _ts, False),
)
PUSH_SCHEDULE = _schema(
    ("id", _int, False), ("industry_id", _int, False), ("push_type", _str, False),
    ("hour", _int, False), ("minute", _int, False), ("enabled", _bool, False),
    ("created_at", _ts, False),
)
SEEN_ARTICLE = _schema(
    ("id", _long, False), ("url", _str, False), ("title", _str, False),
    ("source_id", _int, True), ("first_seen_at", _ts, False),
)
PUSH_LOG = _schema(
    ("id", _long, False), ("industry_id", _int, True), ("push_type", _str, False),
    ("status", _str, False), ("article_count", _int, False), ("recipient_count", _int, False),
    ("error_msg", _str, True), ("html_snapshot", _str, True), ("triggered_by", _str, False),
    ("created_at", _ts, False),
)
MARKET_SNAPSHOT = _schema(
    ("market", _str, False), ("pos", _long, False), ("code", _str, False),
    ("name", _str, True), ("last", _dbl, True), ("change_pct", _str, True),
)
PAGE = _schema(("page_id", _long, False), ("url", _str, False), ("html", _str, True))

TABLES = {
    "industry": INDUSTRY, "news_source": NEWS_SOURCE, "finance_item": FINANCE_ITEM,
    "recipient": RECIPIENT, "smtp_config": SMTP_CONFIG, "push_schedule": PUSH_SCHEDULE,
    "seen_article": SEEN_ARTICLE, "push_log": PUSH_LOG,
    "market_snapshot": MARKET_SNAPSHOT, "page": PAGE,
}

# Defaults of columns that older copies of a table may lack.
ADDED_COLUMNS = {
    "news_source": {
        "link_selector": (_str, None), "language": (_str, "zh"),
        "health_status": (_str, "unknown"), "last_check_at": (_ts, None),
        "last_error": (_str, None), "consecutive_failures": (_int, 0),
    },
    "industry": {"keywords": (_str, None)},
}
