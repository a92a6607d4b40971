import math
from datetime import datetime

from pyspark.sql import functions as F

from courant.functions.display import quote_display
from courant.operators import quotes as Q
from courant.plans import reports
from courant.plans.briefs import evening_brief

NOW = datetime(2024, 1, 31, 15, 4, 5)
SNAPSHOT = [
    ("cn", 1, "300274", "阳光电源", 149.164, "-4.72"), ("cn", 2, "300274", "later row", 1.0, "1"),
    ("cn", 3, "601012", "隆基绿能", float("nan"), "0"), ("hk", 4, "00700", "腾讯", 300.0, "+1.5%"),
    ("global", 5, "LCPT", "伦铜期货", 100.0, "1"), ("global", 6, "XX", "综合铜 03", 12863.0, "+0.19%"),
    ("global", 7, "ALX", "Aluminum spot", 10.0, "bad"), ("global", 8, "LTH", "碳酸锂", float("nan"), "0"),
    ("global", 9, "ZERO", "zero", 0.0, "0"), ("global", 10, "CU2505", None, 5.0, "-0.5%"),
]
ITEMS = [
    (1, 1, "", "300274", "stock"), (2, 1, "自定义", "601012", "stock"), (3, 1, "", "999999", "stock"),
    (4, 1, "", "00700", "stock_hk"), (5, 1, "", "cu2606", "futures"), (6, 1, "", "al2505", "futures"),
    (7, 1, "碳酸锂主力", "lc2506", "futures"), (8, 1, "", "zero", "futures"), (9, 1, "", "cu2505", "futures"),
    (10, 1, "", "x", "futures"), (11, 1, "", "300274", None),
]


def inputs(spark):
    snapshot = spark.createDataFrame(SNAPSHOT, "market string, pos long, code string, name string, last double, change_pct string")
    items = spark.createDataFrame(ITEMS, "item_pos long, industry_id int, name string, symbol string, item_type string")
    return items, snapshot


def test_fetch_quotes(spark):
    items, snapshot = inputs(spark)
    got = {r.item_pos: r for r in Q.fetch_quotes(items, snapshot, F.lit(NOW)).collect()}
    assert sorted(got) == [1, 2, 4, 5, 9, 11]
    assert (got[1].name, got[1].price, got[1].change_pct, got[1].item_type) == ("阳光电源", 149.16, -4.72, "stock")
    assert got[2].name == "自定义" and math.isnan(got[2].price)  # stock prices are not checked
    assert (got[4].item_type, got[4].change_pct) == ("stock", 1.5)
    assert (got[5].name, got[5].price) == ("综合铜 03", 12863.0)  # the preferred word beats the first row
    assert (got[9].price, got[9].name) == (5.0, "cu2505")  # exact code first; no name in the snapshot
    cover = Q.coverage(items, Q.fetch_quotes(items, snapshot, F.lit(NOW))).first()
    assert (cover.requested, cover.found) == (11, 6)
    missing = Q.missing_items(items, Q.fetch_quotes(items, snapshot, F.lit(NOW))).collect()
    assert sorted(r.item_pos for r in missing) == [3, 6, 7, 8, 10]


def test_words_in_order(spark):
    rows = [("global", 1, "A", "rod", 1.0, "0"), ("global", 2, "B", "Bolt", 2.0, "0"), ("global", 3, "C", "red bolt", 3.0, "0")]
    snapshot = spark.createDataFrame(rows, "market string, pos long, code string, name string, last double, change_pct string")
    best = Q.commodity_by_prefix(snapshot, {"bo": ["bolt", "rod"], "ro": ["rod"], "no": ["nut"]}, "red").collect()
    assert {r.prefix: r.found_name for r in best} == {"bo": "red bolt", "ro": "rod"}


def test_display(spark):
    rows = [(1, "n", "s", 2.0, 0.5, "stock"), (2, "n", "s", 2.5, -0.5, "stock"), (3, "n", "s", float("nan"), 0.0, "futures")]
    quotes = spark.createDataFrame(rows, "item_pos long, name string, symbol string, price double, change_pct double, item_type string")
    shown = quote_display(quotes.withColumn("quoted_at", F.lit(NOW))).orderBy("item_pos").collect()
    assert [(r.price_text, r.change_text, r.direction, r.time_text) for r in shown] == [
        ("2.00", "+0.50%", "up", "15:04:05"), ("2.50", "-0.50%", "down", "15:04:05"), ("nan", "0.00%", "flat", "15:04:05")]


def test_evening_report(spark):
    items, snapshot = inputs(spark)
    industries = spark.createDataFrame([(1, "能源"), (2, "empty")], "id int, name string")
    smtp = spark.createDataFrame([(2, "u2", "c2"), (1, "u1", "")], "id int, username string, contact_email string")
    quotes = Q.fetch_quotes(items, snapshot, F.lit(NOW))
    whole = reports.evening_report(quotes, industries, smtp).collect()
    assert len(whole) == 1 and whole[0].n_items == 6 and whole[0].contact == "u1"
    body = whole[0].body
    lines = reports.evening_lines(quotes, industries, smtp)
    assert "".join(r.line for r in reports.body_lines(lines, 1).collect()) == body
    assert "".join(r.line for r in lines.collect()) == body  # as it is stored
    totals = reports.evening_totals(lines, industries).collect()
    assert [(r.industry_id, r.n_items, r.n_chars) for r in totals] == [(1, 6, len(body))]
    assert body.index(reports.STOCK_HEADING) < body.index("00700") < body.index(reports.FUTURES_HEADING) < body.index("cu2606")


def test_a_late_position_keeps_its_snapshot(spark):
    items = spark.createDataFrame(
        [(200_005, 1, "", "300274", "stock"), (7, 2, "", "300274", "stock")],
        "item_pos long, industry_id int, name string, symbol string, item_type string")
    snapshot = inputs(spark)[1]
    industries = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    mail = spark.createDataFrame([(1, "x@y.example"), (2, "z@y.example")], "industry_id int, email string")
    smtp = spark.createDataFrame([(1, "u1", "")], "id int, username string, contact_email string")
    errors = spark.createDataFrame([(2, "refused")], "industry_id int, message string")
    brief = evening_brief(items, snapshot, industries, mail, smtp, F.lit(NOW), errors=errors)
    log = {r.industry_id: r for r in brief.log.collect()}
    assert (log[1].status, log[1].article_count) == ("success", 1) and "300274" in log[1].html_snapshot
    assert (log[2].status, log[2].error_msg, log[2].html_snapshot) == ("failed", "refused", None)
