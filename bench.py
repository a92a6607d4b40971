"""Time the headline queries and print one JSON line.

Folder and cores come from BENCH_SF_DIR and BENCH_CPUS; names on the command
line choose other queries (`all` for every registered one).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from checks.queries import registered

HEADLINE = [
    "extract_links", "extract_links_scoped", "extract_summary", "extract_article_text",
    "parse_keywords", "score_articles", "top_n_per_industry", "filter_report",
    "unseen_articles", "append_seen", "dedup_exact", "dedup_titles", "dedup_semantic",
    "quotes_stock", "quotes_futures_match", "fetch_quotes", "evening_report",
    "consecutive_failures", "latest_health", "push_failure_streak", "cleanup_report",
    "mask_sensitive", "url_safety", "rate_limit", "morning_brief",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rounds = int(os.environ.get("BENCH_ROUNDS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = registered()
    names = sys.argv[1:] or HEADLINE
    names = list(known) if names == ["all"] else names
    known["scan_projected"](spark, folder).count()
    seconds = {}
    for name in names:
        took = []
        for _ in range(rounds + 1):  # the first run warms up
            start = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
