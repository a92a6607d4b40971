"""The registered queries against their SQL texts; COURANT_ALL=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
SOME = ["top_n_per_industry", "extract_links", "extract_article_text", "fetch_quotes", "latest_health", "read_answers", "due_jobs"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_query_has_its_text():
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(name == "pipeline" or name.startswith("op") for name in without)


def test_entry(spark):
    assert entry.entry(spark).columns == ["industry_id", "rank", "doc_id", "title", "score"]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("COURANT_ALL") else SOME)
def test_query(spark, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert difference(got, connect(FOLDER).execute(entry.oracle_sql()[name]).df()) is None
