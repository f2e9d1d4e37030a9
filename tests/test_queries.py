"""Registered queries against their SQL on the smallest tables."""

import pytest
from check_oracle import compare, connect

from nestrank.catalog import all_queries, all_sql

SF_DIR = "/root/testdata/sf0.001"
# queries that score every listing take most of a minute to plan; check_oracle.py runs them
MODULES = tuple(f"nestrank.catalog.{m}_queries" for m in ("store", "page", "data", "many"))
SCORING = {"alerts_not_sent", "stale_alerts", "scout_alerts", "scout_seen"}
NAMES = sorted(n for n, q in all_queries().items() if q.__module__ in MODULES and n not in SCORING)


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    status, note = compare(spark, con, SF_DIR, all_queries()[name], all_sql()[name])
    assert status == "ok", note


@pytest.mark.parametrize("mode", ["score", "price_low", "price_high", "light", "tranquility", "newest"])
def test_sorts_return_every_row_in_order(spark, con, mode):
    name = f"sort_{mode}_all"
    got = [r.id for r in all_queries()[name](spark, SF_DIR).collect()]
    want = [r[0] for r in con.execute(all_sql()[name]).fetchall()]
    assert got == want and len(got) == con.execute("SELECT count(*) FROM orders").fetchone()[0] > 500
