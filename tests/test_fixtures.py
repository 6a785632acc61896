"""The DataFrame fixture views equal the fixture SQL run by DuckDB."""

import pytest

from meterflow.sources.fixtures import FIXTURE_SQL
from tests.oracle import compare

VIEWS = ["usage_sessions", "chunk_deliveries", "outbox_events", "processed_outbox_events",
         "processed_billing_events", "billing_processed_deliveries", "legacy_submissions",
         "session_lifecycle"]


@pytest.mark.parametrize("view", VIEWS)
def test_fixture_view_matches_sql(fx_small, duck_small, view):
    df = getattr(fx_small, view)
    sql = FIXTURE_SQL + f"SELECT * FROM {view}"
    if view in ("chunk_deliveries", "billing_processed_deliveries"):
        sql = FIXTURE_SQL + f"SELECT * REPLACE (CAST(delivery_no AS BIGINT) AS delivery_no) FROM {view}"
    assert compare(df, duck_small, sql) == []


def test_fixture_counts(fx_small):
    assert fx_small.usage_sessions.count() == 1500
    assert fx_small.chunk_deliveries.count() == 6000
