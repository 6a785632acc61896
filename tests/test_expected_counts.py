"""The checked expected results listed in FIXTURES.md (row counts per scale)."""

import pytest
from pyspark.sql import functions as F

from meterflow import schemas as S
from meterflow.operators import analytics, chunks, ledger, outbox, reconcile, sessions
from meterflow.sources.fixtures import Fixtures

EXPECTED = {
    "/root/testdata/sf0.001": {"c1": 545, "c7": (4673, 1155, 172), "c4": 3931, "l1": (1202, 2934, 317),
                               "l4": 150},
    "/root/testdata/sf0.01": {"c1": 5233, "c7": (46877, 11585, 1538), "e1": 5046, "e2": 10220, "c4": 38559,
                              "l1": (12223, 29037, 3032), "l4": 150},
}


@pytest.mark.parametrize("sf", sorted(EXPECTED))
def test_fixture_expected_counts(spark, sf):
    exp = EXPECTED[sf]
    f = Fixtures(spark, sf)
    assert sessions.unbilled_sessions(f.usage_sessions, S.AS_OF, "1 hour").count() == exp["c1"]

    c7 = {r.reject_reason: r.n for r in outbox.validate_chunks(f.chunk_deliveries)
          .groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert (c7[None], c7["time_range"], c7["required_fields"]) == exp["c7"]

    if "e1" in exp:
        unpublished = outbox.unpublished_events(f.outbox_events)
        assert ledger.already_processed(unpublished, f.processed_outbox_events).count() == exp["e1"]
        assert ledger.not_yet_processed(unpublished, f.processed_outbox_events).count() == exp["e2"]

    assert chunks.chunk_backfill(f.usage_sessions, S.AS_OF, "90 days").count() == exp["c4"]

    new = f.processed_billing_events.join(f.first_deliveries.select("event_id", "to_ts"), "event_id")
    rec = {r.status: r.n for r in reconcile.reconcile_summary(
        reconcile.reconcile_pipelines(f.legacy_submissions, new.select("transaction_id", "to_ts"))).collect()}
    both = rec.get("matched", 0) + rec.get("differs", 0)
    assert (both, rec["missing_in_new"], rec["missing_in_legacy"]) == exp["l1"]

    assert analytics.event_volume(f.table("events")).count() == exp["l4"]
