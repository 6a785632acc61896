"""The reference's own six unit cases, as DataFrame tests."""

import datetime as dt

from pyspark.sql import functions as F

from meterflow.operators import analytics, billing, outbox
from meterflow.functions import codec
from meterflow.sources import sinks

NOW = dt.datetime(2024, 5, 1, 12, 0, 0)
CHUNK = ("event_id string, session_id string, sandbox_id string, organization_id string, sequence bigint, "
         "from_ts timestamp_ntz, to_ts timestamp_ntz, cpu double, gpu double, ram_gb double, disk_gb double, "
         "region string, region_type string, sandbox_class string")


def chunk(spark, rows):
    return spark.createDataFrame(rows, CHUNK)


def test_payload_build(spark):
    c = chunk(spark, [("evt-123", "sess-456", "sb-1", "org-789", 1, NOW, NOW + dt.timedelta(hours=1),
                       None, None, None, None, "", "", "")])
    p = billing.billing_payload(c).collect()[0]
    assert p.transaction_id == "sess-456:1"
    assert p.customer_id == "org-789"
    assert p.event_type == "usage_billing_chunk"
    assert p.timestamp == NOW + dt.timedelta(hours=1)
    assert p.properties.duration_hours == 1.0
    assert p.properties.cpu is None  # key absent when the resource is not set
    js = codec.encode(F.struct("properties")).alias("j")
    text = billing.billing_payload(c).select(js).collect()[0].j
    assert '"cpu"' not in text and '"duration_hours":1.0' in text


def test_chunk_validation(spark):
    c = chunk(spark, [
        ("evt-1", "sess-1", "sb-1", "org", 1, NOW, NOW + dt.timedelta(hours=1), 2.0, 0.0, 4.0, 20.0, "us", "", "container"),
        ("", "sess-1", "sb-1", "org", 2, NOW, NOW + dt.timedelta(hours=1), 2.0, 0.0, 4.0, 20.0, "us", "", "container"),
        ("evt-3", "sess-1", "sb-1", "org", 3, NOW, NOW - dt.timedelta(hours=1), 2.0, 0.0, 4.0, 20.0, "us", "", "container"),
    ])
    got = {r.sequence: r.reject_reason for r in outbox.validate_chunks(c).collect()}
    assert got == {1: None, 2: "required_fields", 3: "time_range"}


def test_export_valid_and_null(spark):
    ev = spark.createDataFrame(
        [("evt-1", "sess-1", 1, NOW, "sess-1:1", "org-1")],
        "event_id string, session_id string, sequence bigint, processed_at timestamp_ntz, "
        "metronome_id string, organization_id string")
    recs = sinks.processed_records(ev).select("value")
    null_event = spark.createDataFrame([("null",)], "value string")
    dec = codec.decode_processed(recs.union(null_event.select(F.col("value").cast("binary"))), "value")
    good, bad = analytics.not_null_event(dec)
    assert good.count() == 1 and bad.count() == 1
    rows = analytics.export_rows(dec).collect()
    assert [r.event_id for r in rows] == ["evt-1"]
