"""Record shapes, enum values and run constants of the metering data model."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results
# (enum strings, event types, topic and group names, creation defaults).
# ---------------------------------------------------------------------------
SESSION_ACTIVE = "SESSION_ACTIVE"
SESSION_FINISHED = "SESSION_FINISHED"
BILLING_ACTIVE = "ACTIVE"
BILLING_COMPLETED = "COMPLETED"
SANDBOX_CLASSES = ("linux-vm", "container", "android", "windows", "11184809")
SESSION_STATUSES = (SESSION_ACTIVE, SESSION_FINISHED)
BILLING_STATUSES = (BILLING_ACTIVE, BILLING_COMPLETED)

EVENT_TYPE_CHUNK = "billing_chunk_created"
EVENT_TYPE_PAYLOAD = "usage_billing_chunk"
TOPIC_CHUNKS = "usage-billing-chunks"
TOPIC_PROCESSED = "billing-processed"
BILLING_CONSUMER_GROUP = "billing-processors"

DEFAULT_CPU = 2.0
DEFAULT_GPU = 0.0
DEFAULT_RAM_GB = 4.0
DEFAULT_DISK_GB = 20.0
DEFAULT_REGION = "us-east-1"
DEFAULT_SANDBOX_CLASS = "container"

# Batch bounds of one cycle (scan page, publish lease, mark slice, finish batch,
# replay sample).
SCAN_PAGE = 1000
PUBLISH_BATCH = 500
MARK_SLICE = 1000
FINISH_BATCH = 50
REPLAY_BATCH = 15

# ---------------------------------------------------------------------------
# Run constants used by the fixture queries.
# ---------------------------------------------------------------------------
AS_OF = dt.datetime(1998, 6, 1, 0, 0, 0)
AS_OF_SQL = "TIMESTAMP '1998-06-01 00:00:00'"
SCAN_INTERVAL = "1 hour"
BACKFILL_INTERVAL_DAYS = 90
SAMPLE_SEED = "seed-1"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
NTZ = T.TimestampNTZType()

USAGE_SESSIONS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("sandbox_id", T.StringType(), False),
    T.StructField("organization_id", T.StringType(), False),
    T.StructField("start_at", NTZ, False),
    T.StructField("end_at", NTZ, True),
    T.StructField("status", T.StringType(), False),
    T.StructField("last_billed_at", NTZ, True),
    T.StructField("billing_status", T.StringType(), False),
    T.StructField("billing_sequence", T.LongType(), False),
    T.StructField("cpu", T.DoubleType(), True),
    T.StructField("gpu", T.DoubleType(), True),
    T.StructField("ram_gb", T.DoubleType(), True),
    T.StructField("disk_gb", T.DoubleType(), True),
    T.StructField("region", T.StringType(), False),
    T.StructField("sandbox_class", T.StringType(), False),
    T.StructField("recorded_at", NTZ, False),
])

OUTBOX_EVENTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("event_id", T.StringType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("session_id", T.StringType(), False),
    T.StructField("sequence", T.LongType(), False),
    T.StructField("payload", T.StringType(), True),
    T.StructField("created_at", NTZ, False),
    T.StructField("published_at", NTZ, True),
    T.StructField("retry_count", T.IntegerType(), False),
    T.StructField("last_error", T.StringType(), True),
])

PROCESSED_OUTBOX_EVENTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("event_id", T.StringType(), False),
    T.StructField("session_id", T.StringType(), False),
    T.StructField("sequence", T.LongType(), False),
    T.StructField("processed_at", NTZ, False),
])

PROCESSED_BILLING_EVENTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("event_id", T.StringType(), False),
    T.StructField("session_id", T.StringType(), False),
    T.StructField("sequence", T.LongType(), False),
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("processed_at", NTZ, False),
])

# Wire chunk. Times are decoded as zone-aware and converted to NTZ (UTC) after
# decoding, because a `Z` suffix does not parse into timestamp_ntz.
CHUNK_FIELDS = ("event_id", "session_id", "sandbox_id", "organization_id", "sequence",
                "from", "to", "cpu", "gpu", "ram_gb", "disk_gb", "region",
                "region_type", "sandbox_class")
CHUNK_WIRE = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("sandbox_id", T.StringType()),
    T.StructField("organization_id", T.StringType()),
    T.StructField("sequence", T.LongType()),
    T.StructField("from", T.TimestampType()),
    T.StructField("to", T.TimestampType()),
    T.StructField("cpu", T.DoubleType()),
    T.StructField("gpu", T.DoubleType()),
    T.StructField("ram_gb", T.DoubleType()),
    T.StructField("disk_gb", T.DoubleType()),
    T.StructField("region", T.StringType()),
    T.StructField("region_type", T.StringType()),
    T.StructField("sandbox_class", T.StringType()),
])

PROCESSED_WIRE = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("sequence", T.LongType()),
    T.StructField("processed_at", T.TimestampType()),
    T.StructField("metronome_id", T.StringType()),
    T.StructField("organization_id", T.StringType()),
])

# Billing payload; properties keys in alphabetical order (how the vendor JSON
# encoder writes a map).
PAYLOAD_PROPERTIES = T.StructType([
    T.StructField("cpu", T.DoubleType()),
    T.StructField("disk_gb", T.DoubleType()),
    T.StructField("duration_hours", T.DoubleType()),
    T.StructField("from", T.StringType()),
    T.StructField("gpu", T.DoubleType()),
    T.StructField("ram_gb", T.DoubleType()),
    T.StructField("region", T.StringType()),
    T.StructField("sandbox_class", T.StringType()),
    T.StructField("sandbox_id", T.StringType()),
    T.StructField("sequence", T.LongType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("to", T.StringType()),
])

BILLING_PAYLOAD = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("timestamp", NTZ),
    T.StructField("properties", PAYLOAD_PROPERTIES),
])

KAFKA_RECORD = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("headers", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()),
        T.StructField("value", T.BinaryType()),
    ]))),
    T.StructField("timestamp", T.TimestampType()),
])

TABLE_SCHEMAS = {
    "usage_sessions": USAGE_SESSIONS,
    "outbox_events": OUTBOX_EVENTS,
    "processed_outbox_events": PROCESSED_OUTBOX_EVENTS,
    "processed_billing_events": PROCESSED_BILLING_EVENTS,
}

# Primary / unique keys and allowed enum values checked by check_constraints.
TABLE_KEYS = {
    "usage_sessions": ("id",),
    "outbox_events": ("id", "event_id"),
    "processed_outbox_events": ("event_id",),
    "processed_billing_events": ("event_id",),
}
TABLE_ENUMS = {
    "usage_sessions": {"status": SESSION_STATUSES, "billing_status": BILLING_STATUSES,
                       "sandbox_class": SANDBOX_CLASSES},
}

# Column defaults of the table definitions (fixed values).
TABLE_DEFAULTS = {
    "usage_sessions": {"billing_sequence": "0", "sandbox_class": "'container'",
                       "recorded_at": "localtimestamp()"},
    "outbox_events": {"created_at": "localtimestamp()", "retry_count": "0"},
    "processed_outbox_events": {"processed_at": "localtimestamp()"},
    "processed_billing_events": {"processed_at": "localtimestamp()"},
}
# Tables whose surrogate ``id`` the table gives when a row brings none.
TABLE_SERIALS = ("outbox_events", "processed_outbox_events", "processed_billing_events")
