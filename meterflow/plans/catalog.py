"""Registered queries: one Spark plan per operator id, each with its DuckDB oracle.

Every query reads the driver's tables through the fixture views (``Fixtures``)
and runs over the whole tables. Run constants (clock, intervals, sample seed,
batch bounds) are the ones in ``schemas``.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow import schemas as S
from meterflow.functions import codec
from meterflow.functions import expressions as X
from meterflow.operators import analytics, billing, chunks, constraints, ledger, outbox, reconcile, sessions
from meterflow.session import new_run_dir
from meterflow.sources import sinks
from meterflow.sources.fixtures import FIXTURE_SQL, Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = S.AS_OF
A = S.AS_OF_SQL
CURSOR = "sess-0000005000"
RANGE_LO, RANGE_HI = "1997-01-01 00:00:00", "1997-12-31 23:59:59"
RANGE_LO_SQL, RANGE_HI_SQL = f"TIMESTAMP '{RANGE_LO}'", f"TIMESTAMP '{RANGE_HI}'"
MAX_RETRIES = 1


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = FIXTURE_SQL + sql
        return fn
    return deco


def fx(spark: SparkSession, sf_dir: str) -> Fixtures:
    return Fixtures(spark, sf_dir)


# Shared SQL fragments -------------------------------------------------------
ELIGIBLE_SQL = f"status = 'SESSION_ACTIVE' AND last_billed_at < {A} - INTERVAL 1 HOUR"
SHA_SEQ = "sha256(concat({sid}, ':', CAST({seq} AS VARCHAR)))"
STABLE_ID = "CAST(('0x' || substr(sha256({x}), 1, 15)) AS BIGINT)"
CHUNK_SELECT = ("event_id, session_id, sandbox_id, organization_id, sequence, from_ts, to_ts, "
                "cpu, gpu, ram_gb, disk_gb, region, region_type, sandbox_class")
OUTBOX_NO_PAYLOAD = "id, event_id, event_type, session_id, sequence, created_at, published_at, retry_count, last_error"
def invalid_case(t: str = "") -> str:
    """C7 rule in SQL over the chunk columns of alias ``t`` (none when empty)."""
    p = f"{t}." if t else ""
    return (f"CASE WHEN coalesce({p}event_id,'') = '' OR coalesce({p}session_id,'') = '' "
            f"OR coalesce({p}sandbox_id,'') = '' THEN 'required_fields' "
            f"WHEN NOT coalesce({p}to_ts > {p}from_ts, false) THEN 'time_range' END")


INVALID_CASE = invalid_case()
FIRST = "(SELECT * FROM chunk_deliveries WHERE delivery_no = 1)"


def _no_payload(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in outbox.OUTBOX_COLUMNS if c != "payload"])


# ---------------------------------------------------------------------------
# A: sources and sinks
# ---------------------------------------------------------------------------
@query("a1_read_sessions", "SELECT * FROM usage_sessions")
def a1(spark, d):
    return sessions.read_sessions(fx(spark, d).usage_sessions)


@query("a2_read_outbox", f"SELECT {OUTBOX_NO_PAYLOAD}, true AS payload_decodes FROM outbox_events")
def a2(spark, d):
    o = outbox.read_outbox(fx(spark, d).outbox_with_payload())
    dec = codec.decode_chunks(o.withColumnRenamed("event_id", "outbox_event_id"), "payload")
    ok = F.col("decode_error").isNull() & (F.col("event_id") == F.col("outbox_event_id"))
    return (dec.withColumn("payload_decodes", ok).withColumn("event_id", F.col("outbox_event_id"))
               .select(*[c for c in outbox.OUTBOX_COLUMNS if c != "payload"], "payload_decodes"))


@query("a3_read_ledger", "SELECT event_id, session_id, sequence, transaction_id, processed_at FROM processed_billing_events")
def a3(spark, d):
    return ledger.read_ledger(fx(spark, d).processed_billing_events, "billing")


@query("a3_read_publisher_ledger", "SELECT event_id, session_id, sequence, processed_at FROM processed_outbox_events")
def a3_outbox(spark, d):
    return ledger.read_ledger(fx(spark, d).processed_outbox_events, "outbox")


@query("a6_write_chunks", f"""
SELECT sandbox_id AS key, 'billing_chunk_created' AS h_event_type, event_id AS h_event_id,
       organization_id AS h_organization_id, event_id, session_id, sequence, from_ts, to_ts, cpu, gpu
FROM {FIRST} c WHERE {INVALID_CASE} IS NULL""")
def a6(spark, d):
    valid = outbox.valid_chunks(fx(spark, d).first_deliveries)
    rec = sinks.chunk_records(valid)
    back = codec.decode_chunks(rec.select("key", "value", "headers"), "value")
    return back.select(F.col("key").cast("string").alias("key"),
                       sinks.header_value("headers", "event_type").alias("h_event_type"),
                       sinks.header_value("headers", "event_id").alias("h_event_id"),
                       sinks.header_value("headers", "organization_id").alias("h_organization_id"),
                       "event_id", "session_id", "sequence", "from_ts", "to_ts", "cpu", "gpu")


@query("a8_write_messages", """
SELECT transaction_id AS key, organization_id AS h_organization_id, session_id AS h_session_id, event_id AS value
FROM processed_billing_events p JOIN (SELECT event_id AS e2, organization_id FROM chunk_deliveries WHERE delivery_no = 1) c
  ON c.e2 = p.event_id""")
def a8(spark, d):
    f = fx(spark, d)
    p = f.processed_billing_events.join(f.first_deliveries.select("event_id", "organization_id"), "event_id")
    msgs = p.select("transaction_id", "event_id",
                    F.create_map(F.lit("organization_id"), F.col("organization_id"),
                                 F.lit("session_id"), F.col("session_id")).alias("hdr"))
    rec = sinks.message_records(msgs, "transaction_id", "event_id", "hdr")
    return rec.select(F.col("key").cast("string").alias("key"),
                      sinks.header_value("headers", "organization_id").alias("h_organization_id"),
                      sinks.header_value("headers", "session_id").alias("h_session_id"),
                      F.col("value").cast("string").alias("value"))


@query("a9_write_processed", """
SELECT session_id AS key, event_id, session_id, sequence, processed_at, metronome_id, organization_id
FROM billing_processed_deliveries WHERE delivery_no = 1""")
def a9(spark, d):
    p = fx(spark, d).billing_processed_deliveries.filter(F.col("delivery_no") == 1)
    rec = sinks.processed_records(p)
    back = codec.decode_processed(rec, "value")
    return back.select(F.col("key").cast("string").alias("key"), "event_id", "session_id", "sequence",
                       "processed_at", "metronome_id", "organization_id")


@query("a15_check_constraints", """
SELECT 'unique:event_id' AS constraint, event_id AS value, count(*) AS n
FROM chunk_deliveries GROUP BY event_id HAVING count(*) > 1""")
def a15(spark, d):
    """Would loading every delivery into the publisher ledger break UNIQUE(event_id)?"""
    c = fx(spark, d).chunk_deliveries.select(
        X.stable_id(F.col("event_id")).alias("id"), "event_id", "session_id", "sequence",
        F.col("to_ts").alias("processed_at"))
    return constraints.check_constraints(c, "processed_outbox_events")


# ---------------------------------------------------------------------------
# B: record builders
# ---------------------------------------------------------------------------
CREATE_SQL = f"""
SELECT session_id AS id, sandbox_id, organization_id, ts AS start_at, CAST(NULL AS TIMESTAMP) AS end_at,
       'SESSION_ACTIVE' AS status, ts AS last_billed_at, 'ACTIVE' AS billing_status, CAST(0 AS BIGINT) AS billing_sequence,
       coalesce(cpu, {{cpu}}) AS cpu, coalesce(gpu, {{gpu}}) AS gpu, coalesce(ram_gb, {{ram}}) AS ram_gb,
       coalesce(disk_gb, {{disk}}) AS disk_gb,
       coalesce(nullif(region, ''), 'us-east-1') AS region, coalesce(nullif(sandbox_class, ''), 'container') AS sandbox_class,
       {A} AS recorded_at
FROM session_lifecycle WHERE action = 'create'"""


def _create_requests(f: Fixtures) -> DataFrame:
    return (f.session_lifecycle.filter(F.col("action") == "create")
             .select(F.col("session_id").alias("id"), "sandbox_id", "organization_id",
                     F.col("ts").alias("start_at"), "cpu", "gpu", "ram_gb", "disk_gb", "region",
                     "sandbox_class"))


@query("b1_create_sessions", CREATE_SQL.format(cpu="2.0", gpu="0.0", ram="4.0", disk="20.0"))
def b1(spark, d):
    return sessions.create_sessions(_create_requests(fx(spark, d)), AS_OF)


@query("b2_create_sessions_explicit", CREATE_SQL.format(cpu="0.0", gpu="0.0", ram="0.0", disk="0.0"))
def b2(spark, d):
    return sessions.create_sessions(_create_requests(fx(spark, d)), AS_OF, explicit_resources=True)


BUILD_SQL = f"""
SELECT {SHA_SEQ.format(sid='id', seq='billing_sequence + 1')} AS event_id, id AS session_id, sandbox_id,
       organization_id, billing_sequence + 1 AS sequence, coalesce(last_billed_at, start_at) AS from_ts,
       least({A}, end_at) AS to_ts, cpu, gpu, ram_gb, disk_gb, region, '' AS region_type, sandbox_class
FROM usage_sessions WHERE {ELIGIBLE_SQL}"""


@query("b4_build_chunks", BUILD_SQL)
def b4(spark, d):
    s = fx(spark, d).usage_sessions
    return chunks.build_chunks(sessions.unbilled_sessions(s, AS_OF), AS_OF)


FINISH_REQ_SQL = """, req AS (SELECT id FROM usage_sessions UNION SELECT concat('sess-c', CAST(c_custkey AS VARCHAR)) FROM customer)
"""


def _finish(spark, d):
    f = fx(spark, d)
    req = (f.usage_sessions.select("id")
           .unionByName(f.table("customer").select(F.concat(F.lit("sess-c"), F.col("c_custkey").cast("string")).alias("id"))))
    return sessions.finish_plan(f.usage_sessions, req, AS_OF)


@query("b5_build_final_chunks", f"""
SELECT {SHA_SEQ.format(sid='id', seq='billing_sequence + 1')} AS event_id, id AS session_id, sandbox_id,
       organization_id, billing_sequence + 1 AS sequence, coalesce(last_billed_at, start_at) AS from_ts,
       {A} AS to_ts, cpu, gpu, ram_gb, disk_gb, region, '' AS region_type, sandbox_class
FROM usage_sessions WHERE status = 'SESSION_ACTIVE'""")
def b5(spark, d):
    return _finish(spark, d)[1]


@query("b6_to_outbox", f"""
, bf AS (
  SELECT s.*, k FROM usage_sessions s,
         unnest(generate_series(1, CAST(ceil(date_diff('microsecond', last_billed_at, {A}) / (90 * 86400e6)) AS BIGINT))) AS t(k)
  WHERE status = 'SESSION_ACTIVE' AND last_billed_at < {A} - INTERVAL 90 DAY)
SELECT {STABLE_ID.format(x=SHA_SEQ.format(sid='id', seq='billing_sequence + k'))} AS id,
       {SHA_SEQ.format(sid='id', seq='billing_sequence + k')} AS event_id, 'billing_chunk_created' AS event_type,
       id AS session_id, billing_sequence + k AS sequence, {A} AS created_at, CAST(NULL AS TIMESTAMP) AS published_at,
       0 AS retry_count, CAST(NULL AS VARCHAR) AS last_error,
       last_billed_at + (k - 1) * INTERVAL 90 DAY AS payload_from,
       least(last_billed_at + k * INTERVAL 90 DAY, {A}) AS payload_to, cpu AS payload_cpu, sandbox_id AS payload_sandbox_id
FROM bf""")
def b6(spark, d):
    bf = chunks.chunk_backfill(fx(spark, d).usage_sessions, AS_OF, f"{S.BACKFILL_INTERVAL_DAYS} days")
    rows = outbox.to_outbox(bf, AS_OF)
    dec = codec.decode_chunks(rows, "payload")
    return dec.select(
        *[c for c in outbox.OUTBOX_COLUMNS if c != "payload"],
        F.col("from_ts").alias("payload_from"), F.col("to_ts").alias("payload_to"),
        F.col("cpu").alias("payload_cpu"), F.col("sandbox_id").alias("payload_sandbox_id"))


def _scan(spark, d):
    f = fx(spark, d)
    return chunks.scan_and_chunk(f.usage_sessions, AS_OF, S.SCAN_INTERVAL, existing_outbox=f.outbox_events)


SCAN_OUTBOX_SQL = f"""
SELECT {STABLE_ID.format(x=SHA_SEQ.format(sid='id', seq='billing_sequence + 1'))} AS id,
       {SHA_SEQ.format(sid='id', seq='billing_sequence + 1')} AS event_id, 'billing_chunk_created' AS event_type,
       id AS session_id, billing_sequence + 1 AS sequence, {A} AS created_at, CAST(NULL AS TIMESTAMP) AS published_at,
       0 AS retry_count, CAST(NULL AS VARCHAR) AS last_error
FROM usage_sessions WHERE {ELIGIBLE_SQL}"""


@query("b7_append_outbox", f"SELECT {OUTBOX_NO_PAYLOAD} FROM outbox_events UNION ALL {SCAN_OUTBOX_SQL}")
def b7(spark, d):
    f = fx(spark, d)
    new_rows, _, _ = _scan(spark, d)
    table, _ = outbox.append_outbox(f.outbox_with_payload(), new_rows)
    return _no_payload(table)


@query("b8_decode_chunks", f"SELECT {CHUNK_SELECT}, delivery_no, CAST(NULL AS VARCHAR) AS decode_error FROM chunk_deliveries")
def b8(spark, d):
    """Every delivery through the wire format and back (strict decode)."""
    c = fx(spark, d).chunk_deliveries
    wire = c.select(codec.encode_chunks().alias("value"), "delivery_no")
    return codec.decode_chunks(wire, "value").select(*chunks.CHUNK_COLUMNS, "delivery_no", "decode_error")


@query("b9_to_wire", f"SELECT {CHUNK_SELECT} FROM {FIRST} c")
def b9(spark, d):
    return codec.to_wire(fx(spark, d).first_deliveries)


E4_SQL = f"""
SELECT {CHUNK_SELECT} FROM chunk_deliveries c
WHERE delivery_no = 1 AND NOT EXISTS (SELECT 1 FROM processed_billing_events p WHERE p.event_id = c.event_id)"""


def _e4(spark, d):
    f = fx(spark, d)
    return ledger.dedupe_by_event_id(f.chunk_deliveries.select(*chunks.CHUNK_COLUMNS, "delivery_no"),
                                     f.processed_billing_events, ["delivery_no"]).drop("delivery_no")


@query("b10_billing_payload", f"""
SELECT concat(session_id, ':', CAST(sequence AS VARCHAR)) AS transaction_id, organization_id AS customer_id,
       'usage_billing_chunk' AS event_type, to_ts AS timestamp,
       cpu AS p_cpu, disk_gb AS p_disk_gb, date_diff('microsecond', from_ts, to_ts) / 3.6e9 AS p_duration_hours,
       strftime(from_ts, '%Y-%m-%dT%H:%M:%SZ') AS p_from, gpu AS p_gpu, ram_gb AS p_ram_gb, region AS p_region,
       sandbox_class AS p_sandbox_class, sandbox_id AS p_sandbox_id, sequence AS p_sequence,
       session_id AS p_session_id, strftime(to_ts, '%Y-%m-%dT%H:%M:%SZ') AS p_to
FROM ({E4_SQL})""")
def b10(spark, d):
    return billing.flatten_payload(billing.billing_payload(_e4(spark, d)))


@query("b11_processed_event", f"""
SELECT event_id, session_id, sequence, {A} AS processed_at, concat(session_id, ':', CAST(sequence AS VARCHAR)) AS metronome_id,
       organization_id FROM ({E4_SQL})""")
def b11(spark, d):
    return billing.processed_event(_e4(spark, d), AS_OF)


def _publish_split(spark, d):
    f = fx(spark, d)
    leased = outbox.unpublished_events(f.outbox_with_payload())
    return outbox.publish_split(leased, f.processed_outbox_events)


SPLIT_SQL = f"""
, split AS (
  SELECT o.id, o.event_id, o.session_id, o.sequence,
         CASE WHEN EXISTS (SELECT 1 FROM processed_outbox_events p WHERE p.event_id = o.event_id) THEN 'already'
              WHEN {invalid_case('c')} IS NOT NULL THEN 'invalid'
              ELSE 'publish' END AS outcome,
         CASE WHEN EXISTS (SELECT 1 FROM processed_outbox_events p WHERE p.event_id = o.event_id) THEN NULL
              ELSE {invalid_case('c')} END AS detail
  FROM outbox_events o JOIN {FIRST} c ON c.event_id = o.event_id
  WHERE o.published_at IS NULL AND o.event_type = 'billing_chunk_created')
"""


@query("b12_ledger_rows", SPLIT_SQL + f"""
SELECT {STABLE_ID.format(x='event_id')} AS id, event_id, session_id, sequence, {A} AS processed_at
FROM split WHERE outcome = 'publish'""")
def b12(spark, d):
    pub = _publish_split(spark, d).filter(F.col("outcome") == "publish")
    return ledger.ledger_rows(pub.select(F.col("outbox_event_id").alias("event_id"),
                                         F.col("outbox_session_id").alias("session_id"),
                                         F.col("outbox_sequence").alias("sequence")), AS_OF, "outbox").drop("event_bucket")


@query("b13_append_ledger", SPLIT_SQL + f"""
SELECT event_id, session_id, sequence, processed_at FROM processed_outbox_events
UNION ALL SELECT event_id, session_id, sequence, {A} FROM split WHERE outcome = 'publish'""")
def b13(spark, d):
    new = b12(spark, d)
    table, _, _ = ledger.append_ledger(fx(spark, d).processed_outbox_events, new, "outbox")
    return table


# ---------------------------------------------------------------------------
# C: filters
# ---------------------------------------------------------------------------
@query("c1_unbilled_sessions", f"SELECT * FROM usage_sessions WHERE {ELIGIBLE_SQL}")
def c1(spark, d):
    return sessions.unbilled_sessions(fx(spark, d).usage_sessions, AS_OF, S.SCAN_INTERVAL)


@query("c2_active_sessions", "SELECT * FROM usage_sessions WHERE status = 'SESSION_ACTIVE'")
def c2(spark, d):
    return sessions.active_sessions(fx(spark, d).usage_sessions)


@query("c3_scan_and_chunk", f"""
SELECT {OUTBOX_NO_PAYLOAD}, coalesce(last_billed_at, start_at) AS payload_from, least({A}, end_at) AS payload_to FROM (
  SELECT o.*, s.last_billed_at, s.start_at, s.end_at FROM ({SCAN_OUTBOX_SQL}) o JOIN usage_sessions s ON s.id = o.session_id)
""")
def c3(spark, d):
    rows, _, _ = _scan(spark, d)
    dec = codec.decode_chunks(rows, "payload")
    return dec.select(*[c for c in outbox.OUTBOX_COLUMNS if c != "payload"],
                      F.col("from_ts").alias("payload_from"), F.col("to_ts").alias("payload_to"))


BACKFILL_SQL = f"""
, bf AS (
  SELECT s.*, k FROM usage_sessions s,
         unnest(generate_series(1, CAST(ceil(date_diff('microsecond', last_billed_at, {A}) / (90 * 86400e6)) AS BIGINT))) AS t(k)
  WHERE status = 'SESSION_ACTIVE' AND last_billed_at < {A} - INTERVAL 90 DAY)
"""


@query("c4_chunk_backfill", BACKFILL_SQL + f"""
SELECT {SHA_SEQ.format(sid='id', seq='billing_sequence + k')} AS event_id, id AS session_id, sandbox_id, organization_id,
       billing_sequence + k AS sequence, last_billed_at + (k - 1) * INTERVAL 90 DAY AS from_ts,
       least(last_billed_at + k * INTERVAL 90 DAY, {A}) AS to_ts, cpu, gpu, ram_gb, disk_gb, region,
       '' AS region_type, sandbox_class FROM bf""")
def c4(spark, d):
    return chunks.chunk_backfill(fx(spark, d).usage_sessions, AS_OF, f"{S.BACKFILL_INTERVAL_DAYS} days")


@query("c5_unpublished_events", f"SELECT {OUTBOX_NO_PAYLOAD} FROM outbox_events WHERE published_at IS NULL AND event_type = 'billing_chunk_created'")
def c5(spark, d):
    return _no_payload(outbox.unpublished_events(fx(spark, d).outbox_with_payload()))


@query("c6_published_events", f"SELECT {OUTBOX_NO_PAYLOAD} FROM outbox_events WHERE published_at IS NOT NULL AND event_type = 'billing_chunk_created'")
def c6(spark, d):
    return _no_payload(outbox.published_events(fx(spark, d).outbox_with_payload()))


@query("c7_validate_chunks", f"SELECT event_id, delivery_no, {INVALID_CASE} AS reject_reason FROM chunk_deliveries")
def c7(spark, d):
    return outbox.validate_chunks(fx(spark, d).chunk_deliveries).select("event_id", "delivery_no", "reject_reason")


@query("c8_processed_in_range", f"""
SELECT event_id, session_id, sequence, transaction_id, processed_at FROM processed_billing_events
WHERE processed_at BETWEEN {RANGE_LO_SQL} AND {RANGE_HI_SQL}""")
def c8(spark, d):
    return ledger.processed_in_range(fx(spark, d).processed_billing_events, RANGE_LO, RANGE_HI)


@query("c8_published_in_range", f"""
SELECT event_id, session_id, sequence, processed_at FROM processed_outbox_events
WHERE processed_at BETWEEN {RANGE_LO_SQL} AND {RANGE_HI_SQL}""")
def c8_outbox(spark, d):
    return ledger.processed_in_range(fx(spark, d).processed_outbox_events, RANGE_LO, RANGE_HI)


@query("c9_not_null_event", """
SELECT event_id, session_id, sequence, processed_at, metronome_id, organization_id FROM billing_processed_deliveries""")
def c9(spark, d):
    """Processed topic decoded; the not-null gate keeps every decodable event."""
    p = fx(spark, d).billing_processed_deliveries
    dec = codec.decode_processed(sinks.processed_records(p), "value")
    good, _ = analytics.not_null_event(dec)
    return good.select(*analytics.EXPORT_COLUMNS)


# ---------------------------------------------------------------------------
# D: keyed lookups
# ---------------------------------------------------------------------------
@query("d1_sessions_by_id", """
, k AS (SELECT DISTINCT session_id AS id FROM chunk_deliveries
        UNION SELECT concat('sess-c', CAST(c_custkey AS VARCHAR)) FROM customer)
SELECT k.id, s.sandbox_id, s.organization_id, s.start_at, s.end_at, s.status, s.last_billed_at, s.billing_status,
       s.billing_sequence, s.cpu, s.gpu, s.ram_gb, s.disk_gb, s.region, s.sandbox_class, s.recorded_at,
       s.id IS NOT NULL AS found
FROM k LEFT JOIN usage_sessions s ON s.id = k.id""")
def d1(spark, d):
    f = fx(spark, d)
    keys = (f.chunk_deliveries.select(F.col("session_id").alias("id"))
            .unionByName(f.table("customer").select(F.concat(F.lit("sess-c"), F.col("c_custkey").cast("string")).alias("id"))))
    return sessions.sessions_by_id(keys, f.usage_sessions)


@query("d2_outbox_by_id", f"""
, k AS (SELECT id FROM outbox_events UNION SELECT o_orderkey * 8 FROM orders)
SELECT k.id, o.event_id, o.event_type, o.session_id, o.sequence, o.created_at, o.published_at, o.retry_count,
       o.last_error, o.id IS NOT NULL AS found
FROM k LEFT JOIN outbox_events o ON o.id = k.id""")
def d2(spark, d):
    f = fx(spark, d)
    keys = f.outbox_events.select("id").unionByName(f.table("orders").select((F.col("o_orderkey") * 8).alias("id")))
    return outbox.outbox_by_id(keys, _no_payload(f.outbox_with_payload()))


@query("d3_ledger_by_event_id", """
, k AS (SELECT DISTINCT event_id FROM chunk_deliveries)
SELECT k.event_id, p.session_id, p.sequence, p.transaction_id, p.processed_at, p.event_id IS NOT NULL AS found
FROM k LEFT JOIN processed_billing_events p ON p.event_id = k.event_id""")
def d3(spark, d):
    f = fx(spark, d)
    return ledger.ledger_by_event_id(f.chunk_deliveries.select("event_id"), f.processed_billing_events)


@query("d3_publisher_ledger_by_event_id", """
, k AS (SELECT DISTINCT event_id FROM chunk_deliveries)
SELECT k.event_id, p.session_id, p.sequence, p.processed_at, p.event_id IS NOT NULL AS found
FROM k LEFT JOIN processed_outbox_events p ON p.event_id = k.event_id""")
def d3_outbox(spark, d):
    f = fx(spark, d)
    return ledger.ledger_by_event_id(f.chunk_deliveries.select("event_id"), f.processed_outbox_events)


@query("d4_billing_ledger_by_id", f"""
, l AS (SELECT {STABLE_ID.format(x='event_id')} AS id, * FROM processed_billing_events),
  k AS (SELECT DISTINCT {STABLE_ID.format(x='event_id')} AS id FROM outbox_events)
SELECT k.id, l.event_id, l.session_id, l.sequence, l.transaction_id, l.processed_at, l.id IS NOT NULL AS found
FROM k LEFT JOIN l ON l.id = k.id""")
def d4_billing(spark, d):
    f = fx(spark, d)
    led = f.processed_billing_events.select(X.stable_id(F.col("event_id")).alias("id"), "*")
    return ledger.ledger_by_id(f.outbox_events.select(X.stable_id(F.col("event_id")).alias("id")), led)


@query("d4_ledger_by_id", f"""
, l AS (SELECT {STABLE_ID.format(x='event_id')} AS id, * FROM processed_outbox_events),
  k AS (SELECT DISTINCT {STABLE_ID.format(x='event_id')} AS id FROM outbox_events)
SELECT k.id, l.event_id, l.session_id, l.sequence, l.processed_at, l.id IS NOT NULL AS found
FROM k LEFT JOIN l ON l.id = k.id""")
def d4(spark, d):
    f = fx(spark, d)
    led = f.processed_outbox_events.select(X.stable_id(F.col("event_id")).alias("id"), "*")
    keys = f.outbox_events.select(X.stable_id(F.col("event_id")).alias("id"))
    return ledger.ledger_by_id(keys, led)


# ---------------------------------------------------------------------------
# E: existence joins and dedupe
# ---------------------------------------------------------------------------
@query("e1_already_processed", f"""
SELECT {OUTBOX_NO_PAYLOAD} FROM outbox_events o WHERE published_at IS NULL AND event_type = 'billing_chunk_created'
  AND EXISTS (SELECT 1 FROM processed_outbox_events p WHERE p.event_id = o.event_id)""")
def e1(spark, d):
    f = fx(spark, d)
    return _no_payload(ledger.already_processed(outbox.unpublished_events(f.outbox_with_payload()),
                                                f.processed_outbox_events))


@query("e2_not_yet_processed", f"""
SELECT {OUTBOX_NO_PAYLOAD} FROM outbox_events o WHERE published_at IS NULL AND event_type = 'billing_chunk_created'
  AND NOT EXISTS (SELECT 1 FROM processed_outbox_events p WHERE p.event_id = o.event_id)""")
def e2(spark, d):
    f = fx(spark, d)
    return _no_payload(ledger.not_yet_processed(outbox.unpublished_events(f.outbox_with_payload()),
                                                f.processed_outbox_events))


@query("e3_publish_split", SPLIT_SQL + "SELECT id, event_id, outcome, detail FROM split")
def e3(spark, d):
    return _publish_split(spark, d).select("id", F.col("outbox_event_id").alias("event_id"), "outcome", "detail")


@query("e4_dedupe_by_event_id", E4_SQL)
def e4(spark, d):
    return _e4(spark, d)


@query("e4_bucketed_ledger", E4_SQL)
def e4_bucketed(spark, d):
    """E4 against the ledger as a table bucketed by event id: the ledger is read where
    it lies, only the deliveries are shuffled."""
    f, run = fx(spark, d), new_run_dir(spark, "e4b")
    stored = ledger.save_bucketed(f.processed_billing_events, os.path.basename(run).replace("-", "_"), f"{run}/ledger",
                                  buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ledger.dedupe_by_event_id(f.chunk_deliveries.select(*chunks.CHUNK_COLUMNS, "delivery_no"), stored,
                                     ["delivery_no"]).drop("delivery_no")


@query("e5_dedupe_by_transaction_id", f"""
SELECT {CHUNK_SELECT}, concat(session_id, ':', CAST(sequence AS VARCHAR)) AS transaction_id FROM chunk_deliveries c
WHERE delivery_no = 1 AND NOT EXISTS (SELECT 1 FROM processed_billing_events p
                                      WHERE p.transaction_id = concat(c.session_id, ':', CAST(c.sequence AS VARCHAR)))""")
def e5(spark, d):
    f = fx(spark, d)
    return ledger.dedupe_by_transaction_id(f.chunk_deliveries.select(*chunks.CHUNK_COLUMNS, "delivery_no"),
                                           f.processed_billing_events, ["delivery_no"]).drop("delivery_no")


@query("e6_update_where_in", f"""
SELECT id, event_id, event_type, session_id, sequence, created_at,
       CASE WHEN published_at IS NULL AND EXISTS (SELECT 1 FROM processed_outbox_events p WHERE p.event_id = o.event_id)
            THEN {A} ELSE published_at END AS published_at, retry_count, last_error
FROM outbox_events o""")
def e6(spark, d):
    """Mark published the unpublished events the publisher ledger already holds."""
    f = fx(spark, d)
    o = f.outbox_with_payload()
    keys = ledger.already_processed(outbox.unpublished_events(o), f.processed_outbox_events).select("id")
    return _no_payload(outbox.update_where_in(o, keys, "id", {"published_at": X.as_ts(AS_OF)}))


# ---------------------------------------------------------------------------
# F: counts and summaries
# ---------------------------------------------------------------------------
@query("f1_count_unbilled", f"SELECT count(*) AS n FROM usage_sessions WHERE {ELIGIBLE_SQL}")
def f1(spark, d):
    return sessions.count_unbilled(fx(spark, d).usage_sessions, AS_OF)


@query("f2_count_active", "SELECT count(*) AS n FROM usage_sessions WHERE status = 'SESSION_ACTIVE'")
def f2(spark, d):
    return sessions.count_active(fx(spark, d).usage_sessions)


@query("f3_count_processed_billing", "SELECT count(*) AS n FROM processed_billing_events")
def f3(spark, d):
    return ledger.count_ledger(fx(spark, d).processed_billing_events)


@query("f4_count_processed_outbox", "SELECT count(*) AS n FROM processed_outbox_events")
def f4(spark, d):
    return ledger.count_ledger(fx(spark, d).processed_outbox_events)


@query("f5_processing_stats", """
SELECT count(*) AS total_processed, 'billing-processors' AS consumer_group, 'usage-billing-chunks' AS topic
FROM processed_billing_events""")
def f5(spark, d):
    return billing.processing_stats(fx(spark, d).processed_billing_events)


@query("f6_publish_summary", SPLIT_SQL + "SELECT outcome, count(*) AS n FROM split GROUP BY outcome")
def f6(spark, d):
    return outbox.publish_summary(_publish_split(spark, d))


@query("f7_scan_summary", f"""
SELECT count(*) AS total, count(*) AS processed, CAST(0 AS BIGINT) AS failed FROM usage_sessions WHERE {ELIGIBLE_SQL}""")
def f7(spark, d):
    rows, _, _ = _scan(spark, d)
    return chunks.scan_summary(fx(spark, d).usage_sessions, rows, AS_OF)


@query("f8_finish_summary", FINISH_REQ_SQL + """
SELECT CASE WHEN s.id IS NULL THEN 'not_found' WHEN s.status <> 'SESSION_ACTIVE' THEN 'already_finished'
            ELSE 'finished' END AS outcome, count(*) AS n
FROM req LEFT JOIN usage_sessions s ON s.id = req.id GROUP BY 1""")
def f8(spark, d):
    return sessions.finish_summary(_finish(spark, d)[2])


def _replay(spark, d):
    return outbox.replay_published(fx(spark, d).outbox_with_payload(), S.REPLAY_BATCH, S.SAMPLE_SEED)


REPLAY_SQL = f"""
, sample AS (SELECT event_id FROM outbox_events WHERE published_at IS NOT NULL AND event_type = 'billing_chunk_created'
             ORDER BY md5(concat(event_id, '{S.SAMPLE_SEED}')), event_id LIMIT {S.REPLAY_BATCH})
, replayed AS (SELECT c.* FROM {FIRST} c JOIN sample USING (event_id) WHERE {INVALID_CASE} IS NULL)
"""


@query("f9_replay_summary", REPLAY_SQL + "SELECT count(*) AS replayed FROM replayed")
def f9(spark, d):
    return outbox.replay_summary(_replay(spark, d))


# ---------------------------------------------------------------------------
# G: top-k and samples
# ---------------------------------------------------------------------------
@query("g1_oldest_unbilled", f"""
SELECT * FROM usage_sessions WHERE {ELIGIBLE_SQL} ORDER BY last_billed_at, id LIMIT {S.SCAN_PAGE}""")
def g1(spark, d):
    return sessions.oldest_unbilled(fx(spark, d).usage_sessions, AS_OF, S.SCAN_PAGE)


@query("g2_oldest_active", f"""
SELECT id FROM usage_sessions WHERE status = 'SESSION_ACTIVE' ORDER BY start_at, id LIMIT {S.FINISH_BATCH}""")
def g2(spark, d):
    return sessions.oldest_active(fx(spark, d).usage_sessions, S.FINISH_BATCH)


@query("g3_lease_batch", f"""
SELECT {OUTBOX_NO_PAYLOAD} FROM outbox_events WHERE published_at IS NULL AND event_type = 'billing_chunk_created'
ORDER BY created_at, id LIMIT {S.PUBLISH_BATCH}""")
def g3(spark, d):
    return _no_payload(outbox.lease_batch(fx(spark, d).outbox_with_payload(), S.PUBLISH_BATCH))


@query("g4_latest_processed", f"""
SELECT event_id, session_id, sequence, transaction_id, processed_at FROM processed_billing_events
WHERE processed_at BETWEEN {RANGE_LO_SQL} AND {RANGE_HI_SQL} ORDER BY processed_at DESC, event_id LIMIT {S.SCAN_PAGE}""")
def g4(spark, d):
    return ledger.latest_processed(fx(spark, d).processed_billing_events, RANGE_LO, RANGE_HI, S.SCAN_PAGE)


@query("g4_latest_published", f"""
SELECT event_id, session_id, sequence, processed_at FROM processed_outbox_events
WHERE processed_at BETWEEN {RANGE_LO_SQL} AND {RANGE_HI_SQL} ORDER BY processed_at DESC, event_id LIMIT {S.SCAN_PAGE}""")
def g4_outbox(spark, d):
    return ledger.latest_processed(fx(spark, d).processed_outbox_events, RANGE_LO, RANGE_HI, S.SCAN_PAGE)


@query("g5_sessions_after_cursor", f"""
SELECT * FROM usage_sessions WHERE {ELIGIBLE_SQL} AND id > '{CURSOR}' ORDER BY id LIMIT {S.SCAN_PAGE}""")
def g5(spark, d):
    return sessions.sessions_after_cursor(fx(spark, d).usage_sessions, AS_OF, CURSOR, S.SCAN_PAGE)


@query("g6_sample_published", f"""
SELECT {OUTBOX_NO_PAYLOAD} FROM outbox_events WHERE published_at IS NOT NULL AND event_type = 'billing_chunk_created'
ORDER BY md5(concat(event_id, '{S.SAMPLE_SEED}')), event_id LIMIT {S.REPLAY_BATCH}""")
def g6(spark, d):
    return _no_payload(outbox.sample_published(fx(spark, d).outbox_with_payload(), S.REPLAY_BATCH, S.SAMPLE_SEED))


# ---------------------------------------------------------------------------
# H: sequence, audit, union
# ---------------------------------------------------------------------------
@query("h1_next_sequence", BACKFILL_SQL + """
SELECT id AS session_id, last_billed_at + (k - 1) * INTERVAL 90 DAY AS from_ts, billing_sequence + k AS sequence FROM bf""")
def h1(spark, d):
    s = fx(spark, d).usage_sessions
    cand = chunks.chunk_backfill(s, AS_OF, f"{S.BACKFILL_INTERVAL_DAYS} days").select("session_id", "from_ts", "to_ts")
    return chunks.next_sequence(cand, s).select("session_id", "from_ts", "sequence")


@query("h1_equal_rows", """
SELECT c.session_id, c.from_ts, c.to_ts, coalesce(s.billing_sequence, 0)
       + row_number() OVER (PARTITION BY c.session_id ORDER BY c.from_ts, c.to_ts) AS sequence
FROM chunk_deliveries c LEFT JOIN usage_sessions s ON s.id = c.session_id""")
def h1_equal(spark, d):
    """Every delivery numbered, redelivered ones (equal rows) too."""
    f = fx(spark, d)
    return chunks.next_sequence(f.chunk_deliveries.select("session_id", "from_ts", "to_ts"), f.usage_sessions)


@query("h2_sequence_gaps", f"""
, c AS {FIRST}
, p AS (SELECT session_id, sequence + 1 AS sequence, max(to_ts) AS prev_to FROM c GROUP BY session_id, sequence + 1)
SELECT * FROM (
  SELECT c.session_id, c.sequence, c.event_id, c.from_ts, p.prev_to,
         CASE WHEN p.prev_to IS NULL THEN 'missing_previous' WHEN c.from_ts < p.prev_to THEN 'overlap'
              WHEN c.from_ts > p.prev_to THEN 'gap' END AS issue
  FROM c LEFT JOIN p ON p.session_id = c.session_id AND p.sequence = c.sequence WHERE c.sequence > 1)
WHERE issue IS NOT NULL""")
def h2(spark, d):
    return chunks.sequence_gaps(fx(spark, d).first_deliveries)


@query("h3_union_deliveries", SPLIT_SQL + REPLAY_SQL + f"""
SELECT {CHUNK_SELECT} FROM {FIRST} c WHERE event_id IN (SELECT event_id FROM split WHERE outcome = 'publish')
UNION ALL SELECT {CHUNK_SELECT} FROM replayed""")
def h3(spark, d):
    pub = _publish_split(spark, d).filter(F.col("outcome") == "publish")
    new = codec.to_wire(pub.select(*[c for c in chunks.CHUNK_COLUMNS]))
    return reconcile.union_deliveries(new, _replay(spark, d))


# ---------------------------------------------------------------------------
# I: keyed merges
# ---------------------------------------------------------------------------
@query("i1_advance_sessions", f"""
SELECT id, sandbox_id, organization_id, start_at, end_at, status,
       CASE WHEN {ELIGIBLE_SQL} THEN least({A}, end_at) ELSE last_billed_at END AS last_billed_at,
       billing_status,
       CASE WHEN {ELIGIBLE_SQL} THEN billing_sequence + 1 ELSE billing_sequence END AS billing_sequence,
       cpu, gpu, ram_gb, disk_gb, region, sandbox_class, recorded_at FROM usage_sessions""")
def i1(spark, d):
    _, new_sessions, _ = _scan(spark, d)
    return new_sessions


@query("i2_finish_sessions", f"""
SELECT id, sandbox_id, organization_id, start_at,
       CASE WHEN status = 'SESSION_ACTIVE' THEN {A} ELSE end_at END AS end_at,
       'SESSION_FINISHED' AS status,
       CASE WHEN status = 'SESSION_ACTIVE' THEN {A} ELSE last_billed_at END AS last_billed_at,
       'COMPLETED' AS billing_status,
       CASE WHEN status = 'SESSION_ACTIVE' THEN billing_sequence + 1 ELSE billing_sequence END AS billing_sequence,
       cpu, gpu, ram_gb, disk_gb, region, sandbox_class, recorded_at FROM usage_sessions""")
def i2(spark, d):
    return _finish(spark, d)[0]


@query("i3_mark_published", SPLIT_SQL + f"""
SELECT o.id, o.event_id, o.event_type, o.session_id, o.sequence, o.created_at,
       CASE WHEN s.outcome IN ('already', 'publish') THEN {A} ELSE o.published_at END AS published_at,
       o.retry_count, o.last_error
FROM outbox_events o LEFT JOIN split s ON s.id = o.id""")
def i3(spark, d):
    f = fx(spark, d)
    ids = _publish_split(spark, d).filter(F.col("outcome").isin("already", "publish")).select("id")
    new, _ = outbox.mark_published(f.outbox_with_payload(), ids, AS_OF)
    return _no_payload(new)


@query("i4_reset_published", f"""
, sample AS (SELECT id FROM outbox_events WHERE published_at IS NOT NULL AND event_type = 'billing_chunk_created'
             ORDER BY md5(concat(event_id, '{S.SAMPLE_SEED}')), event_id LIMIT {S.REPLAY_BATCH})
SELECT id, event_id, event_type, session_id, sequence, created_at,
       CASE WHEN id IN (SELECT id FROM sample) THEN NULL ELSE published_at END AS published_at, retry_count, last_error
FROM outbox_events""")
def i4(spark, d):
    new, _ = outbox.reset_published(fx(spark, d).outbox_with_payload(), S.REPLAY_BATCH, S.SAMPLE_SEED)
    return _no_payload(new)


I5_SQL = SPLIT_SQL + """
, failed AS (SELECT o.id, o.event_id, o.event_type, o.session_id, o.sequence, o.created_at, o.published_at,
       CASE WHEN s.outcome = 'invalid' THEN o.retry_count + 1 ELSE o.retry_count END AS retry_count,
       CASE WHEN s.outcome = 'invalid' THEN s.detail ELSE o.last_error END AS last_error
FROM outbox_events o LEFT JOIN split s ON s.id = o.id)
"""


def _i5(spark, d):
    f = fx(spark, d)
    fails = (_publish_split(spark, d).filter(F.col("outcome") == "invalid")
             .select("id", F.col("detail").alias("error")))
    new, _ = outbox.record_failure(f.outbox_with_payload(), fails)
    return new


@query("i5_record_failure", I5_SQL + "SELECT * FROM failed")
def i5(spark, d):
    return _no_payload(_i5(spark, d))


@query("i5b_split_by_retry", I5_SQL + f"""
SELECT id, event_id, retry_count, last_error FROM failed WHERE published_at IS NULL AND retry_count >= {MAX_RETRIES}""")
def i5b(spark, d):
    _, dead = outbox.split_by_retry(_i5(spark, d), MAX_RETRIES)
    return dead.select("id", "event_id", "retry_count", "last_error")


@query("i6_delete_billing_rows", """
SELECT event_id, session_id, sequence, transaction_id, processed_at FROM processed_billing_events p
WHERE NOT EXISTS (SELECT 1 FROM outbox_events o WHERE o.event_id = p.event_id AND o.published_at IS NULL)
  AND sequence > 1""")
def i6_billing(spark, d):
    """Drop billing-ledger rows of first chunks and of events never published."""
    f = fx(spark, d)
    led = f.processed_billing_events.select(X.stable_id(F.col("event_id")).alias("id"), "*")
    gone = led.filter("sequence = 1").select("id").unionByName(
        ledger.already_processed(outbox.unpublished_events(f.outbox_events), led)
        .select(X.stable_id(F.col("event_id")).alias("id")))
    new, _ = ledger.delete_by_id(led, gone)
    return new.drop("id")


@query("i6_delete_by_id", f"""
SELECT event_id, session_id, sequence, processed_at FROM processed_outbox_events p
WHERE NOT EXISTS (SELECT 1 FROM outbox_events o WHERE o.event_id = p.event_id AND o.published_at IS NULL)""")
def i6(spark, d):
    """Drop publisher-ledger rows of events that were never marked published."""
    f = fx(spark, d)
    led = f.processed_outbox_events.select(X.stable_id(F.col("event_id")).alias("id"), "*")
    orphans = ledger.already_processed(outbox.unpublished_events(f.outbox_events), led) \
        .select(X.stable_id(F.col("event_id")).alias("id"))
    new, _ = ledger.delete_by_id(led, orphans)
    return new.drop("id")


# ---------------------------------------------------------------------------
# J7 batch part, K expressions
# ---------------------------------------------------------------------------
@query("j7_replay_published", REPLAY_SQL + f"SELECT {CHUNK_SELECT} FROM replayed")
def j7(spark, d):
    return _replay(spark, d)


@query("k_scalar_expressions", f"""
SELECT event_id, concat(session_id, ':', CAST(sequence AS VARCHAR)) AS transaction_id,
       strftime(from_ts, '%Y-%m-%dT%H:%M:%SZ') AS from_text, date_diff('microsecond', from_ts, to_ts) / 3.6e9 AS hours,
       sha256(concat(session_id, ':', CAST(sequence AS VARCHAR))) AS chunk_id,
       md5(concat(event_id, '{S.SAMPLE_SEED}')) AS sample_key, least(to_ts, {A}) AS bill_until,
       coalesce(nullif(sandbox_id, ''), 'none') AS sandbox_or_default
FROM {FIRST} c""")
def k(spark, d):
    c = fx(spark, d).first_deliveries
    return c.select("event_id", X.transaction_id().alias("transaction_id"),
                    X.rfc3339_seconds("from_ts").alias("from_text"),
                    X.duration_hours("from_ts", "to_ts").alias("hours"),
                    X.chunk_event_id().alias("chunk_id"),
                    X.sample_key("event_id", S.SAMPLE_SEED).alias("sample_key"),
                    X.bill_until(X.as_ts(AS_OF), F.col("to_ts")).alias("bill_until"),
                    X.default_if_missing("sandbox_id", "none").alias("sandbox_or_default"))


# ---------------------------------------------------------------------------
# A10 / L: analytics, reconciliation
# ---------------------------------------------------------------------------
@query("a10_export_analytics", """
SELECT event_id, session_id, sequence, processed_at, metronome_id, organization_id, CAST(processed_at AS DATE) AS export_date
FROM billing_processed_deliveries WHERE delivery_no = 1""")
def a10(spark, d):
    """Processed topic (with redeliveries) -> decode -> dedupe by event id -> export rows."""
    p = fx(spark, d).billing_processed_deliveries
    wire = p.select("delivery_no", codec.encode(sinks.processed_struct()).alias("value"))
    dec = codec.decode_processed(wire, "value")
    return analytics.export_rows(dec, None, ["delivery_no"])


@query("l1_reconcile_pipelines", """
, new AS (SELECT p.transaction_id, c.to_ts FROM processed_billing_events p JOIN (SELECT event_id, to_ts FROM chunk_deliveries WHERE delivery_no = 1) c ON c.event_id = p.event_id)
SELECT coalesce(l.transaction_id, n.transaction_id) AS transaction_id, l.to_ts AS legacy_to_ts, n.to_ts AS new_to_ts,
       CASE WHEN n.transaction_id IS NULL THEN 'missing_in_new' WHEN l.transaction_id IS NULL THEN 'missing_in_legacy'
            WHEN l.to_ts IS NOT DISTINCT FROM n.to_ts THEN 'matched' ELSE 'differs' END AS status
FROM legacy_submissions l FULL OUTER JOIN new n ON n.transaction_id = l.transaction_id""")
def l1(spark, d):
    f = fx(spark, d)
    new = f.processed_billing_events.join(f.first_deliveries.select("event_id", "to_ts"), "event_id") \
        .select("transaction_id", "to_ts")
    return reconcile.reconcile_pipelines(f.legacy_submissions, new, "transaction_id", ("to_ts",))


@query("l1_reconcile_summary", """
, new AS (SELECT p.transaction_id, c.to_ts FROM processed_billing_events p JOIN (SELECT event_id, to_ts FROM chunk_deliveries WHERE delivery_no = 1) c ON c.event_id = p.event_id)
SELECT CASE WHEN n.transaction_id IS NULL THEN 'missing_in_new' WHEN l.transaction_id IS NULL THEN 'missing_in_legacy'
            WHEN l.to_ts IS NOT DISTINCT FROM n.to_ts THEN 'matched' ELSE 'differs' END AS status, count(*) AS n
FROM legacy_submissions l FULL OUTER JOIN new n ON n.transaction_id = l.transaction_id GROUP BY 1""")
def l1s(spark, d):
    return reconcile.reconcile_summary(l1(spark, d))


@query("l2_dual_pipeline_dedupe", f"""
, n AS (SELECT concat(session_id, ':', CAST(sequence AS VARCHAR)) AS transaction_id, organization_id AS customer_id, to_ts FROM ({E4_SQL}))
SELECT transaction_id, customer_id, to_ts, 'new' AS source FROM n
UNION ALL
SELECT transaction_id, organization_id, to_ts, 'legacy' FROM legacy_submissions l
WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.transaction_id = l.transaction_id)""")
def l2(spark, d):
    f = fx(spark, d)
    new = billing.billing_payload(_e4(spark, d)).select("transaction_id", "customer_id",
                                                         F.col("timestamp").alias("to_ts"))
    legacy = f.legacy_submissions.select("transaction_id", F.col("organization_id").alias("customer_id"), "to_ts")
    return reconcile.dual_pipeline_dedupe(legacy, new)


@query("l3_shadow_validate", f"""
SELECT coalesce({INVALID_CASE}, 'ok') AS outcome, count(*) AS n,
       sum(CASE WHEN {INVALID_CASE} IS NULL THEN date_diff('microsecond', from_ts, to_ts) / 3.6e9 END) AS hours
FROM chunk_deliveries GROUP BY 1""")
def l3(spark, d):
    c = fx(spark, d).chunk_deliveries
    return reconcile.shadow_validate(c.select(codec.encode_chunks().alias("value")), "value")


@query("l4_event_volume", """
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(*) / 86400.0 AS events_per_second
FROM events GROUP BY 1, 2""")
def l4(spark, d):
    return analytics.event_volume(fx(spark, d).table("events"))


@query("l4_event_volume_by_month", """
SELECT CAST(date_trunc('month', ts) AS DATE) AS month, event_type, count(*) AS n,
       count(*) / (CAST(day(last_day(CAST(date_trunc('month', ts) AS DATE))) AS DOUBLE) * 86400.0) AS events_per_second
FROM events GROUP BY 1, 2""")
def l4_month(spark, d):
    return analytics.event_volume_by_month(fx(spark, d).table("events"))


@query("l5_shard_output", """
SELECT event_id, session_id, sequence, processed_at, metronome_id, organization_id,
       CAST(('0x' || substr(md5(organization_id), 1, 8)) AS BIGINT) % 16 AS org_bucket
FROM billing_processed_deliveries WHERE delivery_no = 1""")
def l5(spark, d):
    """Layout only (the write is ``sinks.write_sharded``): tenant bucket per row."""
    p = fx(spark, d).billing_processed_deliveries.filter(F.col("delivery_no") == 1)
    s = analytics.shard_columns(p.withColumn("region", F.lit("")), buckets=16)
    return s.select(*analytics.EXPORT_COLUMNS, F.col("org_bucket").cast("bigint").alias("org_bucket"))


@query("flagship_billing_payloads")
def flagship(spark, d):
    from meterflow.plans.flagship import billing_payloads
    return billing_payloads(spark, d)


def _register_flagship_oracle():
    from meterflow.plans.flagship import FLAGSHIP_SQL_BODY
    ORACLES["flagship_billing_payloads"] = FIXTURE_SQL + FLAGSHIP_SQL_BODY


_register_flagship_oracle()
