"""Keys that put every delivery, redelivered ones included, through the operators
whose older keys read first deliveries; K7."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterflow import schemas as S
from meterflow.functions import codec
from meterflow.functions import expressions as X
from meterflow.operators import analytics
from meterflow.plans.catalog import AS_OF, A, CHUNK_SELECT, fx, query
from meterflow.sources import sinks


@query("a9_all_deliveries", """
SELECT session_id AS key, event_id, session_id, sequence, processed_at, metronome_id, organization_id, delivery_no
FROM billing_processed_deliveries""")
def a9_all(spark, d):
    rec = sinks.processed_records(fx(spark, d).billing_processed_deliveries, keep=("delivery_no",))
    return codec.decode_processed(rec, "value").select(
        F.col("key").cast("string").alias("key"), "event_id", "session_id", "sequence", "processed_at", "metronome_id",
        "organization_id", "delivery_no")


@query("b9_all_deliveries", f"SELECT {CHUNK_SELECT}, delivery_no FROM chunk_deliveries")
def b9_all(spark, d):
    """Stored chunk -> wire chunk -> topic record -> chunk."""
    c = fx(spark, d).chunk_deliveries
    wire = codec.to_wire(c, keep=("delivery_no",))
    back = codec.decode_chunks(sinks.chunk_records(wire, keep=("delivery_no",)), "value")
    return back.select(*CHUNK_SELECT.split(", "), "delivery_no")


@query("k_all_deliveries", f"""
SELECT event_id, delivery_no, concat(session_id, ':', CAST(sequence AS VARCHAR)) AS transaction_id,
       strftime(from_ts, '%Y-%m-%dT%H:%M:%SZ') AS from_text, date_diff('microsecond', from_ts, to_ts) / 3.6e9 AS hours,
       sha256(concat(session_id, ':', CAST(sequence AS VARCHAR))) AS chunk_id,
       md5(concat(event_id, '{S.SAMPLE_SEED}')) AS sample_key, least(to_ts, {A}) AS bill_until,
       coalesce(nullif(sandbox_id, ''), 'none') AS sandbox_or_default
FROM chunk_deliveries""")
def k_all(spark, d):
    return fx(spark, d).chunk_deliveries.select(
        "event_id", "delivery_no", X.transaction_id().alias("transaction_id"),
        X.rfc3339_seconds("from_ts").alias("from_text"), X.duration_hours("from_ts", "to_ts").alias("hours"),
        X.chunk_event_id().alias("chunk_id"), X.sample_key("event_id", S.SAMPLE_SEED).alias("sample_key"),
        X.bill_until(X.as_ts(AS_OF), F.col("to_ts")).alias("bill_until"),
        X.default_if_missing("sandbox_id", "none").alias("sandbox_or_default"))


@query("l5_all_deliveries", """
SELECT p.event_id, p.delivery_no, CAST(('0x' || substr(md5(p.organization_id), 1, 8)) AS BIGINT) % 16 AS org_bucket,
       coalesce(s.region, '') AS shard_region, CAST(processed_at AS DATE) AS shard_date
FROM billing_processed_deliveries p JOIN usage_sessions s ON s.id = p.session_id""")
def l5_all(spark, d):
    """The sharded layout by day, with the session's region."""
    f = fx(spark, d)
    p = f.billing_processed_deliveries.join(f.usage_sessions.select(F.col("id").alias("session_id"), "region"), "session_id")
    return analytics.shard_columns(p, buckets=16).select(
        "event_id", "delivery_no", F.col("org_bucket").cast("bigint").alias("org_bucket"), "shard_region", "shard_date")


# The optional fields of a wire chunk; a fixture value of 0 stands for one never set.
RESOURCES = ["cpu", "gpu", "ram_gb", "disk_gb"]


@query("k7_key_only_if_present", f"""
SELECT event_id, delivery_no, concat_ws(',', {', '.join(f"CASE WHEN {c} <> 0 THEN '{c}' END" for c in RESOURCES)}) AS present,
       sequence % 3 <> 0 AS has_metronome_id
FROM chunk_deliveries""")
def k7(spark, d):
    """A resource that is not set has no key in the chunk's JSON, an empty
    ``metronome_id`` none in the processed event's."""
    c = fx(spark, d).chunk_deliveries.withColumns({r: F.when(F.col(r) != 0, F.col(r)) for r in RESOURCES})
    c = c.withColumn("chunk", codec.encode_chunks()).withColumns({
        "processed_at": F.col("to_ts"),
        "metronome_id": F.when(F.col("sequence") % 3 != 0, X.transaction_id()).otherwise(F.lit(""))})
    keys = F.json_object_keys("chunk")
    present = F.filter(F.array(*[F.lit(r) for r in RESOURCES]), lambda r: F.array_contains(keys, r))
    return c.select("event_id", "delivery_no", F.array_join(present, ",").alias("present"), F.array_contains(
        F.json_object_keys(codec.encode(sinks.processed_struct())), "metronome_id").alias("has_metronome_id"))
