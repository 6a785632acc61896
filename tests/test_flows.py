"""Chained stages (L6), typed consumer (A13), periodic scan (J1), create (B3), A14."""

import time

from pyspark.sql import functions as F

from meterflow import schemas as S
from meterflow.operators import constraints
from meterflow.plans import runs
from meterflow.plans.store import SnapshotStore
from meterflow.session import new_run_dir
from meterflow.sources import sinks
from meterflow.streaming import consume, scan, stages, topics

AS_OF = S.AS_OF


def test_staged_flow_end_to_end(spark, fx_small):
    root = new_run_dir(spark, "t-stages")
    outbox_dir = f"{root}/outbox"
    fx_small.outbox_with_payload().repartition(4).write.parquet(outbox_dir)
    r = stages.StageRoots(root)
    stages.run_stages(spark, outbox_dir, r, AS_OF, fx_small.processed_outbox_events,
                      fx_small.processed_billing_events)
    published = spark.read.parquet(f"{r.publish}/topic_usage_billing_chunks").count()
    billed = spark.read.parquet(f"{r.billing}/processed_billing_events").count()
    exported = spark.read.parquet(f"{r.analytics}/analytics_export").count()
    assert published > 0
    assert 0 < billed <= published and exported == billed


def test_foreach_chunk_splits_bad_rows(spark, fx_small):
    root = new_run_dir(spark, "t-consume")
    topic = f"{root}/topic"
    good = sinks.chunk_records(fx_small.first_deliveries).withColumn("seq", F.lit(1).cast("bigint"))
    bad = spark.createDataFrame([(b"k", b"{broken", None, 2)], topics.FILE_TOPIC_SCHEMA)
    topics.write_file_topic(good.unionByName(bad), topic, 2)
    seen = []

    def handler(df, bid):
        seen.append(df.count())

    q = consume.foreach_chunk(topics.read_chunks_stream(spark, topic), handler, f"{root}/rejects", f"{root}/_chk")
    q.awaitTermination()
    assert sum(seen) == fx_small.first_deliveries.count()
    assert spark.read.parquet(f"{root}/rejects").count() == 1


def test_periodic_scan_stream(spark, fx_small):
    store = SnapshotStore(spark, new_run_dir(spark, "t-scan"))
    runs.init_store(store, fx_small.usage_sessions)
    q = scan.start_scan_stream(spark, store, f"{store.root}/_chk", every="1 second", clock_override=AS_OF)
    deadline = time.time() + 60
    while store.latest_version() < 2 and time.time() < deadline:
        time.sleep(1)
    q.stop()
    expected = fx_small.usage_sessions.filter(
        (F.col("status") == S.SESSION_ACTIVE) & (F.col("last_billed_at") < F.lit("1998-05-31 23:00:00").cast("timestamp_ntz"))
    ).count()
    assert store.read("outbox_events").count() == expected


def test_create_run_checks_constraints(spark, fx_small):
    store = SnapshotStore(spark, new_run_dir(spark, "t-create"))
    req = (fx_small.session_lifecycle.filter(F.col("action") == "create")
           .select(F.col("session_id").alias("id"), "sandbox_id", "organization_id",
                   F.col("ts").alias("start_at"), "cpu", "gpu", "ram_gb", "disk_gb", "region", "sandbox_class"))
    v, viol = runs.create_run(store, req, AS_OF)
    assert v == 1 and viol.count() == 0
    assert store.read("usage_sessions").count() == fx_small.usage_sessions.count()
    bad = req.limit(1).withColumn("id", F.lit("new-1")).withColumn("sandbox_class", F.lit("mainframe"))
    v2, viol2 = runs.create_run(store, bad, AS_OF)
    assert v2 is None and [r.constraint for r in viol2.collect()] == ["enum:sandbox_class"]


def test_define_tables(spark):
    root = new_run_dir(spark, "t-ddl")
    made = constraints.define_tables(spark, root, "metering_t")
    assert len(made) == 4
    again = constraints.define_tables(spark, root, "metering_t")   # idempotent
    assert again == made
    cols = [c.name for c in spark.catalog.listColumns("outbox_events", "metering_t")]
    assert cols == S.OUTBOX_EVENTS.fieldNames()
