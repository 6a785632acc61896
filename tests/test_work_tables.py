"""A micro-batch computes its rows once: they lie in a work table, not in a cached plan
that a write to the ledger drops."""

import datetime as dt
import json

from pyspark.sql import functions as F

from meterflow import schemas as S
from meterflow.operators import ledger
from meterflow.session import new_run_dir
from meterflow.sources import sinks
from meterflow.streaming import billing as sbill
from meterflow.streaming import publish, retry, topics

AS_OF = "1998-06-01 00:00:00"


def _message(event: str, sequence: int) -> str:
    return json.dumps({"event_id": event, "session_id": "s", "sandbox_id": "b", "organization_id": "o", "sequence": sequence,
                       "from": "1998-01-01T00:00:00.000000Z", "to": "1998-01-01T01:00:00.000000Z", "cpu": 1.0,
                       "ram_gb": 2.0, "disk_gb": 3.0, "region": "r", "region_type": "", "sandbox_class": "c"})


def _held(spark) -> int:
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def _plans(monkeypatch, *ends: str) -> list[str]:
    """Optimized plans of what is written to folders with these ends, by the order of writes."""
    seen, write = [], sinks.write_batch

    def record(df, target, *args, **kwargs):
        if target.endswith(ends):
            seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, target, *args, **kwargs)

    monkeypatch.setattr(sinks, "write_batch", record)
    return seen


def test_billing_batch_writes_from_work_tables(spark, monkeypatch):
    paths = sbill.BillingPaths(new_run_dir(spark, "work"))
    plans = _plans(monkeypatch, "topic_billing_processed", "processed_billing_events")
    values = [_message("e1", 1), _message("e1", 1), _message("e2", 1), _message("e3", 2), "{", None]
    rows = [(v.encode() if v else None, i) for i, v in enumerate(values)]
    for b in (0, 0, 1):  # a batch that comes again, then one that was billed before
        held = _held(spark)
        sbill.billing_batch(spark.createDataFrame(rows, "value binary, seq bigint"), b, paths, AS_OF)
        assert _held(spark) == held
    assert len(plans) == 6 and not any("InMemoryRelation" in p or "Join" in p for p in plans)
    assert sorted(r.event_id for r in sbill.billed_events(spark, paths).collect()) == ["e1", "e2", "e3"]
    vendor = spark.read.parquet(paths.vendor)
    assert sorted(r.transaction_id for r in vendor.collect()) == ["s:1", "s:2"]
    assert vendor.filter(F.col("transaction_bucket") != ledger.key_bucket("transaction_id")).count() == 0
    stats = sbill.batch_stats(spark, paths).orderBy("batch_id").select("deliveries", "rejected", "billed", "duplicates", "vendor_sends")
    assert [tuple(r) for r in stats.collect()] == [(6, 2, 3, 1, 2), (6, 2, 0, 4, 0)]
    assert spark.read.parquet(paths.rejects).filter("value = '{'").count() == 2


def test_billing_stream_reads_only_value_and_seq(spark, monkeypatch):
    run, seen = new_run_dir(spark, "columns"), []
    message = spark.createDataFrame([(b"k", _message("e1", 1).encode(), [("h", b"v")], 1)], topics.FILE_TOPIC_SCHEMA)
    topics.write_file_topic(message, f"{run}/topic", 1)
    monkeypatch.setattr(sbill, "billing_batch", lambda df, *args: seen.append(df.columns))
    sbill.start_billing_stream(topics.read_chunks_stream(spark, f"{run}/topic"), sbill.BillingPaths(run), f"{run}/chk",
                               AS_OF).awaitTermination()
    assert seen == [["value", "seq"]]


def test_key_spread_is_few_keys_or_buckets(spark):
    many = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    assert ledger.key_spread(many, "k") == (None, ledger.batch_buckets(many, "k"))
    some = many.limit(1).unionByName(spark.createDataFrame([(None,)], "k string"))
    assert ledger.key_spread(some, "k") == (["k0"], None)
    assert ledger.key_spread(many.limit(0), "k") == ([], None)


def test_publish_and_lane_write_from_work_tables(spark, monkeypatch):
    root = new_run_dir(spark, "publish")
    plans = _plans(monkeypatch, "outbox_marks", "publish_failures", "outbox_dead_letters", "/waiting")
    t = dt.datetime(1998, 1, 1)
    # broken, refused, repeat of an event, already sent, good
    outbox = spark.createDataFrame([(i, e, S.EVENT_TYPE_CHUNK, "s", i, p, t, None, 0, None) for i, e, p in (
        (1, "e1", "{"), (2, "e2", _message("e2", 2)), (3, "e3", _message("e3", 3)), (4, "e3", _message("e3", 4)),
        (5, "e5", _message("e5", 5)))], S.OUTBOX_EVENTS)
    sinks.write_batch(spark.createDataFrame([("e5",)], "event_id string").withColumn("event_bucket", ledger.key_bucket("event_id")),
                      f"{root}/processed_outbox_events", -1)
    refuse = lambda rows, n: F.when((F.col("outbox_event_id") == "e2") & (n < 2), F.lit("busy"))
    publish.publish_batch(outbox, 0, root, AS_OF, partitions=2, attempt=refuse)
    marks = {r.id: r.outcome for r in spark.read.parquet(f"{root}/outbox_marks").collect()}
    assert marks == {1: "undecodable", 2: "refused", 3: "publish", 4: "repeat", 5: "already"}
    failed = spark.read.parquet(f"{root}/publish_failures").drop("batch_id")
    assert sorted((r.id, r.attempts) for r in failed.collect()) == [(1, 1), (2, 1)]

    cols = [c.split()[0] for c in retry.FAILURES.split(", ")]
    ticks = lambda s: spark.createDataFrame([(True, s * 1_000_000)], f"{retry.TICK} boolean, {retry.NOW} bigint")
    new = failed.select(*cols, F.lit(False).alias(retry.TICK), F.lit(100_000_000).cast("bigint").alias(retry.NOW))
    held = _held(spark)
    for b, batch in ((0, new), (1, ticks(200))):
        retry.lane_batch(batch, b, root, AS_OF, refuse, 2, None, 10.0, 3)
    assert _held(spark) == held
    sent = {r.id: r.outcome for r in spark.read.parquet(f"{root}/outbox_marks").filter(F.col("batch_id") >= retry.LANE).collect()}
    assert sent == {1: "undecodable", 2: "publish"}
    assert len(plans) == 8 and not any("InMemoryRelation" in p or "Join" in p for p in plans)
