"""Snapshot store runs (atomic pair) and property tests."""

import datetime as dt

import pytest
from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterflow.functions import expressions as X

from meterflow import schemas as S
from meterflow.operators import chunks, ledger, outbox, sessions
from meterflow.plans import runs
from meterflow.plans.store import SnapshotStore
from meterflow.session import new_run_dir
from meterflow.sources import sinks
from meterflow.streaming import billing as sbill

AS_OF = S.AS_OF


def test_scan_publish_cycle_and_atomic_commit(spark, fx_small):
    store = SnapshotStore(spark, new_run_dir(spark, "t-store"))
    runs.init_store(store, fx_small.usage_sessions)
    eligible = chunks.unbilled_sessions(fx_small.usage_sessions, AS_OF).count()
    v = runs.scan_run(store, AS_OF)
    assert store.read("outbox_events").count() == eligible
    # the same clock again: nothing is eligible any more, nothing new is written
    runs.scan_run(store, AS_OF)
    assert store.read("outbox_events").count() == eligible
    assert chunks.unbilled_sessions(runs.current_sessions(store), AS_OF).count() == 0

    # a run that dies after writing one table leaves no visible change
    bad = store.read("usage_sessions").withColumn(
        "id", F.when(F.raise_error(F.lit("injected")).isNull(), F.col("id")))
    with pytest.raises(Exception):
        store.commit({"outbox_events": (store.read("outbox_events").limit(1), "append"),
                      "usage_sessions": (bad, "snapshot")}, "broken")
    assert store.latest_version() == v + 1
    assert store.read("outbox_events").count() == eligible

    topic = new_run_dir(spark, "t-store-topic")
    runs.publish_run(store, topic, AS_OF)
    ob = runs.current_outbox(store)
    assert ob.filter(F.col("published_at").isNull()).count() == 0
    assert spark.read.parquet(topic).count() == store.read("processed_outbox_events").count()
    # publishing again finds nothing unpublished
    runs.publish_run(store, topic, AS_OF)
    assert spark.read.parquet(topic).count() == store.read("processed_outbox_events").count()


def test_finish_run_appends_final_chunks(spark, fx_small):
    store = SnapshotStore(spark, new_run_dir(spark, "t-finish"))
    runs.init_store(store, fx_small.usage_sessions)
    active = fx_small.usage_sessions.filter(F.col("status") == S.SESSION_ACTIVE)
    runs.finish_run(store, active.select("id"), AS_OF)
    s = runs.current_sessions(store)
    assert s.count() == fx_small.usage_sessions.count()
    assert s.filter(F.col("status") == S.SESSION_ACTIVE).count() == 0
    assert store.read("outbox_events").count() == active.count()


def test_backfill_partitions_time_exactly(spark, fx_small):
    """Per session: sequences consecutive, from = previous to, durations sum
    to as_of - last_billed_at."""
    s = fx_small.usage_sessions
    bf = chunks.chunk_backfill(s, AS_OF, "90 days")
    assert chunks.sequence_gaps(bf).filter(F.col("sequence") > F.lit(1)).filter(
        F.col("issue") != "missing_previous").count() == 0
    per = bf.groupBy("session_id").agg(
        F.sum(F.timestamp_diff("MICROSECOND", "from_ts", "to_ts")).alias("us"),
        F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), F.count(F.lit(1)).alias("n"))
    j = per.join(s.select(F.col("id").alias("session_id"), "last_billed_at", "billing_sequence"), "session_id")
    bad = j.filter((F.col("us") != F.timestamp_diff("MICROSECOND", F.col("last_billed_at"), X.ts_lit(AS_OF)))
                   | (F.col("lo") != F.col("billing_sequence") + 1)
                   | (F.col("hi") - F.col("lo") + 1 != F.col("n")))
    assert bad.count() == 0


CHUNK_DDL = ("event_id string, session_id string, sandbox_id string, organization_id string, sequence bigint, "
             "from_ts timestamp_ntz, to_ts timestamp_ntz, cpu double, gpu double, ram_gb double, disk_gb double, "
             "region string, region_type string, sandbox_class string")


def _chunk(i):
    sess, seq = f"s{i % 3}", i // 3 + 1
    t = dt.datetime(2024, 1, 1) + dt.timedelta(hours=seq)
    return (f"e{i}", sess, "sb", "org", seq, t, t + dt.timedelta(hours=1), 1.0, None, 2.0, 3.0, "r", "", "c")


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 8), min_size=1, max_size=25), st.integers(1, 4), st.randoms())
def test_any_delivery_order_and_batching_bills_once(spark, deliveries, n_batches, rnd):
    """Deliver any multiset of chunks in any order, split into any batches:
    one ledger row per event, one vendor row per transaction id."""
    order = list(deliveries)
    rnd.shuffle(order)
    root = new_run_dir(spark, "t-prop")
    paths = sbill.BillingPaths(root)
    rows = [_chunk(i) for i in order]
    df = spark.createDataFrame(rows, CHUNK_DDL).withColumn("seq", F.monotonically_increasing_id())
    recs = sinks.chunk_records(df, keep=("seq",))
    cuts = sorted(rnd.sample(range(1, len(rows)), min(n_batches - 1, len(rows) - 1))) if len(rows) > 1 else []
    bounds = [0, *cuts, len(rows)]
    pdf = recs.toPandas()
    for b in range(len(bounds) - 1):
        part = pdf.iloc[bounds[b]:bounds[b + 1]]
        if part.empty:
            continue
        batch = spark.createDataFrame(part, recs.schema)
        sbill.billing_batch(batch, b, paths, clock=AS_OF, batch_rows_bound=100)
    led = [r.event_id for r in spark.read.parquet(paths.ledger).collect()]
    ven = [r.transaction_id for r in spark.read.parquet(paths.vendor).collect()]
    assert sorted(led) == sorted({f"e{i}" for i in deliveries})
    assert sorted(ven) == sorted({f"s{i % 3}:{i // 3 + 1}" for i in deliveries})


def test_compaction_keeps_rows_and_reads_from_base(spark, fx_small):
    store = SnapshotStore(spark, new_run_dir(spark, "t-compact"))
    runs.init_store(store, fx_small.usage_sessions)
    runs.scan_run(store, AS_OF)
    runs.scan_run(store, dt.datetime(1999, 6, 1))
    before = sorted(r.event_id for r in store.read("outbox_events").select("event_id").collect())
    v = store.compact("outbox_events", ("created_at", "id"))
    runs.scan_run(store, dt.datetime(2000, 6, 1))
    last = store.versions("outbox_events")[-1]
    later = spark.read.parquet(f"{store.root}/outbox_events/v={last}").count()
    assert later > 0
    # the base holds exactly the rows before it; the later append is added on
    # top and nothing from the folded versions is read twice
    base_rows = spark.read.parquet(f"{store.root}/outbox_events/v={v}")
    assert sorted(r.event_id for r in base_rows.select("event_id").collect()) == before
    after = [r.event_id for r in store.read("outbox_events").select("event_id").collect()]
    assert len(after) == len(set(after)) == len(before) + later
    assert [k for _, k in store.entries("outbox_events")].count("base") == 1


def test_compact_outbox_folds_marks(spark, fx_small):
    store = SnapshotStore(spark, new_run_dir(spark, "t-compact-outbox"))
    runs.init_store(store, fx_small.usage_sessions)
    runs.scan_run(store, AS_OF)
    runs.publish_run(store, new_run_dir(spark, "t-co-topic"), AS_OF)
    before = sorted(tuple(r) for r in runs.current_outbox(store).collect())
    runs.compact_outbox(store)
    assert store.read("outbox_marks").count() == 0
    assert sorted(tuple(r) for r in runs.current_outbox(store).collect()) == before
    assert runs.current_outbox(store).filter(F.col("published_at").isNull()).count() == 0


def test_failed_rows_are_retried_then_dead_and_block_nobody(spark, fx_small):
    """A bad oldest row under a lease of one: it fails, is retried up to the limit,
    becomes a dead letter, and the good row behind it is published; the last error
    is that of the latest run."""
    run = new_run_dir(spark, "t-dead")
    store = SnapshotStore(spark, f"{run}/store")
    two = outbox.unpublished_events(fx_small.outbox_with_payload()).orderBy("id").limit(40)
    good = outbox.publish_split(two, fx_small.processed_outbox_events.limit(0)).filter("outcome = 'publish'")
    keep = two.join(good.select("id").orderBy("id").limit(2), "id").orderBy("id")
    ids = [r.id for r in keep.collect()]
    rows = keep.withColumn("payload", F.when(F.col("id") == ids[0], F.lit("not json")).otherwise(F.col("payload")))
    rows = rows.withColumn("created_at", F.when(F.col("id") == ids[0], F.lit("2000-01-01").cast("timestamp_ntz"))
                           .otherwise(F.col("created_at")))
    runs.init_store(store, fx_small.usage_sessions, rows)
    for _ in range(3):
        runs.publish_run(store, f"{run}/topic", AS_OF, limit=1, max_retries=2)
    state = {r.id: r for r in runs.current_outbox(store).collect()}
    assert state[ids[0]].retry_count == 2 and state[ids[0]].published_at is None
    assert state[ids[1]].published_at is not None
    assert [r.id for r in runs.dead_letters(store, 2).collect()] == [ids[0]]
    assert store.read("outbox_rejects").filter("outcome = 'undecodable'").count() == 2
    late = spark.createDataFrame([(ids[1], None, 1, "zzz first", 90), (ids[1], None, 1, "aaa newest", 91)],
                                 runs.MARKS_SCHEMA)
    store.commit({"outbox_marks": (late, "append")}, "marks")
    assert {r.id: r.last_error for r in runs.current_outbox(store).collect()}[ids[1]] == "aaa newest"


def test_runs_write_the_sessions_they_change(spark, fx_small):
    """The batch operators' whole new table equals the folded changes, and a run
    writes one row per session it touched."""
    store = SnapshotStore(spark, new_run_dir(spark, "t-changes"))
    runs.init_store(store, fx_small.usage_sessions)
    eligible = chunks.unbilled_sessions(fx_small.usage_sessions, AS_OF).count()
    _, want, _ = chunks.scan_and_chunk(fx_small.usage_sessions, AS_OF)
    runs.scan_run(store, AS_OF)
    assert 0 < store.read("session_changes").count() == eligible < fx_small.usage_sessions.count()
    some = want.filter(F.col("status") == S.SESSION_ACTIVE).orderBy("id").limit(7).select("id")
    later = dt.datetime(1999, 1, 1)
    want, _, _ = sessions.finish_plan(want, some, later)
    runs.finish_run(store, some, later)
    assert store.read("session_changes").count() == eligible + 7
    got = runs.current_sessions(store)
    assert got.exceptAll(want.select(*got.columns)).count() == 0 == want.select(*got.columns).exceptAll(got).count()
    runs.compact_sessions(store)
    assert store.read("session_changes").count() == 0
    assert runs.current_sessions(store).exceptAll(got).count() == 0
