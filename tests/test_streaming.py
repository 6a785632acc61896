"""Stream tests: resume, crash inside a batch, replayed duplicates, state machine."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterflow import schemas as S
from meterflow.operators import outbox
from meterflow.session import new_run_dir
from meterflow.sources import sinks
from meterflow.streaming import billing as sbill
from meterflow.streaming import publish as spub
from meterflow.streaming import topics
from meterflow.streaming.state_machine import SENTINEL, session_state_machine

AS_OF = S.AS_OF


def _records(fx, part=None, parts=None):
    c = fx.chunk_deliveries
    if part is not None:
        c = c.filter(F.pmod(F.xxhash64("event_id", "delivery_no"), F.lit(parts)) == part)
    return sinks.chunk_records(c, keep=("delivery_no",)).withColumnRenamed("delivery_no", "seq")


def _one_chunk(spark, event_id, session_id, sequence, from_ts, to_ts):
    """One chunk delivery in topic shape."""
    row = spark.range(1).select(
        F.lit(event_id).alias("event_id"), F.lit(session_id).alias("session_id"), F.lit("sb").alias("sandbox_id"),
        F.lit("org").alias("organization_id"), F.lit(sequence).cast("bigint").alias("sequence"),
        F.lit(from_ts).cast("timestamp_ntz").alias("from_ts"), F.lit(to_ts).cast("timestamp_ntz").alias("to_ts"),
        *[F.lit(1.0).alias(c) for c in ("cpu", "gpu", "ram_gb", "disk_gb")],
        *[F.lit("x").alias(c) for c in ("region", "region_type", "sandbox_class")])
    return sinks.chunk_records(row)


def _outputs(spark, paths):
    led = spark.read.parquet(paths.ledger)
    ven = spark.read.parquet(paths.vendor)
    proc = sbill.billed_events(spark, paths)
    return (sorted(r.event_id for r in led.select("event_id").collect()),
            sorted(r.transaction_id for r in ven.select("transaction_id").collect()),
            proc.count())


def _run(spark, topic, paths, chk, seed):
    src = topics.read_chunks_stream(spark, topic, max_per_trigger=1)
    q = sbill.start_billing_stream(src, paths, chk, clock=AS_OF, seed_ledger=seed)
    q.awaitTermination()


@pytest.fixture(scope="module")
def clean_run(spark, fx_small):
    run = new_run_dir(spark, "t-clean")
    topic = f"{run}/topic"
    topics.write_file_topic(_records(fx_small), topic, 4)
    paths = sbill.BillingPaths(run)
    _run(spark, topic, paths, f"{run}/_chk", fx_small.processed_billing_events)
    return run, topic, paths


def test_clean_run_matches_batch_dedupe(spark, fx_small, clean_run):
    _, _, paths = clean_run
    led, ven, n_proc = _outputs(spark, paths)
    first = fx_small.first_deliveries.join(fx_small.processed_billing_events.select("event_id"), "event_id",
                                           "left_anti")
    assert led == sorted(r.event_id for r in first.select("event_id").collect())
    assert len(ven) == len(set(ven)) == len(led)
    assert n_proc == len(led)


def test_resume_from_checkpoint(spark, fx_small, clean_run):
    """Half of the topic, stop, the other half, resume: same result as one run."""
    run = new_run_dir(spark, "t-resume")
    topic, paths, chk = f"{run}/topic", sbill.BillingPaths(run), f"{run}/_chk"
    topics.write_file_topic(_records(fx_small, 0, 2), topic, 2)
    _run(spark, topic, paths, chk, fx_small.processed_billing_events)
    topics.write_file_topic(_records(fx_small, 1, 2), topic, 2)
    _run(spark, topic, paths, chk, fx_small.processed_billing_events)
    assert _outputs(spark, paths) == _outputs(spark, clean_run[2])


def test_crash_after_first_output_has_no_second_effect(spark, fx_small, clean_run, monkeypatch):
    run = new_run_dir(spark, "t-crash")
    topic, paths, chk = f"{run}/topic", sbill.BillingPaths(run), f"{run}/_chk"
    topics.write_file_topic(_records(fx_small), topic, 4)
    orig = sinks.write_vendor
    state = {"crashed": False}

    def boom(df, target, batch_id):
        orig(df, target, batch_id)
        if batch_id == 1 and not state["crashed"]:
            state["crashed"] = True
            raise RuntimeError("injected crash after the vendor write")

    monkeypatch.setattr(sbill.sinks, "write_vendor", boom)
    with pytest.raises(Exception):
        _run(spark, topic, paths, chk, fx_small.processed_billing_events)
    assert state["crashed"]
    _run(spark, topic, paths, chk, fx_small.processed_billing_events)  # restart from the checkpoint
    assert _outputs(spark, paths) == _outputs(spark, clean_run[2])


def test_replayed_duplicates_change_nothing(spark, fx_small, clean_run):
    run, topic, paths = clean_run
    before = _outputs(spark, paths)
    replay = outbox.replay_published(fx_small.outbox_with_payload(), 15, "seed-1")
    assert replay.count() > 0
    topics.write_file_topic(sinks.chunk_records(replay).withColumn("seq", F.lit(99).cast("bigint")), topic, 1)
    _run(spark, topic, paths, f"{run}/_chk", fx_small.processed_billing_events)
    assert _outputs(spark, paths) == before


def test_publish_stream_is_idempotent_per_batch(spark, fx_small):
    run = new_run_dir(spark, "t-pub")
    src_dir = f"{run}/outbox"
    fx_small.outbox_with_payload().repartition(3).write.parquet(src_dir)
    src = spark.readStream.schema(S.OUTBOX_EVENTS).option("maxFilesPerTrigger", 1).parquet(src_dir)
    q = spub.start_publish_stream(src, run, f"{run}/_chk", clock=AS_OF, seed_ledger=fx_small.processed_outbox_events)
    q.awaitTermination()
    marks = spark.read.parquet(f"{run}/outbox_marks")
    led = spark.read.parquet(f"{run}/processed_outbox_events")
    pub = marks.filter(F.col("outcome") == "publish")
    assert pub.count() == led.count() > 0
    # per-key order inside the published topic partitions
    topic = spark.read.parquet(f"{run}/topic_usage_billing_chunks")
    assert topic.count() == led.count()
    stats = {(r.batch_id, r.outcome): r.n for r in spub.publish_stats(spark, run).collect()}
    assert sum(n for (b, o), n in stats.items() if o == "publish") == led.count()
    assert sum(stats.values()) == outbox.unpublished_events(fx_small.outbox_events).count()


@pytest.mark.parametrize("engine", ["processor", "group_state"])
def test_state_machine_ticks_and_final(spark, engine):
    day = dt.timedelta(days=1)
    t0 = dt.datetime(2024, 1, 1)
    attrs = ("sb", "org", 2.0, 0.0, 4.0, 20.0, "us-east-1", "container")
    ev = spark.createDataFrame([
        ("a", "create", t0) + attrs,
        ("a", "finish", t0 + 25 * day) + attrs,          # 2 ticks of 10 days + final 5 days
        ("b", "create", t0 + 2 * day) + attrs,           # active: ticks until the watermark
        (SENTINEL, "tick", t0 + 40 * day) + (None,) * 8,
    ], "session_id string, action string, ts timestamp_ntz, sandbox_id string, organization_id string, "
       "cpu double, gpu double, ram_gb double, disk_gb double, region string, sandbox_class string")
    run = new_run_dir(spark, "t-j9")
    ev.write.parquet(f"{run}/in")
    src = spark.readStream.schema(ev.schema).parquet(f"{run}/in")
    out = session_state_machine(src, "10 days", "0 seconds", engine=engine)
    q = (out.writeStream.format("parquet").option("path", f"{run}/out")
         .option("checkpointLocation", f"{run}/_chk").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = sorted((r.session_id, r.sequence, r.from_ts, r.to_ts, r.kind)
                  for r in spark.read.parquet(f"{run}/out").collect())
    assert rows == [
        ("a", 1, t0, t0 + 10 * day, "tick"), ("a", 2, t0 + 10 * day, t0 + 20 * day, "tick"),
        ("a", 3, t0 + 20 * day, t0 + 25 * day, "final"),
        ("b", 1, t0 + 2 * day, t0 + 12 * day, "tick"), ("b", 2, t0 + 12 * day, t0 + 22 * day, "tick"),
        ("b", 3, t0 + 22 * day, t0 + 32 * day, "tick"),
    ]


_LC = ("session_id string, action string, ts timestamp_ntz, sandbox_id string, organization_id string, "
       "cpu double, gpu double, ram_gb double, disk_gb double, region string, sandbox_class string")


def _lifecycle(spark, batches, delay, interval="10 days"):
    from meterflow.streaming import lifecycle
    run = new_run_dir(spark, "t-life")
    attrs = ("sb", "org", 2.0, 0.0, 4.0, 20.0, "us-east-1", "container")
    for b, rows in enumerate(batches):
        df = spark.createDataFrame([(s, a, t) + attrs for s, a, t in rows], _LC)
        for _ in range(2):  # every batch twice: a retry writes the same again
            lifecycle.lifecycle_batch(df, b, run, interval, delay)
    got = lifecycle.chunks(spark, run).collect()
    bad = lifecycle.rejects(spark, run).collect()
    return (sorted((r.session_id, r.sequence, r.from_ts, r.to_ts, r.kind) for r in got),
            sorted((str(r.session_id), r.action, r.reason) for r in bad))


def test_lifecycle_in_any_order(spark):
    day, t0 = dt.timedelta(days=1), dt.datetime(2024, 1, 1)
    at = lambda n: t0 + n * day
    events = [("a", "create", at(0)), ("a", "finish", at(25)), ("b", "create", at(2)), ("c", "finish", at(4)),
              ("c", "create", at(0))]
    want = [("a", 1, at(0), at(10), "tick"), ("a", 2, at(10), at(20), "tick"), ("a", 3, at(20), at(25), "final"),
            ("b", 1, at(2), at(12), "tick"), ("b", 2, at(12), at(22), "tick"), ("b", 3, at(22), at(32), "tick"),
            ("c", 1, at(0), at(4), "final")]
    end = ("__watermark__", "tick", at(140))
    for order in (events, events[::-1], [events[i] for i in (3, 1, 4, 0, 2)]):
        batches = [order[:2], order[2:4], order[4:], [end]]
        assert _lifecycle(spark, batches, "100 days") == (want, [])


def test_lifecycle_state_is_written_by_change(spark):
    """A batch stores the sessions with events and those that fall due, no others; folding
    between batches changes no result and leaves one row per open session."""
    from meterflow.streaming import lifecycle
    day, t0 = dt.timedelta(days=1), dt.datetime(2024, 1, 1)
    at = lambda n: t0 + n * day
    attrs = ("sb", "org", 2.0, 0.0, 4.0, 20.0, "us-east-1", "container")
    batches = [[(f"s{i}", "create", at(0 if i < 3 else 5)) for i in range(40)],
               [("s7", "finish", at(9)), ("x", "finish", at(9))],   # x waits for its create
               [("__watermark__", "tick", at(11))],                            # s0 to s2 are due
               [("s0", "finish", at(30)), ("s1", "finish", at(12))],  # s0's is dated ahead
               [("__watermark__", "tick", at(13))],
               [("x", "create", at(8)), ("__watermark__", "tick", at(31))]]
    nows = [6, 9, 11, 12, 13, 31]
    results = []
    for every in (None, 2):
        run, stored = new_run_dir(spark, "t-change"), []
        for b, (rows, now) in enumerate(zip(batches, nows)):
            df = spark.createDataFrame([(s, a, t) + attrs for s, a, t in rows], _LC)
            for _ in range(2 if every else 1):
                if every and b and b % every == 0:
                    lifecycle.compact_tables(spark, run, b - 1)
                lifecycle.lifecycle_batch(df, b, run, "10 days", "0 days", clock=at(now))
            own = spark.read.parquet(f"{run}/lifecycle_state").filter(F.col("batch_id") == b)
            stored.append(sorted((r.session_id, r.open) for r in own.select("session_id", "open").collect()))
        results.append((sorted((r.session_id, r.sequence, r.from_ts, r.to_ts, r.kind)
                               for r in lifecycle.chunks(spark, run).collect()), stored))
    assert results[0] == results[1]
    got, stored = results[0]
    assert len(stored[0]) == 40
    assert stored[1] == [("s7", False), ("x", True)]
    assert stored[2] == [("s0", True), ("s1", True), ("s2", True)]
    assert stored[3] == [("s0", True), ("s1", False)]
    assert stored[4] == []
    # s0 and x close, s2 and the 36 others tick; x was stored while it waited
    assert [s for s, is_open in stored[5] if not is_open] == ["s0", "x"] and len(stored[5]) == 39
    want = [("s0", n, at(10 * n - 10), at(10 * n), "tick") for n in (1, 2, 3)] + [("s0", 4, at(30), at(30), "final")]
    want += [("s1", 1, at(0), at(10), "tick"), ("s1", 2, at(10), at(12), "final")]
    want += [("s2", n, at(10 * n - 10), at(10 * n), "tick") for n in (1, 2, 3)]
    want += [("s7", 1, at(5), at(9), "final"), ("x", 1, at(8), at(9), "final")]
    want += [(f"s{i}", n, at(10 * n - 5), at(10 * n + 5), "tick") for i in range(3, 40) if i != 7 for n in (1, 2)]
    assert got == sorted(want)
    lifecycle.compact_tables(spark, run, 5)
    left = lifecycle._table(spark, run, "lifecycle_state", lifecycle.STORED).collect()
    assert len(left) == len({r.session_id for r in left}) == 37 and all(r.open for r in left)
    folders = lambda t: t.select("batch_id").distinct().count()
    assert folders(lifecycle._table(spark, run, "lifecycle_due", lifecycle.DUE)) == 1
    assert lifecycle._table(spark, run, "lifecycle_due", lifecycle.DUE).count() == 37


def test_rows_dated_ahead_do_not_move_the_clock(spark):
    """A rejected row, and a valid one of the future, bill nothing ahead; the future
    finish counts once its time has come."""
    from meterflow.streaming import lifecycle
    day, t0 = dt.timedelta(days=1), dt.datetime(2024, 1, 1)
    run = new_run_dir(spark, "t-ahead")
    attrs = ("sb", "org", 2.0, 0.0, 4.0, 20.0, "us-east-1", "container")
    far = dt.datetime(2124, 1, 1)
    batches = [([("s1", "create", t0), (None, "what", far), ("s1", "paused", far)], 25),
               ([("s2", "create", far), ("s1", "finish", t0 + 45 * day), ("s3", "create", t0 + 33 * day)], 35),
               ([("__watermark__", "tick", t0 + 50 * day)], 50)]
    seen = []
    for b, (rows, now) in enumerate(batches):
        df = spark.createDataFrame([(s, a, t) + attrs for s, a, t in rows], _LC)
        lifecycle.lifecycle_batch(df, b, run, "10 days", "0 days", clock=t0 + now * day)
        seen.append(sorted((r.session_id, r.sequence, r.to_ts, r.kind) for r in lifecycle.chunks(spark, run).collect()))
    assert seen[0] == []  # the greatest event so far is the create
    assert seen[1] == [("s1", n, t0 + 10 * n * day, "tick") for n in (1, 2, 3)]
    assert seen[2] == seen[1] + [("s1", 4, t0 + 40 * day, "tick"), ("s1", 5, t0 + 45 * day, "final"),
                                 ("s3", 1, t0 + 43 * day, "tick")]
    assert sorted(r.reason for r in lifecycle.rejects(spark, run).collect()) == ["invalid"] * 2


def test_billing_batches_leave_nothing_cached(spark, fx_small):
    from meterflow.sources import sinks
    run = new_run_dir(spark, "t-cache")
    paths = sbill.BillingPaths(run)
    batch = sinks.chunk_records(fx_small.chunk_deliveries.limit(50), keep=("delivery_no",)).withColumnRenamed("delivery_no", "seq")
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    for b in range(5):
        sbill.billing_batch(batch, b, paths, clock=AS_OF)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_lifecycle_rejects_are_kept(spark):
    day, t0 = dt.timedelta(days=1), dt.datetime(2024, 1, 1)
    at = lambda n: t0 + n * day
    got, bad = _lifecycle(spark, [[("a", "create", at(0)), ("b", "create", at(40))], [("a", "finish", at(4))],
                                  [("a", "create", at(0)), (None, "create", at(1)), ("x", "what", at(1)), ("y", "create", None)]],
                          "0 days")
    assert [g[:2] for g in got] == [("a", n) for n in range(1, 5)]
    assert bad == sorted([("a", "finish", "finish_before_billed"), ("a", "create", "session_closed"),
                          ("None", "create", "invalid"), ("x", "what", "invalid"), ("y", "create", "invalid")])


def test_ordered_by_key_keeps_per_key_sequence(spark, fx_small):
    """Every key lives in one partition, in sequence order inside it."""
    recs = spub.ordered_by_key(fx_small.first_deliveries, "sandbox_id", ["sequence"], 4)
    rows = recs.select(F.spark_partition_id().alias("p"), "sandbox_id", "sequence").collect()
    parts, last = {}, {}
    for r in rows:
        assert parts.setdefault(r.sandbox_id, r.p) == r.p
        assert last.get((r.p, r.sandbox_id), 0) <= r.sequence
        last[(r.p, r.sandbox_id)] = r.sequence


def test_sharded_write_layout(spark, fx_small):
    from meterflow.operators import analytics
    root = new_run_dir(spark, "t-shard")
    p = fx_small.billing_processed_deliveries.filter(F.col("delivery_no") == 1)
    df = analytics.shard_columns(p.join(fx_small.usage_sessions.select(F.col("id").alias("session_id"), "region"),
                                        "session_id"), buckets=4)
    sinks.write_sharded(df, root)
    back = spark.read.parquet(root)
    assert back.count() == p.count()
    assert set(back.columns) >= {"org_bucket", "shard_region", "shard_date"}
    assert back.filter(F.col("org_bucket") == 0).count() == df.filter(F.col("org_bucket") == 0).count()


def test_redelivery_with_another_date_is_billed_once(spark):
    """One event, one transaction; the redelivery moves ``from`` by a day, in a
    later batch."""
    day = dt.timedelta(days=1)
    run = new_run_dir(spark, "t-dates")
    topic, paths = f"{run}/topic", sbill.BillingPaths(run)
    t0 = dt.datetime(2024, 1, 1)
    for n in range(3):
        rec = _one_chunk(spark, "e1", "s1", 1, t0 + n * day, t0 + n * day + dt.timedelta(hours=1))
        topics.write_file_topic(rec.withColumn("seq", F.lit(n).cast("bigint")), topic, 1)
    _run(spark, topic, paths, f"{run}/_chk", None)
    assert spark.read.parquet(paths.ledger).count() == 1
    assert spark.read.parquet(paths.vendor).count() == 1
    assert sbill.billed_events(spark, paths).count() == 1


def test_redelivery_after_midnight_is_exported_once(spark):
    from meterflow.streaming import analytics as san
    run = new_run_dir(spark, "t-midnight")
    for n, at in enumerate((dt.datetime(2024, 1, 1, 23, 59, 59), dt.datetime(2024, 1, 2, 0, 0, 1))):
        p = spark.createDataFrame([("e1", "s1", 1, at, "s1:1", "org", n)],
                                  "event_id string, session_id string, sequence long, processed_at timestamp_ntz, "
                                  "metronome_id string, organization_id string, seq long")
        topics.write_file_topic(sinks.processed_records(p, keep=("seq",)), f"{run}/topic", 1)
    src = topics.read_processed_stream(spark, f"{run}/topic", max_per_trigger=1, starting="earliest")
    san.start_analytics_stream(src, run, f"{run}/_chk").awaitTermination()
    assert [r.processed_at.day for r in san.exported(spark, run).collect()] == [1]


def test_one_event_id_twice_in_a_lease_is_published_once(spark, fx_small):
    run = new_run_dir(spark, "t-twice")
    one = outbox.unpublished_events(fx_small.outbox_with_payload()).limit(5).cache()
    empty = fx_small.processed_outbox_events.limit(0)
    good = outbox.publish_split(one, empty).filter("outcome = 'publish'")
    n = good.count()
    both = one.unionByName(one.withColumn("id", F.col("id") + 10_000_000))
    spub.publish_batch(both, 0, run, AS_OF, empty, 2)
    assert n > 0 and spark.read.parquet(f"{run}/topic_usage_billing_chunks").count() == n


def test_second_shard_write_keeps_the_first(spark):
    root = new_run_dir(spark, "t-shard2")
    rows = spark.createDataFrame([("a", 1, "eu", dt.date(2024, 1, 1)), ("b", 2, "us", dt.date(2024, 1, 2))],
                                 "event_id string, org_bucket int, shard_region string, shard_date date")
    for b, r in enumerate(("a", "b", "b")):
        sinks.write_sharded(rows.filter(F.col("event_id") == r), root, batch_id=min(b, 1))
    assert sorted(r.event_id for r in spark.read.parquet(root).collect()) == ["a", "b"]


def test_kafka_servers_reach_the_topic_writer(spark, fx_small, monkeypatch):
    """No broker here: the writer is replaced and the arguments looked at."""
    seen = []
    monkeypatch.setattr(sinks, "write_topic", lambda df, target, topic, servers=None, batch_id=None:
                        seen.append((topic, servers, df.columns)))
    run = new_run_dir(spark, "t-kafka")
    spub.publish_batch(outbox.unpublished_events(fx_small.outbox_with_payload()).limit(3), 0, run, AS_OF,
                       fx_small.processed_outbox_events, 2, "broker:9092")
    batch = _records(fx_small).limit(3)
    sbill.billing_batch(batch, 0, sbill.BillingPaths(run), AS_OF, kafka_servers="broker:9092")
    assert [(t, s) for t, s, _ in seen] == [(S.TOPIC_CHUNKS, "broker:9092"), (S.TOPIC_PROCESSED, "broker:9092")]
    assert all("seq" not in c for *_, c in seen)


def test_batch_stats_add_up(spark, clean_run):
    _, topic, paths = clean_run
    st = sbill.batch_stats(spark, paths)
    tot = st.agg(*[F.sum(c).alias(c) for c in ("deliveries", "rejected", "billed", "duplicates", "vendor_sends")]).collect()[0]
    assert tot.deliveries == spark.read.parquet(topic).count()   # every delivery read, replays included
    assert tot.billed == spark.read.parquet(paths.ledger).count()
    assert tot.deliveries == tot.rejected + tot.billed + tot.duplicates
    assert tot.vendor_sends == spark.read.parquet(paths.vendor).count()


def test_watermarked_export_variant(spark, fx_small):
    """Opt-in bounded-state dedupe: redeliveries share processed_at, so a
    watermark delay of an hour catches all of them here."""
    from meterflow.streaming import analytics as san
    run = new_run_dir(spark, "t-wm")
    p = fx_small.billing_processed_deliveries
    topics.write_file_topic(sinks.processed_records(p, keep=("delivery_no",)).withColumnRenamed("delivery_no", "seq"),
                            f"{run}/topic", 2)
    src = topics.read_processed_stream(spark, f"{run}/topic", starting="earliest")
    san.start_analytics_stream_watermarked(src, run, f"{run}/_chk", "1 hour").awaitTermination()
    out = spark.read.parquet(f"{run}/analytics_export_wm")
    assert out.count() == out.select("event_id").distinct().count() == \
        p.filter(F.col("delivery_no") == 1).count()


def test_invalid_and_valid_split_cover_all(fx_small):
    c = fx_small.chunk_deliveries
    assert outbox.valid_chunks(c).count() + outbox.invalid_chunks(c).count() == c.count()


def test_compacting_stream_tables_keeps_results(spark, fx_small):
    """Fold the first batches of the ledger and vendor tables, keep streaming:
    the visible tables and the dedupe are unchanged, nothing is read twice."""
    from meterflow.streaming import compaction
    run = new_run_dir(spark, "t-compact-stream")
    topic, paths, chk = f"{run}/topic", sbill.BillingPaths(run), f"{run}/_chk"
    topics.write_file_topic(_records(fx_small, 0, 2), topic, 2)
    _run(spark, topic, paths, chk, fx_small.processed_billing_events)
    led_schema = sbill.LEDGER_SCHEMA
    before = sorted(r.event_id for r in compaction.visible(spark, paths.ledger, led_schema).collect())
    cid = compaction.compact_batches(spark, paths.ledger, 1, led_schema, ("event_bucket", "event_id"))
    compaction.compact_batches(spark, paths.vendor, 1, sbill.VENDOR_SCHEMA)
    after = sorted(r.event_id for r in compaction.visible(spark, paths.ledger, led_schema).collect())
    assert after == before and cid == -3
    assert spark.read.parquet(paths.ledger).count() == 2 * len(before)   # folded folders still on disk
    topics.write_file_topic(_records(fx_small, 1, 2), topic, 2)         # the rest of the topic
    _run(spark, topic, paths, chk, fx_small.processed_billing_events)
    full = sbill.BillingPaths(new_run_dir(spark, "t-compact-ref"))
    ref_topic = f"{full.root}/topic"
    topics.write_file_topic(_records(fx_small), ref_topic, 4)
    _run(spark, ref_topic, full, f"{full.root}/_chk", fx_small.processed_billing_events)
    got = sorted(r.event_id for r in compaction.visible(spark, paths.ledger, led_schema).collect())
    want = sorted(r.event_id for r in spark.read.parquet(full.ledger).collect())
    assert got == want and len(got) == len(set(got))


def test_retried_batch_rewrites_the_same_clock(spark, fx_small, monkeypatch):
    """No explicit clock: the batch clock comes from the streaming plan, so a
    batch that dies after publishing its processed events and is retried
    writes the same processed_at values again."""
    run = new_run_dir(spark, "t-clock")
    topic, paths, chk = f"{run}/topic", sbill.BillingPaths(run), f"{run}/_chk"
    topics.write_file_topic(_records(fx_small), topic, 4)
    orig = sinks.write_batch
    state = {"crashed": False}

    def boom(df, target, batch_id, *a, **k):
        orig(df, target, batch_id, *a, **k)
        if target == paths.processed_topic and batch_id == 1 and not state["crashed"]:
            state["crashed"] = True
            raise RuntimeError("injected crash after the processed-topic write")

    monkeypatch.setattr(sbill.sinks, "write_batch", boom)
    src = topics.read_chunks_stream(spark, topic, max_per_trigger=1)
    with pytest.raises(Exception):
        sbill.start_billing_stream(src, paths, chk, seed_ledger=fx_small.processed_billing_events).awaitTermination()
    first = {r.event_id: r.processed_at for r in sbill.billed_events(spark, paths).collect()}
    src = topics.read_chunks_stream(spark, topic, max_per_trigger=1)
    sbill.start_billing_stream(src, paths, chk, seed_ledger=fx_small.processed_billing_events).awaitTermination()
    again = {r.event_id: r.processed_at for r in sbill.billed_events(spark, paths).collect()}
    assert first and all(again[e] == t for e, t in first.items())
    led = {r.event_id: r.processed_at for r in spark.read.parquet(paths.ledger).collect()}
    assert led == again


def test_lifecycle_state_is_computed_once(spark, monkeypatch):
    """What a batch writes is made of its stored state, not of a cached plan over tables
    that the batch writes to: such a plan is dropped and computed anew by each write."""
    from meterflow.streaming import lifecycle
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    schema = "session_id string, action string, ts timestamp_ntz, " + lifecycle._ATTR_TYPES
    row = lambda s, a, d: (s, a, at(d), *[None] * len(lifecycle.ATTRS))
    run, plans, write = new_run_dir(spark, "t-once"), {}, sinks.write_batch

    def noted(df, target, *args, **kw):
        plans[target.rsplit("/", 1)[-1]] = df._jdf.queryExecution().executedPlan().toString()
        write(df, target, *args, **kw)

    monkeypatch.setattr(lifecycle.sinks, "write_batch", noted)
    for b, rows in enumerate([[row("a", "create", 0), row("b", "create", 1)], [row("a", "finish", 35)]]):
        lifecycle.lifecycle_batch(spark.createDataFrame(rows, schema), b, run, "10 days", "0 days", clock=at(100))
    for table in ("lifecycle_chunks", "lifecycle_closed", "lifecycle_state", "lifecycle_due"):
        assert "lifecycle_work" in plans[table] and "InMemoryTableScan" not in plans[table]
    got = [(r.session_id, r.kind) for r in lifecycle.chunks(spark, run).collect()]
    assert sorted(got) == [("a", "final")] + [("a", "tick")] * 3 + [("b", "tick")] * 3
