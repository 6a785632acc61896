"""Tasks, files and micro-batches keep their size when the tables grow."""

from meterflow.session import PACKED_BYTES, apply_session_settings


def test_shuffles_are_sized_by_the_tables(spark):
    s = spark.newSession()
    s.conf.set("spark.sql.shuffle.partitions", "200")
    apply_session_settings(s, 4 << 30)
    assert int(s.conf.get("spark.sql.shuffle.partitions")) == 512
    assert int(s.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) == PACKED_BYTES
    apply_session_settings(s, 1 << 20)        # never fewer than the session has
    assert int(s.conf.get("spark.sql.shuffle.partitions")) == 512
    s.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    apply_session_settings(s)                 # a finer setting stays
    assert s.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "1m"


def test_topic_files_and_batches_grow_with_the_tables(fx_small):
    from meterflow.sources.fixtures import SLICE_BYTES, Fixtures
    assert fx_small.files(8) == 8
    big = Fixtures(fx_small.spark, fx_small.sf_dir)
    big.table_bytes = 10 * SLICE_BYTES
    assert (big.files(8), big.files(2)) == (80, 20)


def test_audit_state_settles_merges_and_replays(spark):
    """Numbers in any order over three batches, the second one twice."""
    import datetime as dt
    from meterflow.session import new_run_dir
    from meterflow.streaming import sequence_audit as A
    run, day = new_run_dir(spark, "audit"), dt.datetime(2024, 1, 1)
    at = lambda h: None if h is None else day + dt.timedelta(hours=h)

    def batch(n, *rows):
        df = spark.createDataFrame([(s, q, e, at(a), at(b)) for s, q, e, a, b in rows],
                                   "session_id string, sequence long, event_id string, from_ts timestamp_ntz, to_ts timestamp_ntz")
        A.audit_batch(df, n, f"{run}/findings", f"{run}/state", 0)

    def found():
        return sorted((r.session_id, r.sequence, r.event_id, r.issue) for r in A.findings(spark, f"{run}/findings").collect())

    batch(0, ("a", 2, "a2", 1, 2), ("a", 1, "a1", 0, 1), ("a", 3, "a3", 3, 4), ("b", 2, "b2", 1, 2), (None, 1, "n", 1, 2))
    assert found() == [("b", 2, "b2", "missing_previous")]          # a3 is not settled yet
    for _ in range(2):
        batch(1, ("a", 2, "a2x", 5, 6), ("a", 4, "a4", 4, 5), ("a", 9, "a9", 6, 7), ("b", 3, "b3", 5, 6))
        assert found() == [("a", 2, "a2x", "duplicate_sequence"), ("a", 3, "a3", "gap"),
                           ("b", 2, "b2", "missing_previous"), ("b", 3, "b3", "gap")]
    batch(2, ("a", 2, "a2y", 8, 9), ("a", 5, "a5", 7, None), ("a", 6, "a6", 8, 9), (A.END, 1, "end", 1000, None))
    assert found()[1:] == [("a", 3, "a3", "gap"), ("a", 5, "a5", "gap"), ("a", 9, "a9", "missing_previous"),
                           ("b", 2, "b2", "missing_previous"), ("b", 3, "b3", "gap")]
    ranges = spark.read.parquet(f"{run}/state/ranges").filter("batch_id = 2").select("session_id", "lo", "hi").collect()
    assert sorted(map(tuple, ranges)) == [("a", 1, 6), ("a", 9, 9), ("b", 2, 3)]


def test_scan_entries_come_go_and_replay(spark):
    import datetime as dt
    from meterflow.functions import codec
    from meterflow.session import new_run_dir
    from meterflow.sources.fixtures import Fixtures
    from meterflow.streaming import scan_state as C
    run, day = new_run_dir(spark, "scan"), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    sessions = Fixtures(spark, "/root/testdata/sf0.001").usage_sessions.limit(0)

    def batch(n, *rows):
        df = spark.createDataFrame([(i, k, day + dt.timedelta(minutes=m), (day + dt.timedelta(minutes=m)).replace(tzinfo=None),
                                     None, "sb", "org", 1.0, None, None, None, "r", "c") for i, k, m in rows], C.CHANGES)
        C.scan_batch(df, n, sessions, f"{run}/out", f"{run}/state", 3_600_000_000)

    def chunks():
        rows = codec.decode_chunks(spark.read.parquet(f"{run}/out").select("payload"), "payload")
        return sorted((r.session_id, r.sequence, r.from_ts.hour * 60 + r.from_ts.minute, r.to_ts.hour * 60 + r.to_ts.minute)
                      for r in rows.collect())

    batch(0, ("a", "create", 0), ("b", "create", 0), ("c", "create", 5), (C.TICK, "tick", 10))
    batch(1, ("a", "create", 30), ("b", "finish", 40), (C.TICK, "tick", 65))      # a is there already
    for _ in range(2):
        batch(2, ("b", "create", 70), (C.TICK, "tick", 130))
        assert chunks() == [("a", 1, 0, 65), ("a", 2, 65, 130), ("c", 1, 5, 130)]


def test_reconcile_state_reports_each_row_once(spark):
    """Pairs across batches, a third partner, rows without one; the second batch twice."""
    import datetime as dt
    from meterflow.session import new_run_dir
    from meterflow.streaming import reconcile as R
    run, day = new_run_dir(spark, "rec"), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)

    def batch(n, *rows):
        df = spark.createDataFrame([(s, i, (day + dt.timedelta(hours=h)).replace(tzinfo=None), day + dt.timedelta(hours=h))
                                    for s, i, h in rows], "side string, transaction_id string, to_ts timestamp_ntz, ts timestamp")
        R.reconcile_batch(df, n, f"{run}/out", f"{run}/state", 3_600_000_000)

    def out():
        return sorted((r.transaction_id, r.status) for r in spark.read.parquet(f"{run}/out").collect())

    batch(0, ("legacy", "a", 0), ("legacy", "b", 0), ("new", "c", 0), ("legacy", "d", 0), ("new", "d", 0), ("new", "e", 0))
    assert out() == [("d", "matched")]
    for _ in range(2):
        batch(1, ("new", "a", 1), ("legacy", "e", 0), ("new", "d", 0), ("legacy", "f", 2), ("new", "g", 2))
        assert out() == [("a", "differs"), ("d", "matched"), ("d", "matched"), ("e", "matched")]
    batch(2, ("legacy", R.END, 100), ("new", R.END, 100))
    ends = [("a", "differs"), ("b", "missing_in_new"), ("c", "missing_in_legacy"), ("d", "matched"), ("d", "matched"),
            ("e", "matched"), ("f", "missing_in_new"), ("g", "missing_in_legacy")]
    assert out() == ends
    batch(3, ("legacy", R.END, 200), ("new", R.END, 200))
    assert out() == ends
