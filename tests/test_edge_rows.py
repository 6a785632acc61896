"""Hand-made edge rows (FIXTURES.md section 4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterflow.functions import expressions as X

from meterflow import schemas as S
from meterflow.functions import codec
from meterflow.operators import chunks, constraints, ledger, outbox, sessions
from meterflow.operators.common import explode_count

AS_OF = dt.datetime(2024, 5, 1, 12, 0, 0)
H = dt.timedelta(hours=1)
US = dt.timedelta(microseconds=1)


def session_rows(spark, rows):
    """rows: (id, start_at, end_at, status, last_billed_at, billing_sequence, cpu, gpu)"""
    full = [(i, "sb-" + i, "org", st, en, stat, lb, "ACTIVE", seq, cpu, gpu, 4.0, 20.0, "us-east-1", "container", st)
            for (i, st, en, stat, lb, seq, cpu, gpu) in rows]
    return spark.createDataFrame(full, S.USAGE_SESSIONS)


def test_eligibility_edges(spark):
    s = session_rows(spark, [
        ("null-lba", AS_OF - 10 * H, None, S.SESSION_ACTIVE, None, 0, 1.0, 0.0),
        ("exact", AS_OF - 10 * H, None, S.SESSION_ACTIVE, AS_OF - H, 0, 1.0, 0.0),
        ("one-us-earlier", AS_OF - 10 * H, None, S.SESSION_ACTIVE, AS_OF - H - US, 0, 1.0, 0.0),
        ("finished-old", AS_OF - 10 * H, AS_OF - 9 * H, S.SESSION_FINISHED, AS_OF - 9 * H, 3, 1.0, 0.0),
    ])
    got = {r.id for r in sessions.unbilled_sessions(s, AS_OF, "1 hour").collect()}
    assert got == {"one-us-earlier"}


def test_chunk_end(spark):
    s = session_rows(spark, [
        ("ended-before", AS_OF - 10 * H, AS_OF - 2 * H, S.SESSION_ACTIVE, AS_OF - 5 * H, 1, 1.0, 0.0),
        ("ends-after", AS_OF - 10 * H, AS_OF + 2 * H, S.SESSION_ACTIVE, AS_OF - 5 * H, 1, 1.0, 0.0),
        ("no-end", AS_OF - 10 * H, None, S.SESSION_ACTIVE, AS_OF - 5 * H, 1, None, None),
    ])
    got = {r.session_id: (r.from_ts, r.to_ts, r.sequence) for r in chunks.build_chunks(s, AS_OF).collect()}
    assert got["ended-before"] == (AS_OF - 5 * H, AS_OF - 2 * H, 2)
    assert got["ends-after"] == (AS_OF - 5 * H, AS_OF, 2)
    assert got["no-end"] == (AS_OF - 5 * H, AS_OF, 2)


def test_null_last_billed_falls_back_to_start(spark):
    s = session_rows(spark, [("n", AS_OF - 10 * H, None, S.SESSION_ACTIVE, None, 0, 1.0, 0.0)])
    c = chunks.build_chunks(s, AS_OF).collect()[0]
    assert c.from_ts == AS_OF - 10 * H


def test_create_defaults_and_explicit_zero(spark):
    req = spark.createDataFrame(
        [("a", "org", "sb", None, None, None, None, "", "", None),
         ("b", "org", "sb", 0.0, 0.0, 0.0, 0.0, "eu-west-1", "windows", AS_OF - H)],
        "id string, organization_id string, sandbox_id string, cpu double, gpu double, ram_gb double, "
        "disk_gb double, region string, sandbox_class string, start_at timestamp_ntz")
    got = {r.id: r for r in sessions.create_sessions(req, AS_OF).collect()}
    a, b = got["a"], got["b"]
    assert (a.cpu, a.gpu, a.ram_gb, a.disk_gb, a.region, a.sandbox_class) == (2.0, 0.0, 4.0, 20.0, "us-east-1", "container")
    assert a.start_at == AS_OF and a.last_billed_at == AS_OF and a.status == S.SESSION_ACTIVE
    assert (b.cpu, b.gpu, b.ram_gb, b.disk_gb, b.region, b.sandbox_class) == (0.0, 0.0, 0.0, 0.0, "eu-west-1", "windows")
    assert b.start_at == AS_OF - H and b.billing_sequence == 0 and b.recorded_at == AS_OF
    explicit = {r.id: r for r in sessions.create_sessions(req, AS_OF, explicit_resources=True).collect()}
    assert explicit["a"].cpu == 0.0


CHUNK_DDL = ("event_id string, session_id string, sandbox_id string, organization_id string, sequence bigint, "
             "from_ts timestamp_ntz, to_ts timestamp_ntz, cpu double, gpu double, ram_gb double, disk_gb double, "
             "region string, region_type string, sandbox_class string")


@pytest.mark.parametrize("row,reason", [
    (("", "s", "b", "o", 1, AS_OF, AS_OF + H), "required_fields"),
    (("e", "", "b", "o", 1, AS_OF, AS_OF + H), "required_fields"),
    (("e", "s", "", "o", 1, AS_OF, AS_OF + H), "required_fields"),
    ((None, "s", "b", "o", 1, AS_OF, AS_OF + H), "required_fields"),
    (("e", "s", "b", "o", 1, AS_OF, AS_OF), "time_range"),
    (("e", "s", "b", "o", 1, AS_OF, AS_OF - H), "time_range"),
    (("e", "s", "b", "o", 1, None, AS_OF), "time_range"),
    (("e", "s", "b", "", 1, AS_OF, AS_OF + H), None),
])
def test_validation_edges(spark, row, reason):
    df = spark.createDataFrame([row + (None, None, None, None, "", "", "")], CHUNK_DDL)
    assert outbox.validate_chunks(df).collect()[0].reject_reason == reason


GOOD = ('{"event_id":"e","session_id":"s","sandbox_id":"b","organization_id":"o","sequence":1,'
        '"from":"2024-05-01T10:00:00Z","to":"2024-05-01T11:00:00Z"}')


@pytest.mark.parametrize("text,error", [
    (GOOD, None),
    ('{"event_id":"e", broken', "undecodable"),
    ("null", "undecodable"),
    ("[1]", "undecodable"),
    ("", "empty_value"),
    (None, "null_value"),
    (GOOD.replace('"sequence":1', '"sequence":"x"'), "undecodable"),
    (GOOD.replace('"sequence":1', '"sequence":1.0'), "undecodable"),
    (GOOD.replace('2024-05-01T10:00:00Z', 'not-a-time'), "undecodable"),
    (GOOD.replace('"sequence":1', '"sequence":1,"extra":true'), None),
])
def test_decode_edges(spark, text, error):
    df = spark.createDataFrame([(text,)], "value string")
    assert codec.decode_chunks(df, "value").collect()[0].decode_error == error


def test_decode_time_precision_and_zones(spark):
    nano = GOOD.replace("2024-05-01T10:00:00Z", "2024-05-01T10:00:00.123456789Z")
    plus2 = GOOD.replace("2024-05-01T11:00:00Z", "2024-05-01T13:00:00+02:00")
    df = spark.createDataFrame([(nano,), (plus2,)], "value string")
    rows = codec.decode_chunks(df, "value").collect()
    assert rows[0].decode_error is None and rows[0].from_ts.microsecond == 123456
    assert rows[1].to_ts == dt.datetime(2024, 5, 1, 11, 0, 0)


def test_encode_keeps_microseconds_and_omits_nulls(spark):
    df = spark.createDataFrame([("e", "s", "b", "o", 1, AS_OF + US, AS_OF + H, None, 0.0, 4.0, 20.0, "r", "", "c")],
                               CHUNK_DDL)
    text = df.select(codec.encode_chunks().alias("j")).collect()[0].j
    assert "12:00:00.000001Z" in text and '"cpu"' not in text and '"gpu":0.0' in text
    back = codec.decode_chunks(df.select(codec.encode_chunks().alias("v")), "v").collect()[0]
    assert back.from_ts == AS_OF + US and back.cpu is None and back.gpu == 0.0


def test_dedupe_edges(spark):
    d = spark.createDataFrame([
        ("e1", "s", 1, 2), ("e1", "s", 1, 1),          # twice in a batch: first arrival wins
        ("e2", "s", 2, 1),                              # already in the ledger
        ("e3", "s", 3, 1), ("e4", "s", 3, 2),           # two event ids, one transaction id
    ], "event_id string, session_id string, sequence bigint, seq bigint")
    led = spark.createDataFrame([("e2", "s:2")], "event_id string, transaction_id string")
    fresh = ledger.dedupe_by_event_id(d, led, ["seq"])
    assert sorted((r.event_id, r.seq) for r in fresh.collect()) == [("e1", 1), ("e3", 1), ("e4", 2)]
    once = ledger.dedupe_by_transaction_id(fresh, led, ["seq"])
    assert sorted(r.event_id for r in once.collect()) == ["e1", "e3"]
    # bounded batch: keys broadcast into the ledger lookup, same answer
    fresh_b = ledger.dedupe_by_event_id(d, led, ["seq"], batch_rows_bound=10)
    assert sorted(r.event_id for r in fresh_b.collect()) == ["e1", "e3", "e4"]


def outbox_rows(spark, rows):
    full = [(i, f"evt-{i}", S.EVENT_TYPE_CHUNK, "s", i, None, AS_OF - H * i, pub, rc, None) for i, pub, rc in rows]
    return spark.createDataFrame(full, S.OUTBOX_EVENTS)


def test_merges_with_unknown_ids(spark):
    o = outbox_rows(spark, [(1, None, 0), (2, AS_OF, 0), (3, None, 2)])
    ids = spark.createDataFrame([(1,), (99,)], "id bigint")
    new, check = outbox.mark_published(o, ids, AS_OF)
    c = check.collect()[0]
    assert (c.requested, c.matched) == (2, 1)
    assert {r.id: r.published_at for r in new.collect()} == {1: AS_OF, 2: AS_OF, 3: None}
    fails = spark.createDataFrame([(3, "time_range"), (77, "x")], "id bigint, error string")
    new2, missing = outbox.record_failure(o, fails)
    assert [r.id for r in missing.collect()] == [77]
    r3 = [r for r in new2.collect() if r.id == 3][0]
    assert r3.retry_count == 3 and r3.last_error == "time_range"
    empty = spark.createDataFrame([], "id bigint")
    new3, check3 = outbox.mark_published(o, empty, AS_OF)
    assert new3.filter(F.col("published_at").isNotNull()).count() == 1
    assert check3.collect()[0].requested == 0
    led = spark.createDataFrame([(1, "evt-1")], "id bigint, event_id string")
    kept, not_found = ledger.delete_by_id(led, spark.createDataFrame([(1,), (5,)], "id bigint"))
    assert kept.count() == 0 and [r.id for r in not_found.collect()] == [5]


def test_finish_edges(spark):
    s = session_rows(spark, [
        ("act", AS_OF - 10 * H, None, S.SESSION_ACTIVE, AS_OF - 3 * H, 4, 1.0, 0.0),
        ("done", AS_OF - 10 * H, AS_OF - 5 * H, S.SESSION_FINISHED, AS_OF - 5 * H, 2, 1.0, 0.0),
    ])
    req = spark.createDataFrame([("act",), ("done",), ("ghost",)], "id string")
    new, final, outcomes = sessions.finish_plan(s, req, AS_OF)
    assert {r.id: r.outcome for r in outcomes.collect()} == {"act": "finished", "done": "already_finished",
                                                             "ghost": "not_found"}
    f = final.collect()
    assert len(f) == 1 and (f[0].from_ts, f[0].to_ts, f[0].sequence) == (AS_OF - 3 * H, AS_OF, 5)
    a = [r for r in new.collect() if r.id == "act"][0]
    assert (a.status, a.billing_status, a.end_at, a.last_billed_at, a.billing_sequence) == \
        (S.SESSION_FINISHED, S.BILLING_COMPLETED, AS_OF, AS_OF, 5)


def test_retry_split(spark):
    o = outbox_rows(spark, [(1, None, 0), (2, None, 3), (3, None, 5), (4, AS_OF, 9)])
    retry, dead = outbox.split_by_retry(o, 3)
    assert sorted(r.id for r in retry.collect()) == [1]
    assert sorted(r.id for r in dead.collect()) == [2, 3]


def test_reset_then_publish_split_gives_no_new_delivery(spark):
    """Reset a sample of published rows: the publisher finds them in its ledger
    and only re-marks them (0 new deliveries)."""
    o = outbox_rows(spark, [(i, AS_OF, 0) for i in range(1, 30)])
    led = o.select("event_id", "session_id", "sequence", F.col("created_at").alias("processed_at"))
    reset, ids = outbox.reset_published(o, 5, "seed-1")
    assert ids.count() == 5
    split = outbox.publish_split(outbox.unpublished_events(reset), led)
    assert {r.outcome for r in split.collect()} == {"already"}


def test_constraints_flag_duplicates_nulls_enums(spark):
    s = session_rows(spark, [("a", AS_OF, None, S.SESSION_ACTIVE, AS_OF, 0, 1.0, 0.0),
                             ("a", AS_OF, None, "WEIRD", AS_OF, 0, 1.0, 0.0)])
    v = {(r.constraint, r.value) for r in constraints.check_constraints(s, "usage_sessions").collect()}
    assert ("unique:id", "a") in v and ("enum:status", "WEIRD") in v


def test_sequence_gaps_audit(spark):
    df = spark.createDataFrame([
        ("s", 1, AS_OF, AS_OF + H, "a"), ("s", 2, AS_OF + H, AS_OF + 2 * H, "b"),
        ("s", 3, AS_OF + 3 * H, AS_OF + 4 * H, "c"),     # gap
        ("s", 5, AS_OF + 4 * H, AS_OF + 5 * H, "d"),     # missing 4
        ("s", 5, AS_OF + 4 * H, AS_OF + 5 * H, "e"),     # duplicate sequence
    ], "session_id string, sequence bigint, from_ts timestamp_ntz, to_ts timestamp_ntz, event_id string")
    issues = sorted((r.sequence, r.issue) for r in chunks.sequence_gaps(df).collect())
    assert issues == [(3, "gap"), (5, "duplicate_sequence"), (5, "missing_previous"), (5, "missing_previous")]


def test_hot_key_is_reduced_not_collected(spark):
    """One event delivered 100,000 times (a third of the batch) dedupes to one
    row through the partial aggregate; a 200,000-slice backlog expands in
    bounded blocks."""
    from meterflow.operators.common import explode_count
    base = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("e"), F.col("id").cast("string")))
         .alias("event_id"),
        (F.lit(1_000_000) - F.col("id")).alias("seq"), F.lit("s").alias("session_id"))
    first = ledger.dedupe_by_event_id(base, None, ["seq"])
    hot = first.filter(F.col("event_id") == "hot").collect()
    assert len(hot) == 1 and hot[0].seq == 1_000_000 - 299_997
    assert first.count() == 200_001
    big = explode_count(spark.createDataFrame([(200_000,)], "n bigint"), "n", "k")
    agg = big.agg(F.count(F.lit(1)).alias("c"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect()[0]
    assert (agg.c, agg.lo, agg.hi) == (200_000, 1, 200_000)


def test_bucket_pruning_never_hides_a_key(spark):
    """Any batch, however many buckets: every stored row of a batch key is read,
    rows without a bucket too; a small batch reads few rows."""
    table = spark.range(5000).select(F.concat(F.lit("e"), "id").alias("event_id"))
    table = table.withColumn("event_bucket", F.when(F.rand(1) > 0.01, ledger.key_bucket("event_id"))).cache()
    for n in (0, 1, 40, 4000):
        keys = spark.range(n).select(F.concat(F.lit("e"), "id").alias("event_id"))
        pruned = ledger.bucket_pruned(table, keys, "event_id", "event_bucket")
        assert pruned.join(keys, "event_id").count() == n
        assert pruned.filter("event_bucket is null").count() == table.filter("event_bucket is null").count()
        if n == 1:
            assert pruned.count() < 200


def test_a_broken_bound_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ledger, "BROADCAST_KEYS_MAX_ROWS", 10)
    assert ledger.may_broadcast(spark.range(10), 10) and not ledger.may_broadcast(spark.range(11), 10)
    assert not ledger.may_broadcast(spark.range(1), None) and not ledger.may_broadcast(spark.range(1), 11)


def test_expanding_hot_counts_over_tasks(spark):
    df = spark.createDataFrame([("hot", 400_000), ("a", 3), ("b", 4096), ("c", 0)], "k string, n bigint")
    out = explode_count(df, "n", "i", spread=True)
    got = {r.k: (r.c, r.lo, r.hi) for r in out.groupBy("k").agg(
        F.count(F.lit(1)).alias("c"), F.min("i").alias("lo"), F.max("i").alias("hi")).collect()}
    assert got == {"hot": (400_000, 1, 400_000), "a": (3, 1, 3), "b": (4096, 1, 4096)}
    most = out.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 200_000


def test_predecessor_without_an_end_is_not_missing(spark):
    rows = [("s", 1, AS_OF, None, "e1"), ("s", 2, AS_OF, AS_OF, "e2"), ("s", 4, AS_OF, AS_OF, "e4")]
    c = spark.createDataFrame(rows, "session_id string, sequence long, from_ts timestamp_ntz, to_ts timestamp_ntz, "
                                    "event_id string")
    assert [(r.sequence, r.issue) for r in chunks.sequence_gaps(c).collect()] == [(4, "missing_previous")]


def test_next_sequence_hot_session_is_exact(spark):
    """One session with 60,000 candidate slices next to 300 small ones: ranks
    are exactly 1..n per session, in time order, on top of the base."""
    hot = spark.range(60_000).select(F.lit("hot").alias("session_id"),
                                     (X.ts_lit(AS_OF) + F.make_dt_interval(hours=F.col("id"))).alias("from_ts"))
    small = spark.range(900).select(F.concat(F.lit("s"), (F.col("id") % 300).cast("string")).alias("session_id"),
                                    (X.ts_lit(AS_OF) + F.make_dt_interval(hours=F.col("id"))).alias("from_ts"))
    cand = hot.unionByName(small).withColumn("to_ts", F.col("from_ts") + F.expr("INTERVAL 1 HOUR"))
    base = spark.createDataFrame([("hot", 7)], "id string, billing_sequence bigint")
    out = chunks.next_sequence(cand, base)
    per = {r.session_id: r for r in out.groupBy("session_id").agg(
        F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), F.count(F.lit(1)).alias("n"),
        F.countDistinct("sequence").alias("d")).collect()}
    assert (per["hot"].lo, per["hot"].hi, per["hot"].n, per["hot"].d) == (8, 60_007, 60_000, 60_000)
    assert all((r.lo, r.hi, r.n, r.d) == (1, 3, 3, 3) for k, r in per.items() if k != "hot")
    first = out.filter(F.col("session_id") == "hot").orderBy("from_ts").limit(2).collect()
    assert [r.sequence for r in first] == [8, 9]
