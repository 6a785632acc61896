"""Physical-plan properties the scale design relies on."""

from pyspark.sql import functions as F

from meterflow import schemas as S
from meterflow.functions import codec
from meterflow.operators import chunks, ledger, outbox, sessions
from meterflow.operators.chunks import CHUNK_COLUMNS


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_eligibility_filter_and_projection_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "sessions")
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet")  # warm the reader
    from meterflow.sources.fixtures import Fixtures
    Fixtures(spark, "/root/testdata/sf0.001").usage_sessions.write.parquet(path)
    s = sessions.read_sessions(path, spark)
    df = sessions.unbilled_sessions(s, S.AS_OF).select("id", "last_billed_at")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    p = plan(df)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters: [IsNotNull(status), IsNotNull(last_billed_at), EqualTo(status,SESSION_ACTIVE)" in p
    assert "LessThan(last_billed_at" in p
    assert "ReadSchema: struct<id:string,status:string,last_billed_at:timestamp_ntz>" in p


def test_dedupe_and_audit_use_no_window(fx_small):
    d = fx_small.chunk_deliveries.select(*CHUNK_COLUMNS, "delivery_no")
    e4 = ledger.dedupe_by_event_id(d, fx_small.processed_billing_events, ["delivery_no"])
    gaps = chunks.sequence_gaps(fx_small.first_deliveries)
    bf = chunks.chunk_backfill(fx_small.usage_sessions, S.AS_OF, "90 days")
    for df in (e4, gaps, bf, fx_small.chunk_deliveries):
        assert "Window" not in plan(df)
    # first delivery wins through a partial (map-side) aggregate
    assert "partial_min" in plan(e4)


def test_bounded_batch_broadcasts_only_its_keys(fx_small):
    d = fx_small.chunk_deliveries.select(*CHUNK_COLUMNS, "delivery_no")
    led = fx_small.processed_billing_events
    bounded = ledger.dedupe_by_event_id(d, led, ["delivery_no"], batch_rows_bound=10_000)
    assert "BroadcastExchange" in plan(bounded)
    # above the bound nothing is broadcast by hand (AQE may still choose to at runtime)
    unbounded = ledger.dedupe_by_event_id(d, led, ["delivery_no"], batch_rows_bound=10**9)
    assert "broadcast" not in unbounded._jdf.queryExecution().logical().toString().lower()


def test_json_is_parsed_once_under_a_filter(fx_small):
    enc = fx_small.chunk_deliveries.select(codec.encode_chunks().alias("value"))
    dec = codec.decode_chunks(enc, "value").filter(F.col("decode_error").isNull()).select("event_id")
    p = plan(dec)
    assert p.count("from_json") == 1


def test_publish_split_joins_the_ledger_and_its_own_least_ids(fx_small):
    leased = outbox.unpublished_events(fx_small.outbox_with_payload())
    led = fx_small.processed_outbox_events
    split = outbox.publish_split(leased, led)
    inputs = 2 * plan(leased).count("Join") + plan(led).count("Join")
    assert plan(split).count("Join") - inputs == 2


def test_no_cross_products_in_any_registered_batch_query(spark):
    """No query plans a cartesian product or nested-loop join; the only windows
    are H1's (two keys), over months of a session, hours of a month, intervals of
    an hour and tie buckets of an interval."""
    from meterflow.plans import bad_input, deliveries  # noqa: F401  (add keys)
    from meterflow.plans.catalog import QUERIES
    windows_ok = {"h1_next_sequence", "h1_equal_rows"}
    for key, fn in sorted(QUERIES.items()):
        if fn.__module__.startswith("meterflow.streaming."):  # these run when they are called
            continue
        p = plan(fn(spark, "/root/testdata/sf0.001"))
        assert "CartesianProduct" not in p and "NestedLoopJoin" not in p, key
        if key not in windows_ok:
            assert "Window" not in p, key


def test_scale_conf_sizes_partitions():
    from meterflow.session import scale_conf
    small = scale_conf(10 << 20, 8)
    assert small["spark.sql.shuffle.partitions"] == "16"
    big = scale_conf(100 << 40, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 819200
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
