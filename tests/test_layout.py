"""Table layout and admission: Bloom filters, bucketed ledger, start marks, byte
bounds, column defaults."""

import pytest
from pyspark.sql import functions as F

from meterflow import schemas as S
from meterflow.operators import chunks, constraints, ledger
from meterflow.session import new_run_dir
from meterflow.sources import sinks
from meterflow.streaming import topics


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows_scanned(df) -> int:
    """Rows that the scan of ``df``, a filter over one table, put out."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().head()
    return node.metrics().apply("numOutputRows").value()


def test_few_keys_skip_row_groups_when_every_bucket_is_touched(spark):
    run = new_run_dir(spark, "t-bloom")
    rows = (spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("event_id"),
                                        F.concat(F.lit("s:"), F.col("id").cast("string")).alias("transaction_id"))
            .withColumn("event_bucket", ledger.key_bucket("event_id")))
    write = rows.repartition(8).sortWithinPartitions("event_bucket", "event_id")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    before = hadoop.get("parquet.block.size")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hadoop.set("parquet.block.size", str(32 << 10))
        sinks.write_batch(write, f"{run}/ledger", 0, bloom=("event_id", "transaction_id"))
        sinks.write_batch(write, f"{run}/plain", 0)
        keys = spark.range(0, 200_000, 2_000).select(F.concat(F.lit("s:"), F.col("id").cast("string")).alias("transaction_id"))
        few = ledger.few_keys(keys, "transaction_id")
        assert len(few) == 100
        seen = {}
        for name in ("ledger", "plain"):
            hit = ledger.bucket_pruned(spark.read.parquet(f"{run}/{name}"), keys, "transaction_id", "none", few=few)
            seen[name] = rows_scanned(hit)
            assert hit.count() == 100
        assert seen["ledger"] < 0.5 * seen["plain"], seen
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        if before is None:
            hadoop.unset("parquet.block.size")
        else:
            hadoop.set("parquet.block.size", before)


def test_few_keys_is_bounded_and_ignores_nulls(spark):
    many = spark.range(ledger.FEW_KEYS + 1).select(F.col("id").cast("string").alias("event_id"))
    assert ledger.few_keys(many, "event_id") is None
    one = spark.createDataFrame([(None,), ("a",), ("a",)], "event_id string")
    assert ledger.few_keys(one, "event_id") == ["a"]
    assert ledger.few_keys(one.limit(0), "event_id") == []
    assert ledger.bucket_pruned(one, one, "event_id", "event_bucket", few=[]).count() == 0


def test_bucketed_ledger_is_not_shuffled(spark, fx_small):
    run = new_run_dir(spark, "t-buckets")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = ledger.save_bucketed(fx_small.processed_billing_events, "t_buckets", f"{run}/ledger", buckets=n)
    path = f"{run}/deliveries"
    fx_small.chunk_deliveries.select(*chunks.CHUNK_COLUMNS, "delivery_no").write.parquet(path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(ledger.dedupe_by_event_id(spark.read.parquet(path), stored, ["delivery_no"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert p.count("Exchange ") == 1 and "Bucketed: true" in p


def _records(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id").cast("string").cast("binary").alias("key"),
                                      F.col("id").cast("string").cast("binary").alias("value"),
                                      F.lit(None).cast("array<struct<key:string,value:binary>>").alias("headers"),
                                      F.col("id").alias("seq"))


def _consume(src, path):
    (src.select("seq").writeStream.format("parquet").option("path", f"{path}/out")
     .option("checkpointLocation", f"{path}/_chk").trigger(availableNow=True).start().awaitTermination())


def test_latest_group_keeps_its_mark_and_earliest_reads_all(spark):
    run = new_run_dir(spark, "t-latest")
    topics.write_file_topic(_records(spark, 0, 50), f"{run}/topic", 3)

    def read(group):
        return topics.read_processed_stream(spark, f"{run}/topic", group=f"{run}/{group}")

    read("a")   # the group is seen, and goes away before it reads anything
    topics.write_file_topic(_records(spark, 50, 80), f"{run}/topic", 3)
    _consume(read("a"), f"{run}/a")
    _consume(read("b"), f"{run}/b")
    _consume(topics.read_chunks_stream(spark, f"{run}/topic"), f"{run}/c")
    topics.write_file_topic(_records(spark, 80, 90), f"{run}/topic", 1)
    _consume(read("a"), f"{run}/a")
    _consume(read("b"), f"{run}/b")
    got = {g: sorted(r.seq for r in spark.read.schema("seq long").parquet(f"{run}/{g}/out").collect()) for g in "abc"}
    assert got == {"a": list(range(50, 90)), "b": list(range(80, 90)), "c": list(range(80))}


def test_latest_on_a_topic_not_there_yet_reads_all(spark):
    run = new_run_dir(spark, "t-latest0")
    topics.start_mark(spark, f"{run}/topic", f"{run}/g")
    topics.write_file_topic(_records(spark, 0, 10), f"{run}/topic", 2)
    _consume(topics.read_processed_stream(spark, f"{run}/topic", group=f"{run}/g"), f"{run}/g")
    assert spark.read.parquet(f"{run}/g/out").count() == 10
    with pytest.raises(ValueError):
        topics.read_processed_stream(spark, f"{run}/topic")


def test_bytes_bound_a_batch(spark):
    run = new_run_dir(spark, "t-bytes")
    topics.write_file_topic(_records(spark, 0, 1000), f"{run}/topic", 10)
    batches = []
    src = topics.read_chunks_stream(spark, f"{run}/topic", max_bytes=1)   # smaller than any file: one file a batch
    (src.writeStream.foreachBatch(lambda df, b: batches.append(df.count()))
     .option("checkpointLocation", f"{run}/_chk").trigger(availableNow=True).start().awaitTermination())
    assert len(batches) == 10 and sum(batches) == 1000


def test_defaults_serials_and_refused_rows(spark):
    run = new_run_dir(spark, "t-defaults")
    constraints.define_tables(spark, run, "metering_d")
    rows = spark.createDataFrame([("e1", "s", 1), ("e2", None, 2)], "event_id string, session_id string, sequence long") \
        .withColumn("event_type", F.lit(S.EVENT_TYPE_CHUNK)).withColumn("unknown", F.lit(1))
    refused = constraints.insert_rows(rows, "outbox_events", "metering_d").collect()
    assert [(r.event_id, r.refused) for r in refused] == [("e2", "session_id")]
    got = spark.table("metering_d.outbox_events").collect()
    assert [(r.event_id, r.retry_count, r.published_at) for r in got] == [("e1", 0, None)]
    assert got[0].id is not None and got[0].created_at is not None
    # a lacking NOT NULL column without a default refuses every row; an explicit null too
    assert {r.refused for r in constraints.insert_rows(rows.drop("sequence"), "outbox_events", "metering_d").collect()} \
        == {"sequence", "session_id,sequence"}
    null = rows.filter("event_id = 'e1'").withColumn("retry_count", F.lit(None).cast("int"))
    assert [r.refused for r in constraints.insert_rows(null, "outbox_events", "metering_d").collect()] == ["retry_count"]
    assert constraints.insert_rows(rows.limit(0), "outbox_events", "metering_d").count() == 0
    assert spark.table("metering_d.outbox_events").count() == 1


def test_next_sequence_of_equal_rows_nulls_and_ties(spark):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    same = spark.range(3000).select(F.lit("hot").alias("session_id"), at.alias("from_ts"), at.alias("to_ts"), F.lit("x").alias("tag"))
    ties = spark.range(500).select(F.lit("hot"), at, at, F.concat(F.lit("t"), F.col("id").cast("string")))
    none = spark.createDataFrame([(None, None, None, None), (None, None, None, None), ("hot", None, None, "n")],
                                 "session_id string, from_ts timestamp_ntz, to_ts timestamp_ntz, tag string")
    cand = same.union(ties).union(none)
    base = spark.createDataFrame([("hot", 10), ("other", 3)], "id string, billing_sequence bigint")
    out = chunks.next_sequence(cand, base)
    hot = out.filter("session_id = 'hot'").agg(F.min("sequence"), F.max("sequence"), F.countDistinct("sequence"), F.count("*")).first()
    assert tuple(hot) == (11, 3511, 3501, 3501)
    assert out.filter("tag = 'n'").first().sequence == 11      # null times come first
    assert sorted(r.sequence for r in out.filter("session_id IS NULL").collect()) == [1, 2]
    assert out.columns == [*cand.columns, "sequence"]
    numbers = lambda df: {(r.tag, r.sequence) for r in df.collect()}
    assert numbers(out) == numbers(chunks.next_sequence(cand.repartition(5, "tag"), base))
    assert chunks.next_sequence(cand.limit(0), base).count() == 0


def test_streams_fold_their_tables_as_they_go(spark, fx_small):
    """Folding every second batch changes no result, and lookups list few folders."""
    from meterflow.streaming import billing as sbill
    from meterflow.streaming import compaction
    run = new_run_dir(spark, "t-fold")
    records = sinks.chunk_records(fx_small.chunk_deliveries.limit(400), keep=("delivery_no",)) \
        .withColumnRenamed("delivery_no", "seq").withColumn("seq", F.col("seq").cast("bigint"))
    topics.write_file_topic(records, f"{run}/topic", 5)
    topics.write_file_topic(records, f"{run}/topic", 1)   # everything once more, last
    paths = sbill.BillingPaths(run)
    sbill.start_billing_stream(topics.read_chunks_stream(spark, f"{run}/topic", max_per_trigger=1), paths,
                               f"{run}/_chk", clock=S.AS_OF, compact_every=2).awaitTermination()
    ids = [r.event_id for r in compaction.visible(spark, paths.ledger, sbill.LEDGER_SCHEMA).collect()]
    sent = [r.transaction_id for r in compaction.visible(spark, paths.vendor, sbill.VENDOR_SCHEMA).collect()]
    want = {r.event_id for r in spark.read.parquet(f"{run}/topic").select(
        F.get_json_object(F.col("value").cast("string"), "$.event_id").alias("event_id")).collect()}
    assert len(ids) == len(set(ids)) and set(ids) == want
    assert len(sent) == len(set(sent)) == len(want)
    folders = compaction.visible(spark, paths.ledger, sbill.LEDGER_SCHEMA).select("batch_id").distinct().count()
    assert folders <= 3


def test_a_fold_without_its_pointer_is_not_seen(spark):
    from meterflow.streaming import compaction
    path, schema = f"{new_run_dir(spark, 't-orphan')}/t", "k string, batch_id bigint"
    for b in range(3):
        sinks.write_batch(spark.createDataFrame([(f"k{b}",)], "k string"), path, b)
    sinks.write_batch(spark.createDataFrame([("k0",), ("k1",)], "k string"), path, -3)   # died before its pointer
    see = lambda: sorted(r.k for r in compaction.visible(spark, path, schema).collect())
    assert see() == ["k0", "k1", "k2"]
    assert compaction.compact_batches(spark, path, 1, schema) == -3
    assert see() == ["k0", "k1", "k2"]
