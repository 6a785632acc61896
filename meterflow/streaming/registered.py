"""Streaming query keys: each runs its stream to completion over a file topic
derived from the driver's tables (in a fresh folder under the shared work root)
and returns the sink as a DataFrame, checked against the batch oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterflow import schemas as S
from meterflow.functions import codec
from meterflow.functions import expressions as X
from meterflow.operators import ledger
from meterflow.plans.catalog import AS_OF, A, CHUNK_SELECT, E4_SQL, FIRST, SPLIT_SQL, query
from meterflow.session import new_run_dir
from meterflow.sources import sinks
from meterflow.sources.fixtures import Fixtures
from meterflow.streaming import analytics as san
from meterflow.streaming import billing as sbill
from meterflow.streaming import publish as spub
from meterflow.streaming import topics
from meterflow.streaming import lifecycle
from meterflow.streaming.lifecycle import SENTINEL

TOPIC_FILES = 8


FILES_PER_TRIGGER = 2


def chunk_topic(f: Fixtures, path: str, files: int) -> None:
    """Every chunk delivery as a record of the chunk topic, in ``files`` files."""
    records = sinks.chunk_records(f.dealt_deliveries(files), keep=("delivery_no",))
    topics.write_file_topic(records.withColumnRenamed("delivery_no", "seq"), path, None)


@query("j3_billing_stream", f"""
SELECT event_id, session_id, sequence, {A} AS processed_at, concat(session_id, ':', CAST(sequence AS VARCHAR)) AS metronome_id,
       organization_id FROM ({E4_SQL})""")
def j3(spark, d):
    """Every chunk delivery (with redeliveries) through the billing stream; the
    ledger starts as the fixture billing ledger."""
    f = Fixtures(spark, d)
    run = new_run_dir(spark, "j3")
    topic = f"{run}/topic_usage_billing_chunks"
    chunk_topic(f, topic, f.files(TOPIC_FILES))
    paths = sbill.BillingPaths(run)
    sbill.seed_ledger_table(f.processed_billing_events, paths)
    src = topics.read_chunks_stream(spark, topic, max_per_trigger=f.files(FILES_PER_TRIGGER))
    q = sbill.start_billing_stream(src, paths, f"{run}/_checkpoints/billing", clock=AS_OF)
    q.awaitTermination()
    return sbill.billed_events(spark, paths)


@query("j4_analytics_stream", """
SELECT event_id, session_id, sequence, processed_at, metronome_id, organization_id, CAST(processed_at AS DATE) AS export_date
FROM billing_processed_deliveries WHERE delivery_no = 1""")
def j4(spark, d):
    """Processed topic with redeliveries through the analytics stream."""
    f = Fixtures(spark, d)
    run = new_run_dir(spark, "j4")
    p = f.billing_processed_deliveries
    topic = f"{run}/topic_billing_processed"
    topics.write_file_topic(sinks.processed_records(p, keep=("delivery_no",)).withColumnRenamed("delivery_no", "seq"), topic, f.files(TOPIC_FILES))
    src = topics.read_processed_stream(spark, topic, max_per_trigger=f.files(FILES_PER_TRIGGER), starting="earliest")
    q = san.start_analytics_stream(src, run, f"{run}/_checkpoints/analytics")
    q.awaitTermination()
    return san.exported(spark, run)


@query("j8_late_group", """
SELECT event_id, session_id, sequence, processed_at, metronome_id, organization_id, CAST(processed_at AS DATE) AS export_date
FROM billing_processed_deliveries WHERE CASE WHEN sequence % 2 = 0 THEN delivery_no = 2 ELSE delivery_no = 1 END""")
def j8(spark, d):
    """An analytics group that comes to the processed topic when the first deliveries
    of even sequence numbers lie there: it exports what is written later, before and
    after a stop in between."""
    f = Fixtures(spark, d)
    run = new_run_dir(spark, "j8")
    topic = f"{run}/topic_billing_processed"
    p = f.billing_processed_deliveries
    early, odd = (F.col("sequence") % 2 == 0) & (F.col("delivery_no") == 1), F.col("sequence") % 2 == 1

    def put(rows):
        topics.write_file_topic(sinks.processed_records(rows, keep=("delivery_no",)).withColumnRenamed("delivery_no", "seq"), topic, f.files(TOPIC_FILES))

    def consume():
        src = topics.read_processed_stream(spark, topic, max_per_trigger=f.files(TOPIC_FILES), group=f"{run}/groups/analytics")
        san.start_analytics_stream(src, run, f"{run}/_checkpoints/analytics").awaitTermination()

    put(p.filter(early))
    consume()
    put(p.filter(odd))
    consume()
    put(p.filter(~early & ~odd))
    consume()
    return san.exported(spark, run)


BYTES_CAP = 1_000_000


@query("j10_byte_batches", """
SELECT event_id, count(*) AS deliveries, 0::BIGINT AS batches_over_cap FROM chunk_deliveries GROUP BY event_id""")
def j10(spark, d):
    """Every chunk delivery through a consumer that admits so many bytes a batch, with
    the number of batches that hold more (one file alone may)."""
    f = Fixtures(spark, d)
    run = new_run_dir(spark, "j10")
    topic = f"{run}/topic_usage_billing_chunks"
    chunk_topic(f, topic, 2 * TOPIC_FILES)
    src = topics.read_chunks_stream(spark, topic, max_bytes=BYTES_CAP).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    (src.writeStream.foreachBatch(lambda rows, b: sinks.write_batch(rows, f"{run}/read", b))
     .option("checkpointLocation", f"{run}/_checkpoints/read").trigger(availableNow=True).start().awaitTermination())
    read = spark.read.parquet(f"{run}/read")
    sizes = read.groupBy("batch_id", "file").agg(F.max("bytes").alias("bytes")).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    over = sizes.filter((F.col("files") > 1) & (F.col("bytes") > BYTES_CAP)).count()
    return (codec.decode_chunks(read, "value").groupBy("event_id").agg(F.count(F.lit(1)).alias("deliveries"))
            .withColumn("batches_over_cap", F.lit(over).cast("bigint")))


@query("j2_publish_stream", SPLIT_SQL + f"""
SELECT c.sandbox_id AS key, c.* EXCLUDE (delivery_no, l_orderkey)
FROM {FIRST} c JOIN split s ON s.event_id = c.event_id WHERE s.outcome = 'publish'""")
def j2(spark, d):
    """Unpublished outbox rows through the publish stream; returns the chunk
    topic it wrote (decoded)."""
    f = Fixtures(spark, d)
    run = new_run_dir(spark, "j2")
    src_dir = f"{run}/outbox_stream"
    f.outbox_with_payload(f.files(TOPIC_FILES)).write.option("compression", "zstd").parquet(src_dir)
    src = (spark.readStream.schema(S.OUTBOX_EVENTS).option("maxFilesPerTrigger", f.files(FILES_PER_TRIGGER))
           .parquet(src_dir))
    sinks.write_batch(f.processed_outbox_events.withColumn("event_bucket", ledger.key_bucket("event_id")),
                      f"{run}/processed_outbox_events", -1)
    q = spub.start_publish_stream(src, run, f"{run}/_checkpoints/publish", clock=AS_OF,
                                  partitions=f.files(TOPIC_FILES))
    q.awaitTermination()
    t = spark.read.parquet(f"{run}/topic_usage_billing_chunks")
    dec = codec.decode_chunks(t, "value")
    return dec.select(F.col("key").cast("string").alias("key"), *CHUNK_SELECT.split(", "))


J9_SQL = f"""
, lc AS (SELECT * FROM session_lifecycle WHERE ts <= {A})
, cr AS (SELECT * FROM lc WHERE action = 'create')
, fin AS (SELECT session_id, ts AS end_ts FROM lc WHERE action = 'finish')
, base AS (SELECT cr.*, fin.end_ts,
                  CAST(floor(date_diff('microsecond', cr.ts, coalesce(fin.end_ts, {A})) / (90 * 86400e6)) AS BIGINT) AS n
           FROM cr LEFT JOIN fin USING (session_id))
, ticks AS (SELECT b.*, k FROM base b, unnest(generate_series(1, b.n)) AS t(k))
, chunks AS (
  SELECT session_id, k AS sequence, ts + (k - 1) * INTERVAL 90 DAY AS from_ts, ts + k * INTERVAL 90 DAY AS to_ts,
         organization_id, cpu, 'tick' AS kind FROM ticks
  UNION ALL
  SELECT session_id, n + 1, ts + n * INTERVAL 90 DAY, end_ts, organization_id, cpu, 'final' FROM base WHERE end_ts IS NOT NULL)
SELECT sha256(concat(session_id, ':', CAST(sequence AS VARCHAR))) AS event_id, * FROM chunks"""


@query("j9_session_state_machine", J9_SQL)
def j9(spark, d):
    """Session lifecycle events up to the clock in shuffled order (a finish may
    come batches before its create), then a row that moves the clock, through the
    state table (90-day ticks). The allowed disorder is the table's whole span."""
    f = Fixtures(spark, d)
    run = new_run_dir(spark, "j9")
    lc = f.session_lifecycle.filter(F.col("ts") <= X.ts_lit(AS_OF))
    src_dir, days = f"{run}/lifecycle", 4000
    lc.repartition(f.files(4), F.xxhash64("session_id", "action")).write.parquet(src_dir)
    end = spark.range(1).select(F.lit(SENTINEL).alias("session_id"), F.lit("tick").alias("action"),
                                (X.ts_lit(AS_OF) + F.make_dt_interval(days=F.lit(days))).alias("ts"))
    (lc.limit(0).unionByName(end, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(src_dir))
    src = spark.readStream.schema(lc.schema).option("maxFilesPerTrigger", f.files(2)).parquet(src_dir)
    lifecycle.start_lifecycle_stream(src, run, f"{run}/_checkpoints/j9", f"{days} days",
                                     f"{S.BACKFILL_INTERVAL_DAYS} days").awaitTermination()
    r = lifecycle.chunks(spark, run)
    return r.select("event_id", "session_id", "sequence", "from_ts", "to_ts", "organization_id", "cpu", "kind")



@query("j9_bad_rows", J9_SQL)
def j9_bad(spark, d):
    """As j9, with rows dated a century ahead in every file: without session, with an
    unknown action, and a finish for each session that has none. None of them moves
    the clock or bills time that has not passed."""
    f = Fixtures(spark, d)
    run = new_run_dir(spark, "j9b")
    lc = f.session_lifecycle.filter(F.col("ts") <= X.ts_lit(AS_OF))
    ahead = F.col("ts") + F.make_dt_interval(days=F.lit(36500))
    ended = lc.filter("action = 'finish'").select("session_id")
    bad = (lc.withColumns({"ts": ahead, "action": F.lit("paused")})
           .unionByName(lc.withColumns({"ts": ahead, "session_id": F.lit(None).cast("string")}))
           .unionByName(lc.join(ended, "session_id", "left_anti").withColumns({"ts": ahead, "action": F.lit("finish")}))
           .select(*lc.columns))
    src_dir, days = f"{run}/lifecycle", 4000
    lc.unionByName(bad).repartition(f.files(4), F.xxhash64("session_id", "action", "ts")).write.parquet(src_dir)
    end = spark.range(1).select(F.lit(SENTINEL).alias("session_id"), F.lit("tick").alias("action"),
                                (X.ts_lit(AS_OF) + F.make_dt_interval(days=F.lit(days))).alias("ts"))
    (lc.limit(0).unionByName(end, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(src_dir))
    src = spark.readStream.schema(lc.schema).option("maxFilesPerTrigger", f.files(2)).parquet(src_dir)
    lifecycle.start_lifecycle_stream(src, run, f"{run}/_checkpoints/j9", f"{days} days",
                                     f"{S.BACKFILL_INTERVAL_DAYS} days",
                                     clock=AS_OF + X.dt.timedelta(days=days)).awaitTermination()
    return lifecycle.chunks(spark, run).select("event_id", "session_id", "sequence", "from_ts", "to_ts",
                                               "organization_id", "cpu", "kind")


@query("a11_write_billing_payloads", f"""
, e4 AS ({E4_SQL})
SELECT concat(session_id, ':', CAST(sequence AS VARCHAR)) AS transaction_id, organization_id AS customer_id,
       'usage_billing_chunk' AS event_type, to_ts AS timestamp, date_diff('microsecond', from_ts, to_ts) / 3.6e9 AS p_duration_hours,
       cpu AS p_cpu, sandbox_id AS p_sandbox_id
FROM e4""")
def a11(spark, d):
    """All chunk deliveries as one billing batch into a fresh vendor table
    (A11); the table holds each transaction id once."""
    f = Fixtures(spark, d)
    run = new_run_dir(spark, "a11")
    paths = sbill.BillingPaths(run)
    sbill.seed_ledger_table(f.processed_billing_events, paths)
    c = f.chunk_deliveries
    batch = sinks.chunk_records(c, keep=("delivery_no",)).withColumnRenamed("delivery_no", "seq")
    sbill.billing_batch(batch, 0, paths, clock=AS_OF)
    v = spark.read.parquet(paths.vendor)
    return v.select("transaction_id", "customer_id", "event_type", "timestamp", "p_duration_hours", "p_cpu",
                    "p_sandbox_id")


@query("b3_append_sessions", """
SELECT session_id AS id, sandbox_id, organization_id, ts AS start_at, 'SESSION_ACTIVE' AS status, CAST(0 AS BIGINT) AS billing_sequence,
       coalesce(cpu, 2.0) AS cpu, coalesce(gpu, 0.0) AS gpu
FROM session_lifecycle WHERE action = 'create'""")
def b3(spark, d):
    """Create sessions from every lifecycle create request into a fresh store
    (constraint-checked append) and read the committed table back."""
    from meterflow.plans import runs
    from meterflow.plans.store import SnapshotStore
    f = Fixtures(spark, d)
    store = SnapshotStore(spark, new_run_dir(spark, "b3"))
    req = (f.session_lifecycle.filter(F.col("action") == "create")
           .select(F.col("session_id").alias("id"), "sandbox_id", "organization_id", F.col("ts").alias("start_at"),
                   "cpu", "gpu", "ram_gb", "disk_gb", "region", "sandbox_class"))
    runs.create_run(store, req, AS_OF)
    return store.read("usage_sessions").select("id", "sandbox_id", "organization_id", "start_at", "status",
                                               "billing_sequence", "cpu", "gpu")


@query("j3_redelivery_other_date", f"""
SELECT event_id, session_id, sequence, {A} AS processed_at, concat(session_id, ':', CAST(sequence AS VARCHAR)) AS metronome_id,
       organization_id FROM ({E4_SQL})""")
def j3_dates(spark, d):
    """As j3, but every redelivery comes in a later micro-batch and its chunk
    starts a day later: still the same event, billed once."""
    f = Fixtures(spark, d)
    run = new_run_dir(spark, "j3d")
    topic = f"{run}/topic_usage_billing_chunks"
    for numbers, days in (("delivery_no = 1", 0), ("delivery_no > 1", 1)):
        moved = f.dealt_deliveries(f.files(TOPIC_FILES // 2), numbers).withColumn(
            "from_ts", F.col("from_ts") + F.make_dt_interval(days=F.lit(days)))
        topics.write_file_topic(sinks.chunk_records(moved, keep=("delivery_no",))
                                .withColumnRenamed("delivery_no", "seq"), topic, None)
    paths = sbill.BillingPaths(run)
    sbill.seed_ledger_table(f.processed_billing_events, paths)
    src = topics.read_chunks_stream(spark, topic, max_per_trigger=f.files(TOPIC_FILES // 2))
    sbill.start_billing_stream(src, paths, f"{run}/_checkpoints/billing", clock=AS_OF).awaitTermination()
    return sbill.billed_events(spark, paths)


@query("j4_redelivery_other_date", """
SELECT event_id, session_id, sequence, processed_at, metronome_id, organization_id, CAST(processed_at AS DATE) AS export_date
FROM billing_processed_deliveries WHERE delivery_no = 1""")
def j4_dates(spark, d):
    """As j4, but every redelivery was processed a day later and comes in a later
    micro-batch: exported once, as first delivered."""
    f = Fixtures(spark, d)
    run = new_run_dir(spark, "j4d")
    topic, p = f"{run}/topic_billing_processed", f.billing_processed_deliveries
    for part, days in ((p.filter("delivery_no = 1"), 0), (p.filter("delivery_no > 1"), 1)):
        moved = part.withColumn("processed_at", F.col("processed_at") + F.make_dt_interval(days=F.lit(days)))
        topics.write_file_topic(sinks.processed_records(moved, keep=("delivery_no",))
                                .withColumnRenamed("delivery_no", "seq"), topic, f.files(TOPIC_FILES // 2))
    src = topics.read_processed_stream(spark, topic, max_per_trigger=f.files(TOPIC_FILES // 2), starting="earliest")
    san.start_analytics_stream(src, run, f"{run}/_checkpoints/analytics").awaitTermination()
    return san.exported(spark, run)


def _create_requests(f: Fixtures):
    return (f.session_lifecycle.filter(F.col("action") == "create")
            .select(F.col("session_id").alias("id"), "sandbox_id", "organization_id", F.col("ts").alias("start_at"),
                    "cpu", "gpu", "ram_gb", "disk_gb", "region", "sandbox_class"))


@query("b3_conflicts", """
SELECT 'unique:id' AS "constraint", session_id AS value, CAST(2 AS BIGINT) AS n
FROM session_lifecycle WHERE action = 'finish'""")
def b3_conflicts(spark, d):
    """A second create request for every session that has finished: each comes
    back as a violation, nothing is committed."""
    from meterflow.plans import runs
    from meterflow.plans.store import SnapshotStore
    f = Fixtures(spark, d)
    store = SnapshotStore(spark, new_run_dir(spark, "b3c"))
    runs.create_run(store, _create_requests(f), AS_OF)
    again = _create_requests(f).join(f.session_lifecycle.filter(F.col("action") == "finish")
                                     .select(F.col("session_id").alias("id")), "id", "left_semi")
    version, violations = runs.create_run(store, again, AS_OF)
    assert version is None or again.limit(1).count() == 0
    return violations


@query("l5_shard_write", """
SELECT p.event_id, CAST(('0x' || substr(md5(p.organization_id), 1, 8)) AS BIGINT) % 4 AS org_bucket,
       coalesce(s.region, '') AS shard_region, CAST(date_trunc('year', processed_at) AS DATE) AS shard_date
FROM billing_processed_deliveries p JOIN usage_sessions s ON s.id = p.session_id WHERE delivery_no = 1""")
def l5_write(spark, d):
    """Processed events written in two batches into one table sharded by tenant,
    region and year, the second batch twice (a retry), and read back."""
    from meterflow.operators import analytics
    f = Fixtures(spark, d)
    p = f.billing_processed_deliveries.filter(F.col("delivery_no") == 1)
    rows = analytics.shard_columns(
        p.join(f.usage_sessions.select(F.col("id").alias("session_id"), "region"), "session_id"),
        buckets=4, period="year")
    target = f"{new_run_dir(spark, 'l5')}/events_by_tenant"
    for batch in (0, 1, 1):
        sinks.write_sharded(rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(2)) == batch), target, batch_id=batch)
    back = spark.read.parquet(target)
    return back.select("event_id", F.col("org_bucket").cast("bigint").alias("org_bucket"),
                       F.coalesce("shard_region", F.lit("")).alias("shard_region"),
                       F.col("shard_date").cast("date").alias("shard_date"))


@query("publish_run_rejects", SPLIT_SQL + """
, bad AS (
  SELECT event_id, CASE WHEN (id // 8) % 7 = 0 THEN 'undecodable' ELSE outcome END AS outcome
  FROM split WHERE outcome <> 'already')
SELECT event_id, outcome, CAST(2 AS BIGINT) AS n FROM bad WHERE outcome IN ('undecodable', 'invalid')""")
def publish_rejects(spark, d):
    """Two publish cycles over an outbox in which the payload of every seventh
    order's rows is not JSON: each bad row is rejected, with its reason, by both."""
    from meterflow.plans import runs
    from meterflow.plans.store import SnapshotStore
    f = Fixtures(spark, d)
    run = new_run_dir(spark, "pubrej")
    store = SnapshotStore(spark, f"{run}/store")
    broken = F.floor(F.col("id") / 8) % 7 == 0
    rows = f.outbox_with_payload().withColumn("payload", F.when(broken, F.lit("not json")).otherwise(F.col("payload")))
    runs.init_store(store, f.usage_sessions, rows)
    seed = f.processed_outbox_events.withColumn("event_bucket", ledger.key_bucket("event_id"))
    store.commit({"processed_outbox_events": (seed, "append")}, "seed")
    for _ in range(2):
        runs.publish_run(store, f"{run}/topic", AS_OF)
    return store.read("outbox_rejects").groupBy("event_id", "outcome").agg(F.count(F.lit(1)).alias("n"))
