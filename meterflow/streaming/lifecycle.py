"""J9 with its state kept as a table of changes: session lifecycle events -> chunks, in
plain DataFrame operations.

A micro-batch takes up the sessions it touches, which are those with events of their
own and those that fall due, joins what is stored of them with the events and emits,
by the arithmetic of the backfill:

* for a session whose finish is known and not in the future, all ticks up to the
  finish and the final chunk, whatever the clock;
* for an active session, the ticks that end at or before the clock: the greatest
  event time so far minus ``delay``, the disorder the caller allows. Only usable
  events and marker rows move it, and none that is dated after the batch's own
  time, so neither a rejected row nor one dated ahead bills time that has not passed.

Three tables hold the state, all appended to by touched sessions only:

* ``lifecycle_state``: a session as a batch left it (``open`` false once it is closed).
  The row of the latest batch counts. Sorted by key bucket, with a Bloom filter of the
  session, so a few sessions are found without reading the rest.
* ``lifecycle_due``: when a session must be taken up again without an event: the end of
  its next tick, against the clock, and a finish dated ahead, against the batch time.
  Whatever was due by the clock of the batch before has been dealt with, so the live
  entries of a batch lie between the two clocks: one pushed-down range, and a session
  whose tick is not due yet is neither read, joined nor written.
* ``lifecycle_closed``: closed sessions, for rejecting what comes after.

Nothing is dropped unseen. A finish may come before its create and waits in the
state; a create or finish may be as old as it likes. A finish before the end of a
chunk that was already emitted (more disorder than ``delay``), a second event of a
closed session and a row without session, time or known action go to
``lifecycle_rejects`` with the reason. A repeated create or finish of an open
session changes nothing (the earliest counts). The interval of a stream must not
change over its life: the due times are stored.

Every output is an overwrite of the batch's own ``batch_id`` partition and reads
only earlier batches, so a retried batch writes the same rows again. A batch's state is
computed once and written to ``lifecycle_work``, which the next batch overwrites. Stored changes
are folded every ``compact_every`` batches to one row per open session, and due
entries to those still ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.functions import expressions as X
from meterflow.operators.common import explode_count
from meterflow.operators.ledger import batch_buckets, bucket_pruned, few_keys, key_bucket
from meterflow.sources import sinks
from meterflow.streaming import compaction
from meterflow.streaming.billing import CLOCK_COL, batch_clock, with_batch_clock

ATTRS = ["sandbox_id", "organization_id", "cpu", "gpu", "ram_gb", "disk_gb", "region", "sandbox_class"]
_ATTR_TYPES = ("sandbox_id string, organization_id string, cpu double, gpu double, ram_gb double, "
               "disk_gb double, region string, sandbox_class string")
STATE = f"session_id string, billed_to timestamp_ntz, finish_at timestamp_ntz, seq bigint, {_ATTR_TYPES}"
CHUNKS = ("event_id string, session_id string, " + _ATTR_TYPES + ", sequence bigint, from_ts timestamp_ntz, "
          "to_ts timestamp_ntz, region_type string, kind string")
REJECTS = f"session_id string, action string, ts timestamp_ntz, {_ATTR_TYPES}, reason string"
STORED = f"{STATE}, open boolean, session_bucket int"
DUE = "session_id string, tick_due bigint, finish_due bigint"
CLOSED = "session_id string, session_bucket int"
CLOCK = ("high timestamp_ntz, now timestamp_ntz, clock_us bigint, now_us bigint, "
         "clock_before bigint, now_before bigint")
SENTINEL = "__watermark__"  # a row that only moves the clock
NEVER = -62_135_596_800_000_000  # microseconds of year 1: no event time yet


def _table(spark, root: str, table: str, schema: str) -> DataFrame:
    return compaction.visible(spark, f"{root}/{table}", f"{schema}, batch_id bigint")


def _earlier(spark, root: str, table: str, schema: str, batch_id: int) -> DataFrame:
    return _table(spark, root, table, schema).filter(F.col("batch_id") < batch_id)


def _micros(ts) -> Column:
    return F.timestamp_diff("MICROSECOND", X.ts_lit("1970-01-01"), ts)


def _at_micros(us: int) -> Column:
    return F.timestamp_add("MICROSECOND", F.lit(us), X.ts_lit("1970-01-01"))


def latest(changes: DataFrame) -> DataFrame:
    """The open sessions of ``lifecycle_state`` rows: each as its latest batch left it."""
    rest = [c for c in changes.columns if c not in ("session_id", "batch_id")]
    last = changes.groupBy("session_id").agg(F.max_by(F.struct(*rest), "batch_id").alias("s"))
    return last.select("session_id", *[F.col(f"s.{c}").alias(c) for c in rest]).filter("open")


def _clocks(rows: DataFrame, moves: Column, root: str, batch_id: int, delay: str):
    """Write and read the batch's clocks (microseconds): the event clock up to which
    ticks are due and the batch time, each with the one of the batch before."""
    spark = rows.sparkSession
    before = _earlier(spark, root, "lifecycle_clock", CLOCK, batch_id)
    top = lambda *cols: [F.max(c).alias(c) for c in cols]
    both = (rows.agg(F.max(F.when(moves, F.col("ts"))).alias("high"), F.max(CLOCK_COL).alias("now"))
            .unionByName(before.agg(*top("high", "now", "clock_us", "now_us")), allowMissingColumns=True)
            .agg(*top("high", "now", "clock_us", "now_us")))
    own = both.select(
        "high", "now",
        F.greatest("clock_us", _micros(F.col("high")) - X.interval_micros(delay)).alias("clock_us"),
        F.greatest("now_us", _micros(F.col("now"))).alias("now_us"),
        F.col("clock_us").alias("clock_before"), F.col("now_us").alias("now_before"))
    sinks.write_batch(own.coalesce(1), f"{root}/lifecycle_clock", batch_id)
    t = spark.read.parquet(f"{root}/lifecycle_clock").filter(F.col("batch_id") == batch_id).first()
    return [NEVER if us is None else us for us in (t.clock_us, t.now_us, t.clock_before, t.now_before)]


def lifecycle_batch(batch: DataFrame, batch_id: int, root: str, interval: str, delay: str, clock=None) -> None:
    """One micro-batch. ``clock`` is the time beyond which events are in the future;
    by default the batch's own (the stream's batch time)."""
    spark, step = batch.sparkSession, X.interval_micros(interval)
    rows = batch.select("session_id", "action", F.col("ts").cast("timestamp_ntz").alias("ts"), *ATTRS,
                        batch_clock(batch, clock).alias(CLOCK_COL)).persist()
    batch_rows = rows
    touched = None
    try:
        usable = (F.col("session_id").isNotNull() & F.col("ts").isNotNull()
                  & F.coalesce(F.col("action").isin("create", "finish"), F.lit(False)))
        marker = F.coalesce(F.col("session_id") == SENTINEL, F.lit(False))
        moves = (usable | (marker & F.col("ts").isNotNull())) & (F.col("ts") <= F.col(CLOCK_COL))
        clock_us, now_us, clock_before, now_before = _clocks(rows, moves, root, batch_id, delay)
        clock, now = _at_micros(clock_us), _at_micros(now_us)

        rows = rows.drop(CLOCK_COL)
        good = rows.filter(usable & ~marker)
        between = lambda c, low, high: (F.col(c) > low) & (F.col(c) <= high)
        due = _earlier(spark, root, "lifecycle_due", DUE, batch_id).filter(
            between("tick_due", clock_before, clock_us) | between("finish_due", now_before, now_us))
        touched = good.select("session_id").unionByName(due.select("session_id")).distinct().persist()
        few = few_keys(touched, "session_id")
        buckets = batch_buckets(touched, "session_id") if few is None else None
        closed, stored = (
            bucket_pruned(_earlier(spark, root, table, schema, batch_id), touched, "session_id", "session_bucket",
                          buckets, few) for table, schema in (("lifecycle_closed", CLOSED), ("lifecycle_state", STORED)))
        closed = closed.select("session_id")
        after_close = good.join(closed, "session_id", "left_semi")
        # attributes of the earliest create; hash of the rest breaks ties
        first = F.min(F.when(F.col("action") == "create", F.struct("ts", *ATTRS)))
        new = (good.join(closed, "session_id", "left_anti").groupBy("session_id")
               .agg(first.alias("c"), F.min(F.when(F.col("action") == "finish", F.col("ts"))).alias("f")))
        old = latest(stored.join(touched, "session_id", "left_semi")).withColumn("__old", F.lit(True))
        both = old.join(new, "session_id", "full_outer")
        known = F.col("billed_to").isNotNull()
        state = both.select(
            "session_id", F.coalesce("billed_to", F.col("c.ts")).alias("billed_to"),
            F.least("finish_at", "f").alias("finish_at"), F.coalesce("seq", F.lit(0)).cast("bigint").alias("seq"),
            *[F.when(known, F.col(a)).otherwise(F.col(f"c.{a}")).alias(a) for a in ATTRS],
            F.coalesce("__old", F.lit(False)).alias("__old"))
        # written, not cached: Spark drops a cached plan when a table that it reads is
        # written to, and what is made of it next would compute the state anew
        work = f"{root}/lifecycle_work"
        state.write.mode("overwrite").parquet(work)
        state = spark.read.schema(f"{STATE}, __old boolean").parquet(work)

        late = state.filter("finish_at < billed_to")
        rejects = [rows.filter(~usable & ~marker).withColumn("reason", F.lit("invalid")),
                   after_close.withColumn("reason", F.lit("session_closed")),
                   late.select("session_id", F.lit("finish").alias("action"), F.col("finish_at").alias("ts"), *ATTRS,
                               F.lit("finish_before_billed").alias("reason"))]
        rejects = rejects[0].unionByName(rejects[1].select(*rejects[0].columns)).unionByName(rejects[2])
        sinks.write_batch(rejects, f"{root}/lifecycle_rejects", batch_id)

        started = state.filter("billed_to is not null and (finish_at is null or finish_at >= billed_to)")
        # a finish dated ahead waits in the state
        over = F.coalesce(F.col("finish_at") <= now, F.lit(False))
        started = started.withColumn("__over", over)
        span = F.timestamp_diff("MICROSECOND", "billed_to", F.when(over, F.col("finish_at")).otherwise(clock))
        started = started.withColumn("__n", F.greatest(F.floor(span / F.lit(step)), F.lit(0)).cast("bigint"))
        at = lambda k: F.timestamp_add("MICROSECOND", k * F.lit(step), F.col("billed_to"))
        own = ["session_id", *ATTRS]
        k = F.col("__k")
        ticks = explode_count(started, "__n", "__k", spread=True).select(
            *own, (F.col("seq") + k).alias("sequence"), at(k - 1).alias("from_ts"), at(k).alias("to_ts"),
            F.lit("tick").alias("kind"))
        finals = started.filter("__over").select(
            *own, (F.col("seq") + F.col("__n") + 1).alias("sequence"), at(F.col("__n")).alias("from_ts"),
            F.col("finish_at").alias("to_ts"), F.lit("final").alias("kind"))
        out = ticks.unionByName(finals).select(
            X.chunk_event_id("session_id", "sequence").alias("event_id"), *own, "sequence", "from_ts", "to_ts",
            F.lit("").alias("region_type"), "kind")
        sinks.write_batch(out, f"{root}/lifecycle_chunks", batch_id)

        done = started.filter("__over").select("session_id", "__old").unionByName(late.select("session_id", "__old"))
        done = done.withColumn("session_bucket", key_bucket("session_id"))
        sinks.write_batch(done.drop("__old").sortWithinPartitions("session_bucket", "session_id"),
                          f"{root}/lifecycle_closed", batch_id, bloom=("session_id",))
        running = started.filter("not __over").select(
            "session_id", at(F.col("__n")).alias("billed_to"), "finish_at",
            (F.col("seq") + F.col("__n")).alias("seq"), *ATTRS)
        waiting = state.filter("billed_to is null").drop("__old")
        # a closed session that was stored open needs a row that says so
        left = (running.unionByName(waiting).withColumn("open", F.lit(True))
                .withColumn("session_bucket", key_bucket("session_id"))
                .unionByName(done.filter("__old").drop("__old").withColumn("open", F.lit(False)), allowMissingColumns=True))
        sinks.write_batch(left.sortWithinPartitions("session_bucket", "session_id"), f"{root}/lifecycle_state",
                          batch_id, bloom=("session_id",))
        ahead = running.select("session_id", (_micros(F.col("billed_to")) + step).alias("tick_due"),
                               _micros(F.col("finish_at")).alias("finish_due"))
        sinks.write_batch(ahead.sortWithinPartitions("tick_due"), f"{root}/lifecycle_due", batch_id)
    finally:
        if touched is not None:
            touched.unpersist()
        batch_rows.unpersist()


def compact_tables(spark, root: str, upto: int) -> None:
    """Fold what batches ``<= upto`` (committed ones) stored: one row per open session,
    the due entries still ahead, the closed sessions, one clock row."""
    t = _table(spark, root, "lifecycle_clock", CLOCK).filter(F.col("batch_id") <= upto).agg(
        F.max("clock_us").alias("clock_us"), F.max("now_us").alias("now_us")).first()
    clock_us, now_us = (NEVER if us is None else us for us in t)
    fold = lambda table, schema, sort, keep, bloom=(): compaction.compact_batches(
        spark, f"{root}/{table}", upto, f"{schema}, batch_id bigint", sort, bloom, keep)
    fold("lifecycle_state", STORED, ("session_bucket", "session_id"), latest, ("session_id",))
    fold("lifecycle_due", DUE, ("tick_due",),
         lambda rows: rows.drop("batch_id").filter((F.col("tick_due") > clock_us) | (F.col("finish_due") > now_us)).distinct())
    fold("lifecycle_closed", CLOSED, ("session_bucket", "session_id"), None, ("session_id",))
    fold("lifecycle_clock", CLOCK, (), lambda rows: rows.drop("batch_id").agg(
        *[F.max(c).alias(c) for c in rows.columns if c != "batch_id"]))


def start_lifecycle_stream(source: DataFrame, root: str, checkpoint: str, delay: str, interval: str = "90 days",
                           available_now: bool = True, clock=None, compact_every: int | None = None):
    """Start J9 on lifecycle events (session_id, action, ts, session attributes).
    ``delay`` is how far out of order event times may be before a finish can come
    too late. With ``compact_every`` the state is folded every so many batches."""
    def work(df: DataFrame, bid: int) -> None:
        if compaction.due(bid, compact_every):
            compact_tables(df.sparkSession, root, bid - 1)
        lifecycle_batch(df, bid, root, interval, delay, clock)

    w = (with_batch_clock(source, clock).writeStream
         .foreachBatch(work)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def chunks(spark, root: str) -> DataFrame:
    return _table(spark, root, "lifecycle_chunks", CHUNKS).drop("batch_id")


def rejects(spark, root: str) -> DataFrame:
    return _table(spark, root, "lifecycle_rejects", REJECTS).drop("batch_id")
