"""H2 online: the sequence audit of every session while its chunks come in.

The state is two tables: the deliveries that are not settled yet, and the numbers
settled, as merged ranges, each with the end time of its last number (and the numbers
reported as duplicates). A second delivery of a number is reported at once, and once. A
delivery is settled when the clock (the latest start minus the delay) has passed its
start: only then is a missing predecessor a finding, and a predecessor's end is compared
with its start. Settled numbers go into the ranges and their deliveries go, so the state
grows with the gaps and with the delay, not with the session. Every step is an equi-join
on session and number or an aggregate.

A number that was settled before and comes again is a duplicate only; its distance is
not judged a second time. A null number or session takes no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterflow.functions import expressions as X
from meterflow.session import read_parquet_or_empty
from meterflow.sources import sinks
from meterflow.streaming import state_tables

OPEN = "session_id string, sequence bigint, event_id string, from_us bigint, to_us bigint"
RANGES = "session_id string, lo bigint, hi bigint, to_us bigint"
TOLD = "session_id string, sequence bigint"
CLOCK = "clock_us bigint, ranges_at bigint"
FINDINGS = ("session_id string, sequence bigint, event_id string, from_ts timestamp_ntz, prev_to timestamp_ntz, "
            "issue string")
# The session of a row that is dated after all others and settles them.
END = "__end__"
NUMBER = ["session_id", "sequence"]


def duplicates(fresh: DataFrame, settled: DataFrame, held: DataFrame, told: DataFrame) -> DataFrame:
    """Numbers that have come a second time and are not in ``told``: ``fresh`` and
    ``settled`` are the new deliveries of open and of settled numbers."""
    new = fresh.withColumn("open", F.lit(True)).unionByName(settled.withColumn("open", F.lit(False)))
    every = new.withColumn("new", F.lit(True)).unionByName(held.withColumns({"open": F.lit(True), "new": F.lit(False)}))
    found = every.groupBy(*NUMBER).agg(
        F.min("event_id").alias("event_id"), F.min("from_us").alias("from_us"), F.count(F.lit(1)).alias("n"),
        F.max("new").alias("again"), F.max("open").alias("open")).filter("again AND (n > 1 OR NOT open)")
    return found.join(told, NUMBER, "left_anti").select(
        *NUMBER, "event_id", "from_us", F.lit(None).cast("bigint").alias("prev_us"), F.lit("duplicate_sequence").alias("issue"))


def judge(held: DataFrame, due: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings of the deliveries ``due`` against the numbers before theirs, which are
    open (``held``, due or not) or the last of a settled range."""
    ends = (held.groupBy(*NUMBER).agg(F.max("to_us").alias("prev_us")).withColumn("sequence", F.col("sequence") + 1)
            .unionByName(ranges.select("session_id", (F.col("hi") + 1).alias("sequence"), F.col("to_us").alias("prev_us")))
            .withColumn("known", F.lit(True)))
    issue = (F.when(F.col("known").isNull(), "missing_previous").when(F.col("from_us") < F.col("prev_us"), "overlap")
             .when(F.col("from_us") > F.col("prev_us"), "gap"))
    return (due.filter("sequence > 1").join(ends, NUMBER, "left").withColumn("issue", issue).filter("issue IS NOT NULL")
            .select(*NUMBER, "event_id", "from_us", "prev_us", "issue"))


def merged(ranges: DataFrame, due: DataFrame) -> DataFrame:
    """``ranges`` with the numbers of ``due``, adjoining ones as one."""
    new = due.groupBy(*NUMBER).agg(F.max("to_us").alias("to_us")).select(
        "session_id", F.col("sequence").alias("lo"), F.col("sequence").alias("hi"), "to_us")
    w = Window.partitionBy("session_id").orderBy("lo")
    first = F.coalesce(F.lag("hi").over(w) + 1 < F.col("lo"), F.lit(True)).cast("int")
    return (ranges.unionByName(new).withColumn("__first", first).withColumn("__k", F.sum("__first").over(w))
            .groupBy("session_id", "__k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max_by("to_us", "hi").alias("to_us"))
            .drop("__k"))


def audit_batch(batch: DataFrame, batch_id: int, target: str, root: str, delay_us: int) -> None:
    """``batch``: chunk deliveries (session_id, sequence, event_id, from_ts, to_ts)."""
    spark = batch.sparkSession
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    before = state_tables.clock_before(spark, root, batch_id, CLOCK)
    last, old, ranges_at = (before.batch_id, before.clock_us, before.ranges_at) if before else (-1, 0, -1)
    rows = batch.filter(F.col("session_id").isNotNull() & F.col("sequence").isNotNull() & F.col("from_ts").isNotNull()) \
        .select(*NUMBER, "event_id", micros("from_ts").alias("from_us"), micros("to_ts").alias("to_us"))
    newest = rows.agg(F.max("from_us").alias("m")).first().m
    clock = old if newest is None else max(old, (newest - delay_us) // 1000 * 1000)
    ranges = state_tables.state(spark, root, "ranges", RANGES, ranges_at)
    told = read_parquet_or_empty(spark, f"{root}/told", f"{TOLD}, batch_id bigint").filter(F.col("batch_id") < batch_id)
    prev = state_tables.state(spark, root, "open", OPEN, last)
    rows = rows.filter((F.col("session_id") != END) & (F.col("from_us") > old))
    within = ranges.select(F.col("session_id").alias("__s"), "lo", "hi")
    inside = (F.col("session_id") == F.col("__s")) & F.col("sequence").between(F.col("lo"), F.col("hi"))
    fresh = rows.join(within, inside, "left_anti") if ranges_at >= 0 else rows
    settled = rows.join(within, inside, "left_semi") if ranges_at >= 0 else rows.limit(0)
    held = fresh.withColumn("new", F.lit(True)).unionByName(prev.withColumn("new", F.lit(False))).persist()
    try:
        found = duplicates(held.filter("new").drop("new"), settled, held.filter("NOT new").drop("new"),
                           told.select(*NUMBER)).persist()
        passed = F.floor(F.col("from_us") / 1000) * 1000 < clock
        all_ = held.drop("new")
        if held.filter(passed).isEmpty():
            findings, left = found, all_
        else:
            numbers = all_.filter(passed).select(*NUMBER).distinct()
            due = all_.join(numbers, NUMBER, "left_semi")
            findings, left = found.unionByName(judge(all_, due, ranges)), all_.join(numbers, NUMBER, "left_anti")
            sinks.write_batch(merged(ranges, due), f"{root}/ranges", batch_id)
            ranges_at = batch_id
        sinks.write_batch(findings.select(*NUMBER, "event_id", at("from_us").alias("from_ts"), at("prev_us").alias("prev_to"), "issue"),
                          target, batch_id)
        sinks.write_batch(found.select(*NUMBER), f"{root}/told", batch_id)
        sinks.write_batch(left, f"{root}/open", batch_id)
        state_tables.write_clock(spark, root, batch_id, CLOCK, clock, ranges_at)
        found.unpersist()
    finally:
        held.unpersist()


def start_audit_stream(chunks: DataFrame, target: str, checkpoint: str, delay: str, available_now: bool = True):
    """Findings (FINDINGS) over a stream of chunk deliveries; the state lies beside the
    checkpoint."""
    delay_us = X.interval_micros(delay)
    return state_tables.foreach_batch(
        chunks, lambda df, b: audit_batch(df, b, target, f"{checkpoint}-state", delay_us), checkpoint, available_now)


def findings(spark, target: str) -> DataFrame:
    return read_parquet_or_empty(spark, target, f"{FINDINGS}, batch_id bigint").drop("batch_id")
