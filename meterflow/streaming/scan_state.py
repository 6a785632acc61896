"""The periodic scan as a stream with one entry per active session.

The entries are seeded once from the session table and kept as a table; nothing of the
session table is read again at a tick. Each holds the end of the time billed so far, the
sequence number and what a chunk carries of its session. Ticks are rows of the input
that only move the clock (the latest time seen, in whole milliseconds). At a batch's
clock each session that is due (``last + interval`` strictly before it) emits its chunk
``[last, min(clock, end))`` with the next number (C3) and its entry moves on (I1). A
create adds an entry, a finish removes it (its last chunk is I2's).

A batch reads the entries the batch before left and writes its own, one pass without a
shuffle unless sessions come or go; a batch that is replayed starts from the same
entries and replaces its outputs. Event ids are functions of session and number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow import schemas as S
from meterflow.functions import expressions as X
from meterflow.operators import outbox
from meterflow.operators.chunks import chunk_columns
from meterflow.operators.common import first_by_order
from meterflow.sources import sinks
from meterflow.streaming import state_tables

ATTRS = ["sandbox_id", "organization_id", "cpu", "gpu", "ram_gb", "disk_gb", "region", "sandbox_class"]
_ATTR_TYPES = ("sandbox_id string, organization_id string, cpu double, gpu double, ram_gb double, disk_gb double, "
               "region string, sandbox_class string")
ENTRY = f"id string, last_us bigint, end_us bigint, seq bigint, {_ATTR_TYPES}"
# Input rows: kind is tick, create or finish; ts is when it happened.
CHANGES = f"id string, kind string, ts timestamp, start_at timestamp_ntz, end_at timestamp_ntz, {_ATTR_TYPES}"
TICK = "__tick__"
CLOCK = "clock_us bigint"
_COLS = [c.split()[0] for c in ENTRY.split(", ")]


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def seed(sessions: DataFrame) -> DataFrame:
    """The active sessions as initial entries, one an id; a null end of the billed time
    is never due."""
    rows = (sessions.filter((F.col("status") == S.SESSION_ACTIVE) & F.col("last_billed_at").isNotNull())
            .select("id", _micros("last_billed_at").alias("last_us"), _micros("end_at").alias("end_us"),
                    F.col("billing_sequence").alias("seq"), *ATTRS))
    return first_by_order(rows, ["id"], ["last_us"]).select(*_COLS)


def with_changes(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """``entries`` after the creates and finishes of a batch in the order of their times
    (a create before a finish of the same time). A create of a session that has an entry
    does nothing."""
    ended = changes.filter("kind = 'finish'").groupBy("id").agg(F.max("ts").alias("__ended"))
    born = changes.filter("kind = 'create'").select("id", "ts", _micros("start_at").alias("last_us"), _micros("end_at").alias("end_us"),
                                                    F.lit(0).cast("bigint").alias("seq"), *ATTRS)
    ended_id = ended.withColumnRenamed("id", "__id")
    born = born.join(ended_id, F.col("id").eqNullSafe(F.col("__id")), "left").filter("__ended IS NULL OR ts > __ended")
    born = first_by_order(born.drop("__id", "__ended"), ["id"], ["ts"]).select(*_COLS)
    kept = entries.join(ended_id, F.col("id").eqNullSafe(F.col("__id")), "left_anti")
    there = kept.select(F.col("id").alias("__id"))
    return kept.unionByName(born.join(there, F.col("id").eqNullSafe(F.col("__id")), "left_anti"))


def scan_batch(batch: DataFrame, batch_id: int, sessions: DataFrame, target: str, root: str, interval_us: int) -> None:
    """``batch``: CHANGES rows. Writes the outbox rows of the scan at the batch's clock."""
    spark = batch.sparkSession
    before = state_tables.clock_before(spark, root, batch_id, CLOCK)
    if before is None:
        sinks.write_batch(seed(sessions), f"{root}/entries", -1)
        old, last = 0, -1
    else:
        old, last = before.clock_us, before.batch_id
    entries = state_tables.state(spark, root, "entries", ENTRY, last)
    changes = batch.filter(_micros("ts") > old).persist()
    try:
        newest = changes.agg(F.max(_micros("ts")).alias("m")).first().m
        clock = old if newest is None else max(old, newest // 1000 * 1000)
        moves = changes.filter(F.col("kind").isin("create", "finish"))
        if not moves.isEmpty():
            entries = with_changes(entries, moves)
        now = F.lit(clock).cast("bigint")
        due = F.coalesce(F.col("last_us") < now - interval_us, F.lit(False))
        to = F.least(now, F.col("end_us"))
        at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
        chunks = entries.filter(due).select(
            *chunk_columns(F.col("id"), (F.col("seq") + 1).alias("sequence"), at(F.col("last_us")), at(to)),
            at(now).alias("__as_of"))
        sinks.write_batch(outbox.to_outbox(chunks, F.col("__as_of")), target, batch_id)
        moved = entries.withColumns({"last_us": F.when(due, to).otherwise(F.col("last_us")),
                                     "seq": F.when(due, F.col("seq") + 1).otherwise(F.col("seq"))})
        sinks.write_batch(moved, f"{root}/entries", batch_id)
        state_tables.write_clock(spark, root, batch_id, CLOCK, clock)
    finally:
        changes.unpersist()


def start_scan_state_stream(changes: DataFrame, sessions: DataFrame, target: str, checkpoint: str,
                            interval: str = S.SCAN_INTERVAL, available_now: bool = True):
    """``changes`` is a stream of CHANGES rows in the order of their times; ``sessions``
    the table at its start. The entries lie beside the checkpoint."""
    us = X.interval_micros(interval)
    return state_tables.foreach_batch(
        changes, lambda df, b: scan_batch(df, b, sessions, target, f"{checkpoint}-state", us), checkpoint, available_now)
