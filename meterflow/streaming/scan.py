"""J1 periodic scan: run C3 against the snapshot store on every trigger.

A ``rate`` source (in-process, one row per tick) drives the trigger; each
micro-batch takes its clock from the tick rows it holds, so a batch re-run after
a failure uses the same clock and, with deterministic event ids, writes the
same versions. ``trigger(processingTime='1 minute')`` is the reference's
cadence; ``availableNow`` is not meaningful for a rate source, so tests stop
the query after the ticks they need.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from meterflow import schemas as S
from meterflow.plans import runs
from meterflow.plans.store import SnapshotStore


def scan_tick(batch, batch_id: int, store: SnapshotStore, interval: str, clock_override=None) -> None:
    if clock_override is not None:
        as_of = clock_override
    else:
        row = batch.agg(F.max(F.col("timestamp").cast("timestamp_ntz")).alias("t")).collect()[0]
        if row.t is None:
            return
        as_of = row.t
    runs.scan_run(store, as_of, interval, run_id=f"scan-batch-{batch_id}")


def start_scan_stream(spark: SparkSession, store: SnapshotStore, checkpoint: str,
                      every: str = "1 minute", interval: str = S.SCAN_INTERVAL, clock_override=None):
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (ticks.writeStream
            .foreachBatch(lambda df, bid: scan_tick(df, bid, store, interval, clock_override))
            .option("checkpointLocation", checkpoint)
            .trigger(processingTime=every)
            .start())
