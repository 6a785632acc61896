"""J4 analytics stream: decode (bad rows to rejects) -> dedupe by event id -> A10.

Two dedupe modes:
* ``ledger`` (default) -- exact, unbounded horizon: the exported table itself
  is the ledger (anti join, own ``batch_id`` excluded so a retry is harmless);
* ``watermark`` -- ``dropDuplicatesWithinWatermark('event_id')`` over
  ``processed_at``: bounded state, exact only while duplicates arrive within the
  watermark delay. Opt-in and named as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.functions import codec
from meterflow.operators import analytics, ledger
from meterflow.sources import sinks
from meterflow.streaming import compaction


EXPORT_SCHEMA = "event_id string, export_date date, event_bucket int, batch_id bigint"


def analytics_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    spark = batch.sparkSession
    dec = codec.decode_processed(batch, "value").persist()
    try:
        good, bad = analytics.not_null_event(dec)
        sinks.write_batch(bad.select(F.col("value").cast("string").alias("value"), "decode_error"),
                          f"{root}/analytics_rejects", batch_id)
        stored = compaction.visible(spark, f"{root}/analytics_export", EXPORT_SCHEMA)
        exported = ledger.bucket_pruned(stored.filter(F.col("batch_id") != batch_id), good, "event_id",
                                        "event_bucket", few=ledger.few_keys(good, "event_id"))
        rows = analytics.export_rows(good, exported.select("event_id"), ["seq"])
        sinks.write_analytics(rows.withColumn("event_bucket", ledger.key_bucket("event_id")),
                              f"{root}/analytics_export", batch_id)
    finally:
        dec.unpersist()


def start_analytics_stream(source: DataFrame, root: str, checkpoint: str, available_now: bool = True,
                           compact_every: int | None = None):
    """Start J4. With ``compact_every`` the export, which lookups read, is folded every
    so many batches."""
    def work(df: DataFrame, bid: int) -> None:
        if compaction.due(bid, compact_every):
            compaction.compact_batches(df.sparkSession, f"{root}/analytics_export", bid - 1, EXPORT_SCHEMA,
                                       ("export_date",), ("event_id",))
        analytics_batch(df, bid, root)

    w = (source.writeStream.foreachBatch(work)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="500 milliseconds")
    return w.start()


def start_analytics_stream_watermarked(source: DataFrame, root: str, checkpoint: str, delay: str = "1 hour",
                                       available_now: bool = True):
    """Bounded-state variant: duplicates later than ``delay`` are not caught."""
    dec = codec.decode_processed(source, "value")
    good, _ = analytics.not_null_event(dec)
    ev = (good.withColumn("event_time", F.col("processed_at").cast(T.TimestampType()))
              .withWatermark("event_time", delay)
              .dropDuplicatesWithinWatermark(["event_id"])
              .select(*analytics.EXPORT_COLUMNS, F.to_date("processed_at").alias("export_date")))
    w = (ev.writeStream.format("parquet").option("path", f"{root}/analytics_export_wm")
         .option("checkpointLocation", checkpoint).partitionBy("export_date").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="500 milliseconds")
    return w.start()


def exported(spark, root: str) -> DataFrame:
    t = compaction.visible(spark, f"{root}/analytics_export", EXPORT_SCHEMA)
    return t.select(*analytics.EXPORT_COLUMNS, "export_date")
