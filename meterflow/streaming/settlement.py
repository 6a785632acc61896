"""The flow ingest -> enrich -> charge -> settle, four streaming queries with a
table between each two, each with its own checkpoint.

* ingest: decode (B8), validate (C7), first delivery of each event id across all
  batches (E4 against the table itself); the rest goes to a reject table.
* enrich: stream-to-static temporal join; a chunk takes the session's attributes in
  the version valid at its end. A chunk whose session has no version then keeps nulls.
* charge: price of a chunk in integer micro units, so sums are exact in any order.
* settle: event-time window aggregate per customer; a window is written once, when the
  watermark (``delay`` behind the latest end) has passed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.functions import codec
from meterflow.operators import ledger, outbox
from meterflow.operators.chunks import CHUNK_COLUMNS
from meterflow.session import read_parquet_or_empty
from meterflow.sources import sinks

# Price of an hour of each resource, in micro units.
PRICES = {"cpu": 50_000, "gpu": 900_000, "ram_gb": 5_000, "disk_gb": 200}
INGESTED = ("event_id string, session_id string, sandbox_id string, organization_id string, sequence bigint, "
            "from_ts timestamp_ntz, to_ts timestamp_ntz, event_bucket int")
ENRICHED = (INGESTED.replace(", event_bucket int", "")
            + ", plan_cpu double, plan_gpu double, plan_ram_gb double, plan_disk_gb double, plan_region string, version int")
CHARGED = "event_id string, organization_id string, to_ts timestamp_ntz, charge_micros bigint"
# The customer of a chunk that only closes windows: it is sent last, dated after all.
CLOSING = "__closing__"


def ingest_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """``batch``: topic rows (value, seq)."""
    dec = outbox.validate_chunks(codec.decode_chunks(batch, "value"))
    reason = F.coalesce("decode_error", "reject_reason")
    # kept: the decoded columns, and the message of a row that is refused
    dec = dec.select(*CHUNK_COLUMNS, "seq", F.when(reason.isNotNull(), F.col("value").cast("string")).alias("value"),
                     reason.alias("reason")).persist()
    try:
        ok = F.col("reason").isNull()
        bad = dec.filter(~ok).select("value", "reason")
        sinks.write_batch(bad, f"{root}/ingest_rejects", batch_id)
        good = dec.filter(ok).select(*CHUNK_COLUMNS, "seq")
        seen = read_parquet_or_empty(batch.sparkSession, f"{root}/ingested", f"{INGESTED}, batch_id bigint")
        seen = ledger.bucket_pruned(seen.filter(F.col("batch_id") != batch_id), good, "event_id", "event_bucket")
        fresh = ledger.dedupe_by_event_id(good, seen.select("event_id"), ["seq"])
        rows = fresh.withColumn("event_bucket", ledger.key_bucket("event_id"))
        sinks.write_batch(rows.select(*[c.split()[0] for c in INGESTED.split(", ")])
                          .sortWithinPartitions("event_bucket", "event_id"), f"{root}/ingested", batch_id)
    finally:
        dec.unpersist()


def enrich(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """chunks with the attributes (plan_*) of the session version valid at ``to_ts``.

    ``versions``: session_id, version, valid_from, valid_to (null: still valid) and the
    attributes; a session's versions do not overlap, so a chunk stays one row."""
    v = versions.select(F.col("session_id").alias("__s"), "version", "valid_from", "valid_to",
                        *[F.col(c).alias(f"plan_{c}") for c in (*PRICES, "region")])
    valid = (F.col("to_ts") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("to_ts") < F.col("valid_to")))
    return chunks.join(v, (F.col("session_id") == F.col("__s")) & valid, "left").drop("__s", "valid_from", "valid_to")


def charge(enriched: DataFrame) -> DataFrame:
    """(event_id, organization_id, to_ts, charge_micros): hours times prices, rounded
    to whole micro units per chunk."""
    hours = F.timestamp_diff("MICROSECOND", "from_ts", "to_ts") / 3.6e9
    rate = sum(F.coalesce(f"plan_{c}", F.lit(0.0)) * p for c, p in PRICES.items())
    return enriched.select("event_id", "organization_id", "to_ts", F.round(hours * rate).cast("bigint").alias("charge_micros"))


def settle(charges: DataFrame, window: str, delay: str) -> DataFrame:
    """(organization_id, window_start, window_end, chunks, charge_micros) per closed window.
    No filter on the customer here: it would be pushed below the watermark, which a
    closing chunk has to move; that chunk's own window never closes."""
    timed = charges.withColumn("__ts", F.col("to_ts").cast("timestamp")).withWatermark("__ts", delay)
    return (timed.groupBy(F.window("__ts", window).alias("w"), "organization_id")
            .agg(F.count("*").alias("chunks"), F.sum("charge_micros").alias("charge_micros"))
            .select("organization_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "chunks", "charge_micros"))


def _sink(df: DataFrame, path: str, checkpoint: str, available_now: bool):
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def run_flow(topic: DataFrame, versions: DataFrame, root: str, window: str = "1 day", delay: str = "7 days",
             max_files: int = 1000, available_now: bool = True) -> list:
    """Start the four stages over ``root``. With ``available_now`` each runs to the end
    of what the one before has written; otherwise all run on. Returns the queries."""
    spark = topic.sparkSession

    def table(name: str, schema: str) -> DataFrame:
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{root}/{name}")

    def start(name: str):
        if name == "ingest":
            w = topic.writeStream.foreachBatch(lambda df, b: ingest_batch(df, b, root)).option(
                "checkpointLocation", f"{root}/_checkpoints/ingest")
            return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
        if name == "enrich":
            out = enrich(table("ingested", INGESTED).drop("event_bucket"), versions)
            return _sink(out.select(*[c.split()[0] for c in ENRICHED.split(", ")]), f"{root}/enriched",
                         f"{root}/_checkpoints/enrich", available_now)
        if name == "charge":
            return _sink(charge(table("enriched", ENRICHED)), f"{root}/charges", f"{root}/_checkpoints/charge", available_now)
        return _sink(settle(table("charges", CHARGED), window, delay), f"{root}/settled", f"{root}/_checkpoints/settle",
                     available_now)

    stages = []
    for name in ("ingest", "enrich", "charge", "settle"):
        q = start(name)
        stages.append(q)
        if available_now:
            q.awaitTermination()
    return stages
