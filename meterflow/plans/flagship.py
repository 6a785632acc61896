"""Flagship plan: chunk topic -> strict decode -> dedupe -> billing payloads.

Touches B8 (decode), E4 (first delivery per event id, ledger anti join), E5
(transaction id) and B10 (payload). One shuffle for the in-batch dedupe (with a
map-side partial aggregate), one for the ledger join (or none when the ledger
side is broadcastable by size), everything else is codegen'd projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.functions import codec
from meterflow.operators import billing, ledger
from meterflow.operators.chunks import CHUNK_COLUMNS
from meterflow.sources.fixtures import Fixtures

FLAGSHIP_SQL_BODY = """
SELECT concat(session_id, ':', CAST(sequence AS VARCHAR)) AS transaction_id, organization_id AS customer_id,
       'usage_billing_chunk' AS event_type, to_ts AS timestamp,
       cpu AS p_cpu, disk_gb AS p_disk_gb, date_diff('microsecond', from_ts, to_ts) / 3.6e9 AS p_duration_hours,
       strftime(from_ts, '%Y-%m-%dT%H:%M:%SZ') AS p_from, gpu AS p_gpu, ram_gb AS p_ram_gb, region AS p_region,
       sandbox_class AS p_sandbox_class, sandbox_id AS p_sandbox_id, sequence AS p_sequence,
       session_id AS p_session_id, strftime(to_ts, '%Y-%m-%dT%H:%M:%SZ') AS p_to
FROM chunk_deliveries c
WHERE delivery_no = 1
  AND NOT EXISTS (SELECT 1 FROM processed_billing_events p WHERE p.event_id = c.event_id)
  AND NOT EXISTS (SELECT 1 FROM processed_billing_events p
                  WHERE p.transaction_id = concat(c.session_id, ':', CAST(c.sequence AS VARCHAR)))"""


def billing_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixtures(spark, sf_dir)
    topic = f.chunk_deliveries.select(codec.encode_chunks().alias("value"), "delivery_no")
    decoded = codec.decode_chunks(topic, "value").filter(F.col("decode_error").isNull())
    chunks = decoded.select(*CHUNK_COLUMNS, "delivery_no")
    led = f.processed_billing_events
    fresh = ledger.dedupe_by_event_id(chunks, led, ["delivery_no"])
    once = ledger.dedupe_by_transaction_id(fresh, led, ["delivery_no"])
    return billing.flatten_payload(billing.billing_payload(once))
