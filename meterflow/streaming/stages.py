"""L6 staged flow: outbox -> publish (J2) -> chunk topic -> billing (J3) ->
processed topic -> analytics (J4), each stage its own streaming query with a
table (file topic) between stages, each with its own checkpoint.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from meterflow import schemas as S
from meterflow.sources import sinks
from meterflow.streaming import analytics as san
from meterflow.streaming import billing as sbill
from meterflow.streaming import publish as spub
from meterflow.streaming import topics


@dataclass
class StageRoots:
    root: str

    @property
    def publish(self):
        return f"{self.root}/publish"

    @property
    def billing(self):
        return f"{self.root}/billing"

    @property
    def analytics(self):
        return f"{self.root}/analytics"


def run_stages(spark: SparkSession, outbox_dir: str, roots: StageRoots, clock=None,
               publisher_ledger: DataFrame | None = None, billing_ledger: DataFrame | None = None,
               files_per_trigger: int = 2, downstream_files_per_trigger: int | None = None,
               partitions: int = sinks.TOPIC_PARTITIONS, kafka_servers: str | None = None) -> None:
    """Drain every stage once (``availableNow``), upstream first. Downstream
    stages take ``downstream_files_per_trigger`` topic files (Kafka: offsets) per
    micro-batch, the bounds of ``topics`` when None. With ``kafka_servers`` both
    topics are Kafka's."""
    src = spark.readStream.schema(S.OUTBOX_EVENTS).option("maxFilesPerTrigger", files_per_trigger) \
        .parquet(outbox_dir)
    spub.start_publish_stream(src, roots.publish, f"{roots.publish}/_chk", clock,
                              publisher_ledger, partitions=partitions,
                              kafka_servers=kafka_servers).awaitTermination()

    chunk_topic = f"{roots.publish}/topic_usage_billing_chunks"
    chunks = topics.read_chunks_stream(spark, chunk_topic, kafka_servers, max_per_trigger=downstream_files_per_trigger)
    sbill.start_billing_stream(chunks, sbill.BillingPaths(roots.billing), f"{roots.billing}/_chk", clock,
                               seed_ledger=billing_ledger, kafka_servers=kafka_servers).awaitTermination()

    processed_topic = sbill.BillingPaths(roots.billing).processed_topic
    processed = topics.read_processed_stream(spark, processed_topic, kafka_servers, max_per_trigger=downstream_files_per_trigger,
                                             starting="earliest")
    san.start_analytics_stream(processed, roots.analytics, f"{roots.analytics}/_chk").awaitTermination()
