"""Keyed topic envelopes and idempotent sinks.

IDs: A6, A7, A8, A9 (envelopes + topic writes), A10 (analytics table), A11
(vendor table unique on transaction_id), L5 (sharded layout).

Every sink write of a micro-batch is an overwrite of its own ``batch_id``
partition (dynamic partition overwrite), so a retried batch replaces what it
wrote before instead of adding to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow import schemas as S
from meterflow.functions import codec


def envelope(df: DataFrame, key: Column, value: Column, headers: dict[str, Column] | Column | None = None,
             timestamp: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Kafka-shaped rows: binary key and value, headers as
    ``array<struct<key:string, value:binary>>``. ``headers`` is either a dict of
    header columns or a ``map<string,string>`` column (A8)."""
    if headers is None:
        h = F.lit(None).cast("array<struct<key:string,value:binary>>")
    elif isinstance(headers, dict):
        h = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value"))
                      for k, v in headers.items()])
    else:
        h = F.transform(F.map_entries(headers),
                        lambda e: F.struct(e["key"].alias("key"), e["value"].cast("binary").alias("value")))
    cols = [key.cast("binary").alias("key"), value.cast("binary").alias("value"), h.alias("headers")]
    if timestamp is not None:
        cols.append(timestamp.alias("timestamp"))
    return df.select(*cols, *keep)


def chunk_records(chunks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keyed by sandbox id, JSON chunk value, three headers. A DataFrame
    is already a batch, so the single and batch publish are one operator; an
    empty frame writes nothing."""
    return envelope(chunks, F.col("sandbox_id"), codec.encode_chunks(),
                    {"event_type": F.lit(S.EVENT_TYPE_CHUNK), "event_id": F.col("event_id"),
                     "organization_id": F.col("organization_id")}, keep=keep)


def message_records(df: DataFrame, key_col: str, value_col: str, headers_col: str | None = None) -> DataFrame:
    """Generic keyed message with a header map."""
    return envelope(df, F.col(key_col), F.col(value_col), F.col(headers_col) if headers_col else None)


def processed_struct() -> Column:
    """Wire processed event (``metronome_id`` omitted when empty)."""
    return F.struct(
        "event_id", "session_id", "sequence",
        F.col("processed_at").cast(T.TimestampType()).alias("processed_at"),
        F.nullif(F.col("metronome_id"), F.lit("")).alias("metronome_id"),
        "organization_id")


def processed_records(processed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Processed event keyed by session id."""
    return envelope(processed, F.col("session_id"), codec.encode(processed_struct()), keep=keep)


def header_value(headers: str, name: str) -> Column:
    """Read one header back as a string."""
    return F.element_at(F.filter(F.col(headers), lambda h: h["key"] == name), 1)["value"].cast("string")


# The reference deployment's partition count of a topic.
TOPIC_PARTITIONS = 48


def write_topic(records: DataFrame, target: str, topic: str, kafka_servers: str | None = None,
                batch_id: int | None = None) -> None:
    """Publish records. With ``kafka_servers`` the Kafka sink is used (all
    replicas ack is the producer default there); otherwise ``target`` is a
    folder of Parquet files standing in for the topic, partitioned by batch."""
    if kafka_servers:
        (records.write.format("kafka").option("kafka.bootstrap.servers", kafka_servers)
                .option("topic", topic).option("includeHeaders", "true").save())
        return
    write_batch(records, target, batch_id)


def with_bloom(writer: DataFrameWriter, cols: tuple[str, ...]) -> DataFrameWriter:
    """Bloom filters of ``cols`` in every row group, sized by the values it holds."""
    for c in cols:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return writer.option("parquet.bloom.filter.adaptive.enabled", "true") if cols else writer


def write_batch(df: DataFrame, target: str, batch_id: int | None, partition_cols: tuple[str, ...] = (),
                bloom: tuple[str, ...] = ()) -> None:
    """Idempotent append: overwrite exactly this batch's partition. ``bloom``: columns
    that are looked up by a few values."""
    if batch_id is None:
        w = with_bloom(df.write.mode("append"), bloom)
        if partition_cols:
            w = w.partitionBy(*partition_cols)
        w.parquet(target)
        return
    (with_bloom(df.withColumn("batch_id", F.lit(int(batch_id)).cast("bigint")).write.mode("overwrite"), bloom)
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy("batch_id", *partition_cols).parquet(target))


def write_analytics(rows: DataFrame, target: str, batch_id: int | None) -> None:
    """A10: analytics table (the columnar-store slot; a JDBC sink can take its
    place where a driver is installed).

    One ``batch_id`` partition per micro-batch (idempotent overwrite), rows
    sorted by ``export_date`` inside it so a date filter prunes row groups by
    their min/max statistics. A batch that spans years of event dates (a
    backfill) then writes a few files instead of one folder per day.
    """
    write_batch(rows.sortWithinPartitions("export_date"), target, batch_id, bloom=("event_id",))


def write_vendor(payloads: DataFrame, target: str, batch_id: int | None) -> None:
    """Vendor table; the caller passes only transaction ids never sent
    before (E5), so the table stays unique on ``transaction_id``."""
    write_batch(payloads, target, batch_id, bloom=("transaction_id",))


def write_sharded(df: DataFrame, target: str, salt: int = 8, batch_id: int | None = None) -> None:
    """Output split by tenant bucket, region and date. A write adds to the
    table; with ``batch_id`` it replaces what the same batch wrote before.

    Rows are clustered by the partition columns plus a salt, so one hot tenant
    is written by ``salt`` tasks instead of one, and each task writes few files.
    """
    keys = ("org_bucket", "shard_region", "shard_date")
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salt)))
    write_batch(salted.repartition(*keys, "__salt").drop("__salt"), target, batch_id, keys)
