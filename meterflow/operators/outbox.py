"""Outbox operators: rows, filters, validation, publish split, leases, samples, merges.

IDs: A2, B6, B7, C5, C6, C7, D2, E3, E6, F6, F9, G3, G6, I3, I4, I5, I5b, J7 (batch part).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow import schemas as S
from meterflow.functions import codec
from meterflow.functions import expressions as X
from meterflow.operators.common import first_by_order

OUTBOX_COLUMNS = S.OUTBOX_EVENTS.fieldNames()


def read_outbox(source, spark=None) -> DataFrame:
    """A2: projected scan of the ten outbox columns."""
    if isinstance(source, str):
        source = spark.read.schema(S.OUTBOX_EVENTS).parquet(source)
    return source.select(*OUTBOX_COLUMNS)


def to_outbox(chunks: DataFrame, as_of) -> DataFrame:
    """Chunk -> outbox row: type ``billing_chunk_created``, JSON payload,
    unpublished, retry 0; surrogate id is a stable hash of the event id."""
    now = X.as_ts(as_of)
    return chunks.select(
        X.stable_id(F.col("event_id")).alias("id"), "event_id",
        F.lit(S.EVENT_TYPE_CHUNK).alias("event_type"), "session_id", "sequence",
        codec.encode_chunks().alias("payload"),
        now.alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("published_at"),
        F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("last_error"))


def append_outbox(outbox: DataFrame, new_rows: DataFrame):
    """Insert rows whose ``event_id`` is not there yet (UNIQUE event_id).

    Returns ``(outbox', inserted)``; of in-batch duplicates the least row (by id,
    then the other columns) stays, whatever the input order."""
    fresh = first_by_order(new_rows.select(*OUTBOX_COLUMNS), ["event_id"], ["id"])
    inserted = fresh.join(outbox.select("event_id"), "event_id", "left_anti")
    return outbox.select(*OUTBOX_COLUMNS).unionByName(inserted.select(*OUTBOX_COLUMNS)), inserted


def unpublished_events(outbox: DataFrame, event_type: str = S.EVENT_TYPE_CHUNK) -> DataFrame:
    """C5."""
    return outbox.filter(F.col("published_at").isNull() & (F.col("event_type") == event_type))


def published_events(outbox: DataFrame, event_type: str = S.EVENT_TYPE_CHUNK) -> DataFrame:
    """C6."""
    return outbox.filter(F.col("published_at").isNotNull() & (F.col("event_type") == event_type))


def reject_reason():
    """C7 rule as a column: ids non-empty first, then ``to > from`` strictly.
    A missing (null) id or time rejects like an empty one."""
    def empty(c):
        return F.coalesce(F.col(c), F.lit("")) == ""
    bad_ids = empty("event_id") | empty("session_id") | empty("sandbox_id")
    good_range = F.coalesce(F.col("to_ts") > F.col("from_ts"), F.lit(False))
    return (F.when(bad_ids, F.lit("required_fields"))
             .when(~good_range, F.lit("time_range")))


def validate_chunks(chunks: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` (null = valid)."""
    return chunks.withColumn("reject_reason", reject_reason())


def valid_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.filter(reject_reason().isNull())


def invalid_chunks(chunks: DataFrame) -> DataFrame:
    return validate_chunks(chunks).filter(F.col("reject_reason").isNotNull())


def outbox_by_id(keys: DataFrame, outbox: DataFrame, key_col: str = "id") -> DataFrame:
    """Fetch by surrogate id; unknown ids come back with ``found = false``."""
    k = keys.select(F.col(key_col).cast("bigint").alias("id")).distinct()
    o = outbox.select(*[c for c in OUTBOX_COLUMNS if c in outbox.columns]).withColumn("__hit", F.lit(True))
    j = k.join(o, "id", "left")
    return j.select(*[c for c in o.columns if c != "__hit"],
                    F.coalesce(F.col("__hit"), F.lit(False)).alias("found"))


def publish_split(leased: DataFrame, ledger: DataFrame) -> DataFrame:
    """Classify each leased outbox row.

    ``already``     -- event id in the publisher ledger: only mark it published;
    ``undecodable`` -- payload does not decode: left unpublished (not a failure);
    ``invalid``     -- decoded but fails C7: left unpublished, counted as failure;
    ``repeat``      -- good, but the least id among the good rows of this event id
                       in the lease is published: a later cycle finds the event in
                       the ledger. A broken row never stands in a good one's way;
    ``publish``     -- publish, write the ledger row, mark published.
    One left join to the ledger's keys and one to the lease's own least good ids
    (keys only); decoded chunk columns are carried for the publish branch. Rows are
    decoded after the shuffle by event id, which moves the payload alone.
    """
    seen = ledger.select(F.col("event_id").alias("__key")).distinct().withColumn("__seen", F.lit(True))
    rows = (leased.withColumnRenamed("event_id", "outbox_event_id")
            .withColumnRenamed("session_id", "outbox_session_id")
            .withColumnRenamed("sequence", "outbox_sequence"))
    dec = codec.decode_chunks(rows.join(seen, F.col("outbox_event_id") == F.col("__key"), "left"), "payload")
    good = F.col("decode_error").isNull() & reject_reason().isNull()
    firsts = (dec.filter(good).groupBy(F.col("outbox_event_id").alias("__event"))
              .agg(F.min("id").alias("__first")))
    dec = dec.join(firsts, F.col("outbox_event_id") == F.col("__event"), "left")
    repeat = F.col("id") > F.col("__first")
    outcome = (F.when(F.col("__seen").isNotNull(), F.lit("already"))
                .when(F.col("decode_error").isNotNull(), F.lit("undecodable"))
                .when(reject_reason().isNotNull(), F.lit("invalid"))
                .when(repeat, F.lit("repeat"))
                .otherwise(F.lit("publish")))
    detail = (F.when(F.col("__seen").isNotNull(), F.lit(None))
               .when(F.col("decode_error").isNotNull(), F.col("decode_error"))
               .otherwise(reject_reason()))
    return dec.withColumn("outcome", outcome).withColumn("detail", detail).drop("__seen", "__first", "__key", "__event")


def publish_summary(split: DataFrame) -> DataFrame:
    """counts per outcome of one publish cycle (``already`` and ``publish``
    are successes, ``invalid`` is a failure, ``undecodable`` is skipped)."""
    return split.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def lease_batch(outbox: DataFrame, n: int = S.PUBLISH_BATCH,
                event_type: str = S.EVENT_TYPE_CHUNK) -> DataFrame:
    """Oldest unpublished events first (ties by id), top n. The exclusive
    row lease itself is a scheduler concern: Spark tasks own disjoint splits."""
    return unpublished_events(outbox, event_type).orderBy("created_at", "id").limit(n)


def sample_published(outbox: DataFrame, n: int = S.REPLAY_BATCH, seed: str = S.SAMPLE_SEED,
                     event_type: str = S.EVENT_TYPE_CHUNK) -> DataFrame:
    """Reproducible random sample of published events (md5 order)."""
    return (published_events(outbox, event_type)
            .withColumn("__k", X.sample_key("event_id", seed))
            .orderBy("__k", "event_id").limit(n).drop("__k"))


def _merge_by_id(outbox: DataFrame, updates: DataFrame, assign: dict) -> DataFrame:
    """Keyed update: ``updates`` (id + value columns) left-joined on id; columns
    in ``assign`` take the new expression where a key matched."""
    j = outbox.select(*OUTBOX_COLUMNS).join(updates.withColumn("__hit", F.lit(True)), "id", "left")
    hit = F.col("__hit").isNotNull()
    return j.select(*[F.when(hit, assign[c]).otherwise(F.col(c)).alias(c) if c in assign else F.col(c)
                      for c in OUTBOX_COLUMNS])


def mark_published(outbox: DataFrame, ids: DataFrame, as_of):
    """Set ``published_at`` for a set of ids.

    Returns ``(outbox', check)``; ``check`` has requested and matched counts
    (the reference treats a difference as an error)."""
    now = X.as_ts(as_of)
    keys = ids.select(F.col("id").cast("bigint").alias("id")).distinct()
    new = _merge_by_id(outbox, keys, {"published_at": now})
    hits = keys.join(outbox.select("id").withColumn("__m", F.lit(1)), "id", "left")
    check = hits.agg(F.count(F.lit(1)).alias("requested"),
                     F.count("__m").alias("matched"))
    return new, check


def reset_published(outbox: DataFrame, n: int = S.REPLAY_BATCH, seed: str = S.SAMPLE_SEED):
    """I4: set ``published_at = null`` for a reproducible sample of published
    events. Returns ``(outbox', reset_ids)``."""
    sample = sample_published(outbox, n, seed).select("id")
    return _merge_by_id(outbox, sample, {"published_at": F.lit(None).cast("timestamp_ntz")}), sample


def update_where_in(outbox: DataFrame, key_source: DataFrame, key: str, assign: dict) -> DataFrame:
    """Keys chosen by a sub-select drive an update (``WHERE key IN (...)``)."""
    keys = key_source.select(key).distinct()
    if key == "id":
        return _merge_by_id(outbox, keys, assign)
    ids = outbox.join(keys, key, "left_semi").select("id")
    return _merge_by_id(outbox, ids, assign)


def record_failure(outbox: DataFrame, failures: DataFrame):
    """``retry_count + 1`` and ``last_error`` for failed ids.

    ``failures`` has id and error; of several errors of one id the least counts.
    Returns ``(outbox', not_found_ids)``."""
    f = failures.groupBy(F.col("id").cast("bigint").alias("id")).agg(F.min("error").alias("__err"))
    new = _merge_by_id(outbox, f, {"retry_count": F.col("retry_count") + 1,
                                   "last_error": F.col("__err")})
    missing = f.join(outbox.select("id"), "id", "left_anti").select("id")
    return new, missing


def split_by_retry(outbox: DataFrame, max_retries: int):
    """``(retryable, dead_letter)``: unpublished events below / at-or-over
    the retry limit."""
    pending = outbox.filter(F.col("published_at").isNull())
    return (pending.filter(F.col("retry_count") < max_retries),
            pending.filter(F.col("retry_count") >= max_retries))


def replay_published(outbox: DataFrame, n: int = S.REPLAY_BATCH, seed: str = S.SAMPLE_SEED) -> DataFrame:
    """J7 (batch part): re-send a sample of published events past the dedupe
    gate, no state change: G6 -> B8 -> C7 -> wire rows ready for A6."""
    sample = sample_published(outbox, n, seed)
    dec = codec.decode_chunks(sample.select(F.col("payload").alias("value")), "value")
    good = dec.filter(F.col("decode_error").isNull())
    return codec.to_wire(valid_chunks(good))


def replay_summary(replayed: DataFrame) -> DataFrame:
    """F9."""
    return replayed.agg(F.count(F.lit(1)).alias("replayed"))
