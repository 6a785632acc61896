"""Processed-event ledgers and dedupe (exactly-once effect over at-least-once input).

IDs: A3, B12, B13, C8, D3, D4, E1, E2, E4, E5, F3, F4, G4, I6.

Ledger join at scale: the ledger grows without bound while a batch is bounded.
``ledger_hits`` looks up only the batch's own keys: with a known small batch the
distinct batch keys are broadcast into a semi join over the ledger (no ledger
shuffle); otherwise Spark plans a shuffled join and AQE re-plans at runtime.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow import schemas as S
from meterflow.functions import expressions as X
from meterflow.operators.common import first_by_order

# Distinct keys of a batch up to this many rows are broadcast (about 64 bytes
# per event id, so ~64 MB at the limit).
BROADCAST_KEYS_MAX_ROWS = 1_000_000

LEDGER_KINDS = {
    "billing": S.PROCESSED_BILLING_EVENTS,
    "outbox": S.PROCESSED_OUTBOX_EVENTS,
}


def read_ledger(source, kind: str = "billing", spark=None, exclude_batch: int | None = None) -> DataFrame:
    """A3: scan of either ledger. When the ledger is a ``batch_id``-partitioned
    table, ``exclude_batch`` hides the rows a retried batch wrote itself."""
    if isinstance(source, str):
        source = spark.read.parquet(source)
    if exclude_batch is not None and "batch_id" in source.columns:
        source = source.filter(F.col("batch_id") != exclude_batch)
    cols = [c for c in LEDGER_KINDS[kind].fieldNames() if c in source.columns]
    return source.select(*cols)


def ledger_rows(events: DataFrame, as_of, kind: str = "billing") -> DataFrame:
    """Processed events -> ledger rows (surrogate id from the event id).

    ``event_bucket`` (and for billing rows ``transaction_bucket``) is kept too, so
    that lookups can be limited to the buckets of a batch's keys
    (``bucket_pruned``)."""
    now = X.as_ts(as_of)
    cols = [X.stable_id(F.col("event_id")).alias("id"), "event_id", "session_id", "sequence"]
    if kind == "billing":
        cols.append(X.transaction_id().alias("transaction_id") if "transaction_id" not in events.columns
                    else F.col("transaction_id"))
    cols.append(now.alias("processed_at"))
    cols.append(key_bucket("event_id").alias("event_bucket"))
    out = events.select(*cols)
    if kind == "billing":
        out = out.withColumn("transaction_bucket", key_bucket("transaction_id"))
    return out


# Key buckets of the stored ledger, vendor and export rows. A bucket is a function
# of the key alone, so pruning by it can never hide a duplicate.
KEY_BUCKETS = 256


def key_bucket(key) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def batch_buckets(keys: DataFrame, key: str) -> list[int]:
    """The buckets of a (bounded) batch's keys; at most ``KEY_BUCKETS`` numbers reach
    the driver."""
    found = keys.select(key_bucket(key).alias("b")).distinct().collect()
    return sorted(r.b for r in found if r.b is not None)


# A batch of up to this many keys looks them up by value.
FEW_KEYS = 1_000


def few_keys(keys: DataFrame, key: str, about: int | None = None) -> list[str] | None:
    """The distinct keys of a batch that has at most ``FEW_KEYS``, else None; no more
    than one key over that reaches the driver. A sketch tells large batches (``about``: its
    count when it is known), so that their keys are not shuffled to be counted."""
    about = keys.agg(F.approx_count_distinct(key)).first()[0] if about is None else about
    if about > 2 * FEW_KEYS:
        return None
    found = keys.select(key).filter(F.col(key).isNotNull()).distinct().limit(FEW_KEYS + 1).collect()
    return sorted(r[0] for r in found) if len(found) <= FEW_KEYS else None


def key_spread(keys: DataFrame, key: str) -> tuple[list | None, list[int] | None]:
    """``few_keys`` and, for a batch of more keys, ``batch_buckets``, from one pass over it."""
    seen = keys.agg(F.approx_count_distinct(key).alias("n"), F.collect_set(key_bucket(key)).alias("b")).first()
    few = few_keys(keys, key, seen.n)
    return few, None if few is not None else sorted(seen.b)


def bucket_pruned(table: DataFrame, keys: DataFrame, key: str, bucket_col: str,
                  buckets: list[int] | None = None, few: list[str] | None = None) -> DataFrame:
    """Only the rows of ``table`` that can match the (bounded) batch.

    ``few`` (``few_keys``): the rows with these keys; the pushed predicate skips row
    groups by the Bloom filter of the key column, even when every bucket is touched.
    Otherwise the rows whose bucket some key of the batch has, plus rows stored without
    a bucket; ``buckets`` when they are known already. Files are written sorted by
    the bucket, so that row groups are skipped when a batch has few buckets; a batch
    that has every bucket reads all."""
    if few is not None:
        return table.filter(F.col(key).isin(few)) if few else table.filter(F.lit(False))
    if bucket_col not in table.columns:
        return table
    found = batch_buckets(keys, key) if buckets is None else buckets
    if len(found) >= KEY_BUCKETS:
        return table
    return table.filter(F.col(bucket_col).isin(found) | F.col(bucket_col).isNull())


def may_broadcast(keys: DataFrame, batch_rows_bound: int | None) -> bool:
    """True when the claimed bound is small enough and the keys keep to it
    (counted up to one more than the limit)."""
    if batch_rows_bound is None or batch_rows_bound > BROADCAST_KEYS_MAX_ROWS:
        return False
    return keys.limit(BROADCAST_KEYS_MAX_ROWS + 1).count() <= BROADCAST_KEYS_MAX_ROWS


def ledger_hits(keys: DataFrame, ledger: DataFrame, key: str = "event_id",
                batch_rows_bound: int | None = None) -> DataFrame:
    """Ledger keys that occur in ``keys``.

    ``batch_rows_bound`` is the caller's upper bound of the batch size. Below the
    limit it is checked against the keys at hand, and only a set that holds is
    broadcast; otherwise a shuffled semi join is planned.
    """
    k = keys.select(key).distinct()
    if may_broadcast(k, batch_rows_bound):
        k = F.broadcast(k)
    return ledger.select(key).join(k, key, "left_semi").distinct()


def already_processed(df: DataFrame, ledger: DataFrame, key: str = "event_id") -> DataFrame:
    """EXISTS in the ledger."""
    return df.join(ledger.select(key), key, "left_semi")


def not_yet_processed(df: DataFrame, ledger: DataFrame, key: str = "event_id") -> DataFrame:
    """NOT EXISTS in the ledger (true = still to do)."""
    return df.join(ledger.select(key), key, "left_anti")


def dedupe(deliveries: DataFrame, ledger: DataFrame | None, key: str, order_cols: list[str],
           batch_rows_bound: int | None = None) -> DataFrame:
    """E4/E5 core: first delivery per key wins, inside the batch (smallest
    ``order_cols``, by partial aggregation) and across batches (anti join with
    the ledger).

    Without a proven batch bound the anti join is planned directly: the batch
    side is already hash-partitioned on ``key`` by the aggregation, so only the
    ledger's key column is shuffled. With a small proven bound the batch keys
    are broadcast to pick the ledger hits first (no ledger shuffle at all).
    """
    first = first_by_order(deliveries, [key], order_cols)
    if ledger is None:
        return first
    if batch_rows_bound is not None and batch_rows_bound <= BROADCAST_KEYS_MAX_ROWS:
        return first.join(ledger_hits(first, ledger, key, batch_rows_bound), key, "left_anti")
    return first.join(ledger.select(key), key, "left_anti")


def dedupe_by_event_id(deliveries: DataFrame, ledger: DataFrame | None,
                       order_cols: list[str], batch_rows_bound: int | None = None) -> DataFrame:
    """E4."""
    return dedupe(deliveries, ledger, "event_id", order_cols, batch_rows_bound)


def dedupe_by_transaction_id(deliveries: DataFrame, ledger: DataFrame | None,
                             order_cols: list[str], batch_rows_bound: int | None = None) -> DataFrame:
    """E5: the same ``session_id:sequence`` reaches the vendor once."""
    d = deliveries if "transaction_id" in deliveries.columns else \
        deliveries.withColumn("transaction_id", X.transaction_id())
    return dedupe(d, ledger, "transaction_id", order_cols, batch_rows_bound)


def clashes(rows: DataFrame, ledger: DataFrame, key: str, batch_rows_bound: int | None = None) -> DataFrame:
    """The keys (``__clash``) that ``rows`` hold more than once or the ledger has; only
    keys are shuffled. Rows with any other key are first deliveries as they stand."""
    counts = rows.groupBy(F.col(key).alias("__clash")).agg(F.count(F.lit(1)).alias("__n"))
    k = counts.select("__clash")
    # the batch's keys are the hash table; the ledger is not sorted
    k = F.broadcast(k) if may_broadcast(k, batch_rows_bound) else k.hint("shuffle_hash")
    seen = ledger.select(F.col(key).alias("__key")).join(k, F.col("__key") == F.col("__clash"), "left_semi")
    return counts.filter("__n > 1").select("__clash").unionByName(seen.select(F.col("__key").alias("__clash"))).distinct()


def save_bucketed(rows: DataFrame, table: str, path: str, key: str = "event_id",
                  buckets: int = KEY_BUCKETS) -> DataFrame:
    """A ledger of its own table, bucketed and sorted by ``key``: with as many shuffle
    partitions as buckets, E1, E2, E4 and E5 join it without shuffling it (only the
    batch moves). Rows are dealt by the bucket first, one file a bucket."""
    (rows.repartition(buckets, key).write.format("parquet").mode("overwrite")
     .bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table))
    return rows.sparkSession.table(table)


def append_ledger(ledger: DataFrame, rows: DataFrame, kind: str = "billing"):
    """Insert ledger rows; an existing ``event_id`` means "already done",
    not an error; of rows with one event id the least (by ``processed_at``, then the
    other columns) stays. Returns ``(ledger', inserted, already)``."""
    cols = [c for c in LEDGER_KINDS[kind].fieldNames() if c in rows.columns]
    fresh = first_by_order(rows.select(*cols), ["event_id"], ["processed_at"])
    hit = ledger.select("event_id").withColumn("__seen", F.lit(True))
    j = fresh.join(hit, "event_id", "left")
    inserted = j.filter(F.col("__seen").isNull()).select(*cols)
    already = j.filter(F.col("__seen").isNotNull()).select(*cols)
    base_cols = [c for c in cols if c in ledger.columns]
    return ledger.select(*base_cols).unionByName(inserted.select(*base_cols)), inserted, already


def processed_in_range(ledger: DataFrame, start, end) -> DataFrame:
    """``start <= processed_at <= end``, both ends inclusive."""
    return ledger.filter(F.col("processed_at").between(X.as_ts(start), X.as_ts(end)))


def latest_processed(ledger: DataFrame, start, end, n: int) -> DataFrame:
    """C8, newest first (ties by event id), top n."""
    return processed_in_range(ledger, start, end).orderBy(F.col("processed_at").desc(), "event_id").limit(n)


def _lookup(keys: DataFrame, ledger: DataFrame, key: str, key_col: str) -> DataFrame:
    k = keys.select(F.col(key_col).alias(key)).distinct()
    j = k.join(ledger.withColumn("__hit", F.lit(True)), key, "left")
    return j.select(*ledger.columns, F.coalesce(F.col("__hit"), F.lit(False)).alias("found"))


def ledger_by_event_id(keys: DataFrame, ledger: DataFrame, key_col: str = "event_id") -> DataFrame:
    """D3: fetch by event id; unknown keys come back with ``found = false``."""
    return _lookup(keys, ledger, "event_id", key_col)


def ledger_by_id(keys: DataFrame, ledger: DataFrame, key_col: str = "id") -> DataFrame:
    """Fetch by surrogate id."""
    return _lookup(keys, ledger, "id", key_col)


def count_ledger(ledger: DataFrame) -> DataFrame:
    """F3/F4."""
    return ledger.agg(F.count(F.lit(1)).alias("n"))


def delete_by_id(ledger: DataFrame, ids: DataFrame, key: str = "id"):
    """Remove ledger rows by id. Returns ``(ledger', not_found_ids)``."""
    k = ids.select(key).distinct()
    return ledger.join(k, key, "left_anti"), k.join(ledger.select(key), key, "left_anti")
