"""Session operators: read, create, eligibility, lookups, counts, top-k, state merges.

IDs: A1, B1, B2, C1, C2, D1, F1, F2, F8, G1, G2, G5, I1, I2.
All operators take the clock (``as_of``) as a parameter; none reads the wall clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow import schemas as S
from meterflow.functions import expressions as X

SESSION_COLUMNS = S.USAGE_SESSIONS.fieldNames()


_ts = X.as_ts


def read_sessions(source, spark=None) -> DataFrame:
    """A1: projected scan of the sixteen session columns (path or DataFrame)."""
    if isinstance(source, str):
        source = spark.read.schema(S.USAGE_SESSIONS).parquet(source)
    return source.select(*SESSION_COLUMNS)


def create_sessions(requests: DataFrame, as_of, explicit_resources: bool = False) -> DataFrame:
    """B1/B2: session requests -> session rows.

    Missing values take the creation defaults (cpu 2, gpu 0, ram 4, disk 20,
    region us-east-1, class container, status active, start = clock). With
    ``explicit_resources`` (B2) all four resources are given by the caller: a
    missing one is the zero value, never the default, so an explicit 0 is kept.
    Empty region/class still default. ``id`` is taken from the request when
    present, else derived deterministically from the request fields.
    """
    now = _ts(as_of)
    cols = set(requests.columns)

    def opt(name, default=None):
        return F.col(name) if name in cols else F.lit(default)

    start = F.coalesce(opt("start_at").cast("timestamp_ntz"), now)
    if "id" in cols:
        sid = F.col("id")
    else:
        sid = F.sha2(F.concat_ws("|", opt("organization_id"), opt("sandbox_id"),
                                 start.cast("string")), 256)
    res = {}
    defaults = {"cpu": S.DEFAULT_CPU, "gpu": S.DEFAULT_GPU, "ram_gb": S.DEFAULT_RAM_GB,
                "disk_gb": S.DEFAULT_DISK_GB}
    for name, d in defaults.items():
        given = opt(name).cast("double")
        res[name] = F.coalesce(given, F.lit(0.0 if explicit_resources else d))
    return requests.select(
        sid.alias("id"),
        opt("sandbox_id").cast("string").alias("sandbox_id"),
        opt("organization_id").cast("string").alias("organization_id"),
        start.alias("start_at"),
        F.lit(None).cast("timestamp_ntz").alias("end_at"),
        X.default_if_missing(opt("status").cast("string"), S.SESSION_ACTIVE).alias("status"),
        start.alias("last_billed_at"),
        F.lit(S.BILLING_ACTIVE).alias("billing_status"),
        F.lit(0).cast("bigint").alias("billing_sequence"),
        *[res[n].alias(n) for n in ("cpu", "gpu", "ram_gb", "disk_gb")],
        X.default_if_missing(opt("region").cast("string"), S.DEFAULT_REGION).alias("region"),
        X.default_if_missing(opt("sandbox_class").cast("string"), S.DEFAULT_SANDBOX_CLASS)
         .alias("sandbox_class"),
        now.alias("recorded_at"),
    )


def unbilled_sessions(sessions: DataFrame, as_of, interval: str = S.SCAN_INTERVAL) -> DataFrame:
    """Active and ``last_billed_at < as_of - interval`` (strict; a null
    ``last_billed_at`` is never eligible). Pushed to the Parquet scan."""
    cutoff = _ts(as_of) - X.interval_lit(interval)
    return sessions.filter((F.col("status") == S.SESSION_ACTIVE) & (F.col("last_billed_at") < cutoff))


def active_sessions(sessions: DataFrame) -> DataFrame:
    """``status = SESSION_ACTIVE``."""
    return sessions.filter(F.col("status") == S.SESSION_ACTIVE)


def count_unbilled(sessions: DataFrame, as_of, interval: str = S.SCAN_INTERVAL) -> DataFrame:
    """F1."""
    return unbilled_sessions(sessions, as_of, interval).agg(F.count(F.lit(1)).alias("n"))


def count_active(sessions: DataFrame) -> DataFrame:
    """F2."""
    return active_sessions(sessions).agg(F.count(F.lit(1)).alias("n"))


def oldest_unbilled(sessions: DataFrame, as_of, n: int, interval: str = S.SCAN_INTERVAL) -> DataFrame:
    """G1: eligible sessions, oldest ``last_billed_at`` first (ties by id), top n."""
    return unbilled_sessions(sessions, as_of, interval).orderBy("last_billed_at", "id").limit(n)


def oldest_active(sessions: DataFrame, n: int = S.FINISH_BATCH) -> DataFrame:
    """Ids of active sessions, oldest ``start_at`` first (ties by id), top n."""
    return active_sessions(sessions).select("id", "start_at").orderBy("start_at", "id").limit(n).select("id")


def sessions_after_cursor(sessions: DataFrame, as_of, cursor: str = "", n: int = S.SCAN_PAGE,
                          interval: str = S.SCAN_INTERVAL) -> DataFrame:
    """Keyset page of eligible sessions, ``id > cursor`` in binary string
    order (all when the cursor is empty), ordered by id, top n."""
    df = unbilled_sessions(sessions, as_of, interval)
    if cursor:
        df = df.filter(F.col("id") > F.lit(cursor))
    return df.orderBy("id").limit(n)


def sessions_by_id(keys: DataFrame, sessions: DataFrame, key_col: str = "id") -> DataFrame:
    """Fetch sessions for a set of ids; unknown ids come back with
    ``found = false`` instead of failing the whole set."""
    k = keys.select(F.col(key_col).alias("id")).distinct()
    s = sessions.select(*SESSION_COLUMNS).withColumn("__hit", F.lit(True))
    j = k.join(s, "id", "left")
    return j.select(*SESSION_COLUMNS, F.coalesce(F.col("__hit"), F.lit(False)).alias("found"))


def advance_sessions(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """After chunks are emitted set ``last_billed_at = to`` and
    ``billing_sequence = sequence`` of the session's last chunk.

    Chunks are first reduced to one row per session with a partial aggregation
    (``max_by``), then left-joined: untouched sessions keep their values.
    """
    last = (chunks.groupBy(F.col("session_id").alias("id"))
                  .agg(F.max("sequence").alias("__seq"),
                       F.max_by("to_ts", "sequence").alias("__to")))
    j = sessions.join(last, "id", "left")
    out = []
    for c in SESSION_COLUMNS:
        if c == "last_billed_at":
            out.append(F.coalesce(F.col("__to"), F.col(c)).alias(c))
        elif c == "billing_sequence":
            out.append(F.coalesce(F.col("__seq"), F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def finish_plan(sessions: DataFrame, requests: DataFrame, as_of=None):
    """I2 + B5 + F8: finish a set of sessions.

    ``requests`` has ``id`` and optionally ``finished_at`` (default: the clock); of
    several requests for one id the earliest counts. Only active sessions finish;
    finished ones are rejected, unknown ids are ``not_found``, a requested end before
    the time billed so far is ``end_before_billed`` and changes nothing (the clock as
    the default end always finishes). Returns ``(sessions', final_chunks, outcomes)`` from one plan:
    sessions' is the full table with the finished rows updated; final chunks are
    ``[coalesce(last_billed_at, start_at), finished_at)`` with ``sequence + 1``.
    """
    from meterflow.operators.chunks import chunk_columns

    rq_cols = set(requests.columns)
    fin_at = (F.col("finished_at").cast("timestamp_ntz") if "finished_at" in rq_cols else _ts(as_of))
    if "finished_at" in rq_cols and as_of is not None:
        fin_at = F.coalesce(fin_at, _ts(as_of))
    own_end = F.col("finished_at").cast("timestamp_ntz") if "finished_at" in rq_cols else F.lit(None).cast("timestamp_ntz")
    req = requests.groupBy("id").agg(F.min(fin_at).alias("__fin"), F.min(own_end).alias("__own"))
    s = sessions.select(*SESSION_COLUMNS).withColumn("__known", F.lit(True))
    j = req.join(s, "id", "left")
    outcome = (F.when(F.col("__known").isNull(), F.lit("not_found"))
                .when(F.col("status") != S.SESSION_ACTIVE, F.lit("already_finished"))
                .when((F.col("__own") <= F.col("__fin"))
                      & (F.col("__fin") < F.coalesce("last_billed_at", "start_at")), F.lit("end_before_billed"))
                .otherwise(F.lit("finished")))
    classified = j.withColumn("outcome", outcome)
    outcomes = classified.select("id", "outcome")
    done = classified.filter(F.col("outcome") == "finished")

    seq = (F.col("billing_sequence") + 1).alias("sequence")
    final_chunks = done.select(
        *chunk_columns(F.col("id"), seq, F.coalesce(F.col("last_billed_at"), F.col("start_at")),
                       F.col("__fin")))

    upd = done.select(F.col("id"), F.col("__fin").alias("__end"),
                      (F.col("billing_sequence") + 1).alias("__seq"))
    merged = sessions.select(*SESSION_COLUMNS).join(upd, "id", "left")
    hit = F.col("__end").isNotNull()
    new_cols = []
    for c in SESSION_COLUMNS:
        if c in ("last_billed_at", "end_at"):
            new_cols.append(F.when(hit, F.col("__end")).otherwise(F.col(c)).alias(c))
        elif c == "billing_sequence":
            new_cols.append(F.when(hit, F.col("__seq")).otherwise(F.col(c)).alias(c))
        elif c == "status":
            new_cols.append(F.when(hit, F.lit(S.SESSION_FINISHED)).otherwise(F.col(c)).alias(c))
        elif c == "billing_status":
            new_cols.append(F.when(hit, F.lit(S.BILLING_COMPLETED)).otherwise(F.col(c)).alias(c))
        else:
            new_cols.append(F.col(c))
    return merged.select(*new_cols), final_chunks, outcomes


def finish_summary(outcomes: DataFrame) -> DataFrame:
    """F8: finished vs failed counts of one finish run."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
