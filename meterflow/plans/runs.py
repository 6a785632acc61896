"""Batch service cycles over the snapshot store (one commit per run).

* ``scan_run``    -- C3: chunk every eligible session, advance the sessions;
                     outbox rows and session versions commit together (the
                     atomic pair).
* ``finish_run``  -- I2/B5: finish a set of sessions and append their final
                     chunks to the outbox in the same commit.
* ``publish_run`` -- E3 + A6 + B13 + I3: publish unpublished outbox rows once,
                     write ledger rows and published marks in one commit.

The outbox is append-only; state changes (published, failures) are appended to
``outbox_marks`` and folded in by ``current_outbox``. Sessions likewise: created
rows are appended to ``usage_sessions``, every later state of a session to
``session_changes``, and ``current_sessions`` takes the latest. A run writes what it
changed; no table is rewritten whole, except by the compactions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow import schemas as S
from meterflow.functions import expressions as X
from meterflow.operators import chunks, ledger, outbox, sessions
from meterflow.plans.store import SnapshotStore
from meterflow.sources import sinks

# A row that has failed this often is a dead letter.
MAX_RETRIES = 5
MARKS_SCHEMA = "id bigint, published_at timestamp_ntz, failed int, last_error string, run bigint"


def current_outbox(store: SnapshotStore) -> DataFrame:
    """Outbox rows with marks folded in: latest publish time, failures counted,
    the error of the latest run that failed."""
    rows = store.read("outbox_events", S.OUTBOX_EVENTS)
    try:
        marks = store.read("outbox_marks")
    except KeyError:
        return rows
    m = marks.groupBy("id").agg(F.max("published_at").alias("__pub"),
                                F.sum("failed").cast("int").alias("__fails"),
                                F.max_by("last_error", F.when(F.col("failed") > 0, F.col("run"))).alias("__err"))
    j = rows.join(m, "id", "left")
    return j.select(*[
        F.coalesce(F.col("published_at"), F.col("__pub")).alias(c) if c == "published_at" else
        (F.col("retry_count") + F.coalesce(F.col("__fails"), F.lit(0))).alias(c) if c == "retry_count" else
        F.coalesce(F.col("__err"), F.col("last_error")).alias(c) if c == "last_error" else F.col(c)
        for c in outbox.OUTBOX_COLUMNS])


def current_sessions(store: SnapshotStore) -> DataFrame:
    """Sessions with the latest change of each folded in."""
    base = store.read("usage_sessions").select(*sessions.SESSION_COLUMNS)
    try:
        changes = store.read("session_changes")
    except KeyError:
        return base
    # narrow first: the latest run per changed session, then that run's row
    last = changes.groupBy("id").agg(F.max("run").alias("run"))
    latest = changes.join(last, ["id", "run"]).select(*sessions.SESSION_COLUMNS)
    return base.join(last.select("id"), "id", "left_anti").unionByName(latest)


def _changes(store: SnapshotStore, rows: DataFrame) -> DataFrame:
    """Session rows as a run writes them: with the run's version."""
    return rows.select(*sessions.SESSION_COLUMNS, F.lit(store.latest_version() + 1).cast("bigint").alias("run"))


def compact_sessions(store: SnapshotStore, run_id: str = "compact-sessions") -> int:
    """Fold the session changes into a new base and start an empty change log."""
    folded = current_sessions(store).sortWithinPartitions("status", "last_billed_at")
    empty = _changes(store, folded.limit(0))
    return store.commit({"usage_sessions": (folded, "base"), "session_changes": (empty, "base")}, run_id)


def init_store(store: SnapshotStore, sessions_df: DataFrame, outbox_df: DataFrame | None = None,
               run_id: str = "init") -> int:
    tables = {"usage_sessions": (sessions_df, "base")}
    if outbox_df is not None:
        tables["outbox_events"] = (outbox_df.select(*outbox.OUTBOX_COLUMNS), "append")
    return store.commit(tables, run_id)


def create_run(store: SnapshotStore, requests: DataFrame, as_of, run_id: str | None = None):
    """B1 + B3: build session rows from requests, check their constraints (ids
    unique among themselves and against the table, required columns set, enums
    allowed) and append. Returns ``(version, violations)``; nothing is committed
    when a request violates a constraint, and an id that the table has already is
    a ``unique:id`` violation."""
    from meterflow.operators.constraints import check_constraints
    new = sessions.create_sessions(requests, as_of)
    try:
        current = store.read("usage_sessions")
    except KeyError:
        current = None
    violations = check_constraints(new, "usage_sessions")
    if current is not None:
        taken = (new.join(current.select("id"), "id", "left_semi").groupBy(F.col("id").alias("value"))
                 .agg((F.count(F.lit(1)) + 1).alias("n")))
        inside = violations.filter(F.col("constraint") == "unique:id").select("value")
        violations = violations.unionByName(taken.join(inside, "value", "left_anti").select(
            F.lit("unique:id").alias("constraint"), "value", "n"))
    if violations.limit(1).count() > 0:
        return None, violations
    return store.commit({"usage_sessions": (new, "append")},
                        run_id or f"create-{uuid.uuid4().hex[:8]}"), violations


def scan_run(store: SnapshotStore, as_of, interval: str = S.SCAN_INTERVAL, run_id: str | None = None,
             check_outbox: bool = False) -> int:
    """Event ids are ``sha256(session_id:sequence)`` and the sequence advances
    in the same commit as the outbox rows, so a committed run can never emit an
    existing id; the O(outbox) uniqueness probe is therefore opt-in."""
    # only the eligible sessions change, so only they are planned and written
    sess = sessions.unbilled_sessions(current_sessions(store), as_of, interval)
    existing = store.read("outbox_events", S.OUTBOX_EVENTS) if check_outbox else None
    rows, changed, _ = chunks.scan_and_chunk(sess, as_of, interval, existing_outbox=existing)
    if check_outbox:  # a session whose event was a duplicate keeps its state
        changed = changed.join(rows.select(F.col("session_id").alias("id")), "id", "left_semi")
    return store.commit({"session_changes": (_changes(store, changed), "append"),
                         "outbox_events": (rows, "append")}, run_id or f"scan-{uuid.uuid4().hex[:8]}")


def finish_run(store: SnapshotStore, ids: DataFrame, as_of, run_id: str | None = None) -> int:
    sess = current_sessions(store).filter(F.col("status") == S.SESSION_ACTIVE).join(
        ids.select("id").distinct(), "id", "left_semi")
    changed, final_chunks, _ = sessions.finish_plan(sess, ids, as_of)
    rows = outbox.to_outbox(final_chunks, as_of)   # ids unique by construction (see scan_run)
    return store.commit({"session_changes": (_changes(store, changed), "append"),
                         "outbox_events": (rows, "append")}, run_id or f"finish-{uuid.uuid4().hex[:8]}")


def _failed():
    return F.col("outcome").isin("undecodable", "invalid")


def dead_letters(store: SnapshotStore, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Unpublished outbox rows that have failed ``max_retries`` times: no longer
    leased."""
    return outbox.split_by_retry(current_outbox(store), max_retries)[1]


def publish_run(store: SnapshotStore, topic_dir: str, as_of, limit: int | None = None,
                run_id: str | None = None, max_retries: int = MAX_RETRIES,
                kafka_servers: str | None = None) -> int:
    """One publish cycle over all (or the ``limit`` oldest) unpublished events
    that have failed fewer than ``max_retries`` times. Undecodable and invalid rows
    count as failures and go to ``outbox_rejects`` with the reason."""
    ob = outbox.split_by_retry(current_outbox(store), max_retries)[0]
    leased = outbox.lease_batch(ob, limit) if limit else outbox.unpublished_events(ob)
    try:
        led = store.read("processed_outbox_events")
        if limit:  # a bounded lease: only the buckets of its keys
            led = ledger.bucket_pruned(led, leased, "event_id", "event_bucket")
    except KeyError:
        led = ob.limit(0).select("event_id")
    split = outbox.publish_split(leased, led).persist()
    try:
        return _publish(store, split, topic_dir, as_of, run_id, kafka_servers)
    finally:
        split.unpersist()


def _publish(store: SnapshotStore, split: DataFrame, topic_dir: str, as_of, run_id: str | None,
             kafka_servers: str | None) -> int:
    """The four outputs of one cycle, all from the same (kept) split."""
    pub = split.filter(F.col("outcome") == "publish")
    version = store.latest_version() + 1
    sinks.write_topic(sinks.chunk_records(pub), topic_dir, S.TOPIC_CHUNKS, kafka_servers, batch_id=version)
    new_ledger = ledger.ledger_rows(pub.select(F.col("outbox_event_id").alias("event_id"),
                                               F.col("outbox_session_id").alias("session_id"),
                                               F.col("outbox_sequence").alias("sequence")), as_of, "outbox")
    new_ledger = new_ledger.sortWithinPartitions("event_bucket", "event_id")
    marks = split.select(
        "id",
        F.when(F.col("outcome").isin("already", "publish"), X.as_ts(as_of)).alias("published_at"),
        F.when(_failed(), F.lit(1)).otherwise(F.lit(0)).alias("failed"),
        F.when(_failed(), F.col("detail")).alias("last_error"),
        F.lit(version).cast("bigint").alias("run"))
    rejects = split.filter(_failed()).select("id", F.col("outbox_event_id").alias("event_id"), "outcome", "detail",
                                          X.as_ts(as_of).alias("rejected_at"))
    return store.commit({"processed_outbox_events": (new_ledger, "append"),
                         "outbox_rejects": (rejects, "append"),
                         "outbox_marks": (marks, "append")}, run_id or f"publish-{uuid.uuid4().hex[:8]}")


def compact_outbox(store: SnapshotStore, run_id: str = "compact-outbox") -> int:
    """Fold the published/failure marks into a new outbox base and start an
    empty mark log, in one commit. ``current_outbox`` then joins only the marks
    written since; the rows are sorted unpublished-first (nulls first) so the
    lease scan's filter skips published row groups."""
    folded = current_outbox(store).sortWithinPartitions(F.col("published_at").asc_nulls_first(), "created_at")
    empty_marks = store.spark.createDataFrame([], MARKS_SCHEMA)
    return store.commit({"outbox_events": (folded, "base"), "outbox_marks": (empty_marks, "base")}, run_id)
