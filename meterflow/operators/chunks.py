"""Chunk (usage slice) operators: build, scan, backfill, sequence, audit.

IDs: B4, B5 (builder shared with I2), C3, C4, F7, H1, H2, K4, K5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow import schemas as S
from meterflow.functions import expressions as X
from meterflow.operators.common import explode_count
from meterflow.operators.sessions import advance_sessions, unbilled_sessions

CHUNK_COLUMNS = ["event_id", "session_id", "sandbox_id", "organization_id", "sequence",
                 "from_ts", "to_ts", "cpu", "gpu", "ram_gb", "disk_gb", "region",
                 "region_type", "sandbox_class"]


def chunk_columns(session_id: Column, sequence: Column, from_ts: Column, to_ts: Column) -> list[Column]:
    """Chunk projection over a session row (resources copied; region_type
    is never set by the producers, so it is empty)."""
    sid = session_id.alias("session_id")
    seq = sequence.cast("bigint").alias("sequence")
    return [
        X.chunk_event_id(session_id, sequence.cast("bigint")).alias("event_id"),
        sid, F.col("sandbox_id"), F.col("organization_id"), seq,
        from_ts.alias("from_ts"), to_ts.alias("to_ts"),
        F.col("cpu"), F.col("gpu"), F.col("ram_gb"), F.col("disk_gb"), F.col("region"),
        F.lit("").alias("region_type"), F.col("sandbox_class"),
    ]


def build_chunks(eligible: DataFrame, as_of) -> DataFrame:
    """One chunk per session: ``from = coalesce(last_billed_at, start_at)``,
    ``to = least(as_of, end_at)``, ``sequence = billing_sequence + 1``."""
    now = X.as_ts(as_of)
    return eligible.select(*chunk_columns(
        F.col("id"), F.col("billing_sequence") + 1,
        F.coalesce(F.col("last_billed_at"), F.col("start_at")),
        X.bill_until(now, F.col("end_at"))))


def scan_and_chunk(sessions: DataFrame, as_of, interval: str = S.SCAN_INTERVAL,
                   existing_outbox: DataFrame | None = None):
    """C1 -> B4 -> B6, and I1 from the same chunks.

    Returns ``(outbox_rows, sessions', rejects)``. A chunk whose ``event_id`` is
    already in ``existing_outbox`` (the UNIQUE constraint) is rejected and its
    session is not advanced: event and advance go together or not at all; the
    other rows are unaffected.
    """
    from meterflow.operators.outbox import to_outbox

    chunks = build_chunks(unbilled_sessions(sessions, as_of, interval), as_of)
    if existing_outbox is not None:
        seen = existing_outbox.select("event_id").withColumn("__dup", F.lit(True))
        chunks = chunks.join(seen, "event_id", "left")
        rejects = (chunks.filter(F.col("__dup").isNotNull()).drop("__dup")
                   .withColumn("reject_reason", F.lit("duplicate_event_id")))
        chunks = chunks.filter(F.col("__dup").isNull()).drop("__dup")
    else:
        rejects = chunks.limit(0).withColumn("reject_reason", F.lit(None).cast("string"))
    outbox_rows = to_outbox(chunks, as_of)
    return outbox_rows, advance_sessions(sessions, chunks), rejects


def scan_summary(sessions: DataFrame, outbox_rows: DataFrame, as_of,
                 interval: str = S.SCAN_INTERVAL) -> DataFrame:
    """eligible total vs processed (chunks written) for one scan."""
    eligible = unbilled_sessions(sessions, as_of, interval).select(F.lit(1).alias("__t"), F.lit(0).alias("__p"))
    written = outbox_rows.select(F.lit(0).alias("__t"), F.lit(1).alias("__p"))
    both = eligible.unionByName(written).agg(F.sum("__t").cast("bigint").alias("total"),
                                             F.sum("__p").cast("bigint").alias("processed"))
    return both.select(F.coalesce("total", F.lit(0)).alias("total"),
                       F.coalesce("processed", F.lit(0)).alias("processed"),
                       (F.coalesce("total", F.lit(0)) - F.coalesce("processed", F.lit(0))).alias("failed"))


def chunk_backfill(sessions: DataFrame, as_of, interval: str = "90 days") -> DataFrame:
    """C4: every interval-wide chunk per eligible session up to ``as_of``.

    What repeated scans at fixed ticks would have emitted: slices
    ``[lba + k*I, least(lba + (k+1)*I, as_of, end_at))`` for
    ``k = 0 .. ceil((bound - lba) / I) - 1`` with sequence ``billing_sequence + k + 1``.
    The slice count is arithmetic, so no window is needed; slices are expanded
    in bounded blocks (``explode_count``) so a long backlog never builds one big
    array.
    """
    now = X.as_ts(as_of)
    step = X.interval_micros(interval)
    elig = unbilled_sessions(sessions, as_of, interval)
    start = F.coalesce(F.col("last_billed_at"), F.col("start_at"))
    bound = X.bill_until(now, F.col("end_at"))
    span = F.timestamp_diff("MICROSECOND", start, bound)
    n = F.when(span > 0, F.floor((span + F.lit(step - 1)) / F.lit(step))).otherwise(F.lit(0))
    with_n = elig.withColumn("__n", n.cast("bigint")).withColumn("__start", start).withColumn("__bound", bound)
    exp = explode_count(with_n, "__n", "__k", spread=True)
    k0 = F.col("__k") - 1
    frm = F.timestamp_add("MICROSECOND", k0 * F.lit(step), F.col("__start"))
    to = F.least(F.timestamp_add("MICROSECOND", F.col("__k") * F.lit(step), F.col("__start")),
                 F.col("__bound"))
    return exp.select(*chunk_columns(F.col("id"), F.col("billing_sequence") + F.col("__k"), frm, to))


# Buckets that rows of one session and one interval are dealt to.
TIE_BUCKETS = 64


def _before(df: DataFrame, group: list[str], order: list[str], out: str, n: str = "__n") -> DataFrame:
    """Adds ``out``: the sum of ``n`` over the rows of ``group`` that come earlier."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)))


def _join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join where null keys are equal to each other."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(r, on, how).drop(*[f"__r_{k}" for k in keys])


def next_sequence(candidates: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """H1: gapless per-session counter when one run yields several chunks:
    ``billing_sequence`` + the chunk's rank in its session ordered by
    ``(from_ts, to_ts)``, null times first; rows of one interval are ordered by a
    hash of their columns, so that the numbers do not depend on the input order.

    ``candidates`` has session_id, from_ts, to_ts (and any other columns that can be
    grouped by); ``base`` gives the session's current ``billing_sequence`` (``id``),
    0 when absent. Equal rows get a number each; rows without a session id are
    numbered together.

    A window ``row_number`` per session would put a hot session in one task. Here
    prefix sums go down a calendar: row counts per month of a session, per hour of a
    month, per interval of an hour (dealt to ``TIE_BUCKETS``), each added to what
    came before its parent. A window group holds the months of one session, the
    hours of one month, the intervals of one hour, or one tie bucket of one interval,
    whose equal rows were counted before; none grows with the session's rows.
    Nothing is sorted globally nor checkpointed: a recomputed task gives the same
    numbers.
    """
    cols, sid = candidates.columns, "session_id"
    rows = (candidates.groupBy(*cols).agg(F.count(F.lit(1)).alias("__dup"))
            .withColumn("__hash", F.xxhash64(*cols))
            .withColumn("__tie", F.pmod("__hash", F.lit(TIE_BUCKETS))))
    spot = [sid, "from_ts", "to_ts", "__tie"]
    spots = (rows.groupBy(*spot).agg(F.sum("__dup").alias("__n"))
             .withColumn("__hour", F.date_trunc("hour", "from_ts"))
             .withColumn("__month", F.date_trunc("month", "from_ts")))
    hours = spots.groupBy(sid, "__month", "__hour").agg(F.sum("__n").alias("__n"))
    months = hours.groupBy(sid, "__month").agg(F.sum("__n").alias("__n"))
    months = _before(months, [sid], ["__month"], "__before_month")
    if base is not None:
        start = base.select(F.col("id").alias(sid), F.col("billing_sequence").alias("__base"))
        months = months.join(start, sid, "left").withColumn(
            "__before_month", F.col("__before_month") + F.coalesce("__base", F.lit(0))).drop("__base")
    hours = _join_on(_before(hours, [sid, "__month"], ["__hour"], "__before_hour"),
                     months.drop("__n"), [sid, "__month"])
    spots = _join_on(_before(spots, [sid, "__hour"], ["from_ts", "to_ts", "__tie"], "__before_spot"),
                     hours.drop("__n", "__month"), [sid, "__hour"])
    first = spots.select(*spot, (F.col("__before_month") + F.col("__before_hour")
                                 + F.col("__before_spot")).alias("__before"))
    placed = _join_on(_before(rows, spot, ["__hash", *cols], "__earlier", "__dup"), first, spot)
    return explode_count(placed, "__dup", "__k").select(
        *cols, (F.col("__before") + F.col("__earlier") + F.col("__k")).cast("bigint").alias("sequence"))


def sequence_gaps(chunks: DataFrame) -> DataFrame:
    """H2: audit of the per-session order guarantee.

    For each chunk with ``sequence > 1`` its predecessor is the chunk with
    ``sequence - 1`` of the same session. Issues: ``missing_previous``,
    ``overlap`` (from < previous to), ``gap`` (from > previous to), and
    ``duplicate_sequence`` (two chunks share a sequence). Written as an
    equi-join on (session_id, sequence) instead of a ``lag`` window, so one
    session with millions of chunks is spread over many tasks.
    """
    c = chunks.select("session_id", "sequence", "from_ts", "to_ts", "event_id")
    per = c.groupBy("session_id", "sequence").agg(
        F.max("to_ts").alias("prev_to"), F.count(F.lit(1)).alias("__n"),
        F.min("event_id").alias("event_id"), F.min("from_ts").alias("from_ts"))
    prev = per.select("session_id", (F.col("sequence") + 1).alias("sequence"), "prev_to",
                      F.col("__n").alias("__np"))
    j = c.filter(F.col("sequence") > 1).join(prev, ["session_id", "sequence"], "left")
    # a predecessor whose end is not known is there, and its distance is not
    issue = (F.when(F.col("__np").isNull(), F.lit("missing_previous"))
              .when(F.col("from_ts") < F.col("prev_to"), F.lit("overlap"))
              .when(F.col("from_ts") > F.col("prev_to"), F.lit("gap")))
    link = (j.withColumn("issue", issue).filter(F.col("issue").isNotNull())
             .select("session_id", "sequence", "event_id", "from_ts", "prev_to", "issue"))
    dup = (per.filter(F.col("__n") > 1)
            .select("session_id", "sequence", "event_id", "from_ts",
                    F.lit(None).cast("timestamp_ntz").alias("prev_to"),
                    F.lit("duplicate_sequence").alias("issue")))
    return link.unionByName(dup)
