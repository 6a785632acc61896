"""Keys that put bad rows through the operators: every reject branch has rows.

The bad rows are derived from the fixture views by the order number, in the same
way by the Spark plan and by the oracle.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from meterflow.functions import codec
from meterflow.functions import expressions as X
from meterflow.operators import analytics, chunks, constraints, ledger, outbox, sessions
from meterflow.plans.catalog import AS_OF, A, CHUNK_SELECT, FIRST, SPLIT_SQL, fx, query
from meterflow.session import new_run_dir
from meterflow.sources import sinks

# The order number of an event id 'evt-<order>-<line>' or session id.
ORDER_SQL = "CAST(split_part(event_id, '-', 2) AS BIGINT)"


def _order():
    return F.split("event_id", "-")[1].cast("bigint")


def _spoilt(value, order):
    """Null, empty, blank and broken payloads among good ones."""
    return (F.when(order % 7 == 0, F.lit(None)).when(order % 7 == 1, F.lit(""))
            .when(order % 7 == 2, F.lit("  ")).when(order % 7 == 3, F.lit("{broken"))
            .when(order % 7 == 4, F.concat(F.lit("["), value)).otherwise(value))


SPOILT_SQL = """CASE {o} % 7 WHEN 0 THEN 'null_value' WHEN 1 THEN 'empty_value' WHEN 2 THEN 'empty_value'
  WHEN 3 THEN 'undecodable' WHEN 4 THEN 'undecodable' END"""


@query("b8_decode_rejects", f"""
SELECT concat('k', event_id) AS k, delivery_no, {SPOILT_SQL.format(o=ORDER_SQL)} AS decode_error,
       CASE WHEN {ORDER_SQL} % 7 > 4 THEN event_id END AS event_id FROM chunk_deliveries""")
def b8_rejects(spark, d):
    c = fx(spark, d).chunk_deliveries
    wire = c.select(F.concat(F.lit("k"), "event_id").alias("k"), "delivery_no",
                    _spoilt(codec.encode_chunks().cast("string"), _order()).alias("value"))
    return codec.decode_chunks(wire, "value").select("k", "delivery_no", "decode_error", "event_id")


@query("c9_null_events", f"""
SELECT coalesce({SPOILT_SQL.format(o=ORDER_SQL)}, 'exported') AS outcome, count(*) AS n
FROM billing_processed_deliveries GROUP BY 1""")
def c9_null(spark, d):
    """Export errors by reason beside the exported events."""
    p = fx(spark, d).billing_processed_deliveries
    wire = sinks.processed_records(p, keep=("event_id",)).withColumn(
        "value", _spoilt(F.col("value").cast("string"), _order())).drop("event_id")
    good, bad = analytics.not_null_event(codec.decode_processed(wire, "value"))
    return (good.select(F.lit("exported").alias("outcome"))
            .unionByName(bad.select(F.coalesce("decode_error", F.lit("null_event")).alias("outcome")))
            .groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))


@query("e3_publish_split_outcomes", SPLIT_SQL + """
, o AS (SELECT CASE WHEN outcome <> 'already' AND (id // 8) % 7 < 5 THEN 'undecodable' ELSE outcome END AS outcome FROM split)
SELECT outcome, count(*) * CASE WHEN outcome IN ('undecodable', 'invalid') THEN 2 ELSE 1 END AS n FROM o GROUP BY outcome
UNION ALL SELECT 'repeat', count(*) FROM o WHERE outcome = 'publish' HAVING count(*) > 0
UNION ALL SELECT 'already', count(*) FROM o WHERE outcome = 'already' HAVING count(*) > 0""")
def e3_outcomes(spark, d):
    """F6 over an outbox that holds every row twice, under a second id, and whose
    payloads are spoilt: all five outcomes; a broken row is broken under either id. (The rows of one lease that are in the
    ledger already are so under either id.)"""
    f = fx(spark, d)
    rows = f.outbox_with_payload()
    rows = rows.withColumn("payload", _spoilt(F.col("payload").cast("string"), F.floor(F.col("id") / 8)))
    twice = rows.unionByName(rows.withColumn("id", F.col("id") + (1 << 50)))
    split = outbox.publish_split(outbox.unpublished_events(twice), f.processed_outbox_events)
    once = split.filter((F.col("outcome") != "already") | (F.col("id") < (1 << 50)))
    again = split.filter((F.col("outcome") == "already") & (F.col("id") >= (1 << 50)))
    return outbox.publish_summary(once).unionByName(outbox.publish_summary(again))


@query("e3_broken_first_row", SPLIT_SQL + """
SELECT id, event_id, outcome FROM split
UNION ALL SELECT -id, event_id, CASE outcome WHEN 'already' THEN outcome ELSE 'undecodable' END FROM split""")
def e3_broken_first(spark, d):
    """Every row of the lease comes after a broken one of the same event, with a
    lower id: the good one is published all the same."""
    f = fx(spark, d)
    rows = f.outbox_with_payload()
    broken = rows.withColumns({"id": -F.col("id"), "payload": F.lit("{broken")})
    split = outbox.publish_split(outbox.unpublished_events(rows.unionByName(broken)), f.processed_outbox_events)
    return split.select("id", F.col("outbox_event_id").alias("event_id"), "outcome")


@query("i2_conflicting_finishes", f"""
, r AS (SELECT *, least({A}, coalesce(last_billed_at, start_at) + (billing_sequence % 5 - 1) * INTERVAL 1 HOUR) AS fin,
               status = 'SESSION_ACTIVE' AND fin >= coalesce(last_billed_at, start_at) AS ok FROM usage_sessions)
SELECT id, CASE WHEN ok THEN 'finished' WHEN status = 'SESSION_ACTIVE' THEN 'end_before_billed' ELSE 'already_finished' END AS outcome,
       CASE WHEN ok THEN 'SESSION_FINISHED' ELSE status END AS status, CASE WHEN ok THEN fin ELSE end_at END AS end_at,
       CASE WHEN ok THEN fin ELSE last_billed_at END AS last_billed_at, billing_sequence + CAST(ok AS INT) AS billing_sequence,
       CASE WHEN ok THEN coalesce(last_billed_at, start_at) END AS chunk_from, CASE WHEN ok THEN fin END AS chunk_to
FROM r""")
def i2_conflicts(spark, d):
    """Two finish requests for every session, at different times and in shuffled
    order: the earlier counts, and an end before the time billed so far is refused."""
    s = fx(spark, d).usage_sessions
    hours = F.make_dt_interval(hours=(F.col("billing_sequence") % 5 - 1).cast("int"))
    req = (s.select("id", (F.coalesce("last_billed_at", "start_at") + hours).alias("finished_at"))
           .unionByName(s.select("id", X.ts_lit(AS_OF).alias("finished_at"))).orderBy(F.xxhash64("id", "finished_at")))
    new, final, outcomes = sessions.finish_plan(s, req, AS_OF)
    ends = final.select(F.col("session_id").alias("id"), F.col("from_ts").alias("chunk_from"), F.col("to_ts").alias("chunk_to"))
    return (new.select("id", "status", "end_at", "last_billed_at", "billing_sequence").join(outcomes, "id")
            .join(ends, "id", "left"))


@query("e5_two_events_one_transaction", f"""
SELECT {CHUNK_SELECT} FROM {FIRST} c WHERE sequence % 2 = 1
UNION ALL SELECT {CHUNK_SELECT.replace('event_id', "concat('second-', event_id) AS event_id", 1)} FROM {FIRST} c
WHERE sequence % 2 = 0""")
def e5_two(spark, d):
    """Every transaction id comes from two event ids; the earlier delivery wins."""
    c = fx(spark, d).first_deliveries.select(*chunks.CHUNK_COLUMNS)
    odd = F.col("sequence") % 2
    two = c.withColumn("at", 1 - odd).unionByName(
        c.withColumn("event_id", F.concat(F.lit("second-"), "event_id")).withColumn("at", odd))
    return ledger.dedupe_by_transaction_id(two, None, ["at"]).select(*chunks.CHUNK_COLUMNS)


H2_SQL = """
, c AS (SELECT session_id, sequence, event_id, from_ts, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE to_ts END AS to_ts
        FROM chunk_deliveries)
, p AS (SELECT session_id, sequence, max(to_ts) AS prev_to, count(*) AS n, min(event_id) AS event_id, min(from_ts) AS from_ts
        FROM c GROUP BY session_id, sequence)
SELECT * FROM (
  SELECT c.session_id, c.sequence, c.event_id, c.from_ts, p.prev_to,
         CASE WHEN p.n IS NULL THEN 'missing_previous' WHEN c.from_ts < p.prev_to THEN 'overlap'
              WHEN c.from_ts > p.prev_to THEN 'gap' END AS issue
  FROM c LEFT JOIN p ON p.session_id = c.session_id AND p.sequence = c.sequence - 1 WHERE c.sequence > 1)
WHERE issue IS NOT NULL
UNION ALL SELECT session_id, sequence, event_id, from_ts, NULL, 'duplicate_sequence' FROM p WHERE n > 1"""


@query("h2_redelivered_sequences", H2_SQL)
def h2_redelivered(spark, d):
    """The audit over all deliveries, redeliveries included, with unknown ends."""
    c = fx(spark, d).chunk_deliveries
    return chunks.sequence_gaps(c.withColumn("to_ts", F.when(_order() % 11 != 0, F.col("to_ts"))))


@query("a15_broken_sessions", """
SELECT 'not_null:organization_id' AS "constraint", CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM usage_sessions
WHERE CAST(substr(id, 6) AS BIGINT) % 13 = 0 HAVING count(*) > 0
UNION ALL SELECT 'enum:status', 'BROKEN', count(*) FROM usage_sessions
WHERE CAST(substr(id, 6) AS BIGINT) % 17 = 0 HAVING count(*) > 0
UNION ALL SELECT 'unique:id', id, 2 FROM usage_sessions WHERE CAST(substr(id, 6) AS BIGINT) % 19 = 0""")
def a15_broken(spark, d):
    """NOT NULL, enum and primary key violations of one table."""
    s = fx(spark, d).usage_sessions
    n = F.substring("id", 6, 20).cast("bigint")
    s = (s.withColumn("organization_id", F.when(n % 13 != 0, F.col("organization_id")))
         .withColumn("status", F.when(n % 17 == 0, F.lit("BROKEN")).otherwise(F.col("status"))))
    again = (s.filter(n % 19 == 0).withColumn("organization_id", F.lit("org")).withColumn("status", F.lit("SESSION_ACTIVE")))
    return constraints.check_constraints(s.unionByName(again), "usage_sessions")


@query("i5_unknown_failures", """
SELECT id + 1000000000000 AS id FROM outbox_events WHERE sequence = 1""")
def i5_unknown(spark, d):
    """Failures of ids that the outbox does not have come back."""
    f = fx(spark, d)
    o = f.outbox_with_payload()
    bad = o.filter("sequence < 3").select(
        F.when(F.col("sequence") == 1, F.col("id") + 1_000_000_000_000).otherwise(F.col("id")).alias("id"),
        F.lit("boom").alias("error"))
    return outbox.record_failure(o, bad)[1]


@query("a14_partial_insert", """
SELECT 'refused' AS outcome, id, CAST(NULL AS BIGINT) AS billing_sequence, CAST(NULL AS VARCHAR) AS sandbox_class, false AS stamped,
       CASE WHEN n % 7 = 0 THEN 'sandbox_id,region' ELSE 'region' END AS detail
FROM (SELECT *, CAST(split_part(id, '-', 2) AS BIGINT) AS n FROM usage_sessions) WHERE n % 5 = 0
UNION ALL
SELECT 'refused', id, NULL, NULL, false, 'sandbox_id' FROM (SELECT *, CAST(split_part(id, '-', 2) AS BIGINT) AS n FROM usage_sessions)
WHERE n % 5 <> 0 AND n % 7 = 0
UNION ALL
SELECT 'stored', id, 0, 'container', true, region FROM (SELECT *, CAST(split_part(id, '-', 2) AS BIGINT) AS n FROM usage_sessions)
WHERE n % 5 <> 0 AND n % 7 <> 0""")
def a14_partial(spark, d):
    """Sessions without the columns that have a default, some without a region or a
    sandbox, into the defined table; what it holds then, and what it refused."""
    run = new_run_dir(spark, "a14")
    name = os.path.basename(run).replace("-", "_")
    constraints.define_tables(spark, run, name)
    n = F.split("id", "-")[1].cast("bigint")
    rows = (fx(spark, d).usage_sessions.drop("billing_sequence", "sandbox_class", "recorded_at")
            .withColumn("region", F.when(n % 5 != 0, F.col("region")))
            .withColumn("sandbox_id", F.when(n % 7 != 0, F.col("sandbox_id"))))
    refused = constraints.insert_rows(rows, "usage_sessions", name)
    stored = spark.table(f"{name}.usage_sessions")
    shown = stored.select(F.lit("stored").alias("outcome"), "id", "billing_sequence", "sandbox_class",
                          F.col("recorded_at").isNotNull().alias("stamped"), F.col("region").alias("detail"))
    return shown.unionByName(refused.select(
        F.lit("refused").alias("outcome"), "id", F.lit(None).cast("bigint").alias("billing_sequence"),
        F.lit(None).cast("string").alias("sandbox_class"), F.lit(False).alias("stamped"),
        F.col("refused").alias("detail")))
