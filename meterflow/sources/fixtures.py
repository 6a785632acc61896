"""Usage-metering inputs derived from the driver's TPC-H-style tables.

The driver's tables hold no usage data, so sessions, chunk deliveries, outbox rows
and ledgers are derived from ``orders`` and ``lineitem`` by fixed rules. The rules
are written twice: as DataFrame code (what our queries read) and as the SQL text
``FIXTURE_SQL`` that prefixes every DuckDB oracle query. Both give the same
multiset of rows.

Plan notes (scale):
* Every derived column of a chunk delivery depends only on
  ``(l_orderkey, l_linenumber)``. So redeliveries are counted with a partial
  (map-side) aggregation, joined once to the sessions, and re-expanded by
  ``explode_count``; a key that holds a third of all lineitem rows never sits in
  one task as a window partition would.
* Sessions join lineitem on the integer order key. ``lpad(..., 10)`` in the SQL
  text is injective while order keys stay below 10^10, so both joins agree on
  the given tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.operators.common import explode_count
from meterflow.session import apply_session_settings, path_bytes

# Fixed fixture definition, shared with the oracle side. Unchanged text from
# FIXTURES.md section 3.
FIXTURE_SQL = """WITH usage_sessions AS (
  SELECT concat('sess-', lpad(CAST(o_orderkey AS STRING), 10, '0')) AS id,
         concat('sb-', CAST(o_custkey AS STRING)) AS sandbox_id,
         concat('org-', CAST(o_custkey % 100 AS STRING)) AS organization_id,
         o_orderdate AS start_at,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate + (o_orderkey % 240 + 1) * INTERVAL '1' HOUR END AS end_at,
         CASE WHEN o_orderstatus = 'F' THEN 'SESSION_FINISHED' ELSE 'SESSION_ACTIVE' END AS status,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate + (o_orderkey % 240 + 1) * INTERVAL '1' HOUR
              WHEN o_orderstatus = 'P' THEN o_orderdate + (o_orderkey % 48) * INTERVAL '1' HOUR
              ELSE o_orderdate END AS last_billed_at,
         CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'ACTIVE' END AS billing_status,
         CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 240 + 1
              WHEN o_orderstatus = 'P' THEN o_orderkey % 48 ELSE 0 END AS billing_sequence,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 8 AS DOUBLE) END AS cpu,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 2 AS DOUBLE) END AS gpu,
         CAST(2 + o_orderkey % 32 AS DOUBLE) AS ram_gb,
         CAST(10 + o_orderkey % 100 AS DOUBLE) AS disk_gb,
         CASE o_custkey % 4 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'us-west-2' WHEN 2 THEN 'eu-west-1' ELSE 'ap-southeast-1' END AS region,
         CASE o_orderkey % 4 WHEN 0 THEN 'container' WHEN 1 THEN 'linux-vm' WHEN 2 THEN 'windows' ELSE 'android' END AS sandbox_class,
         o_orderdate AS recorded_at
  FROM orders
), chunk_deliveries AS (
  SELECT concat('evt-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS event_id,
         s.id AS session_id,
         CASE WHEN l_orderkey % 37 = 0 THEN '' ELSE s.sandbox_id END AS sandbox_id,
         s.organization_id,
         CAST(l_linenumber AS BIGINT) AS sequence,
         s.start_at + (l_linenumber - 1) * INTERVAL '1' HOUR AS from_ts,
         s.start_at + (l_linenumber - 1 + (l_orderkey + l_linenumber) % 5) * INTERVAL '1' HOUR AS to_ts,
         s.cpu, s.gpu, s.ram_gb, s.disk_gb, s.region, '' AS region_type, s.sandbox_class,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                            ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS delivery_no,
         l_orderkey
  FROM lineitem JOIN usage_sessions s
    ON s.id = concat('sess-', lpad(CAST(l_orderkey AS STRING), 10, '0'))
), outbox_events AS (
  SELECT l_orderkey * 8 + sequence AS id, event_id, 'billing_chunk_created' AS event_type, session_id, sequence,
         to_ts AS created_at,
         CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE to_ts + INTERVAL '1' MINUTE END AS published_at,
         0 AS retry_count, CAST(NULL AS STRING) AS last_error, l_orderkey
  FROM chunk_deliveries WHERE delivery_no = 1
), processed_outbox_events AS (
  SELECT event_id, session_id, sequence, created_at + INTERVAL '1' MINUTE AS processed_at
  FROM outbox_events WHERE published_at IS NOT NULL OR l_orderkey % 9 = 0
), processed_billing_events AS (
  SELECT event_id, session_id, sequence, concat(session_id, ':', CAST(sequence AS STRING)) AS transaction_id,
         created_at + INTERVAL '2' MINUTE AS processed_at
  FROM outbox_events WHERE published_at IS NOT NULL AND l_orderkey % 2 = 0
), billing_processed_deliveries AS (
  SELECT p.event_id, p.session_id, p.sequence, p.processed_at, p.transaction_id AS metronome_id, c.organization_id, c.delivery_no
  FROM processed_billing_events p JOIN chunk_deliveries c ON c.event_id = p.event_id
), legacy_submissions AS (
  SELECT concat(session_id, ':', CAST(sequence AS STRING)) AS transaction_id, organization_id,
         CASE WHEN l_orderkey % 50 = 1 THEN to_ts + INTERVAL '1' HOUR ELSE to_ts END AS to_ts, from_ts
  FROM chunk_deliveries WHERE delivery_no = 1 AND l_orderkey % 10 <> 0
), session_lifecycle AS (
  SELECT id AS session_id, 'create' AS action, start_at AS ts, sandbox_id, organization_id, cpu, gpu, ram_gb, disk_gb, region, sandbox_class FROM usage_sessions
  UNION ALL
  SELECT id, 'finish', end_at, sandbox_id, organization_id, cpu, gpu, ram_gb, disk_gb, region, sandbox_class FROM usage_sessions WHERE end_at IS NOT NULL
)
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def _hours(ts: Column, n: Column) -> Column:
    return F.timestamp_add("HOUR", n, ts)


def _minutes(ts: Column, n: int) -> Column:
    return F.timestamp_add("MINUTE", F.lit(n), ts)


# Bytes of the tables that fill the files of a small topic.
SLICE_BYTES = 64 << 20


def session_id_of(orderkey: Column) -> Column:
    return F.concat(F.lit("sess-"), F.lpad(orderkey.cast("string"), 10, "0"))


class Fixtures:
    """Lazily built fixture DataFrames for one data folder.

    Nothing is cached or collected: each property is a plan that Spark reads
    from the parquet files when an action runs.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.table_bytes = sum(path_bytes(spark, f"{self.sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
        apply_session_settings(spark, self.table_bytes)

    def files(self, n: int) -> int:
        """``n`` files or files a batch on small tables, as many times more as the tables
        hold ``SLICE_BYTES``: a file stays as large as it is, and a topic has the same
        number of micro-batches at any size."""
        return n * max(1, -(-self.table_bytes // SLICE_BYTES))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- sessions ---------------------------------------------------------
    @cached_property
    def _orders(self) -> DataFrame:
        return self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")

    @staticmethod
    def _session_columns() -> dict[str, Column]:
        """Session columns, each a function of the order's own row."""
        k, c, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
        fin = F.col("o_orderstatus") == "F"
        part = F.col("o_orderstatus") == "P"
        end = _hours(d, k % 240 + 1)
        return {
            "id": session_id_of(k),
            "sandbox_id": F.concat(F.lit("sb-"), c.cast("string")),
            "organization_id": F.concat(F.lit("org-"), (c % 100).cast("string")),
            "start_at": d,
            "end_at": F.when(fin, end),
            "status": F.when(fin, "SESSION_FINISHED").otherwise("SESSION_ACTIVE"),
            "last_billed_at": F.when(fin, end).when(part, _hours(d, k % 48)).otherwise(d),
            "billing_status": F.when(fin, "COMPLETED").otherwise("ACTIVE"),
            "billing_sequence": F.when(fin, k % 240 + 1).when(part, k % 48).otherwise(F.lit(0).cast("bigint")),
            "cpu": F.when(k % 11 == 0, F.lit(None)).otherwise((1 + k % 8).cast("double")),
            "gpu": F.when(k % 13 == 0, F.lit(None)).otherwise((k % 2).cast("double")),
            "ram_gb": (2 + k % 32).cast("double"),
            "disk_gb": (10 + k % 100).cast("double"),
            "region": F.when(c % 4 == 0, "us-east-1").when(c % 4 == 1, "us-west-2")
                       .when(c % 4 == 2, "eu-west-1").otherwise("ap-southeast-1"),
            "sandbox_class": F.when(k % 4 == 0, "container").when(k % 4 == 1, "linux-vm")
                              .when(k % 4 == 2, "windows").otherwise("android"),
            "recorded_at": d,
        }

    @property
    def usage_sessions(self) -> DataFrame:
        return self._orders.select(*[c.alias(name) for name, c in self._session_columns().items()])

    # -- chunk deliveries -------------------------------------------------
    @cached_property
    def _lines(self) -> DataFrame:
        """One row per (order, line) with the number of deliveries and the order's few
        columns; partial aggregation before the shuffle, then one join. Texts are made
        from these after the shuffles."""
        counts = (self.table("lineitem").groupBy("l_orderkey", "l_linenumber")
                  .agg(F.count(F.lit(1)).alias("_n")))
        return counts.join(self._orders, F.col("l_orderkey") == F.col("o_orderkey"), "inner")

    def _chunk_columns(self) -> list[Column]:
        ok, ln, s = F.col("l_orderkey"), F.col("l_linenumber"), self._session_columns()
        return [
            F.concat(F.lit("evt-"), ok.cast("string"), F.lit("-"), ln.cast("string")).alias("event_id"),
            s["id"].alias("session_id"),
            F.when(ok % 37 == 0, F.lit("")).otherwise(s["sandbox_id"]).alias("sandbox_id"),
            s["organization_id"].alias("organization_id"),
            ln.cast("bigint").alias("sequence"),
            _hours(s["start_at"], ln - 1).alias("from_ts"),
            _hours(s["start_at"], ln - 1 + (ok + ln) % 5).alias("to_ts"),
            *[s[c].alias(c) for c in ("cpu", "gpu", "ram_gb", "disk_gb", "region")],
            F.lit("").alias("region_type"), s["sandbox_class"].alias("sandbox_class"),
        ]

    @cached_property
    def _first_deliveries(self) -> DataFrame:
        return self._lines.select(*self._chunk_columns(), "l_orderkey", "_n")

    @property
    def chunk_deliveries(self) -> DataFrame:
        """At-least-once topic: every redelivery is a row, numbered 1..n."""
        return explode_count(self._lines, "_n", "delivery_no").select(*self._chunk_columns(), "delivery_no", "l_orderkey")

    def dealt_deliveries(self, files: int, numbers: str = "true") -> DataFrame:
        """``chunk_deliveries`` whose ``delivery_no`` meets ``numbers``, dealt over ``files``
        tasks: redeliveries lie anywhere. Only keys and the order's few columns are
        shuffled for it; a topic written from it needs no shuffle of its records."""
        rows = explode_count(self._lines, "_n", "delivery_no").filter(numbers)
        return (rows.repartition(files, F.xxhash64("l_orderkey", "l_linenumber", "delivery_no"))
                .select(*self._chunk_columns(), "delivery_no", "l_orderkey"))

    @property
    def first_deliveries(self) -> DataFrame:
        """``chunk_deliveries WHERE delivery_no = 1`` (without the helper count)."""
        return self._first_deliveries.drop("_n").withColumn("delivery_no", F.lit(1).cast("bigint"))

    # -- outbox and ledgers -----------------------------------------------
    @cached_property
    def _outbox(self) -> DataFrame:
        f = self._first_deliveries
        ok = F.col("l_orderkey")
        return f.select(
            (ok * 8 + F.col("sequence")).alias("id"), "event_id",
            F.lit("billing_chunk_created").alias("event_type"), "session_id", "sequence",
            F.col("to_ts").alias("created_at"),
            F.when(ok % 3 == 0, F.lit(None)).otherwise(_minutes(F.col("to_ts"), 1)).alias("published_at"),
            F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("last_error"),
            "l_orderkey", "_n",
        )

    @property
    def outbox_events(self) -> DataFrame:
        return self._outbox.drop("_n")

    def outbox_with_payload(self, files: int | None = None) -> DataFrame:
        """Outbox rows in the stored shape, payload = JSON of the chunk; dealt over
        ``files`` tasks, before the payload is made, when given."""
        from meterflow.functions.codec import encode_chunks
        ok = F.col("l_orderkey")
        pub = F.when(ok % 3 == 0, F.lit(None)).otherwise(_minutes(F.col("to_ts"), 1))
        lines = self._lines if files is None else self._lines.repartition(files, F.xxhash64("l_orderkey", "l_linenumber"))
        return lines.select(*self._chunk_columns(), "l_orderkey").select(
            (ok * 8 + F.col("sequence")).alias("id"), "event_id",
            F.lit("billing_chunk_created").alias("event_type"), "session_id", "sequence",
            encode_chunks().alias("payload"),
            F.col("to_ts").alias("created_at"), pub.alias("published_at"),
            F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("last_error"),
        )

    @property
    def processed_outbox_events(self) -> DataFrame:
        o = self._outbox
        return (o.filter(F.col("published_at").isNotNull() | (F.col("l_orderkey") % 9 == 0))
                 .select("event_id", "session_id", "sequence",
                         _minutes(F.col("created_at"), 1).alias("processed_at")))

    @cached_property
    def _billing_ledger(self) -> DataFrame:
        o = self._outbox
        return (o.filter(F.col("published_at").isNotNull() & (F.col("l_orderkey") % 2 == 0))
                 .select("event_id", "session_id", "sequence",
                         F.concat(F.col("session_id"), F.lit(":"), F.col("sequence").cast("string"))
                          .alias("transaction_id"),
                         _minutes(F.col("created_at"), 2).alias("processed_at"), "_n"))

    @property
    def processed_billing_events(self) -> DataFrame:
        return self._billing_ledger.drop("_n")

    @property
    def billing_processed_deliveries(self) -> DataFrame:
        """Processed-event topic with redeliveries (one per chunk delivery)."""
        p = self._billing_ledger.join(
            self._first_deliveries.select("event_id", "organization_id"), "event_id")
        d = explode_count(p, "_n", "delivery_no")
        return d.select("event_id", "session_id", "sequence", "processed_at",
                        F.col("transaction_id").alias("metronome_id"), "organization_id",
                        "delivery_no")

    @property
    def legacy_submissions(self) -> DataFrame:
        f = self._first_deliveries.filter(F.col("l_orderkey") % 10 != 0)
        return f.select(
            F.concat(F.col("session_id"), F.lit(":"), F.col("sequence").cast("string")).alias("transaction_id"),
            "organization_id",
            F.when(F.col("l_orderkey") % 50 == 1, _hours(F.col("to_ts"), F.lit(1)))
             .otherwise(F.col("to_ts")).alias("to_ts"),
            "from_ts")

    @property
    def session_lifecycle(self) -> DataFrame:
        s = self.usage_sessions
        rest = ["sandbox_id", "organization_id", "cpu", "gpu", "ram_gb", "disk_gb", "region", "sandbox_class"]
        create = s.select(F.col("id").alias("session_id"), F.lit("create").alias("action"),
                          F.col("start_at").alias("ts"), *rest)
        finish = s.filter(F.col("end_at").isNotNull()).select(
            F.col("id").alias("session_id"), F.lit("finish").alias("action"),
            F.col("end_at").alias("ts"), *rest)
        return create.unionByName(finish)
