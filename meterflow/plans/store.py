"""Versioned table store with one commit log (atomic multi-table runs).

Spark has no multi-table transaction and MERGE INTO needs a lakehouse format.
Here every run writes new table versions under ``<root>/<table>/v=<n>/`` and
only then appends one commit record per table to ``<root>/_commits``. Readers
resolve a table through the commit log, so a run that dies half-way leaves
unreferenced folders and no visible change; a re-run with the same
deterministic ids writes the same content.

Table kinds:
* ``snapshot`` -- the version folder holds the whole table (mutable tables
  such as ``usage_sessions``);
* ``append``   -- the version folder holds only the rows added by that run
  (ledgers, outbox rows, mark logs); the table is the union of committed
  versions, read with partition pruning on ``v``;
* ``base``     -- a compaction of an append table: readers start at the latest
  base and add the appends committed after it.

One writer per store is assumed (the run that owns the tables); concurrent
writers would need an external version allocator.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.session import path_exists

COMMITS = "_commits"
COMMIT_SCHEMA = T.StructType([
    T.StructField("version", T.LongType(), False),
    T.StructField("table_name", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("run_id", T.StringType(), False),
    T.StructField("committed_at", T.TimestampNTZType(), False),
])


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- commit log ---------------------------------------------------------
    def _commits(self) -> DataFrame | None:
        path = f"{self.root}/{COMMITS}"
        if not path_exists(self.spark, path):
            return None
        return self.spark.read.schema(COMMIT_SCHEMA).parquet(path)

    def latest_version(self) -> int:
        c = self._commits()
        if c is None:
            return 0
        v = c.agg(F.max("version").alias("v")).collect()[0].v
        return v or 0

    def entries(self, table: str) -> list[tuple[int, str]]:
        """(version, kind) of ``table``'s writes since its latest base (or all,
        when it has none), in order. The log is filtered and aggregated by
        Spark; the driver receives only these few rows."""
        c = self._commits()
        if c is None:
            return []
        t = c.filter(F.col("table_name") == table)
        base = t.filter(F.col("kind") == "base").agg(F.max("version").alias("b")).collect()[0].b
        if base is not None:
            t = t.filter(F.col("version") >= base)
        last = t.agg(F.max_by("kind", "version").alias("k"), F.max("version").alias("v")).collect()[0]
        if last.v is None:
            return []
        if last.k == "snapshot":
            return [(last.v, "snapshot")]
        return sorted((r.version, r.kind) for r in t.select("version", "kind").collect())

    def versions(self, table: str) -> list[int]:
        return [v for v, _ in self.entries(table)]

    def kind(self, table: str) -> str | None:
        e = self.entries(table)
        return e[-1][1] if e else None

    # -- write ----------------------------------------------------------------
    def commit(self, tables: dict[str, tuple[DataFrame, str]], run_id: str) -> int:
        """Write every table version, then append the commit records last."""
        version = self.latest_version() + 1
        for name, (df, kind) in tables.items():
            assert kind in ("snapshot", "append", "base"), kind
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={version}")
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        rows = [(version, name, kind, run_id, now) for name, (_, kind) in tables.items()]
        self.spark.createDataFrame(rows, COMMIT_SCHEMA).coalesce(1) \
            .write.mode("append").parquet(f"{self.root}/{COMMITS}")
        return version

    def compact(self, table: str, sort_cols: tuple[str, ...] = (), run_id: str = "compact") -> int:
        """Fold an append table's versions into one ``base`` version (fewer,
        larger files; optionally sorted for min/max pruning). Readers start at
        the latest base; superseded folders are no longer read and can be
        removed by a retention job. Nothing is deleted here."""
        df = self.read(table)
        if sort_cols:
            df = df.sortWithinPartitions(*sort_cols)
        return self.commit({table: (df, "base")}, run_id)

    # -- read -----------------------------------------------------------------
    def read(self, table: str, schema: T.StructType | None = None) -> DataFrame:
        entries = self.entries(table)
        if not entries:
            if schema is None:
                raise KeyError(f"table {table} has no committed version")
            return self.spark.createDataFrame([], schema)
        if entries[-1][1] == "snapshot":
            return self.spark.read.parquet(f"{self.root}/{table}/v={entries[-1][0]}")
        base = max((v for v, k in entries if k == "base"), default=None)
        vs = [v for v, _ in entries if base is None or v >= base]
        df = self.spark.read.option("basePath", f"{self.root}/{table}").parquet(
            *[f"{self.root}/{table}/v={v}" for v in vs])
        return df.drop("v")
