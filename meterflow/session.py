"""Spark session helpers and the shared work folder.

Everything that must survive an executor loss (stream checkpoints, snapshot
versions, sink tables written by tests) lives under the folder the cluster names
in ``spark.checkpoint.dir``. We only pick our own folder when that setting is
unset, which is the case in local tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

# Session settings every entry point relies on: UTC clock, AQE for runtime
# re-planning and skew splitting. Timestamps are typed explicitly everywhere
# (timestamp_ntz for stored times, zone-aware only at the JSON and watermark
# edges), so no default timestamp type is assumed.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "meterflow",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


# Adaptive execution packs small shuffle partitions together by their compressed bytes.
# A row of order and line number takes about 4 of them and becomes a chunk of 1 KB once
# it is joined and sorted, so a task gets far fewer than the 64 MB of the default.
PACKED_BYTES = 2 << 20
# Table bytes per shuffle partition.
PARTITION_BYTES = 8 << 20


def apply_session_settings(spark: SparkSession, table_bytes: int = 0) -> None:
    """Pin what operators depend on: the UTC clock zone, and shuffle partitions that stay
    as large as they are when the tables grow. A finer setting of the session is kept."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    packed = spark._jsparkSession.sessionState().conf().getConf(
        spark._jvm.org.apache.spark.sql.internal.SQLConf.ADVISORY_PARTITION_SIZE_IN_BYTES())
    if packed > PACKED_BYTES:
        spark.conf.set(name, str(PACKED_BYTES))
    parts = -(-table_bytes // PARTITION_BYTES)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder, from the cluster's Hadoop file system; 0 if absent."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def work_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written tables.

    Reads ``spark.checkpoint.dir`` from the session. Only under a local master may
    it be unset (tests): a folder is then created and registered. On a cluster a
    folder of the driver's machine would be invisible to the executors, so an
    unset setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="meterflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    try:
        spark.sparkContext.setCheckpointDir(root)
    except Exception:  # Spark Connect has no SparkContext
        pass
    return root.rstrip("/")


def new_run_dir(spark: SparkSession, name: str) -> str:
    """A fresh, never reused sub-folder of the work root for one run."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the cluster's Hadoop file system (HDFS, S3A,
    local), not the driver's local disk."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_parquet_or_empty(spark: SparkSession, path: str, schema: str):
    """A table that may not have been written yet, or only with empty batches."""
    if path_exists(spark, path):
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
    return spark.createDataFrame([], schema)


def scale_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 128 << 20) -> dict:
    """Settings for a cluster run, derived from the input size and the cores.

    * shuffle partitions: enough that a partition stays near
      ``target_partition_bytes`` (so it fits an executor without spilling
      much), never fewer than 2 per core; AQE coalesces the small ones;
    * file splits of the same target size;
    * AQE skew splitting on, with a skew threshold of the target size;
    * RocksDB state store for the keyed session state machine (state off-heap,
      changelog checkpoints).
    """
    parts = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
