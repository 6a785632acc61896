"""Pipeline reconciliation and unions.

IDs: L1, L2, L3, H3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.functions import codec
from meterflow.operators.billing import billing_payload
from meterflow.operators.common import first_by_order
from meterflow.operators.outbox import reject_reason


def status(in_legacy, in_new, compare: tuple[str, ...]):
    """Status of a joined pair (columns ``legacy_*`` and ``new_*``)."""
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"legacy_{c}").eqNullSafe(F.col(f"new_{c}"))
    return (F.when(~in_new, F.lit("missing_in_new")).when(~in_legacy, F.lit("missing_in_legacy"))
             .when(same, F.lit("matched")).otherwise(F.lit("differs")))


def reconcile_pipelines(legacy: DataFrame, new: DataFrame, key: str = "transaction_id",
                        compare: tuple[str, ...] = ("to_ts",)) -> DataFrame:
    """L1: compare two pipelines per key with one full outer join.

    status: ``matched`` (both, equal values), ``differs`` (both, a compared
    column differs, null-safe), ``missing_in_new``, ``missing_in_legacy``.
    """
    l = legacy.select(key, *[F.col(c).alias(f"legacy_{c}") for c in compare]).withColumn("__l", F.lit(True))
    n = new.select(key, *[F.col(c).alias(f"new_{c}") for c in compare]).withColumn("__n", F.lit(True))
    j = l.join(n, key, "full_outer")
    found = status(F.col("__l").isNotNull(), F.col("__n").isNotNull(), compare)
    return j.select(key, *[f"legacy_{c}" for c in compare], *[f"new_{c}" for c in compare],
                    found.alias("status"))


def reconcile_summary(rec: DataFrame) -> DataFrame:
    return rec.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def dual_pipeline_dedupe(legacy: DataFrame, new: DataFrame, key: str = "transaction_id") -> DataFrame:
    """L2: union of both pipelines' submissions, one per key; the new pipeline
    wins over the legacy one when both submitted."""
    u = (new.withColumn("source", F.lit("new")).withColumn("__prio", F.lit(0))
            .unionByName(legacy.withColumn("source", F.lit("legacy")).withColumn("__prio", F.lit(1)),
                         allowMissingColumns=True))
    return first_by_order(u, [key], ["__prio"]).drop("__prio")


def shadow_validate(records: DataFrame, value_col: str = "value") -> DataFrame:
    """L3: decode + validate + payload with no sink; counts per outcome."""
    dec = codec.decode_chunks(records, value_col)
    outcome = (F.when(F.col("decode_error").isNotNull(), F.col("decode_error"))
                .otherwise(F.coalesce(reject_reason(), F.lit("ok"))))
    checked = dec.withColumn("outcome", outcome)
    ok = billing_payload(checked.filter(F.col("outcome") == "ok"), keep=("outcome",)) \
        .select("outcome", F.col("properties.duration_hours").alias("duration_hours"))
    bad = checked.filter(F.col("outcome") != "ok").select("outcome", F.lit(None).cast("double").alias("duration_hours"))
    return (ok.unionByName(bad).groupBy("outcome")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("duration_hours").alias("hours")))


def union_deliveries(new: DataFrame, replayed: DataFrame) -> DataFrame:
    """H3: new events and replayed events on one topic."""
    return new.unionByName(replayed)
