"""L1 while both pipelines run: a full outer join of two streams.

Submissions of the legacy and the new pipeline meet by transaction id within ``delay``
of each other's event time. The clock is the lesser of the two sides' latest times, less
``delay``. A submission without a partner is reported (``missing_in_new``,
``missing_in_legacy``) once, by the batch whose clock passes its time by ``delay``.

The state is a table of the submissions that can still matter: one is kept for twice the
delay, until every partner it has been reported with has passed too, so that no row
needs a mark of having matched. A batch joins what it holds once, in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.functions import expressions as X
from meterflow.operators.reconcile import status
from meterflow.sources import sinks
from meterflow.streaming import state_tables

# A pair of rows with this id, dated after all others, closes what is open.
END = "__end__"
OPEN = "side string, transaction_id string, to_ts timestamp_ntz, us bigint"
CLOCK = "legacy_us bigint, new_us bigint"


def reconcile_batch(batch: DataFrame, batch_id: int, target: str, root: str, delay_us: int) -> None:
    """``batch``: rows of both sides (side, transaction_id, to_ts, ts)."""
    spark = batch.sparkSession
    before = state_tables.clock_before(spark, root, batch_id, CLOCK)
    last, sides = (before.batch_id, {"legacy": before.legacy_us, "new": before.new_us}) if before else (-1, {"legacy": 0, "new": 0})
    old = min(sides.values())
    rows = batch.select("side", "transaction_id", "to_ts", F.unix_micros("ts").alias("us"))
    for r in rows.groupBy("side").agg(F.max("us").alias("m")).collect():
        if r.m is not None:
            sides[r.side] = max(sides[r.side], (r.m - delay_us) // 1000 * 1000)
    clock = min(sides.values())
    held = (rows.filter(F.col("us") > old).withColumn("fresh", F.lit(True))
            .unionByName(state_tables.state(spark, root, "open", OPEN, last).withColumn("fresh", F.lit(False))))

    def side(name):
        return held.filter(F.col("side") == name).select(
            *[F.col(c).alias(f"{name}_{c}") for c in ("transaction_id", "to_ts", "us", "fresh")])

    def passed(name):  # by this batch's clock, and by none before
        limit = F.col(f"{name}_us") + delay_us
        return (limit < clock) & (F.col(f"{name}_fresh") | (limit >= old))
    near = F.abs(F.col("new_us") - F.col("legacy_us")) <= delay_us
    j = side("legacy").join(side("new"), (F.col("legacy_transaction_id") == F.col("new_transaction_id")) & near, "full_outer")
    has = {n: F.col(f"{n}_us").isNotNull() for n in ("legacy", "new")}
    told = (F.when(has["legacy"] & has["new"], F.col("legacy_fresh") | F.col("new_fresh"))
            .when(has["legacy"], passed("legacy")).otherwise(passed("new")))
    out = (j.filter(told).select(F.coalesce("legacy_transaction_id", "new_transaction_id").alias("transaction_id"),
                                 "legacy_to_ts", "new_to_ts", status(has["legacy"], has["new"], ("to_ts",)).alias("status"))
           .filter(F.col("transaction_id") != END))
    sinks.write_batch(out, target, batch_id)
    sinks.write_batch(held.filter(F.col("us") + 2 * delay_us >= clock).drop("fresh"), f"{root}/open", batch_id)
    state_tables.write_clock(spark, root, batch_id, CLOCK, sides["legacy"], sides["new"])


def start_reconcile_stream(legacy: DataFrame, new: DataFrame, target: str, checkpoint: str, delay: str,
                           available_now: bool = True):
    """(transaction_id, legacy_to_ts, new_to_ts, status) from streams of
    (transaction_id, to_ts, ts); the state lies beside the checkpoint."""
    both = [df.select(F.lit(name).alias("side"), "transaction_id", "to_ts", "ts") for name, df in (("legacy", legacy), ("new", new))]
    us = X.interval_micros(delay)
    return state_tables.foreach_batch(
        both[0].unionByName(both[1]), lambda df, b: reconcile_batch(df, b, target, f"{checkpoint}-state", us),
        checkpoint, available_now)
