"""Analytics export and capacity views.

IDs: A10 (row shaping; the sink is ``sources.sinks.write_analytics``), C9, L4, L5 (layout).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.functions import expressions as X
from meterflow.operators.common import first_by_order

EXPORT_COLUMNS = ["event_id", "session_id", "sequence", "processed_at", "metronome_id", "organization_id"]


def not_null_event(decoded: DataFrame):
    """A null (undecodable or JSON ``null``) event is an export error.
    Returns ``(events, rejects)``; rejects keep the raw value and the reason."""
    bad = F.col("decode_error").isNotNull() | F.col("event_id").isNull()
    return decoded.filter(~bad), decoded.filter(bad)


def export_rows(decoded: DataFrame, exported: DataFrame | None = None,
                order_cols: list[str] | None = None) -> DataFrame:
    """A10 rows with the documented dedupe by ``event_id``: first delivery per
    event wins in the batch, and events already exported are skipped."""
    events, _ = not_null_event(decoded)
    first = first_by_order(events.select(*EXPORT_COLUMNS, *(order_cols or [])), ["event_id"],
                           order_cols or ["processed_at"])
    if exported is not None:
        first = first.join(exported.select("event_id"), "event_id", "left_anti")
    return first.select(*EXPORT_COLUMNS).withColumn("export_date", F.to_date("processed_at"))


def event_volume_by_month(events: DataFrame, ts_col: str = "ts", type_col: str = "event_type") -> DataFrame:
    """L4: events per calendar month and type, with the average rate per second
    of that month."""
    month = F.to_date(F.date_trunc("month", ts_col))
    seconds = F.dayofmonth(F.last_day("month")) * F.lit(86400.0)
    return (events.groupBy(month.alias("month"), F.col(type_col).alias("event_type"))
                  .agg(F.count(F.lit(1)).alias("n")).withColumn("events_per_second", F.col("n") / seconds))


def event_volume(events: DataFrame, ts_col: str = "ts", type_col: str = "event_type") -> DataFrame:
    """L4: events per day and type, with the average rate per second."""
    return (events.groupBy(F.to_date(ts_col).alias("day"), F.col(type_col).alias("event_type"))
                  .agg(F.count(F.lit(1)).alias("n"))
                  .withColumn("events_per_second", F.col("n") / F.lit(86400.0)))


def shard_columns(df: DataFrame, org_col: str = "organization_id", region_col: str = "region",
                  ts_col: str = "processed_at", buckets: int = 16, period: str = "day") -> DataFrame:
    """L5 layout: tenant hash bucket, region and date as partition columns; the
    date is the first day of the row's ``period`` (day, month or year)."""
    return (df.withColumn("org_bucket", X.hash_bucket(F.col(org_col), buckets))
              .withColumn("shard_region", F.coalesce(F.col(region_col), F.lit("")))
              .withColumn("shard_date", F.to_date(F.date_trunc(period, ts_col))))
