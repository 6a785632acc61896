"""Scalar column expressions (all JVM-side built-ins, no Python per row)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ts_lit(value: dt.datetime | str) -> Column:
    """A timestamp_ntz literal (the clock every operator takes as a parameter).

    Built from text: a Python ``datetime`` literal would be read in the
    driver process's local zone, so the same clock would mean a different
    instant on differently configured drivers."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def interval_lit(text: str) -> Column:
    """Interval literal such as ``'1 hour'`` or ``'90 days'``."""
    return F.expr(f"INTERVAL {_interval_sql(text)}")


def _interval_sql(text: str) -> str:
    n, unit = text.split()
    unit = unit.upper().rstrip("S")
    return f"'{int(n)}' {unit}"


def transaction_id(session_id="session_id", sequence="sequence") -> Column:
    """K1: ``session_id:sequence``."""
    return F.concat_ws(":", _c(session_id), _c(sequence).cast("string"))


def chunk_event_id(session_id="session_id", sequence="sequence") -> Column:
    """Deterministic event id, hex sha-256 of ``session_id:sequence``.

    A random id per call would give two ids for one (session, sequence) under a
    task retry; the hash is retry-safe.
    """
    return F.sha2(transaction_id(session_id, sequence), 256)


def stable_id(text) -> Column:
    """Positive 60-bit surrogate key from a string key (first 15 hex digits of
    sha-256). Stable across re-runs and partitionings, unlike
    ``monotonically_increasing_id``."""
    return F.conv(F.substring(F.sha2(_c(text), 256), 1, 15), 16, 10).cast("bigint")


def rfc3339_seconds(ts) -> Column:
    """K2: second-precision RFC 3339 text in UTC (fraction truncated)."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def duration_hours(start="from", end="to") -> Column:
    """K4: fractional hours between two timestamps, microsecond exact."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(3.6e9)


def bill_until(as_of, end_at="end_at") -> Column:
    """K5: the earlier of the session end and the clock; ``least`` skips nulls."""
    return F.least(_c(as_of), _c(end_at))


def default_if_missing(col, default) -> Column:
    """K6: null -> default; for strings, empty -> default too."""
    c = _c(col)
    if isinstance(default, str):
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    return F.coalesce(c, F.lit(default))


def sample_key(event_id="event_id", seed: str = "seed-1") -> Column:
    """Reproducible random order, md5 of ``event_id || seed``."""
    return F.md5(F.concat(_c(event_id), F.lit(seed)))


def hash_bucket(col, buckets: int) -> Column:
    """Stable bucket in [0, buckets) from md5, identical in any SQL engine with md5."""
    return F.pmod(F.conv(F.substring(F.md5(_c(col)), 1, 8), 16, 10).cast("bigint"),
                  F.lit(buckets))


def as_ts(value) -> Column:
    """Clock parameter as a Column: a Column passes through, a datetime or ISO
    text becomes a timestamp_ntz literal."""
    return value if isinstance(value, Column) else ts_lit(value)


_UNIT_US = {"MICROSECOND": 1, "MILLISECOND": 1000, "SECOND": 1_000_000,
            "MINUTE": 60_000_000, "HOUR": 3_600_000_000, "DAY": 86_400_000_000,
            "WEEK": 7 * 86_400_000_000}


def interval_micros(text: str) -> int:
    """Fixed-length interval text (``'90 days'``, ``'1 hour'``) in microseconds."""
    n, unit = text.split()
    return int(n) * _UNIT_US[unit.upper().rstrip("S")]
