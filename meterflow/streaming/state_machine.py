"""J9 session state machine: create -> active -> (tick)* -> finished, keyed by session.

A grouped stateful operator with event-time timers:

* ``create`` starts the state (last billed = start, sequence 0);
* every full interval that ends at or before the watermark emits a ``tick``
  chunk ``[last, last + interval)`` and bumps the sequence; a timer is set just
  under the next tick so it fires as soon as the watermark reaches it;
* ``finish`` emits the ticks that end at or before the finish time, then the
  ``final`` chunk ``[last, finish)`` and drops the state.

Ticks are emitted only up to the watermark, so results are deterministic for
any batching as long as events are no more out of order than the watermark
delay, which the caller states. Spark drops later events, and a finish must not
come before its create: where either can happen use ``lifecycle``, which keeps its
state as a table, loses no event and needs no Python. Tests drain the last ticks
with a sentinel event that moves the watermark.

Two engines run the same transitions (``_Machine``):
* ``processor`` (default): ``transformWithStateInPandas`` with a value state and
  registered timers (RocksDB state store) -- measured ~20 % faster here;
* ``group_state``: ``applyInPandasWithState`` with an event-time timeout.

Python runs once per session group per micro-batch (Arrow batches), never per
row of the whole stream; state is one small row per live session.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meterflow.functions import expressions as X

# The grouped functions are shipped to the Python workers by value, so
# executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SENTINEL = "__watermark__"
ATTRS = ["sandbox_id", "organization_id", "cpu", "gpu", "ram_gb", "disk_gb", "region", "sandbox_class"]
OUT_SCHEMA = ("session_id string, sandbox_id string, organization_id string, sequence long, "
              "from_ts timestamp_ltz, to_ts timestamp_ltz, cpu double, gpu double, ram_gb double, disk_gb double, "
              "region string, sandbox_class string, kind string")
STATE_SCHEMA = ("status string, last_us long, seq long, sandbox_id string, organization_id string, "
                "cpu double, gpu double, ram_gb double, disk_gb double, region string, sandbox_class string")
_ACTION_ORDER = {"create": 0, "finish": 1}

OUT_COLS = [c.split()[0] for c in OUT_SCHEMA.split(", ")]
STATE_COLS = ["status", "last_us", "seq", *ATTRS]


class _Machine:
    """The transitions, on plain Python values (most groups hold one or two
    events); one output frame per group."""

    def __init__(self, interval_us: int):
        self.interval_us = interval_us

    def _emit(self, out, sid, st, frm, to, kind):
        st["seq"] += 1
        out["session_id"].append(sid)
        for a in ATTRS:
            out[a].append(st[a])
        out["sequence"].append(st["seq"])
        out["from_ts"].append(frm)
        out["to_ts"].append(to)
        out["kind"].append(kind)

    def ticks_until(self, out, sid, st, limit_us):
        while st["last_us"] + self.interval_us <= limit_us:
            self._emit(out, sid, st, st["last_us"], st["last_us"] + self.interval_us, "tick")
            st["last_us"] += self.interval_us

    @staticmethod
    def new_out():
        return {c: [] for c in OUT_COLS}

    def apply_events(self, out, sid, st, pdfs, wm_us):
        """Fold this batch's events (sorted by time, create before finish at
        equal times) into the state; returns the new state (None = never
        created)."""
        events = []
        for p in pdfs:
            ts_us = p["ts"].to_numpy(dtype="datetime64[us]").astype("int64").tolist()
            acts = p["action"].tolist()
            attrs = {a: p[a].tolist() for a in ATTRS}
            for i, (t, act) in enumerate(zip(ts_us, acts)):
                events.append((t, _ACTION_ORDER.get(act, 2), act, {a: attrs[a][i] for a in ATTRS}))
        events.sort(key=lambda e: (e[0], e[1]))
        for t, _, act, attrs in events:
            if act == "create" and st is None:
                st = {"status": "active", "last_us": t, "seq": 0, **attrs}
            elif act == "finish" and st is not None and st["status"] == "active":
                self.ticks_until(out, sid, st, t)
                self._emit(out, sid, st, st["last_us"], t, "final")
                st["last_us"] = t
                st["status"] = "finished"
        if st is not None and st["status"] == "active":
            self.ticks_until(out, sid, st, wm_us)
        return st

    def next_timer_ms(self, st) -> int:
        """Just under the next tick end, so the timer fires once the watermark
        reaches it."""
        return (st["last_us"] + self.interval_us) // 1000 - 1

    @staticmethod
    def frame(out):
        if not out["sequence"]:
            return None
        out["from_ts"] = np.array(out["from_ts"], dtype="datetime64[us]")
        out["to_ts"] = np.array(out["to_ts"], dtype="datetime64[us]")
        return pd.DataFrame(out, columns=OUT_COLS)


def make_step(interval_us: int):
    """``applyInPandasWithState`` function (engine ``group_state``)."""
    m = _Machine(interval_us)

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        sid = key[0]
        if sid == SENTINEL:
            for _ in pdfs:
                pass
            return
        out = m.new_out()
        st = dict(zip(STATE_COLS, state.get)) if state.exists else None
        wm = state.getCurrentWatermarkMs() * 1000
        if state.hasTimedOut:
            if st is not None:
                m.ticks_until(out, sid, st, wm)
        else:
            st = m.apply_events(out, sid, st, pdfs, wm)
        if st is None or st["status"] == "finished":
            if state.exists:
                state.remove()
        else:
            state.update(tuple(st[c] for c in STATE_COLS))
            state.setTimeoutTimestamp(m.next_timer_ms(st))
        f = m.frame(out)
        if f is not None:
            yield f

    return step


class SessionProcessor(StatefulProcessor):
    """``transformWithStateInPandas`` processor (engine ``processor``): one
    value state per session plus one event-time timer at the next tick."""

    def __init__(self, interval_us: int):
        self.interval_us = interval_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.m = _Machine(self.interval_us)
        self.state = handle.getValueState("session", STATE_SCHEMA + ", timer_ms long")

    # Every state call is a round trip to the JVM, so each path makes few:
    # exists/get, then at most an update and one timer change (a get on a
    # missing value would log a warning per key, hence the exists first).
    def _load(self):
        if not self.state.exists():
            return None, None
        row = tuple(self.state.get())
        return dict(zip(STATE_COLS, row[:len(STATE_COLS)])), row[len(STATE_COLS)]

    def _store(self, st, old_timer, existed: bool):
        if st is None or st["status"] == "finished":
            if old_timer is not None:
                self.handle.deleteTimer(old_timer)
            if existed:
                self.state.clear()
            return
        timer = self.m.next_timer_ms(st)
        if timer != old_timer:
            if old_timer is not None:
                self.handle.deleteTimer(old_timer)
            self.handle.registerTimer(timer)
        self.state.update(tuple(st[c] for c in STATE_COLS) + (timer,))

    def handleInputRows(self, key, rows, timerValues):
        sid = key[0]
        if sid == SENTINEL:
            for _ in rows:
                pass
            return
        out = self.m.new_out()
        st, timer = self._load()
        existed = st is not None
        st = self.m.apply_events(out, sid, st, rows, timerValues.getCurrentWatermarkInMs() * 1000)
        self._store(st, timer, existed)
        f = self.m.frame(out)
        if f is not None:
            yield f

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        st, _ = self._load()
        if st is None:
            return
        out = self.m.new_out()
        self.m.ticks_until(out, key[0], st, timerValues.getCurrentWatermarkInMs() * 1000)
        self._store(st, None, True)   # the fired timer is gone; register the next one
        f = self.m.frame(out)
        if f is not None:
            yield f

    def close(self) -> None:
        pass


def session_state_machine(events: DataFrame, interval: str, delay: str,
                          engine: str = "processor") -> DataFrame:
    """Streaming lifecycle events -> chunk rows with event ids.

    ``events``: session_id, action ('create'|'finish'), ts, and the session
    attributes. ``ts`` may be timestamp_ntz; it is read as UTC at this edge
    because watermarks need a zone-aware timestamp. The ``processor`` engine
    needs the RocksDB state store; it is selected on the session when another
    provider is set.
    """
    interval_us = X.interval_micros(interval)
    ev = (events.withColumn("ts", F.col("ts").cast(T.TimestampType()))
                .withWatermark("ts", delay))
    if engine == "processor":
        spark = events.sparkSession
        if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        out = ev.groupBy("session_id").transformWithStateInPandas(
            SessionProcessor(interval_us), OUT_SCHEMA, "append", "EventTime")
    else:
        out = ev.groupBy("session_id").applyInPandasWithState(
            make_step(interval_us), OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(
        X.chunk_event_id("session_id", "sequence").alias("event_id"), "session_id", "sandbox_id",
        "organization_id", "sequence", F.col("from_ts").cast("timestamp_ntz").alias("from_ts"),
        F.col("to_ts").cast("timestamp_ntz").alias("to_ts"), "cpu", "gpu", "ram_gb", "disk_gb", "region",
        F.lit("").alias("region_type"), "sandbox_class", "kind")
