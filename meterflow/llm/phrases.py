"""Document fingerprints (operator 10).

Method: locally consistent parsing. The bytes of a text are parsed into phrases,
phrases into phrases of phrases, until one is left. On each level runs of equal
names become one name, deterministic coin tossing (the lowest bit in which a name
differs from the one before, repeated) turns the names into labels below 8 with
no two neighbours equal, and a phrase starts at every label greater than both its
neighbours. A cut depends on a few names around it, so equal substrings get equal
phrases except near their ends, at whatever offset they stand. A phrase's name is
a 64-bit hash of its parts.

The fingerprint keeps, for each of ``SLOTS`` classes of names, 16 bits of the
least name of the levels from ``FROM_LEVEL`` up and of the root; the share of equal
slots among those used estimates the Jaccard likeness of the phrase sets.

Texts are parsed in numpy, many short ones side by side. The next document is
found by one range shuffle on doc_id: inside a sorted partition it is the next
row; only the first and last row of each partition meet in a second, small step.

Cases: null counts as the empty text, whose fingerprint is all zero (likeness 1
to another empty text, 0 to others); rows with the same doc_id stand in the order
of a hash of their text; null ids come last; a single row is its own next;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterflow.llm.common import cut, ship

SLOTS = 64
FROM_LEVEL = 3
_BATCH_BYTES = 1 << 18
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _coins(size: int) -> np.ndarray:
    """Table of one coin-tossing step: entry (before * size + own)."""
    before, own = np.divmod(np.arange(size * size), size)
    diff = before ^ own
    low = np.bitwise_count((diff & -diff) - 1).astype(np.int64)
    return np.where(diff > 0, 2 * low + (own >> np.minimum(low, 62) & 1), 0).astype(np.uint8)


_BYTE_NAMES = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _M1)
_STEPS = [(128, _coins(128)), (14, _coins(14)), (8, _coins(8))]


def parse_level(x: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and first-of-document marks of the next level."""
    change = first.copy()
    change[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(change)
    runs = np.diff(at, append=len(x)).astype(np.uint64)
    x, first = _mix(x[at] + runs * _M1), first[at]
    # labels: a first name is compared with its own complement
    before = np.concatenate((x[:1], x[:-1]))
    before[first] = ~x[first]
    diff = x ^ before
    low = np.bitwise_count((diff & (~diff + np.uint64(1))) - np.uint64(1))
    label = 2 * low + ((x >> low) & np.uint64(1)).astype(np.uint8)
    for size, table in _STEPS:
        before = np.concatenate((label[:1], label[:-1]))
        before[first] = label[first] ^ 1
        label = table[before.astype(np.intp) * size + label]
    label = label.astype(np.int8)
    after = np.concatenate((label[1:], [np.int8(-1)]))
    after[:-1][first[1:]] = -1
    before = np.concatenate(([np.int8(-1)], label[:-1]))
    starts = np.flatnonzero(((label > before) & (label > after)) | first)
    lens = np.diff(starts, append=len(x))
    place = (np.arange(len(x)) - np.repeat(starts, lens)).astype(np.uint64)
    names = np.add.reduceat(_mix(x + (place + np.uint64(1)) * _M3), starts)
    return _mix(names + lens.astype(np.uint64) * _M1 + np.uint64(level)), first[starts]


def _sketch(texts: list[bytes]) -> np.ndarray:
    """16-bit slots of each text's phrase names (0: slot not used)."""
    least = np.full((len(texts), SLOTS), _EMPTY)
    lens = np.array([len(t) for t in texts])
    x = _BYTE_NAMES[np.frombuffer(b"".join(texts), np.uint8)]
    doc = np.repeat(np.arange(len(texts)), lens)
    level = 0
    while len(x):
        first = np.concatenate(([True], doc[1:] != doc[:-1]))
        x, mark = parse_level(x, first, level)
        doc = doc[np.flatnonzero(first)][np.cumsum(mark) - 1]
        level += 1
        single = np.bincount(doc, minlength=len(texts)) == 1
        done = single[doc]
        take = done if level < FROM_LEVEL else np.ones(len(x), bool)
        names = x[take]
        np.minimum.at(least, (doc[take], (names % np.uint64(SLOTS)).astype(np.intp)), names // np.uint64(SLOTS))
        x, doc = x[~done], doc[~done]
    slots = (least % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    slots[least == _EMPTY] = 0
    return slots


def sketches(texts: list[str]) -> np.ndarray:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out, at = [np.zeros((0, SLOTS), np.uint16)], 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= _BATCH_BYTES):
            size += len(raw[end])
            end += 1
        out.append(_sketch(raw[at:end]))
        at = end
    return np.concatenate(out)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: equal slots among those that either side uses."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return np.where(used > 0, same / np.maximum(used, 1), 1.0)


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def _finished(ids, texts: list[str], own: np.ndarray, after: list[str], after_own: np.ndarray) -> pd.DataFrame:
    new = [edited(t, a) for t, a in zip(texts, after)]
    changed = sketches(new)
    return pd.DataFrame({
        "part": pd.Series([None] * len(texts), dtype="Int64"), "edge": 0, "doc_id": ids,
        "n_chars": [len(t) for t in texts],
        "sha": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in new],
        "own": [r.astype(">u2").tobytes() for r in own], "changed": [r.astype(">u2").tobytes() for r in changed],
        "near_edited": likeness(own, changed), "near_next": likeness(own, after_own), "text": None})


_SHAPE = ("part long, edge int, doc_id long, n_chars long, sha binary, own binary, changed binary, "
          "near_edited double, near_next double, text string")


def _edge(part: int, edge: int, doc_id, text: str, own: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"part": pd.Series([part], dtype="Int64"), "edge": edge, "doc_id": pd.Series([doc_id], dtype="Int64"),
                         "n_chars": 0, "sha": None, "own": [own.astype(">u2").tobytes()], "changed": None,
                         "near_edited": 0.0, "near_next": 0.0, "text": [text]})


def _along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every row of a sorted partition with its next one; the first row (edge 1)
    and the last (edge 2) are passed on with their texts."""
    part = TaskContext.get().partitionId()
    held = None  # the last row so far: id, text, sketch
    for pdf in batches:
        if not len(pdf):
            continue
        ids = list(pdf["doc_id"].astype("Int64"))
        texts = [t or "" for t in pdf["text"]]
        own = sketches(texts)
        if held is None:
            yield _edge(part, 1, None, texts[0], own[0])
        else:
            ids, texts, own = [held[0], *ids], [held[1], *texts], np.concatenate((held[2][None], own))
        held = ids[-1], texts[-1], own[-1]
        if len(ids) > 1:
            yield _finished(pd.Series(ids[:-1], dtype="Int64"), texts[:-1], own[:-1], texts[1:], own[1:])
    if held is not None:
        yield _edge(part, 2, *held)


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        read = lambda c: np.array([np.frombuffer(b, ">u2") for b in pdf[c]], np.uint16).reshape(-1, SLOTS)
        yield _finished(pdf["doc_id"].astype("Int64"), list(pdf["text"]), read("own"),
                        list(pdf["after"]), read("after_own"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, sha, own, changed, near_edited, near_next), sketches and
    hash as binary."""
    ship(docs.sparkSession)
    order = [F.asc_nulls_last("doc_id"), F.asc("key")]
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .withColumn("key", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
            .select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_along, _SHAPE))
    rows = cut(rows)
    # one first and one last row per partition: the next partition's first, at the end the first of all
    parts = rows.where("edge = 1").select("part")
    by_part, everything = Window.orderBy("part"), Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    follows = parts.select("part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(everything))
                           .alias("next"))
    firsts = rows.where("edge = 1").select(F.col("part").alias("next"), F.col("text").alias("after"),
                                           F.col("own").alias("after_own"))
    lasts = (rows.where("edge = 2").select("part", "doc_id", "text", "own").join(follows, "part")
             .join(firsts, "next").select("doc_id", "text", "own", "after", "after_own")
             .mapInPandas(_across, _SHAPE))
    return rows.where("edge = 0").unionAll(lasts).drop("part", "edge", "text")


def op10(docs: DataFrame) -> DataFrame:
    text = lambda c: F.lower(F.hex(c))
    return fingerprints(docs).select(
        "doc_id", "n_chars", text("sha").alias("edited_sha256"), text("own").alias("fingerprint"),
        text("changed").alias("edited_fingerprint"), "near_edited", "near_next")
