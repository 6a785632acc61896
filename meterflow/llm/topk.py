"""Exact top-k search by inner product (operator 13).

Method: block-at-a-time pruning. Vectors are sorted by a locality code (the signs of
their first ``CODE`` components) and vec_id, and cut into ranges of ``BLOCK`` rows. A
block keeps its forward index (the vectors) and each term's greatest and least value;
a query's summed term maxima bound every score in the block. A query takes the blocks
in descending order of its bounds, scores them through their forward indexes and
stops at the first bound below its k-th score. Scores are exact, so are the results.

Blocks lie in shards, one range partition each. Every query first searches its own
shard, which gives a k-th score to start with, then visits all other shards, where
only candidates that reach that score come out. The queries are copied to the shards,
the vectors never move again; a task holds one shard (about ``SHARD`` components) and
one block's queries at a time.

Cases: vectors that are null or hold null or non-finite components take no part; a
missing component of a shorter vector counts as 0, the empty vector scores 0 with
everyone; a null vec_id is no query and the last among ties; rows that repeat a
vec_id are rows of their own, as queries too; fewer candidates than k give all of
them; sums beyond 2**53 are computed as Python integers, a score beyond a long
counts as the nearest long; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterflow.llm.common import cut, ship

K = 20
EVERY = 20
CODE = 16
BLOCK = 1024
SHARD = 1 << 22
SPREAD = 64
_EXACT = 2.0 ** 53
_LONG = (1 << 63) - 1
_KINDS = ("int8", "int16", "int32", "float64")
# An id that is null is carried as 0 beside a mark: Python would turn it into a float.
_INDEX = "shard int, block int, n int, ids array<long>, none array<long>, own array<long>, kind string, vectors binary"
_HITS = "query_id long, shard int, own long, vec_id long, none boolean, score long"


def shards_for(rows: int, width: int) -> int:
    """Shards of about SHARD components; small tables still go over SPREAD tasks, but
    no shard is cut below a block."""
    return max(1, -(-rows * width // SHARD), min(SPREAD, rows // BLOCK))


def _pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows (vec_id, none, shard, v) to blocks."""
    held, count, at = [], 0, 0

    def block(df: pd.DataFrame, no: int) -> pd.DataFrame:
        vs = [np.floor(64 * np.asarray(v, np.float64)) for v in df["v"]]
        m = np.zeros((len(vs), max(map(len, vs))))
        for i, v in enumerate(vs):
            m[i, :len(v)] = v
        kind = next((k for k in _KINDS if m.size == 0 or (k != "float64" and np.iinfo(k).min <= m.min()
                                                          and m.max() <= np.iinfo(k).max)), "float64")
        own = np.arange(no * BLOCK, no * BLOCK + len(df))
        return pd.DataFrame({"shard": [int(df["shard"].iloc[0])], "block": [no], "n": [len(df)],
                             "ids": [df["vec_id"].to_numpy(np.int64)], "none": [df["none"].to_numpy(np.int64)],
                             "own": [own], "kind": [kind], "vectors": [m.astype(kind).tobytes()]})

    for df in parts:
        held.append(df)
        count += len(df)
        if count >= BLOCK:
            rows = pd.concat(held, ignore_index=True)
            cuts = range(0, count - count % BLOCK, BLOCK)
            for start in cuts:
                yield block(rows[start:start + BLOCK], at)
                at += 1
            held, count = [rows[len(cuts) * BLOCK:]], count % BLOCK
    if count:
        yield block(pd.concat(held, ignore_index=True), at)


def index(vectors: DataFrame) -> DataFrame:
    """The blocks of all usable vectors, written once."""
    ship(vectors.sparkSession)
    finite = F.forall("v", lambda x: F.abs(x) < F.lit(float("inf")))
    v = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"),
                        F.monotonically_increasing_id().alias("row")).where(finite))
    code = F.transform(F.slice("v", 1, CODE), lambda x: x >= 0)
    order = ["code", "vec_id", "row"]
    rows, width = v.agg(F.count("*"), F.max(F.size("v"))).first()
    n = shards_for(rows, width or 0)
    v = v.withColumn("code", code).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return cut(v.select(F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().cast("long").alias("none"),
                        F.spark_partition_id().alias("shard"), "v").mapInPandas(_pack, _INDEX))


class _Block:
    """One block: ids, forward index and the greatest and least value of its terms."""

    def __init__(self, row):
        m = np.frombuffer(row.vectors, row.kind).reshape(row.n, -1).astype(np.float64)
        self.m, self.own = m, np.array(row.own, np.int64)
        self.ids, self.none = np.array(row.ids, np.int64), np.array(row.none, bool)
        self.high, self.low = m.max(0), m.min(0)


def _width(m: np.ndarray, width: int) -> np.ndarray:
    """m with exactly ``width`` components: a missing one counts as 0."""
    return m[..., :width] if m.shape[-1] >= width else np.concatenate(
        (m, np.zeros((*m.shape[:-1], width - m.shape[-1]))), -1)


def _ints(m: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in m.ravel()] + [0], object)[:-1].reshape(m.shape)


class _Shard:
    """The blocks a task searches, and their term bounds side by side."""

    def __init__(self):
        self.blocks: list[_Block] = []
        self._bounds = None

    def add(self, block: _Block) -> None:
        self.blocks.append(block)
        self._bounds = None

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        if self._bounds is None:
            w = max((b.m.shape[1] for b in self.blocks), default=0)
            self._bounds = tuple(np.array([_width(x, w) for x in side]).reshape(len(self.blocks), w)
                                 for side in ([b.high for b in self.blocks], [b.low for b in self.blocks]))
        return self._bounds

    def search(self, q: np.ndarray, own: int, floor: int | None, k: int) -> list:
        """(score, null id, id) of the best k rows for q, at least floor, best first;
        ``own``: the query's row, left out."""
        high, low = (_width(x, len(q)) for x in self.bounds())
        reach = np.maximum(np.abs(high), np.abs(low)).max(0, initial=0)
        exact = float(reach @ np.abs(q)) < _EXACT
        if not exact:  # Python integers
            q, high, low = _ints(q), _ints(high), _ints(low)
        bounds = np.maximum(high * q, low * q).sum(1)
        bounds = bounds if exact else np.clip(bounds, -_LONG - 1, _LONG)
        best: list = []
        for i in sorted(range(len(self.blocks)), key=lambda i: -bounds[i]):
            if floor is not None and bounds[i] < floor:
                break
            b = self.blocks[i]
            m = _width(b.m, len(q))
            s = m @ q if exact else np.clip(_ints(m) @ q, -_LONG - 1, _LONG)
            take = np.flatnonzero((b.own != own) & (s >= floor if floor is not None else True))
            if exact and len(take) > k:
                take = take[np.lexsort((b.ids[take], b.none[take], -s[take]))[:k]]
            if len(take):
                best += [(int(s[j]), bool(b.none[j]), int(b.ids[j])) for j in take]
                best.sort(key=lambda h: (-h[0], h[1], h[2]))
                del best[k:]
                if len(best) == k:
                    floor = best[-1][0] if floor is None else max(floor, best[-1][0])
        return best


def _hits(b: _Block, j: int, shard: int, best: list) -> list:
    """Rows of _HITS for the query in row j of b."""
    return [(int(b.ids[j]), shard, int(b.own[j]), i, none, s) for s, none, i in best]


_HIT_COLS = ["query_id", "shard", "own", "vec_id", "none", "score"]


def _own_search(k: int, every: int):
    """A shard's blocks to hits of its own queries."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, shard = _Shard(), None
        for df in parts:
            for row in df.itertuples(index=False):
                here.add(_Block(row))
                shard = row.shard
        for b in here.blocks:
            found = []
            for j in np.flatnonzero(~b.none & (b.ids % every == 0)):
                found += _hits(b, j, shard, here.search(b.m[j], int(b.own[j]), None, k))
            yield pd.DataFrame(found, columns=_HIT_COLS)
    return run


def _far_search(k: int, every: int):
    """Rows of a shard: its blocks (kind 0), then blocks of queries of other shards
    (kind 1) with their floors, to hits."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, at = _Shard(), None
        for df in parts:
            for row in df.itertuples(index=False):
                if row.to != at:
                    here, at = _Shard(), row.to
                if row.far == 0:
                    here.add(_Block(row))
                    continue
                b, found = _Block(row), []
                floors = dict(zip(row.f_own, row.floors)) if row.f_own is not None else {}
                for j in np.flatnonzero(~b.none & (b.ids % every == 0)):
                    found += _hits(b, j, row.shard, here.search(b.m[j], -1, floors.get(int(b.own[j])), k))
                yield pd.DataFrame(found, columns=_HIT_COLS)
    return run


def _queries(every: int):
    """Blocks to blocks of their queries alone."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            out = []
            for row in df.itertuples(index=False):
                m = np.frombuffer(row.vectors, row.kind).reshape(row.n, -1)
                at = np.flatnonzero((row.none == 0) & (row.ids % every == 0))
                if len(at):
                    out.append((row.shard, row.block, len(at), row.ids[at], row.none[at], row.own[at], row.kind, m[at].tobytes()))
            yield pd.DataFrame(out, columns=["shard", "block", "n", "ids", "none", "own", "kind", "vectors"])
    return run


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query (vec_id
    divisible by ``every``)."""
    blocks = index(vectors)
    near = cut(blocks.mapInPandas(_own_search(k, every), _HITS))
    # a query's k-th score in its own shard, if it has k there
    ranked = near.groupBy("shard", "own").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    floors = ranked.groupBy("shard", F.floor(F.col("own") / BLOCK).cast("int").alias("block")).agg(
        F.collect_list("own").alias("f_own"), F.collect_list("floor").alias("floors"))
    asked = blocks.mapInPandas(_queries(every), _INDEX).join(floors, ["shard", "block"], "left")
    last = blocks.agg(F.max("shard")).first()[0] or 0
    asked = asked.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(last)))).where("to <> shard")
    none = F.lit(None).cast("array<long>")
    sent = (blocks.withColumns({"to": F.col("shard"), "f_own": none, "floors": none, "far": F.lit(0)})
            .unionByName(asked.withColumn("far", F.lit(1)))
            .repartition("to").sortWithinPartitions("to", "far", "shard", "block"))
    far = sent.mapInPandas(_far_search(k, every), _HITS)
    best = Window.partitionBy("query_id", "shard", "own").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    hits = near.unionAll(far).withColumn("vec_id", F.when(~F.col("none"), F.col("vec_id")))
    return (hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op13(vectors: DataFrame) -> DataFrame:
    return search(vectors)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, q.r, c.vec_id, list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)])::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
t AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id, r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM t WHERE rank <= 20
"""
