import random

import numpy as np
import pytest

from meterflow.llm import topk
from meterflow.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_MID
from tests.oracle import compare


def test_oracle_on_whole_table(spark, duck_mid):
    assert compare(QUERIES["op13_topk"](spark, SF_MID), duck_mid, ORACLES["op13_topk"]) == []


def brute(rows, k=20):
    usable = [(i, [int(np.floor(64 * np.float64(x))) for x in v]) for i, v in rows
              if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, qv) in enumerate(usable):
        if q is None or q % 20:
            continue
        scores = [(max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(qv, v)))), i) for m, (i, v) in enumerate(usable) if m != n]
        found = sorted((-s, i is None, i or 0) for s, i in scores)
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(found[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=str)


def odd(seed):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(150)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)]                    # a hot vector: ties go by id
    rows += [(20, [0.1, 0.2]), (20, [0.1, 0.2]), (40, []), (None, [0.9] * 6), (None, [0.9] * 6),
             (60, None), (80, [0.1, None]), (100, [float("nan")] * 6), (120, [float("inf"), 0.0])]
    return rows


@pytest.mark.parametrize("block,shard", [(1024, 1 << 22), (8, 300), (1, 7)])
def test_odd_rows_against_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "SPREAD", 4)
    rows = odd(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr(
        "*", "1 as shard", "2 as score", "3 as code", "4 as v", "5 as own")
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert rows_of(topk.op13(df)) == brute(f32)
    assert topk.op13(df.where("false")).count() == 0


def test_sums_beyond_floats(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 2)
    monkeypatch.setattr(topk, "SHARD", 8)
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 5.0]), (20, [2.0 ** 40 + 0.5, 3.0]), (21, [2.0 ** 40, 3.0]),
            (22, [2.0 ** 40, 3.0 + 1 / 64])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(topk.op13(df)) == brute(rows)


def test_blocks_below_the_kth_score_are_not_scored():
    """Clustered vectors: the bounds leave most blocks out."""
    rng = np.random.default_rng(0)
    shard, scored = topk._Shard(), []

    class Row:
        pass

    class Counted(np.ndarray):
        def __matmul__(self, q):
            scored.append(1)
            return np.asarray(self) @ q

    for c in range(50):
        row, m = Row(), np.floor(64 * (rng.normal(size=8) * 2 + rng.normal(size=(32, 8)) * 0.05))
        row.vectors, row.kind, row.n = m.tobytes(), "float64", 32
        row.ids = row.own = np.arange(c * 32, c * 32 + 32)
        row.none = np.zeros(32)
        b = topk._Block(row)
        b.m = b.m.view(Counted)
        shard.add(b)
    q = np.asarray(shard.blocks[7].m[0])
    best = shard.search(q, 7 * 32, None, 20)
    every = sorted(((-int(x), int(i)) for b in shard.blocks for x, i in zip(np.asarray(b.m) @ q, b.ids) if i != 7 * 32))[:20]
    assert [(-s, i) for s, _, i in best] == every and len(scored) <= 5
