import zlib

import numpy as np

from meterflow.llm import quality
from meterflow.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in quality.op9(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(got[i].predicted == (got[i].score >= 0.7) and 0 <= got[i].score <= 1 for i in got)
    seen = {r.doc_id: r.quality for r in labels.collect()}
    held = [(got[i].predicted, y) for i, y in seen.items() if i in got and got[i].held_out]
    for label in (0, 1):
        assert np.mean([a == label for a, b in held if b == label]) > 0.9


def test_trees_against_brute_force():
    rng = np.random.default_rng(4)
    g, h = rng.standard_normal((6, 6)), rng.random((6, 6)) + 0.1
    s = quality._SMOOTH
    best = max((sum(g[a, b].sum() ** 2 / (h[a, b].sum() + s) for a in (slice(i), slice(i, None))
                    for b in (slice(j), slice(j, None))) - g.sum() ** 2 / (h.sum() + s), i, j)
               for i in range(1, 6) for j in range(1, 6))
    gain, step = quality.quadrants(g, h)
    assert np.isclose(gain, best[0])
    _, i, j = best
    assert np.isclose(step[0, 0], g[:i, :j].sum() / (h[:i, :j].sum() + s))
    g1, h1 = np.array([1.0, 1, -2, -2, 3, 3]), np.ones(6)
    assert len(set(np.round(quality.shallow_tree(g1, h1), 6))) == 3


def test_table_additions(spark):
    rng = np.random.default_rng(5)
    x = rng.random((500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # nothing but an interaction
    m = quality.Gam(x)
    m.fit(x, y, np.ones(500))
    assert ((m.scores(x) > 0.5) == y).mean() > 0.9
    fine, coarse = m.bins(x, m.cuts), m.bins(x, m.pair_cuts)
    for k in range(20):
        z = m.bias + sum(t[fine[k, f]] for f, t in enumerate(m.tables))
        z += sum(t[coarse[k, a], coarse[k, b]] for a, b, t in m.pairs)
        assert np.isclose(m.raw(x)[k], z)


def test_odd_rows(spark):
    rows = [(i, "Some plain words in a line. " * (3 + i % 5) if i % 3 else "x | y | z ###$$$ " * 9) for i in range(300)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "word " * 100000), (None, "plain words."), (904, "a"), (904, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as y", "3 as quality")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(1, 1), (None, 0), (2, None)],
                                   "doc_id long, quality int")
    got = quality.op9(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows)
    by = {r.doc_id: r for r in got.collect()}
    assert all(by[i].predicted == int(i % 3 > 0) for i in range(300))
    assert quality.op9(docs.where("false"), labels).count() == 0
    assert {r.score for r in quality.op9(docs.where("doc_id < 5"), labels.where("quality = 1")).collect()} == {0.0}
