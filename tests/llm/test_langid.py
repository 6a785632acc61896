import zlib

import numpy as np

from meterflow.llm import langid
from meterflow.llm.common import table
from tests.conftest import SF_MID


def test_held_out_accuracy(spark):
    docs = table(spark, SF_MID, "documents")
    want = {r.doc_id: r.lang for r in docs.collect()}
    got = {r.doc_id: r for r in langid.op8(docs).collect()}
    assert sorted(got) == sorted(want)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 for i in got)
    held = [got[i].lang_pred == want[i] for i in got if got[i].held_out]
    assert len(held) > 150 and np.mean(held) > 0.97


def test_gradients_by_finite_differences():
    """Backpropagation through time against numeric slopes of one gate weight."""
    rng = np.random.default_rng(0)
    gru = langid.Gru(rng, 4)
    gru.x, gru.u = gru.x.astype(np.float64), gru.u.astype(np.float64)
    ids = rng.integers(1, 256, (6, 5))
    goal = rng.standard_normal((4, 5))

    def run():
        h, kept = np.zeros((4, 5)), []
        for t in range(6):
            g, rec, new = gru.step(ids[t], h)
            kept.append((g, rec, h))
            h = new
        return h, kept

    h, kept = run()
    dx, du, dh = np.zeros((256, 12)), np.zeros((12, 4)), goal.copy()
    for t in range(5, -1, -1):
        dh = gru.back(ids[t], *kept[t], dh, dx, du)
    for row in range(12):
        for what, grad, at in ((gru.u, du, (row, 1)), (gru.x, dx.T, (row, ids[2, 3]))):
            keep = what[at]
            what[at] = keep + 1e-5
            up = (run()[0] * goal).sum()
            what[at] = keep - 1e-5
            slope = (up - (run()[0] * goal).sum()) / 2e-5
            what[at] = keep
            assert np.isclose(slope, grad[at], atol=1e-5)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 60)
    rows = [(i, ("der die das und " if i % 2 else "the and of with ") * (1 + i % 5), "de" if i % 2 else "en")
            for i in range(200)]
    rows += [(900, None, "de"), (901, "", "de"), (902, "123 ² ½ Ⅷ ... !!", "en"), (903, "der die das und " * 9000, None),
             (None, "the and of with", None), (904, "the", None), (904, "the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "*", "1 as lang_pred", "2 as score", "3 as rank", "4 as l", "5 as h")
    got = langid.op8(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(rows)
    by = {r.doc_id: r for r in got.collect()}
    assert [(by[i].lang_pred, by[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by[903].lang_pred == "de" and by[None].lang_pred == "en"
    assert np.mean([by[i].lang_pred == ("de" if i % 2 else "en") for i in range(200)]) > 0.95
    assert langid.op8(docs.where("false")).count() == 0
    assert {r.lang_pred for r in langid.op8(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_long_texts_are_pooled_over_all_windows(spark, monkeypatch):
    m = langid.BiGru(["a", "b"])
    text = "some bytes " * 300
    whole = m.predict([text, "x", text])
    monkeypatch.setattr(langid, "_SIDE", 3)
    assert np.allclose(whole[1], m.predict([text, "x", text])[1], atol=1e-6)
