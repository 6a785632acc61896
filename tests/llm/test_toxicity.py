import zlib

import numpy as np
from pyspark.sql import functions as F

from meterflow.llm import toxicity
from meterflow.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in toxicity.op7(docs, labels).collect()}
    assert len(got) == docs.count()
    seen = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(got[i].predicted == (got[i].score >= 0.5) and 0 <= got[i].score <= 1 for i in got)
    held = [(got[i].predicted, y) for i, y in seen.items() if i in got and got[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    toxic = [a for a, b in held if b == 1]
    assert np.mean(toxic) > 0.75
    assert np.mean([a for a, b in held if b == 0]) < 0.02


def test_odd_rows(spark):
    rows = [(i, ("vile insult here " if i % 4 == 0 else "kind words there ") + f"filler{i % 13} text",
             "en" if i % 2 else None) for i in range(400)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 34 !!", "en"), (903, "long " * 120000 + "vile insult", "en"),
             (904, "long " * 120000, "en"), (None, "vile insult", "en"), (905, "kind", "en"), (905, "kind", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "*", "1 as score", "2 as y", "3 as share", "4 as toxic")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(3, 0), (None, 1), (5, None)],
                                   "doc_id long, toxic int").selectExpr("*", "'x' as text", "1 as y")
    got = toxicity.op7(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows)
    by = {r.doc_id: r for r in got.collect()}
    assert by[903].predicted == 1 and by[903].score > by[904].score and by[None].predicted == 1
    assert np.mean([by[i].predicted == (i % 4 == 0) for i in range(400)]) > 0.98
    assert toxicity.op7(docs.where("false"), labels).count() == 0
    for none in (labels.where("false"), labels.where("toxic = 1")):
        assert {r.score for r in toxicity.op7(docs.where("doc_id < 9"), none).collect()} == {0.0}


def test_pieces_agree_with_whole(spark, monkeypatch):
    rng = np.random.default_rng(1)
    m, words = toxicity.Model(), toxicity.Words()
    docs = [toxicity.word_ids(" ".join(f"w{x}" .translate({48 + i: 97 + i for i in range(10)})
                                       for x in rng.integers(0, 500, n)), words) for n in (0, 1, 2, 3, 50, 400)]
    m.learn_words(words, anew=True)
    whole = m.raw(docs)[0]
    monkeypatch.setattr(toxicity, "PIECE", 16)
    assert np.allclose(m.raw(docs)[0], whole, atol=1e-5)
    # brute force of the widest filters on the longest text
    e = m.e[words.rows].sum(axis=1)
    ids = np.concatenate((docs[-1], [0, 0]))
    want = [max(sum(e[ids[t + j]] @ m.w[3][j][:, f] for j in range(3)) for t in range(400)) for f in range(3)]
    got = m.pooled(*toxicity._layout([docs[-1]]))[0][2 * toxicity.FILTERS:2 * toxicity.FILTERS + 3]
    assert np.allclose(got, want, atol=1e-4)
