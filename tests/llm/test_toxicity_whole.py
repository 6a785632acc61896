"""Op7 learns from every labelled row, whatever the number of rows and shards."""

import zlib

import numpy as np

from meterflow.llm import toxicity


def _tables(spark, n):
    docs = spark.range(n).selectExpr(
        "id as doc_id", "concat(if(id % 10 = 0, 'vile insult ', 'kind words '), 'filler', id % 13) as text", "'en' as lang")
    long = spark.createDataFrame([(n, "calm " * 12_000, "en")], "doc_id long, text string, lang string")
    labels = spark.range(n + 1).selectExpr("id as doc_id", f"int(id % 10 = 0 and id < {n}) as toxic")
    return docs.unionByName(long).unionByName(docs.where("doc_id = 1")), labels


def test_every_labelled_row_is_learnt_from(spark):
    n = 6001
    docs, labels = _tables(spark, n)
    rows, sizes = toxicity.labelled(docs, labels)
    want = {i for i in range(n + 1) if zlib.crc32(str(i).encode()) % 5}
    assert sorted(r.doc_id for r in rows.select("doc_id").collect()) == sorted(want)
    assert sum(sizes.values()) == len(want) and rows.selectExpr("max(length(text))").first()[0] == 60_000
    assert sum(v for (y, _), v in sizes.items() if y == 0) > 4000  # 2,000 a class before


def test_shards_are_averaged(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 150)
    docs, labels = _tables(spark, 600)
    rows, _ = toxicity.labelled(docs, labels)
    assert rows.select("shard").distinct().count() > 2
    got = {r.doc_id: r.predicted for r in toxicity.op7(docs, labels).collect()}
    assert np.mean([got[i] == (i % 10 == 0) for i in range(600)]) > 0.98


def test_long_text_in_pieces_trains_alike(spark, monkeypatch):
    def fitted():
        words, m = toxicity.Words(), toxicity.Model()
        docs = [toxicity.word_ids(" ".join(f"w{chr(97 + (i * k) % 23)}" for i in range(90)), words) for k in range(1, 9)]
        m.fit(docs, np.array([0, 1] * 4, np.float32), words, np.ones(8, np.float32))
        return m
    whole = fitted()
    monkeypatch.setattr(toxicity, "PIECE", 16)
    pieces = fitted()
    assert all(np.allclose(v, pieces.parameters()[k], atol=1e-5) for k, v in whole.parameters().items())


def test_sums_reach_the_driver_as_one_row_a_piece(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 64)
    parts = [{"e": np.arange(40, dtype=np.float32) * k, "bias": np.ones(1, np.float32)} for k in range(1, 8)]
    rows = [r for at, part in enumerate(parts) for name, x in part.items()
            for r in toxicity._pieces(name, x, at).itertuples(index=False, name=None)]
    assert len(rows) == 7 * (3 + 1)
    df = spark.createDataFrame([(n, int(p), int(a), bytearray(b)) for n, p, a, b in rows], toxicity.PIECES).repartition(5)
    sent = []
    frame = type(df)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: sent.append(collect(self)) or sent[-1])
    total = toxicity._summed(df, np.float32)
    assert len(sent[0]) == 3 + 1 and max(len(r.part) for r in sent[0]) <= 64
    assert np.array_equal(total["e"], sum(x["e"] for x in parts)) and total["bias"][0] == 7
