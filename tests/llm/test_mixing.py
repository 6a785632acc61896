import pytest
from pyspark.sql import functions as F

from meterflow.llm import mixing
from meterflow.llm.common import table
from tests.conftest import SF_MID


def brute_targets(size_of):
    """Repeated resharing of what is above the cap."""
    names = sorted((s for s in size_of if s is not None)) + ([None] if None in size_of else [])
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, open_, out = sum(size_of.values()), set(names), {}
    while open_:
        share = {s: total * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size_of[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * size_of[s]
            total -= out[s]
        open_ -= over
    return out


def test_whole_table(spark):
    docs = table(spark, SF_MID, "documents")
    got = mixing.op1(docs).collect()
    size_of = {}
    for r in docs.collect():
        n = len([w for w in r.text.encode().split() if w])
        size_of[r.source] = size_of.get(r.source, 0) + n
    want = brute_targets(size_of)
    source = {r.doc_id: r.source for r in docs.collect()}
    taken = dict.fromkeys(size_of, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size_of[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(got) == docs.count()
    for s in taken:
        assert taken[s] == pytest.approx(want[s], rel=0.01), s
    again = mixing.op1(docs.repartition(5, F.rand(1))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_caps_nulls_and_odd_rows(spark):
    rows = [(i, "w " * (i % 7 + 1), "a") for i in range(400)] + \
           [(1000 + i, "x\ty z", "tiny") for i in range(3)] + \
           [(2000 + i, "p q", None) for i in range(50)] + \
           [(3000, None, "empty"), (3001, "", "empty"), (None, "n u l l", "a"), (5, "w", "a"), (5, "w", "a"),
            (4000, "long " * 30000, "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.selectExpr("*", "9 as size", "9 as n", "9 as rate", "9 as s", "'q' as copies", "1 as salt")
    got = mixing.op1(docs).collect()
    size_of = {}
    for _, t, s in rows:
        size_of[s] = size_of.get(s, 0) + len((t or "").split())
    want = brute_targets(size_of)
    assert len(got) == len(rows)
    tiny = [r for r in got if r.doc_id in (1000, 1001, 1002)]
    assert {r.target for r in tiny} == {27.0} and sum(r.taken for r in tiny) == 27
    nul = [r for r in got if r.doc_id and 2000 <= r.doc_id < 2050]
    assert nul[0].target == pytest.approx(want[None]) and nul[0].source_size == 100
    assert abs(sum(r.taken for r in nul) - nul[0].target) <= 4
    assert all(r.taken <= 3 * r.size for r in got)
    assert [r.taken for r in got if r.doc_id in (3000, 3001)] == [0, 0]
    assert mixing.op1(docs.where("false")).count() == 0
    full = docs.selectExpr("doc_id", "text", "'en' lang", "source", "1L n_chars")
    kept = mixing.stage(full)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies"]
    assert kept.count() > 0


def test_hot_cell_is_exact(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "'five words in this text' as text",
                                         "if(id % 3 = 0, 'hot', concat('s', id % 40)) as source")
    got = mixing.op1(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    for r in got:
        assert r.t > 0
    by = (mixing.mix(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"),
                                                 F.first("target").alias("target")).collect())
    for r in by:
        assert abs(r.t - r.target) <= 5.01, r


@pytest.mark.parametrize("doc_id", ["null", "7", "id % 2"])
def test_repeated_and_null_ids_meet_their_targets(spark, monkeypatch, doc_id):
    """Many rows that agree in everything: as many take a copy more as the target
    asks for, whatever their ids."""
    monkeypatch.setattr(mixing, "TIES", 16)
    docs = spark.range(4500).selectExpr(f"cast({doc_id} as long) as doc_id", "'five words in this text' as text",
                                        "concat('s', id % 3) as source")
    by = (mixing.mix(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.count("*").alias("n"),
                                                 F.first("target").alias("target")).collect())
    assert len(by) == 3
    for r in by:
        assert r.n == 1500 and abs(r.t - r.target) <= 5.01, r
