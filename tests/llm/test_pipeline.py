"""Every stage of the pipeline against a plain version of its decision, on the
rows its predecessor kept."""

import pytest

import corpus_pipeline as P
from meterflow.llm import toxicity
from meterflow.llm.common import DOC_COLS, table
from tests.conftest import SF_MID
from tests.llm import test_decontam, test_mixing, test_secrets, test_simhash


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF_MID, "documents"), []
    for name, stage in P.STAGES:
        kept = stage(spark, docs, SF_MID).cache()
        out.append((name, [r.asDict() for r in docs.collect()], kept.columns, [r.asDict() for r in kept.collect()]))
        docs = kept
    return out


def key(rows):
    return sorted((r["doc_id"], r["text"]) for r in rows)


def test_columns(stages):
    assert [n for n, *_ in stages] == ["toxicity", "simhash", "decontamination", "secrets", "mixing"]
    for name, _, columns, _ in stages:
        assert columns == DOC_COLS + (["copies"] if name == "mixing" else [])


def test_toxicity_rejects(spark, stages):
    _, docs, _, kept = stages[0]
    model = toxicity.train(table(spark, SF_MID, "documents"), table(spark, SF_MID, "labels"))
    words = toxicity.Words()
    ids = [toxicity.word_ids(d["text"], words) for d in docs]
    model.learn_words(words, anew=True)
    want = [d for d, s in zip(docs, model.scores(ids)) if s < 0.5]
    assert key(kept) == key(want) and 0 < len(kept) < len(docs)


def test_one_of_each_group(stages):
    _, docs, _, kept = stages[1]
    comp = test_simhash.brute([(d["doc_id"], d["text"]) for d in docs])
    assert sorted(d["doc_id"] for d in kept) == sorted({c for _, c in comp.values()})
    assert set(key(kept)) <= set(key(docs)) and len(kept) < len(docs)


def test_contaminated_go(spark, stages):
    _, docs, _, kept = stages[2]
    items = [(r.item_id, r.text) for r in table(spark, SF_MID, "benchmark").collect()]
    bad = {r[0] for r in test_decontam.brute([(d["doc_id"], d["text"]) for d in docs], items) if r[5]}
    assert bad and key(kept) == key([d for d in docs if d["doc_id"] not in bad])


def test_secrets_are_masked(stages):
    _, docs, _, kept = stages[3]
    text = {d["doc_id"]: d for d in docs}
    hit = 0
    for d in kept:
        before = text[d["doc_id"]]["text"]
        values = [before[a:b] for a, _, b in test_secrets.brute(before)]
        assert not any(v in d["text"] for v in values)
        assert d["n_chars"] == (len(d["text"]) if d["text"] != before else text[d["doc_id"]]["n_chars"])
        assert bool(values) <= (d["text"] != before)
        hit += bool(values)
    assert len(kept) == len(docs) and hit > 5


def test_sources_reach_their_targets(stages):
    _, docs, _, kept = stages[4]
    size = {d["doc_id"]: len(d["text"].encode().split()) for d in docs}
    of = {}
    for d in docs:
        of[d["source"]] = of.get(d["source"], 0) + size[d["doc_id"]]
    want, taken = test_mixing.brute_targets(of), dict.fromkeys(of, 0)
    for d in kept:
        assert 1 <= d["copies"] <= 3
        taken[d["source"]] += d["copies"] * size[d["doc_id"]]
    for s in of:
        assert taken[s] == pytest.approx(want[s], rel=0.02), s


def test_run_chains_the_stages(spark, stages):
    got = P.run(spark, SF_MID)
    assert key(r.asDict() for r in got.collect()) == key(stages[4][3])


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF_MID, name).where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
