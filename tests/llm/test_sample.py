"""The bounded training samples hold on repeated ids."""

from meterflow.llm import langid
from meterflow.llm.common import labelled_sample


def test_one_row_per_chosen_id(spark):
    docs = spark.range(6000).selectExpr("if(id < 5000, 1L, id) as doc_id", "concat('text ', id % 7) as text", "'en' as lang")
    labels = spark.range(4998, 6000).selectExpr("if(id < 5000, 1L, id) as doc_id", "cast(id % 2 as int) as toxic")
    got = labelled_sample(docs, labels, "toxic", 5, 0, 5).collect()
    assert len(got) <= 10 and len({r.doc_id for r in got}) == len(got)
    assert {r.y for r in got} == {0, 1}


def test_language_sample_is_distinct(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid.BiGru, "fit", lambda self, w, y: seen.append(len(w)))
    docs = spark.range(4000).selectExpr("if(id < 3000, 3L, id) as doc_id", "concat('word und text ', id % 3) as text",
                                        "if(id % 2 = 0, 'en', 'de') as lang")
    langid.train(docs, per_language=4)
    assert seen and seen[0] <= 2 * 4 * langid.TRAIN_WINDOWS
