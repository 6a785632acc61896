import hashlib
import re

from meterflow.llm import decontam
from meterflow.llm.queries import ORACLES, QUERIES
from meterflow.llm.common import table
from tests.conftest import SF_MID
from tests.oracle import compare


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                found = grams.get(tuple(w[k:k + n]))
                if found is not None:
                    hit |= set(range(k, k + n))
                    ids |= found
        text = ",".join(sorted(str(i) for i in ids if i is not None))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(text.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_oracle_on_whole_table(spark, duck_mid):
    assert compare(QUERIES["op4_decontamination"](spark, SF_MID), duck_mid, ORACLES["op4_decontamination"]) == []


ITEMS = [(1, "One two three four five"), (2, "alpha Beta gamma " * 6), (3, ""), (4, None), (5, "one"),
         (10, "Größe über alles: ist 12 nicht Ü"), (9, "one two three four five"), (None, "null item words here"),
         (2, "alpha Beta gamma " * 6)]
DOCS = [(1, "x ONE-two; three four five y"), (2, "alpha beta gamma " * 40), (3, None), (4, ""), (5, "... !!"),
        (6, "größe über alles ist 12 nicht Ü"), (7, "one " * 5), (8, "clean text only"), (8, "clean text only"),
        (9, "filler " * 3000 + "one two three four five"), (None, "null item words here"),
        (11, "one two three four six"), (12, "alpha beta gamma " * 4), (12, "alpha beta gamma " * 4)]


def test_odd_rows(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr(
        "*", "1 as w", "2 as h", "3 as at", "4 as key", "5 as items")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as gram", "1 as len")
    want = brute(DOCS, ITEMS)
    assert sorted(map(tuple, decontam.op4(docs, bench).collect()), key=str) == want
    # everything shuffled; windows broadcast without their ids
    plans, answers = [], []
    total = decontam.windows(bench).count()
    for rows in (0, total, 10 ** 6):
        per = decontam.judged(docs, bench, broadcast_rows=rows)
        plans.append(per._jdf.queryExecution().optimizedPlan().toString())
        answers.append(sorted((str(r.doc_id), r.n_hit, [x["id"] for x in r["items"]], r.copies) for r in per.collect()))
    assert answers[0] == answers[1] == answers[2] and len({p.count("Join") for p in plans}) == 3
    assert [a[:2] for a in answers[0]] == sorted({(str(w[0]), w[2]) for w in want})
    assert decontam.op4(docs.where("false"), bench).count() == 0
    none = decontam.op4(docs, bench.where("false")).collect()
    assert len(none) == len(DOCS) and not any(r.n_hit or r.contaminated for r in none)


def test_stage_and_span_removal(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' lang", "'s' source", "1L n_chars", "'q' as __k")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = [(r.doc_id, r.text) for r in decontam.drop_contaminated(docs, bench).collect()]
    bad = {str((d, h)) for d, _, h, _, _, c in brute(DOCS, ITEMS) if c}
    assert bad and sorted(kept, key=str) == sorted(
        [(d, t) for d, t in DOCS if not brute([(d, t)], ITEMS)[0][5]], key=str)
    cleaned = {r.doc_id: r.text for r in decontam.remove_spans(docs, bench).collect()}
    assert cleaned[1] == "x y" and cleaned[11] == "two three four six" and cleaned[8] == "clean text only"
