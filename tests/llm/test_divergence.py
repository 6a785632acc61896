import re
from collections import Counter

import pytest

from meterflow.llm import divergence
from meterflow.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_SMALL
from tests.oracle import compare


def test_oracle_on_whole_table(spark, duck_small):
    assert compare(QUERIES["op12_divergence"](spark, SF_SMALL), duck_small, ORACLES["op12_divergence"]) == []


def brute(rows):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for la, _, ts in docs if la == lang for t in set(ts))
        kept = {t for t, n in held.items() if n >= 3}
        used = {}
        for la, s, ts in docs:
            if la == lang:
                used.setdefault(s, Counter()).update(t for t in ts if t in kept)
        def shares(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        p = {s: shares(c) for s, c in used.items()}
        q = shares(sum(used.values(), Counter()))
        for s in used:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in used if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if used[s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, 200)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(found[:top])]
    return sorted(out, key=str)


ROWS = ([("en", "a", "The cat sat on the mat"), ("en", "a", "the CAT sat"), ("en", "b", "the cat ran"), ("en", "b", "The dog the dog"),
         ("en", "c", None), (None, None, "the the x"), (None, "a", "the x"), ("", "", "x the"), ("xx", "lone", "solo solo"),
         ("de", "a", "Über straße über"), ("de", "b", "über Straße STRASSE"), ("de", "b", "über 12 straße x"), ("de", "", ""),
         ("zz", "a", "one"), ("zz", "b", "two")]
        # prefixes that many documents share although no longer term is kept
        + [("en", f"s{i % 3}", f"prefixes{i} prefixed prefix{'y' * i} {'z' * 40}{i % 4} same") for i in range(9)]
        + [("en", "a", "same same same")] * 4
        + [("en", f"w{i % 2}", " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(260))) for i in range(4)]
        + [("en", "w0", " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)} " * (j % 7) for j in range(260)))])


@pytest.mark.parametrize("held,slices", [(400_000, 1 << 20), (5, 7)])
def test_odd_rows_against_brute_force(spark, monkeypatch, held, slices):
    df = spark.createDataFrame(ROWS, "lang string, source string, text string").selectExpr(
        "*", "1 as n", "2 as level", "'x' as term", "3 as id", "4 as v")
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "SLICE", slices)
    got = sorted(map(tuple, divergence.op12(df).select("lang", "source", "part", "item", "value", "rank").collect()), key=str)
    assert got == brute(ROWS)
    assert divergence.op12(df.where("false")).count() == 0


def test_refinement_drops_prefixes_before_longer_ones_are_counted(spark, monkeypatch):
    """A prefix that holds leaves its level, longer ones of two documents go; by
    broadcast and by shuffled joins alike."""
    df = spark.createDataFrame([("en", "s", f"abcdefgh{chr(97 + i)} qq{chr(97 + i)}rstuv") for i in range(4)],
                               "lang string, source string, text string")
    for bound in (200_000, 0):
        monkeypatch.setattr(divergence, "BROADCAST", bound)
        counts = divergence.counted(df)
        alive = {(r.above, bytes(r.prefix)) for r in divergence.alive_prefixes(counts)[0].collect()}
        assert alive == {(4, b"abcd"), (8, b"abcdefgh")}
        assert divergence.kept_terms(counts).count() == 0
        kept = divergence.kept_terms(divergence.counted(df.unionAll(df).unionAll(df)))
        assert {(bytes(r.term), r.n_term) for r in kept.collect()} == {
            (w, 3) for i in range(4) for w in (b"abcdefgh%c" % (97 + i), b"qq%crstuv" % (97 + i))}
