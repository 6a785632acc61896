import random

import xxhash
from pyspark.sql import Row

from meterflow.llm import simhash
from meterflow.llm.common import components, table
from tests.conftest import SF_MID


def brute_fp(text, k=4):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(docs):
    fps = {d: brute_fp(t) for d, t in docs}
    ids = sorted(fps)
    links = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    comp = brute_components(ids, links)
    return {d: (f"{fps[d]:016x}", comp[d]) for d in ids}


def test_whole_table_against_brute_force(spark):
    docs = table(spark, SF_MID, "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6(docs).collect()}
    assert got == want
    assert len({c for _, c in got.values()}) < len(got)


def test_cells_blocks_and_fine_grid_lose_no_link(spark):
    rng = random.Random(3)
    pts = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            pts.add(centre ^ sum(1 << b for b in set(rng.choices(range(64), k=rng.randint(0, 6)))))
    pts = sorted(p - (1 << 64) if p >> 63 else p for p in pts)
    m = (1 << 64) - 1
    want = brute_components(pts, [(a, b) for a in pts for b in pts
                                  if a < b and ((a ^ b) & m).bit_count() <= 4])
    df = spark.createDataFrame([Row(fp=p) for p in pts])
    for kw in ({"block": 7}, {"fine": True}, {"fine": True, "block": 5}, {}):
        edges = simhash.links(df, **kw).collect()
        assert all(((e.a ^ e.b) & m).bit_count() <= 4 for e in edges)
        assert brute_components(pts, [(e.a, e.b) for e in edges]) == want, kw


def test_components_long_path_and_empty(spark):
    path = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in components(path).collect()} == {0}
    assert components(path.where("a < 0")).count() == 0


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One TWO"), (6, "é " * 9000),
            (None, "only here and nowhere else"), (7, "x"), (7, "x"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "'a' as fp", "1 as root", "2 as component_id", "0 as key")
    got = [(r.doc_id, r.component_id) for r in simhash.op6(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (3, 1), (8, 1), (4, 4), (5, 4), (6, 6),
                                           (None, None), (7, 7), (7, 7)], key=str)
    assert simhash.op6(docs.where("false")).count() == 0
    full = docs.selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars", "'z' as __key")
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(full).collect()]
    assert sorted(kept, key=str) == sorted([(1, None), (4, "one two"), (6, "é " * 9000), (7, "x"),
                                            (None, "only here and nowhere else")], key=str)
