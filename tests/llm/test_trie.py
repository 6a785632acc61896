import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from meterflow.llm import trie
from meterflow.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_MID
from tests.oracle import compare


def test_oracle_on_whole_table(spark, duck_mid):
    assert compare(QUERIES["op11_trie"](spark, SF_MID), duck_mid, ORACLES["op11_trie"]) == []


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            md5 = hashlib.md5((x or "").encode()).hexdigest()
            own[c].append((t is not None, t or 0, r or "", md5, x or ""))
    own = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        leaves[n] = sum(leaves[k] for k in kids[n]) if kids[n] else 1
        saved[n] = (len(members[n]) - 1) * words + sum(saved[k] for k in kids[n])
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 as pos", "2 as a", "3 as words", "4 as w", "5 as block", "6 as len")
    got = sorted((tuple(r) for r in trie.trie(df).collect()), key=str)
    assert got == brute(rows)
    return df


ROWS = ([(c, t, ["user", "bot"][t % 2], f"turn {t} of {c % 3}") for c in range(0, 45) for t in range(c % 6)]
        + [(c, t, "user", "one two  three") for c in range(200, 260) for t in range(5)]                    # copies
        + [(300, None, None, None), (300, None, "", ""), (300, 4, "u", "x y"), (301, 4, "u", "x y"), (None, 1, "u", "lost"),
           (-3, 0, "u", "a"), (-3, 1, "u", "b"), (-20, 0, "u", "below"), (0, 9, "u", "late\tword s")]
        + [(320, 0, "u", x) for x in ("tie 2", "tie 1", "tie 3")] + [(320, 1, "u", "same")] * 12              # repeated rows
        + [(400, t, "u", f"long {t % 3}") for t in range(60)] + [(410, t, "u", f"long {t % 3}") for t in range(50)])


@pytest.mark.parametrize("local,block", [(1024, 4096), (6, 3)])
def test_odd_rows_against_brute_force(spark, monkeypatch, local, block):
    """In memory only, and by rounds of splits over tiny blocks."""
    monkeypatch.setattr(trie, "LOCAL", local)
    monkeypatch.setattr(trie, "BLOCK", block)
    df = check(spark, ROWS)
    assert trie.trie(df.where("false")).count() == 0


def test_turnless_conversations(spark):
    """A base that is absent gives no turns; what h skips is gone."""
    rows = [(c, 0, "u", "only") for c in range(1, 20)]
    check(spark, rows)
    assert {r.depth: r.n_convs for r in trie.trie(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string")).collect()}[0] == 19


def test_components_halve():
    """A path of n nodes is solved by a centroid's split, not node by node."""
    n = 2000
    w, parent = list(range(n, 0, -1)), [i - 1 for i in range(n)]
    acc = [[0] * n]
    trie._finish_one(w, parent, [[1] * n], acc)
    assert acc[0] == list(range(n, 0, -1))
