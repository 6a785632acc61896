import hashlib

import pytest

from meterflow.llm import chat
from meterflow.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_MID
from tests.oracle import compare


def test_oracle_on_whole_table(spark, duck_mid):
    assert compare(QUERIES["op3_chat"](spark, SF_MID), duck_mid, ORACLES["op3_chat"]) == []


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        md5 = hashlib.md5((x or "").encode()).hexdigest()
        convs.setdefault(c, []).append((t is None, t or 0, r is None, r or "", x is None, md5, x or ""))
    said = {c: [(r[3] if not r[2] else None, r[6] if not r[4] else None) for r in sorted(v)] for c, v in convs.items()}
    out = []
    for c, s in said.items():
        longer = any(len(o) > len(s) and o[:len(s)] == s for o in said.values())
        earlier = any(o == s and (d is not None) and (c is None or d < c) for d, o in said.items())
        if not longer and not earlier:
            text = "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in s)
            out.append((c, len(s), text))
    return sorted(out, key=str)


ROWS = ([(c, t, ["user", "bot"][t % 2], f"turn {t}") for c in range(1, 6) for t in range(c)]      # snapshots 1..5
        + [(10 + c, t, "user", "hot") for c in range(50) for t in range(2)]                          # equal ones
        + [(70, t, "user", "hot") for t in range(3)]
        + [(80, 0, None, None), (81, 0, "", ""), (82, None, "user", "x"), (82, 1, "user", "a"), (None, 0, "user", "lost"),
           (90, 0, "user", "same"), (90, 0, "user", "same"), (91, 0, "user", "same")]
        + [(92, 0, "user", x) for x in ("tie one", "tie two", None, "tie three")]
        + [(95, t * 700, "user", f"long {t % 5}") for t in range(3000)]
        + [(96, t * 9, "user", f"long {t % 5}") for t in range(2999)])


@pytest.mark.parametrize("block", [1024, 3])
def test_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 as pos", "2 as a", "3 as c", "4 as block")
    got = sorted(map(tuple, chat.collapse(turns).collect()), key=str)
    assert got == brute(ROWS)
    assert [r[0] for r in got if r[0] in (95, 96)] == [95] and [r[0] for r in got if r[0] and r[0] < 6] == [5]
    assert chat.collapse(turns.where("false")).count() == 0
