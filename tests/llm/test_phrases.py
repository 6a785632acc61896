import hashlib

import numpy as np

from meterflow.llm import phrases
from meterflow.llm.common import table
from tests.conftest import SF_MID


def names(text, level):
    """Phrase names of one level with the bytes they span."""
    x = phrases._BYTE_NAMES[np.frombuffer(text, np.uint8)]
    spans = np.arange(len(x) + 1)
    for k in range(level):
        # spans: follow the cuts by parsing the marks of positions
        first = np.zeros(len(x), bool)
        first[0] = True
        x, _ = phrases.parse_level(x, first, k)
    return set(x.tolist())


def slow_sketch(text):
    """One text by itself, level by level, in plain Python sets."""
    x, level, found = phrases._BYTE_NAMES[np.frombuffer(text, np.uint8)], 0, set()
    while len(x):
        first = np.zeros(len(x), bool)
        first[0] = True
        x, _ = phrases.parse_level(x, first, level)
        level += 1
        if level >= phrases.FROM_LEVEL or len(x) == 1:
            found |= set(x.tolist())
        if len(x) == 1:
            break
    slots = [0] * phrases.SLOTS
    for s in range(phrases.SLOTS):
        own = [n // phrases.SLOTS for n in found if n % phrases.SLOTS == s]
        slots[s] = min(own) % 65535 + 1 if own else 0
    return slots


def test_whole_table(spark):
    docs = table(spark, SF_MID, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(text)
    got = {r.doc_id: r for r in phrases.op10(docs).collect()}
    assert sorted(got) == ids
    own = {i: slow_sketch(text[i].encode()) for i in ids[:150]}
    for k, i in enumerate(ids):
        after, n = text[ids[(k + 1) % len(ids)]], len(text[i])
        new = text[i][:n - n // 2] + after[:n // 2]
        r = got[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        if i in own:
            assert r.fingerprint == "".join(f"{s:04x}" for s in own[i])
            assert r.edited_fingerprint == "".join(f"{s:04x}" for s in slow_sketch(new.encode()))
    by_text = {}
    for i in ids:
        assert by_text.setdefault(text[i], got[i].fingerprint) == got[i].fingerprint
    long = [r for r in got.values() if r.n_chars > 1000]
    assert 0.2 < np.mean([r.near_edited for r in long]) < 0.6
    assert np.mean([r.near_next for r in long]) < 0.1


def test_equal_substrings_share_phrases_at_any_offset(spark):
    rng = np.random.default_rng(2)
    shared = rng.integers(97, 123, 3000).astype(np.uint8).tobytes()
    for shift in (0, 1, 2, 3, 7, 50):
        a, b = names(shared, 3), names(rng.integers(97, 123, shift).astype(np.uint8).tobytes() + shared, 3)
        assert len(a & b) >= 0.9 * len(a)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "aaaaaaaaaaaa"), (5, "é" * 7), (6, "\U0001F600 x " * 9000), (7, "same"),
            (7, "same"), (9, "tail"), (None, "no id"), (8, "b" * 300000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as part", "3 as own")
    got = phrases.op10(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].n_chars == 0 and by[1].fingerprint == by[2].fingerprint == "0" * 256
    assert by[1].near_next == 1 and by[2].near_next == 0
    assert by[5].edited_sha256 == hashlib.sha256(("é" * 4 + "\U0001F600 x").encode()).hexdigest()
    assert by[None].edited_sha256 == hashlib.sha256(b"no ").hexdigest()  # its next is doc 1, empty
    assert by[9].edited_sha256 == hashlib.sha256(b"tano").hexdigest()
    one = phrases.op10(docs.where("doc_id = 9")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"tata").hexdigest() and one[0].near_next == 1
    assert phrases.op10(docs.where("false")).count() == 0
