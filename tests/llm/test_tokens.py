import random

import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from meterflow.llm import tokens
from meterflow.llm.common import table
from tests.conftest import SF_MID

LIB = Tokenizer.from_file(str(public_tokenizers.path(tokens.VOCABULARY)))


def library(text):
    return len(LIB.encode(text, add_special_tokens=False).ids) if text else 0


def test_whole_table_against_the_library(spark):
    docs = table(spark, SF_MID, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = tokens.op5(docs).collect()
    assert len(got) == len(text)
    for r in got:
        assert (r.n_bytes, r.n_tokens) == (len(text[r.doc_id].encode()), library(text[r.doc_id]))
        assert r.over_limit == (r.n_tokens > 512)


PARTS = [" ", "  ", "\n", "\t", "\r\n", " ", " ", "\u0085", "\x1c", "\x1f", "'s", "'ll", "don't", "a", "Zz",
         "é", "ß", "漢字", "٣", "½", "12345", "!!", "...", "<|endoftext|>", "<|endof", "\U0001F600", "é",
         "aaaaaaaa", " the", "​", "﻿", "\x00", "_", "-", "https://x.y/z?a=1"]


def test_odd_texts_against_the_library():
    rng = random.Random(5)
    bpe = tokens.loaded(tokens.VOCABULARY)
    for _ in range(4000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 12)))
        assert bpe.count(text) == library(text), repr(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text_against_the_library(text):
    assert tokens.loaded(tokens.VOCABULARY).count(text) == library(text)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "x" * 100000), (5, "word " * 60000), (None, "a<|endoftext|>b"), (6, "hi"), (6, "hi")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as n_bytes")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.op5(docs).collect()), key=str)
    assert got == sorted(((d, len((t or "").encode()), library(t)) for d, t in rows), key=str)
    assert tokens.op5(docs.where("false")).count() == 0
