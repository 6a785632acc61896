"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterflow.llm import (chat, decontam, divergence, langid, mixing, phrases, quality, secrets, simhash, tokens,
                           topk, toxicity, trie)
from meterflow.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op1(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op2(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.op5(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op6(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op8(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.op10(table(spark, sf_dir, "documents"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.op12(table(spark, sf_dir, "documents"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op13(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_secrets, op3_chat, op4_decontamination, op5_tokens, op6_simhash, op7_toxicity,
                                  op8_language, op9_quality, op10_phrases, op11_trie, op12_divergence, op13_topk)}
ORACLES: dict[str, str] = {"op3_chat": chat.ORACLE, "op4_decontamination": decontam.ORACLE, "op11_trie": trie.ORACLE,
                           "op12_divergence": divergence.ORACLE, "op13_topk": topk.ORACLE}
