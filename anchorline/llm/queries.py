"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, htmltext, langid, linededup, merkle, minhash, mpegts, packing, prefixtrie, quality, simhash, toxicity
from .common import table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(table(spark, sf_dir, "documents"), vocabulary_path())


def op3_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.query(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(table(spark, sf_dir, "conversations"))


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.query(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.query(table(spark, sf_dir, "pages"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.query(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.query(table(spark, sf_dir, "documents"), vocabulary_path())


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.query(table(spark, sf_dir, "documents"))


def op12_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.query(table(spark, sf_dir, "conversations"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.query(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_packing, op3_mpegts, op4_chat, op5_linededup, op6_simhash, op7_quality, op8_html, op9_langid, op10_bpe, op11_minhash, op12_prefixtrie, op13_merkle)}
ORACLE_SQL: dict[str, str] = {"op4_chat": chat.ORACLE, "op11_minhash": minhash.ORACLE, "op12_prefixtrie": prefixtrie.ORACLE, "op13_merkle": merkle.ORACLE}
