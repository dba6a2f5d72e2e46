"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import crc_mod, table, vocabulary_path

#: The key of the registered queries' surrogates; a deployment passes its own secret.
SURROGATE_KEY = "sparkloom"


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.jaccard_join import classes

    return classes(table(spark, sf_dir, "documents"), width=4, percent=85)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.decontamination import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.sentencepiece_codec import digests

    return digests(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.token_files import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.fingerprints import with_edited

    return with_edited(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.language_id import identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(crc_mod("doc_id", 4) != 2))
    return identify(docs, model, ["doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out")])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.toxicity import score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = train(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return score(docs, lexicon, ["doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out")])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.quality import score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return score(docs, model, ["doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out")])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.pii import pseudonymise

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, SURROGATE_KEY).select("doc_id", "n_entities", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {}
