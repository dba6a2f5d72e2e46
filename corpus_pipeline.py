"""From raw documents to token digests: quality, near duplicates, leaks, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``.  Null and empty texts pass the near-duplicate and later
stages; the quality model decides on them as on any other text.  Columns of other names
than those of ``documents`` stay as they are; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import crc_mod, free, materialise, table, vocabulary_path
from sparkloom.llm.decontamination import without_leaks
from sparkloom.llm.jaccard_join import classes
from sparkloom.llm.pii import pseudonymise
from sparkloom.llm.quality import score, train
from sparkloom.llm.queries import SURROGATE_KEY
from sparkloom.llm.sentencepiece_codec import digests


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    model = train(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0))
    names = free(docs, "score"), free(docs, "predicted")
    return score(docs, model, docs.columns, names=names).where(F.col(names[1]) == 1).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class (five words, Jaccard of 0.8) the document with the smallest id stays.

    A row without an id stays once for each different text.
    """
    kept = classes(docs, width=5, percent=80).where("doc_id = component_id").select("doc_id").distinct()
    stays = docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    nameless = docs.where("doc_id is null").dropDuplicates(["text"])
    return stays.unionByName(nameless)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities are replaced by surrogates; ``n_chars`` follows the new text."""
    out = pseudonymise(docs, SURROGATE_KEY, count=free(docs, "n_entities")).withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each document."""
    return digests(docs, vocabulary_path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: SQL cannot express the models and the encoder; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
