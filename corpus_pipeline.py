"""A corpus pipeline over `documents`: each stage calls one operator of heapscope.llm, its result is written as
Parquet and reread as the next stage's documents.

Stages: documents that the toxicity classifier scores 0.7 or more go; of each group of near duplicates (five-word shingles,
similarity 0.8) the document of the smallest doc_id stays; personal numbers and dates get pseudonyms; sources are
mixed to their target weights (a document has a row for each time that blocks of it are taken, with the words taken); what is left is
encoded. All stages but the last return the columns of documents. Null or empty texts pass the first three stages and are in no mix, which has no words of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heapscope.llm import bpe, minhash, mixing, pii, toxicity
from heapscope.llm.common import staged, table, unstage


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.pseudonymised(docs, pii.session_key(spark))
    return out.withColumn("n_chars", pii.F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and ids (little-endian unsigned 32-bit) of every row left."""
    return bpe.bpe_encode(docs, bpe.vocabulary_path(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("pii", pseudonymise),
    ("mixing", mix),
    ("bpe", encode),
]

#: SQL cannot express the trained classifier, the hashed permutations or the BPE vocabulary; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            unstage(before)
        before = docs
    return docs
