"""Corpus pipeline: documents to packed sequences in five stages, each of which is one of the llm operators.

Stages take (spark, docs, sf_dir); each works on all rows that its predecessor kept, and all but the last return the
columns of documents, extra ones too. run() stores every stage's rows as Parquet in the shared scratch folder.

Defined cases, as in the operators: a null text counts as empty, so it is junk and goes in the first stage. Rows
without an id are equal, similar and packed like others, but have no place among similar texts and stay there. Of
repeated rows of one id and text one stays. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import release, table, tables_written, written
from tessera.llm.exact import exact_dedup
from tessera.llm.mixing import mix_documents
from tessera.llm.packing import best_fit_pack, default_tokenizer
from tessera.llm.quality import keep_good, prepared
from tessera.llm.simhash import keep_dissimilar


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier finds neither junk nor abusive."""
    return keep_good(*prepared(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by similarity 0.8 or more on five-word shingles, the row with the smallest id."""
    return keep_dissimilar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights; one that two epochs take comes twice."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document with their sequences and places."""
    return best_fit_pack(docs, default_tokenizer())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: The classifier, the fingerprints and the tokeniser can't be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = tables_written()
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before, keep=1)  # what the stage itself has stored
    return docs
