"""From raw documents to packed training sequences, in stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
has kept, and is written as Parquet and read again before the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rondelle.llm.exact_dedup import exact_groups
from rondelle.llm.packing import pack_documents
from rondelle.llm.quality import with_quality
from rondelle.llm.shared import drop_folder, new_folder
from rondelle.llm.shingle_copies import without_near_copies

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored as empty, whole texts are read, repeated
    rows and ties are scored each, null sources and langs are sites of their
    own; an empty table gives an empty result.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return with_quality(docs, labels).where("kept").select(*docs.columns)


def keep_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the smallest doc_id; of equal or null ids the first by place in the files.

    Null counts as empty, so one row without text stays; an empty table gives an
    empty result.
    """
    return exact_groups(docs).where("kept").select(*docs.columns)


def keep_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (5-word shingles, similarity 0.8 or more): the smallest doc_id.

    Null ids give way to any id, of equal ids one row stays; texts without words
    are alike; an empty table gives an empty result.
    """
    return without_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, with their place in a sequence.

    A null or empty text is one piece with the end id alone, a long text has as
    many pieces as it needs; an empty table gives an empty result.
    """
    return pack_documents(docs.select("doc_id", F.col("text")), TOKENIZER)


STAGES = [("quality", keep_quality), ("exact_dedup", keep_exact), ("near_dedup", keep_near), ("packing", pack)]

#: Not expressible in SQL (model, fingerprints, tokenizer); see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one.

    Each stage's rows are written to the shared folder and read again; a stage's
    table is dropped once the next one has been written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_folder(spark, before)
        before = path
    return docs
