"""From documents to packed training windows, each stage over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns of
``documents``. ``run`` writes each stage's result as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import decontamination, line_dedup, packing, quality_classifier, simhash
from tarmac.llm.common import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good, by a model learnt from the labelled ones among ``docs``.

    Null and empty texts are scored as empty; repeated rows and rows without doc_id are judged each by its text. Without
    labelled documents of both kinds every score is the same: all stay or, if all known ones are bad, none.
    """
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = {c: f"__own_{c}" for c in ("score", "predicted") if c in docs.columns}
    scored = quality_classifier.score_documents(docs.withColumnsRenamed(own), model).where("predicted = 1").drop("score", "predicted")
    return scored.withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand in three or more of them but for the largest doc_id; n_chars follows.

    A null text becomes empty; a null doc_id is the smallest; repeated rows come out alike and all stay. Columns named like
    the stage's own counts keep their values.
    """
    own = {c: f"__own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    kept = line_dedup.dedup_lines(docs.withColumnsRenamed(own)).drop("n_lines", "n_dropped")
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 or more of their five-word shingles: the least (doc_id, text hash).

    Repeated rows are one document, and so are all texts without words; rows without doc_id, or with one doc_id on several
    texts, are documents of their own. A null doc_id is never the least unless a group has no other.
    """
    return simhash.one_of_each(docs).select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the five-word shingles of every test item.

    Null and empty texts hold nothing; rows are told apart by doc_id and text, and repeated ones stay or go together.
    """
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens: their ids, and the digest of these.

    A null or empty text is the end id alone; every row, repeated or not, is a document of its own.
    """
    return packing.pack_documents(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("windows", windows)]

#: Models, fingerprints and encoded texts are beyond SQL; tests/llm/test_pipeline.py holds each stage against a slow version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
