"""The corpus pipeline: five operators of pixelframe.llm in a row over documents, each written and read again.

A stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. Columns that documents have besides are carried along, whatever their names.

Defined results: an empty table gives no rows. Null and empty texts have no language and go at the first stage, null sources
are a source of their own. A row is judged by its own text, so null and repeated ids are rows like others until the
second stage, where repeated rows are reduced to one; rows of one id and different texts stay apart and are drawn
together. Of equal or similar texts the smallest id stays, a null id last. Texts may be of any length.

Every stage sets the session's spark.sql.execution.arrow.maxBytesPerBatch to BATCH, which holds until it is set again (the
rows are read after the stage has returned).
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pixelframe.llm.bpe import encode
from pixelframe.llm.common import drop, shared_dir
from pixelframe.llm.jaccard import keep_one
from pixelframe.llm.langid import learn_and_label
from pixelframe.llm.mixing import mix
from pixelframe.llm.pii import find_pii, redact

#: Bytes after which an Arrow batch ends. A batch stands in the JVM's direct memory and in the Python worker, beside the one
#: before it; by Spark's 10,000 rows or 64 MB it is all texts of a task. No row is left out or cut.
BATCH = 4 << 20


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go (null, or without a letter); lang is what the text is found to be in. A row is
    judged by its own text, whatever its id."""
    found = learn_and_label(docs, carry=tuple(docs.columns)).where("lang_pred != 'und'")
    return found.select(*[F.col("lang_pred" if c == "lang" else f"_{k}").alias(c) for k, c in enumerate(docs.columns)])


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, once; null ids come last."""
    return keep_one(docs).select(*docs.columns)


@in_small_batches
def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers are replaced by their kind in brackets."""
    return redact(docs, find_pii(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@in_small_batches
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to their weights: documents that no draw took go, those drawn twice stand twice."""
    return mix(docs).select(*docs.columns)


@in_small_batches
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(docs, path, public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("pii", pii), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: No stage but PII's base patterns is a matter of SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet in the shared folder; a stage's files go when its
    successor is written."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_dir(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            if old is not None:
                drop(old)
            docs = old = spark.read.parquet(path)
            old.cut_path = path
    return docs
