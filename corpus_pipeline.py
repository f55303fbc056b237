"""Document pipeline: quality, near-dedup, decontamination, PII, tokens. Each stage reads what the one before it wrote.

ORACLE_SQL is None: the stages learn models, link sets and run merges, which SQL can't express; tests hold them against brute force.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import bpe, decontaminate, dedup, pii, quality
from tidewatch.llm.common import read, small_batches, stored
from tidewatch.llm.queries import BYTE_BPE

ORACLE_SQL = None


# Stage functions take (spark, docs, sf_dir). Null texts count as empty: they are scored like any text, never near copies, never
# contaminated, hold no personal data and have no tokens. Empty tables pass through. All columns of docs are kept but by the last.
# Those that send texts to Python workers lower the size of the session's batches first.

def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.accept(docs, read(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    small_batches(spark)
    return bpe.round_trip(docs, BYTE_BPE, keep=False)


STAGES = [("quality", accept_quality), ("near_dedup", keep_one_of_near_copies), ("decontaminate", drop_benchmark), ("personal_data", redact_personal_data), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
