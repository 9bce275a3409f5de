"""A training corpus from raw documents: five stages, each written as Parquet before the next.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept:

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: of every group of near copies (5-word shingles, similarity 0.8) the document with the least id stays.
3. repeats: byte strings of 200 or more that occur elsewhere are cut out; every document
   stays, with `n_chars` counted anew, also when nothing of its text is left.
4. decontaminate: documents with a verified passage of a benchmark item go.
5. encode: token counts and digests of ids and of decoded bytes.

Stages 1 to 4 return the columns of `documents`. Null texts are read as empty; rows
without an id are never dropped by stages 2 and 4. SQL cannot express stages 1 to 3 and
5, so there is no ORACLE_SQL; the stages are tested against plain versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutspark.llm import bpe, decontam, neardup, quality, suffixes
from boutspark.llm.lean import small_batches
from boutspark.staging import stage


# Fixed value: shingle similarity from which documents are near copies (op5 asks for 85).
NEAR_PERCENT = 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return neardup.keep_first(docs, percent=NEAR_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    cut = suffixes.remove_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    kind = docs.schema["n_chars"].dataType
    return cut.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(kind))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = _table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
