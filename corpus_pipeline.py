"""The corpus pipeline: five stages over ``documents``, each a call of one corpus operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents.  All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knownat.llm import decontam, mixing, quality, simhash, tokens
from knownat.llm.common import prepare, shared_folder, stored_order
from knownat.llm.queries import table, tokenizer_path


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the classifier rejects go."""
    prepare(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each SimHash group stays."""
    prepare(spark)
    return simhash.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that contain a benchmark item go."""
    prepare(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents in training order, each as often as its source's target takes it."""
    prepare(spark)
    return mixing.mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token files in the training order that the mixing stage stored, read back."""
    prepare(spark)
    folder, index = tokens.write_tokens(docs, tokenizer_path(), order=stored_order())
    return tokens.with_starts(tokens.read_tokens(folder, index)).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


STAGES = [
    ("quality classifier", keep_good_quality),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources", mix_sources),
    ("token-id output", write_token_files),
]

#: Trained networks, XXH64 votes and tokenizers are beyond SQL; tests check each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder before the next."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
