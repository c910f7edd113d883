"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from finspan.llm import byte_bpe, decontaminate, line_dedup, minhash_near, quality_divergence
from finspan.llm.common import written
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Least Jaccard similarity, in percent, of documents that the near-duplicate stage takes for copies; op10 has 85.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_divergence.keep_good(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated blocks of lines go from later documents, whose n_chars follows; documents of which nothing is left go."""
    out = line_dedup.delete_repeated_lines(docs).where("removed_lines = 0 or trim(text) <> ''")
    n_chars = F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the least doc_id."""
    return minhash_near.one_of_each(docs, NEAR_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with the benchmark go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids (binary, little-endian unsigned 32-bit), which decode to the text."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("minhash_near", near_deduplication),
    ("decontaminate", benchmark_decontamination),
    ("byte_bpe", encoding),
]

#: Alignment, signatures and the tokenizer have no SQL form; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
