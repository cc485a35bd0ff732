"""A corpus pipeline of five operators: quality, line dedup, near-dedup, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bpe, decontam, linededup, neardup, quality
from colloquy.llm._shared import release_scratch, remainder, remove, scratch_root, spare, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labels of the documents it is given."""
    release_scratch(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) != 2)
    (own,) = spare(docs.columns, "score")
    return quality.score(docs, model, name=own).where(F.col(own) >= quality.CUT).drop(own)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that are later copies of repeated runs or of single lines of 5 words or more; n_chars follows the text."""
    release_scratch(spark)
    done = linededup.dedup_lines(docs, min_words=5)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more), the one with the smallest id."""
    release_scratch(spark)
    return neardup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, whole or by its question."""
    release_scratch(spark)
    (own,) = spare(docs.columns, "leaks")
    return decontam.with_leaks(docs, table(spark, sf_dir, "benchmark"), name=own).where(F.size(own) == 0).drop(own)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    release_scratch(spark)
    return bpe.encode_decode(docs, bpe.vocabulary("word_bpe_49k.json"), block_bytes=8_000_000)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", decontaminate),
    ("bpe_tokens", tokenize),
]

#: The classifier is trained, which SQL cannot express; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Each stage's result is written to the shared folder and read again."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        out, before = stage(spark, docs, sf_dir), path
        path = f"{scratch_root(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
