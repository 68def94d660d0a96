"""The corpus pipeline: raw documents to packed training sequences, each stage one operator over all its predecessor kept.

run() writes every stage as Parquet into the folder that spark.checkpoint.dir names, and the next stage reads it again,
so that a lost executor costs no more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm.common import col, materialize, release, unused, written
from tamarack.llm.language import identify
from tamarack.llm.mixing import mix
from tamarack.llm.packing import packed
from tamarack.llm.simhash import drop_near_duplicates
from tamarack.llm.suffix import cut_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with `lang` set to it. Null, empty and unintelligible texts go."""
    (score,) = unused(docs.columns, "_similarity")
    return identify(docs, score=score).select(*map(col, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the lowest doc_id; rows without an id stay."""
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each passage of 50 words or more stays at its first place only; a document of which nothing is left goes."""
    return cut_repeats(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the schedule over tempered source weights has them, each of them at least once."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin, position): which words of a document lie where in which sequence."""
    return packed(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mix", target_mix),
    ("packing", packing),
]

#: No SQL expresses signatures, clustered centroids and best-fit packing; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        mark = written()
        docs = materialize(stage(spark, docs, sf_dir))
        release(max(mark - 1, 0) if stage is not STAGES[0][1] else mark, written() - 1)  # what the stage wrote, and what it read
    return STAGES[-1][1](spark, docs, sf_dir)
