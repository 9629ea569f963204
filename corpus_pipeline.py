"""A training corpus from documents in five stages. Each works on all that the one before it kept.

Every stage is (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents. run() writes
each stage's rows as Parquet in the shared folder and reads them again for the next, so a lost executor costs no stage.

In every stage an empty table gives no rows, extra columns may have any names and go along, and rows with one doc_id or
with none are documents of their own. What nulls, empty texts and ties come to is said at each stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, decontam, packing, quality, shared, simhash, suffix


#: What the stage before wrote between its steps; its rows have been written out when the next one begins.
_LEFT: list[str] = []


def _stage(make):
    @functools.wraps(make)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _LEFT:
            shared.drop(spark, _LEFT.pop())
        n = len(shared.MADE)
        out = make(spark, docs, sf_dir)
        _LEFT.extend(shared.MADE[n:])
        return out

    return stage


@_stage
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts fail them; equal texts of a language have one verdict, by
    the text and its language alone; a null language shares the reference of unknown ones."""
    return quality.keep_good(docs)


@_stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8): the one with the smallest
    doc_id, and of rows with that id one by a hash of the text. Null and empty texts are copies of each other. Rows without
    an id stay."""
    return simhash.keep_first(docs, words=5, similarity=0.8)


@_stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier, by doc_id and then by a hash of the text. One of which nothing is left
    stays, as an empty text; a null text stays null. Rows without an id lose nothing."""
    return suffix.strip(docs)


@_stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts and rows without an id stay. An item that is null or
    without an id is no item; equal items count once."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens. A null or empty text is one piece, the end
    id alone; pieces alike in all columns take any of their places."""
    return packing.pack(docs, bpe.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality_rules", good),
    ("simhash_near_dedup", without_copies),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: SQL can't express these stages; tests/llm/test_pipeline.py holds each against brute force on what the one before kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.keep(stage(spark, docs, sf_dir), name)
    return docs
