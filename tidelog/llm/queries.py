"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, chat, decontam, idstore, packing, pages, quality, simhash, suffix, tokencount, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_quality_rules", quality.ORACLE)
def op4_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality.judge(docs)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op2_id_store")
def op2_id_store(spark, sf_dir):
    file = bpe.path("byte_bpe_50k.json")
    path = idstore.store(table(spark, sf_dir, "documents").select("doc_id", "text"), file, end_id=2)
    return idstore.read(spark, path, file, end_id=2)


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


@query("op1_token_counts")
def op1_token_counts(spark, sf_dir):
    return tokencount.count(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe.path("word_bpe_49k.json"), limit=2048)


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.score(docs, toxicity.fit(docs, labels.where(toxicity.fold() != 0)))


@query("op5_simhash_components")
def op5_simhash_components(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, radius=4)


@query("op7_perspective_rotation", chat.ORACLE)
def op7_perspective_rotation(spark, sf_dir):
    rows = chat.rotate(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return rows.withColumn("mask", F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["begin"], m["end"])), ","))


@query("op8_page_differencing")
def op8_page_differencing(spark, sf_dir):
    return pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op10_template_decontamination")
def op10_template_decontamination(spark, sf_dir):
    return decontam.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op6_repeated_passages")
def op6_repeated_passages(spark, sf_dir):
    return suffix.removed(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
