"""The corpus pipeline over ``documents``: each stage is written as Parquet and read again by the next.

Rejected toxic documents go, repeated lines are cut out, one document of each near-duplicate class stays, contaminated
documents go, and what is left is packed into sequences. Only lines and rows are taken out; the columns stay those
of ``documents``, with ``n_chars`` following the text, until the last stage.

Documents that the line stage leaves without text stay rows of empty text; being of equal text, one of them survives the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from surveyloom.llm.columns import spare_names
from surveyloom.session import materialize

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted to the labelled documents of ``docs``, without those held out for checking."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    [score] = spare_names(docs, "toxic_score")
    return toxicity.score(docs, model, score_col=score).where(F.col(score) < 0.5).drop(score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    total, removed = spare_names(docs, "n_lines", "n_removed")
    out = line_dedup.dedup_lines(docs, total_col=total, removed_col=removed)
    cut = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", cut).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, threshold=0.8).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, benchmark).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), end_id=0, capacity=CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Tokens and a fitted model are beyond SQL; the tests compare the pipeline with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
