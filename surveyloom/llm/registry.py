"""Registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm import centroids, decontaminate, language_id, line_dedup, near_dedup, packing, periodic_runs, quality_rules, suffix_dedup, token_files, toxicity, url_rules, warc
from surveyloom.llm.columns import let

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*url_rules.SITE_RULES, *url_rules.PATTERN_RULES]
    out = url_rules.judge_urls(_table(spark, sf_dir, "pages"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict", "matched")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge_quality(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_files.read_digests(token_files.write_tokens(docs, public_tokenizers.path(TOKENIZER), end_id=1))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_bytes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"), min_bytes=0)
    out = warc.read_archives(manifest, keep_payload=False).withColumnRenamed("id", "page_id")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(_table(spark, sf_dir, "documents"), threshold=0.8)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=0, capacity=2048)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64.0)


def planted_periods(docs: DataFrame) -> DataFrame:
    """The documents, with the words of every tenth id (by CRC-32) made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        first = g % n
        period = 1 + F.floor((n - first) / (3 + g % 8))
        at = lambda i: F.when(i < first, i).otherwise(first + (i - first) % period)
        return F.array_join(F.transform(words, lambda w, i: F.get(words, at(i.cast("long")).cast("int"))), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    periodic = let(words, lambda held: F.when(F.size(held) > 0, planted(held)).otherwise(F.lit("")))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.collapse_runs(planted_periods(_table(spark, sf_dir, "documents")), keep=["doc_id"])
    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    longer = lambda best, r: F.when(r.length * best.period > best.length * r.period, r).otherwise(best)
    best = F.when(F.size("runs") > 0, F.aggregate("runs", F.get("runs", F.lit(0)), longer))  # runs lie in the order of ties
    return out.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~held_out))
    predicted = language_id.predict(docs, model, keep=["doc_id"])
    return predicted.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {
    q.__name__: q
    for q in (op1_line_dedup, op2_url_filters, op3_token_files, op4_benchmark_decontamination, op5_quality_rules, op6_suffix_array_dedup, op7_warc, op8_toxicity, op9_minhash_near_dedup, op10_best_fit_packing, op11_centroid_clustering, op12_periodic_runs, op13_language_id)
}
