"""The registered queries of the training-data operators.

Each is thin: it reads its whole table, applies its operator with production
parameters and derives the columns of its result from what the operator gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, mixing, packing, pivot_search, quality_model, quality_rules, simhash, spans, token_files, toxicity
from .common import Scratch, read_table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spans.dedup(rows)
    # a column of plain values: the character spans that went, as start-end
    shown = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["start"], r["end"])), " ")
    return out.select("doc_id", "text", "n_sentences", "n_removed", shown.alias("removed"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = quality_rules.apply_rules(rows, labels)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(
        "doc_id",
        *[F.col(f"stats.{c}").alias(c) for c in counts],
        F.coalesce(F.col("rule") == 0, F.lit(False)).alias("base_failed"),
        F.col("rule").isNull().alias("kept"),
        "rule",
    )


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(read_table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.groups(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-files")
    folder = scratch.path("data")
    token_files.write_tokens(read_table(spark, sf_dir, "documents"), folder)
    scratch.expire("data")
    return token_files.read_tokens(spark, folder, with_ids=False)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(read_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_toxicity": op5_toxicity,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_token_files": op7_token_files,
    "op8_license_scan": op8_license_scan,
    "op9_source_mixing": op9_source_mixing,
    "op10_quality_classifier": op10_quality_classifier,
}

#: Those that SQL can express.
ORACLES = {"op4_exact_top_k": pivot_search.ORACLE, "op9_source_mixing": mixing.ORACLE}
