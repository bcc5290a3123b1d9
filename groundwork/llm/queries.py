"""Registered queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from groundwork.llm import chat, decontaminate, divergence, html_text, license_scan, mixing, near_dup, pii, quality, secret_scan, spans, token_counts, topk, whitening
from groundwork.llm import sql as oracle
from groundwork.sources.tables import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at 5, 2, 1 by turns and 150 percent of all words."""
    drawn = mixing.plan(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with an assistant turn as a preference pair; of those with an odd number the
    rejected side leaves at the first reply."""
    made = chat.format_pairs(chat.stale_reply_pairs(table(spark, sf_dir, "conversations"), early=F.col("conv_id") % 2 == 1))
    spans = [chat.spans_text(F.col(c)).alias(c) for c in ("chosen_spans", "rejected_spans")]
    return made.select(F.col("pair_id").alias("conv_id"), "n_prefix", "prompt", "chosen", "rejected", *spans)


def op3_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after the clean-up, counted by its edits."""
    made = token_counts.revised_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_before", "n_after", "n_encoded", F.size("lengths").cast("long").alias("n_leaves"), F.length("text").cast("long").alias("n_chars"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    read = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op5_license_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document names."""
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_tiling_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it leaks."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality.RESULT[:-1])


def op8_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = spans.of_kinds(F.col("secret_spans"), secret_scan.BASE)
    return found.select("doc_id", *spans.digest(F.col("secret_spans"), base, secret_scan.BASE))


def op9_bagminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["fixed"])
    return found.select("doc_id", *spans.digest(F.col("pii_spans"), base, pii.BASE), F.size("pii_spans").cast("long").alias("n_spans"))


def op11_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first four components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for each whose id is divisible by 100."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source held against the others of its language, and its foremost terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_preference_format": op2_preference_format,
    "op3_edit_token_counts": op3_edit_token_counts,
    "op4_main_text": op4_main_text,
    "op5_license_labels": op5_license_labels,
    "op6_tiling_leaks": op6_tiling_leaks,
    "op7_line_quality": op7_line_quality,
    "op8_secret_spans": op8_secret_spans,
    "op9_bagminhash_classes": op9_bagminhash_classes,
    "op10_pii_spans": op10_pii_spans,
    "op11_lanczos_whitening": op11_lanczos_whitening,
    "op12_threshold_topk": op12_threshold_topk,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": oracle.OP1,
    "op2_preference_format": oracle.OP2,
    "op7_line_quality": oracle.OP7,
    "op12_threshold_topk": oracle.OP12,
    "op13_source_divergence": oracle.OP13,
}
