"""The corpus operators as queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import boilerplate, encoding, leakage, mixing, neardup, residue, sentences, sitelines, stuffing
from millrace.llm.common import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_fields(table(spark, d, "pt_crawl")).select("row_key", "field").distinct()


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored_crawl(table(spark, d, "pt_crawl"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, d, "pt_processed")).select("row_key_a", "row_key_b").distinct()


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, "pt_processed"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "pt_crawl"), table(spark, d, "pt_processed")).select("row_key").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.furniture_lines(table(spark, d, "pt_processed"), table(spark, d, "pt_crawl"))


def p4_main_text(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_text(table(spark, d, "pt_processed"), table(spark, d, "pt_crawl"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_pages(table(spark, d, "pt_crawl")).select("row_key").distinct()


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "pt_crawl"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.without_repeated_lines(table(spark, d, "pt_processed"), table(spark, d, "pt_crawl"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    lines = sitelines.repeated_lines(table(spark, d, "pt_processed"), table(spark, d, "pt_crawl"))
    return lines.where("docs >= 5").select("row_key", F.col("line_no").cast("int").alias("line_no")).distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    hits = leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return hits.where("longest_run >= 10").select("doc_id", "item_id").distinct()


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.mix_shares(mixing.mixed(table(spark, d, "documents"), targets), targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_ends(table(spark, d, "documents"))


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}
