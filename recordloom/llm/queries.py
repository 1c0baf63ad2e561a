"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import table


def op1_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.llm.language import identified

    return identified(table(spark, sf_dir, "documents"))


def op2_budget_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.llm.mixing import chosen

    took = chosen(table(spark, sf_dir, "documents"))
    return took.select("doc_id", "domain", F.col("m_lang").alias("lang"), F.col("m_source").alias("source"), "n_tokens", "copies", "taken_tokens")


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"))


def op4_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), ngram=3, most=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.llm.substring import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op6_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.llm.quality import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sign_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_window_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op9_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.llm.urls import judged, parts

    # pages have no labels of their own: the last number of a path names the document shown
    pages, marks = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.regexp_extract(parts(F.col("url"))[1], "([0-9]{1,18})[^0-9/]*/?$", 1).try_cast("bigint")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    labels = pages.select("page_id", number.alias("doc_id")).join(marks.select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")
    return judged(pages, labels)


def op10_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.llm.rules import judged

    return judged(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from recordloom.llm import mixing

    return {"op2_budget_tree": mixing.oracle()}
