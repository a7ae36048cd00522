"""The queries of this package and, where SQL can say them, their twins for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, divergence, html, katz, licenses, lines, mixing, quality, simhash, substrings, suffixes, urls
from .common import read


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(read(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(urls.example_captures(pages), urls.example_entries(pages))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assess(docs, keep=["doc_id"]).select("doc_id", *quality.BASE, "base_failed", "kept", "posterior")


def op8_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(read(spark, sf_dir, "documents"))
    hits = decontaminate.search(index, read(spark, sf_dir, "benchmark"))
    return decontaminate.digest(hits).drop("n_near_items")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(read(spark, sf_dir, "pages"), html.default_model(spark))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(read(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(read(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_suffix_dedup, op2_line_dedup, op3_url_filters, op4_mixing, op5_license_scan, op6_simhash,
        op7_quality_rules, op8_katz_scores, op9_decontamination, op10_html_extraction, op11_token_alignment, op12_substring_dedup, op13_source_divergence,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": lines.ORACLE_SQL,
        "op3_url_filters": urls.ORACLE_SQL,
        "op4_mixing": mixing.ORACLE_SQL,
        "op5_license_scan": licenses.ORACLE_SQL,
        "op9_decontamination": decontaminate.ORACLE_SQL,
        "op12_substring_dedup": substrings.ORACLE_SQL,
        "op13_source_divergence": divergence.ORACLE_SQL,
    }
