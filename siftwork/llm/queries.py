"""The queries of this subpackage: each reads its whole table and applies one operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, licenses, secret_scan, spelling, url_filter
from .decontaminate import with_leaks
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import pack
from .pii import find_private
from .quality import judge
from .spelling import variants
from .suffix_dedup import remove_repeats
from .whitening import whitened


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"), html_extract.train(spark))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(_table(spark, sf_dir, "documents"), cleaned=True)
    return judged.select("*", (F.col("n_words") - F.col("lost_words")).alias("clean_words"), F.sha2("clean_text", 256).alias("clean_sha256")).drop("clean_text")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secret_scan.train(secret_scan.labelled_findings(spark))
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"), model)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(_table(spark, sf_dir, "documents"), length=400, shared_words=50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared_words")


def op7_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(_table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.filter_urls(url_filter.sample_captures(pages), url_filter.sample_events(pages))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(_table(spark, sf_dir, "documents"), licenses.known_texts(spark))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(_table(spark, sf_dir, "embeddings"))


def op12_mixing_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(_table(spark, sf_dir, "documents"), least=6, times=5, factor=5, spoil=199)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_html_extraction, op2_quality_rules, op3_best_fit_packing, op4_benchmark_decontamination, op5_secret_scans, op6_suffix_array_dedup, op7_pii_sanitisation, op8_url_filters, op9_license_scans, op10_minhash_near_dedup, op11_embedding_whitening, op12_mixing_to_target_weights, op13_spelling_variants)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filters": url_filter.ORACLE, "op9_license_scans": licenses.oracle(), "op13_spelling_variants": spelling.ORACLE}
