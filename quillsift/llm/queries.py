"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillsift.llm import chroma, exact_dedup, licenses, merkle, mixing, near_dedup, product_codes, quality, secrets_scan, sentencepieces, suffix_dedup, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality.query,
        "op2_exact_dedup": exact_dedup.query,
        "op3_sentencepiece": sentencepieces.query,
        "op4_near_dedup": near_dedup.query,
        "op5_license_scan": licenses.query,
        "op6_mixing": mixing.query,
        "op7_secret_scan": secrets_scan.query,
        "op8_url_filter": url_filter.query,
        "op9_warc": warc.query,
        "op10_chroma": chroma.query,
        "op11_suffix_dedup": suffix_dedup.query,
        "op12_product_codes": product_codes.query,
        "op13_merkle": merkle.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.ORACLE,
        "op6_mixing": mixing.ORACLE,
        "op8_url_filter": url_filter.ORACLE,
        "op9_warc": warc.ORACLE,
        "op12_product_codes": product_codes.ORACLE,
        "op13_merkle": merkle.ORACLE,
    }
