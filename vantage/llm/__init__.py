"""Operators for preparing training text. Nothing outside this package imports it.

``queries()`` and ``oracle_sql()`` register one query for each operator, and the corpus pipeline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline
    from vantage.llm import dedup, html, language, licenses, manifest, media, mixing, packing, phrases, substrings, topk, toxicity, warc

    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op7_language_id": language.op7_language_id,
        "op10_html_extraction": html.op10_html_extraction,
        "pipeline": corpus_pipeline.run,
        "op3_substring_dedup": substrings.op3_substring_dedup,
        "op8_exact_topk": topk.op8_exact_topk,
        "op2_minhash_dedup": dedup.op2_minhash_dedup,
        "op9_mixing": mixing.op9_mixing,
        "op4_media_columns": media.op4_media_columns,
        "op5_warc": warc.op5_warc,
        "op6_packing": packing.op6_packing,
        "op11_phrase_collocations": phrases.op11_phrase_collocations,
        "op12_merkle_manifest": manifest.op12_merkle_manifest,
        "op13_license_scans": licenses.op13_license_scans,
    }


def oracle_sql() -> dict[str, str]:
    from vantage.llm import sql

    return sql.ORACLES
