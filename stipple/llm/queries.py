"""The queries of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stipple.llm import ann, bpe, ctw, decontam, html, jaccard, language, sharding, substrings, transcripts

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_decontam": decontam.query,
        "op2_ann": ann.query,
        "op3_language": language.query,
        "op3_pages": language.query_pages,
        "op4_sharding": sharding.query,
        "op5_jaccard": jaccard.query,
        "op6_substrings": substrings.query,
        "op7_transcripts": transcripts.query,
        "op8_ctw": ctw.query,
        "op9_bpe": bpe.query,
        "op10_html": html.query,
    }


def oracle_sql() -> dict[str, str]:
    return {}
