"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline
    from maskforge.llm import bpe, decontaminate, langid, line_dedup, near_dedup, quality, secrets, token_counts, toxicity, url_filter

    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_langid": langid.op5_langid,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_quality": quality.op8_quality,
        "op9_secrets": secrets.op9_secrets,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    from maskforge.llm import line_dedup, quality, url_filter

    return {
        "op6_url_filter": url_filter.oracle(),
        "op8_quality": quality.ORACLE,
        "op10_line_dedup": line_dedup.ORACLE,
    }
