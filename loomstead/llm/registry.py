"""The queries of this subpackage and the SQL that those which SQL can express must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import decontaminate, html_text, near_dup, neighbours, packing, quality, sharding, suffix_dedup, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_near_dup": near_dup.op3_near_dup,
        "op4_html_text": html_text.op4_html_text,
        "op5_packing": packing.op5_packing,
        "op6_sharding": sharding.op6_sharding,
        "op7_quality": quality.op7_quality,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_neighbours": neighbours.op10_neighbours,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontaminate.OP1_SQL, "op3_near_dup": near_dup.OP3_SQL, "op8_suffix_dedup": suffix_dedup.OP8_SQL, "op9_url_filter": url_filter.OP9_SQL}
