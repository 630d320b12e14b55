"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from llm import bpe, chat, language, media, neardup, packing, suffixes, topk, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media_columns": media.op1_media_columns,
        "op2_bpe_round_trip": bpe.op2_bpe_round_trip,
        "op3_minhash_neardup": neardup.op3_minhash_neardup,
        "op4_language_id": language.op4_language_id,
        "op5_chat_formatting": chat.op5_chat_formatting,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_url_filter": urls.op8_url_filter,
        "op9_suffix_dedup": suffixes.op9_suffix_dedup,
        "op10_exact_topk": topk.op10_exact_topk,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_formatting": chat.SQL, "op10_exact_topk": topk.SQL}
