"""Queries of the training-data operators, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, embeddings, htmltext, katz, langid, licenses, linededup, simhash, unigram


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_line_dedup": linededup.op1_line_dedup,
        "op2_simhash": simhash.op2_simhash,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_licenses": licenses.op4_licenses,
        "op5_embeddings": embeddings.op5_embeddings,
        "op6_katz": katz.op6_katz,
        "op7_language": langid.op7_language,
        "op8_token_counts": unigram.op8_token_counts,
        "op9_bpe": bpe.op9_bpe,
        "op10_html": htmltext.op10_html,
    }


def oracle_sql() -> dict[str, str]:
    return {}
