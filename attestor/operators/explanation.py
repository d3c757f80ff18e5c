"""Explanations of verdicts that stand: a prompt for each and a model's reply.

A verdict never waits for its explanation: where the model fails, or says too
little or too much, the explanation is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import fixed as X
from attestor.shipping import ship_code

Model = Callable[[str, list[str]], list]


def prompt(claim: Column, spans: Column, verdict: Column, confidence: Column) -> Column:
    """The request for one verdict: claim, evidence (each span cut), verdict."""
    cut = F.transform(spans, lambda s: F.concat(F.lit("- "), F.substring(s, 1, X.EXPLAINED_SPAN_CHARS)))
    return F.concat(F.lit("CLAIM:\n"), claim, F.lit("\n\nEVIDENCE:\n"), F.array_join(cut, "\n"), F.lit("\n\nVERDICT: "), verdict, F.format_string(" (confidence %.2f)", confidence))


def explain(rows: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """rows (claim_text, spans, verdict_type, confidence) with explanation.
    load gives the model once a worker; the model takes the system's text and
    a list of prompts. Called for rows without evidence too."""
    ship_code(rows.sparkSession)

    def replies(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model: Model | None = None
        for asked in batches:
            try:
                model = model or load()
                said = model(X.EXPLANATION_SYSTEM, asked.tolist())
            except Exception:  # no explanation, and the next batch tries again
                said = [None] * len(asked)
            yield pd.Series(said, dtype=object)

    replies.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    said = F.pandas_udf(replies, "string")(prompt(F.col("claim_text"), F.col("spans"), F.col("verdict_type"), F.col("confidence")))
    size = F.length("explanation")
    fits = size.between(*X.EXPLANATION_CHARS)
    return rows.withColumn("explanation", said).withColumn("explanation", F.when(fits, F.col("explanation")))
