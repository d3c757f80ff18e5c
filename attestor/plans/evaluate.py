"""Evaluation of a claim set against the abstracts it cites.

Each claim's cited sentences are an index of their own: the ten best by terms,
the five best of these by the reranker, pooled inference, a verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.config import DEFAULTS, Settings
from attestor.operators import metrics as M
from attestor.operators import retrieval as R
from attestor.operators import verdicts as V
from attestor.sources import jsonl

from .verify import Scorers

TOP_LEXICAL, TOP_FINAL = 10, 5


def evaluate(claims: DataFrame, corpus: DataFrame, using: Scorers | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """Results (id, gold_label, predicted_label, confidence, retrieved_spans,
    retrieval_recall, status) of claims (id, claim, gold_label,
    cited_doc_ids). retrieval_recall is 1 where anything was retrieved."""
    using = using or Scorers()
    cited = jsonl.cited_sentences(claims, corpus)
    spans = cited.select(F.col("id").alias("doc_id"), F.struct("doc_no", "sent_idx").alias("span_idx"), F.col("sentence").alias("text"))
    asked = claims.select(F.col("id").alias("claim_id"), F.col("claim").alias("claim_text"), F.col("id").alias("doc_id"), F.lit("completed").alias("status"))
    best = R.top_k(R.lexical_scores(asked, asked.select("claim_id", "doc_id"), R.build_index(spans)), TOP_LEXICAL)
    pairs = best.select("claim_id", "doc_id", "span_idx", F.col("rank").alias("place")).join(spans, ["doc_id", "span_idx"]).join(asked.select("claim_id", "claim_text"), "claim_id")
    final = R.top_k(using.rerank(pairs), TOP_FINAL, ties=("place",)).withColumnRenamed("text", "span_text")
    # The sentences are of other documents than the claim, which has none.
    scored = using.infer(final).select("claim_id", F.lit(None).cast("long").alias("source_document_id"), "p_entail", "p_neutral", "p_contra")
    judged = V.classify(asked, scored, s)
    kept = final.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "span_text"))), lambda x: x["span_text"]).alias("retrieved_spans"))
    rows = claims.join(judged.withColumnRenamed("claim_id", "id"), "id").join(kept.withColumnRenamed("claim_id", "id"), "id", "left")
    found = F.coalesce("retrieved_spans", F.array().cast("array<string>"))
    return rows.select("id", "gold_label", F.col("verdict_type").alias("predicted_label"), "confidence", found.alias("retrieved_spans"), (F.size(found) > 0).cast("int").alias("retrieval_recall"), F.lit("classified").alias("status"))


def report(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Macro F1, reliability bins and calibration error of results."""
    bins = M.reliability_bins(results)
    return M.macro_f1(results), bins, M.calibration_error(bins)
