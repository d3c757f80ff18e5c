"""Numeric functions: similarity, ratios, verdict thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.config import DEFAULTS, SCIFACT_LABEL, Settings


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, tiny: float = 1e-10) -> Column:
    """Cosine with tiny added to either length."""
    return dot(a, b) / ((norm(a) + tiny) * (norm(b) + tiny))


def ratio(part: Column, whole: Column, vacuous: float) -> Column:
    """part / whole, or vacuous where whole is zero."""
    return F.when(whole == 0, F.lit(vacuous)).otherwise(part.cast("double") / whole)


def verdict(entail: Column, neutral: Column, contra: Column, s: Settings = DEFAULTS) -> Column:
    """struct<verdict_type, confidence> of pooled probabilities; the order of
    the tests matters, as pooled probabilities need not add up to one."""
    top = F.greatest(entail, neutral, contra)
    kind = F.when(top < s.least_confidence, "needs_review").when(entail >= s.entail, "supported").when(contra >= s.contradict, "contradicted").otherwise("insufficient_support")
    sure = F.when(top < s.least_confidence, top).when(entail >= s.entail, entail).when(contra >= s.contradict, contra).otherwise(top)
    return F.struct(kind.alias("verdict_type"), sure.alias("confidence"))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").when(confidence < 0.5, "low")


def scifact_label(verdict_type: Column) -> Column:
    label = F.lit("")
    for kind, name in SCIFACT_LABEL.items():
        if name:
            label = F.when(verdict_type == kind, name).otherwise(label)
    return label


def bm25(tf: Column, df: Column, length: Column, n: Column, mean_length: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """One term's share of a BM25 score with never-negative weights."""
    weight = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    return weight * tf / (tf + k1 * (1.0 - b + b * length / mean_length))
