"""Evaluation: verdict metrics, threshold sweep, macro F1, reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.config import DEFAULTS, Settings
from attestor.functions import scores as S

ENTAIL_GRID = (0.80, 0.84, 0.86, 0.88, 0.90, 0.92, 0.94)
CONTRADICT_GRID = (0.75, 0.78, 0.80, 0.82, 0.85, 0.88)
BINS = 10


def _n(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def gold_metrics(results: DataFrame) -> DataFrame:
    """One row over results (gold_verdict, predicted_verdict,
    evidence_span_count, source) of source gold. Nothing to get wrong is a
    rate of 0, nothing to find a recall of 1."""
    gold, predicted = F.col("gold_verdict"), F.col("predicted_verdict")
    c = results.where(F.col("source") == "gold").agg(
        F.count("*").alias("n_gold"),
        _n(gold.isin("contradicted", "insufficient_support")).alias("_risky"),
        _n(gold.isin("contradicted", "insufficient_support") & (predicted == "supported")).alias("_false"),
        _n(gold == "contradicted").alias("n_gold_contradicted"),
        _n((gold == "contradicted") & (predicted == "contradicted")).alias("_contra"),
        _n(gold == "insufficient_support").alias("n_gold_insufficient"),
        _n(predicted == "insufficient_support").alias("n_predicted_insufficient"),
        _n((gold == "insufficient_support") & (predicted == "insufficient_support")).alias("_insufficient"),
        _n(F.col("evidence_span_count") > 0).alias("n_gold_with_evidence"),
    )
    col = F.col
    return c.select(
        S.ratio(col("_false"), col("_risky"), 0.0).alias("false_support_rate"), S.ratio(col("_contra"), col("n_gold_contradicted"), 1.0).alias("contradiction_recall"),
        S.ratio(col("_insufficient"), col("n_predicted_insufficient"), 1.0).alias("insufficient_support_precision"), S.ratio(col("n_gold_with_evidence"), col("n_gold"), 1.0).alias("evidence_retrieval_recall"),
        "n_gold", "n_gold_contradicted", "n_gold_insufficient", "n_predicted_insufficient", "n_gold_with_evidence",
    )


def per_class(results: DataFrame) -> DataFrame:
    """(gold_verdict, n, correct, recall, top_predictions): the three most
    frequent predictions of each gold verdict, as type:count."""
    pairs = results.groupBy("gold_verdict", "predicted_verdict").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "predicted_verdict")))
    rows = pairs.groupBy("gold_verdict").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gold_verdict") == F.col("predicted_verdict"), F.col("n")).otherwise(0)).alias("correct"), ordered.alias("_top"))
    top = F.array_join(F.transform(F.slice("_top", 1, 3), lambda x: F.concat(x["predicted_verdict"], F.lit(":"), (-x["n"]).cast("string"))), ", ")
    return rows.select("gold_verdict", "n", "correct", (F.col("correct") / F.col("n")).alias("recall"), top.alias("top_predictions"))


def _rates(*keys: str):
    gold, predicted = F.col("gold_verdict"), F.col("predicted_verdict")
    return [
        F.count("*").alias("n_total"),
        _n(gold == predicted).alias("n_correct"),
        _n(gold != "needs_review").alias("_three"),
        _n((gold != "needs_review") & (gold == predicted)).alias("_three_right"),
        _n(gold != "supported").alias("_unsupported"),
        _n((gold != "supported") & (predicted == "supported")).alias("_false"),
        _n(gold == "contradicted").alias("_contra"),
        _n((gold == "contradicted") & (predicted == "contradicted")).alias("_contra_right"),
    ]


def _named(rows: DataFrame, *keys: str) -> DataFrame:
    col = F.col
    return rows.select(
        *keys, S.ratio(col("n_correct"), col("n_total"), 0.0).alias("overall_acc"), S.ratio(col("_three_right"), col("_three"), 0.0).alias("three_class_acc"),
        S.ratio(col("_false"), col("_unsupported"), 0.0).alias("false_support_rate"), S.ratio(col("_contra_right"), col("_contra"), 0.0).alias("contradiction_recall"), "n_total", "n_correct",
    )


def benchmark_report(results: DataFrame) -> DataFrame:
    """One row over results (gold_verdict, predicted_verdict). Its false
    support rate is over all that is not supported, needs_review included."""
    return _named(results.agg(*_rates()))


def sweep(cases: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Metrics at each pair of thresholds of the grid, over cases (case_id,
    gold_verdict, n_spans, n_scored, p_entail, p_neutral, p_contra) that are
    scored once. The grid is a constant array, so each case becomes as many
    rows as it has pairs and is counted where it stands."""
    grid = F.array(*(F.struct(F.lit(e).alias("entail"), F.lit(c).alias("contra")) for e in ENTAIL_GRID for c in CONTRADICT_GRID))
    rows = cases.withColumn("_g", F.explode(grid)).select("*", "_g.*")
    top = F.greatest("p_entail", "p_neutral", "p_contra")
    predicted = (
        F.when(F.col("n_spans") == 0, "insufficient_support").when(F.col("n_scored") == 0, "needs_review").when(top < s.least_confidence, "needs_review")
        .when(F.col("p_entail") >= F.col("entail"), "supported").when(F.col("p_contra") >= F.col("contra"), "contradicted").otherwise("insufficient_support")
    )
    return _named(rows.withColumn("predicted_verdict", predicted).groupBy("entail", "contra").agg(*_rates()), "entail", "contra")


def best_thresholds(swept: DataFrame, n: int = 15) -> DataFrame:
    """The n best pairs: highest three-class accuracy, then lowest false
    support rate."""
    return swept.orderBy(F.desc("three_class_acc"), F.asc("false_support_rate"), "entail", "contra").limit(n)


def macro_f1(results: DataFrame) -> DataFrame:
    """One row over results (gold_label, predicted_label) with gold labels
    SUPPORT, CONTRADICT or empty. Only rows with a gold label are scored."""
    gold, predicted = F.col("gold_label"), S.scifact_label(F.col("predicted_label"))
    scored = gold.isin("SUPPORT", "CONTRADICT")
    counts = [F.count("*").alias("n_total"), _n(gold == "").alias("n_nei"), _n(scored).alias("n_scored")]
    for name in ("SUPPORT", "CONTRADICT"):
        low = name.lower()
        counts += [_n(gold == name).alias(f"{low}_n"), _n(scored & (predicted == name)).alias(f"_{low}_p"), _n((gold == name) & (predicted == name)).alias(f"_{low}_t")]
    rows = results.agg(*counts)
    for low in ("support", "contradict"):
        rows = rows.withColumns({f"{low}_precision": S.ratio(F.col(f"_{low}_t"), F.col(f"_{low}_p"), 0.0), f"{low}_recall": S.ratio(F.col(f"_{low}_t"), F.col(f"{low}_n"), 0.0)})
        p, r = F.col(f"{low}_precision"), F.col(f"{low}_recall")
        rows = rows.withColumn(f"{low}_f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))
    rows = rows.withColumn("macro_f1", (F.col("support_f1") + F.col("contradict_f1")) / 2)
    return rows.select("macro_f1", *(f"{low}_{m}" for low in ("support", "contradict") for m in ("precision", "recall", "f1", "n")), "n_nei", "n_scored", "n_total")


def three_class_scores(results: DataFrame) -> DataFrame:
    """(label, n, precision, recall, f1) and with them accuracy and macro_f1
    over the labels of results (gold, predicted), none left out."""
    labels = results.select(F.explode(F.array("gold", "predicted")).alias("label")).where("label is not null").distinct()
    gold = results.groupBy(F.col("gold").alias("label")).agg(F.count("*").alias("n"), _n(F.col("gold") == F.col("predicted")).alias("_right"))
    said = results.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("_said"))
    rows = labels.join(gold, "label", "left").join(said, "label", "left").na.fill(0)
    rows = rows.withColumns({"precision": S.ratio(F.col("_right"), F.col("_said"), 0.0), "recall": S.ratio(F.col("_right"), F.col("n"), 0.0)})
    p, r = F.col("precision"), F.col("recall")
    return rows.select("label", "n", "precision", "recall", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"))


def reliability_bins(results: DataFrame, bins: int = BINS) -> DataFrame:
    """(bin, bin_low, bin_high, n, accuracy, avg_confidence) of classified
    results; the last bin has its upper edge, empty bins have no averages."""
    spark, step = results.sparkSession, 1.0 / bins
    edges = spark.createDataFrame([(i, i * step, (i + 1) * step) for i in range(bins)], "bin int, bin_low double, bin_high double")
    at = F.lit(None).cast("int")
    sure = F.coalesce(F.col("confidence"), F.lit(0.0))
    for i in range(bins):
        low, high = i * step, (i + 1) * step
        at = F.when((sure >= low) & ((sure <= 1.0) if high == 1.0 else (sure < high)), i).otherwise(at)
    right = F.coalesce(F.col("predicted_label").isNotNull() & (S.scifact_label(F.col("predicted_label")) == F.col("gold_label")), F.lit(False))
    counts = results.where("status = 'classified'").groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"), F.avg(sure).alias("avg_confidence"))
    return edges.join(F.broadcast(counts), "bin", "left").na.fill(0, ["n"])  # one row a bin


def calibration_error(binned: DataFrame) -> DataFrame:
    """(ece, n_classified): mean distance of accuracy and confidence, weighted
    by bins."""
    return binned.agg(F.sum("n").alias("n_classified"), F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("avg_confidence"))).alias("_off")).select(
        S.ratio(F.coalesce("_off", F.lit(0.0)), F.col("n_classified"), 0.0).alias("ece"), "n_classified"
    )
