"""Reviewers' queue, decisions, runs and packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.config import DEFAULTS, IN_FLIGHT, NO_VERDICT_SEVERITY, REVIEW_ACTIONS, SEVERITY, STAGE_SECONDS, VERDICTS, Settings
from attestor.functions import scores as S
from attestor.functions import text as T
from attestor.workspace import Workspace

RESTARTED = "ServerRestart: pipeline was interrupted by server shutdown"


def distribution(verdicts: DataFrame) -> DataFrame:
    """(verdict_type, n, pct) for each of the four types, none left out; pct
    to one digit, half to even."""
    counts = verdicts.where(F.col("verdict_type").isin(*VERDICTS)).groupBy("verdict_type").agg(F.count("*").alias("n"))
    kinds = verdicts.sparkSession.createDataFrame([(v,) for v in VERDICTS], "verdict_type string")
    rows = kinds.join(F.broadcast(counts), "verdict_type", "left").na.fill(0, ["n"])  # four rows
    total = F.sum("n").over(Window.partitionBy())
    return rows.select("verdict_type", "n", F.when(total == 0, 0.0).otherwise(F.bround(F.col("n") * 100.0 / total, 1)).alias("pct"))


def severity(verdict_type: Column) -> Column:
    value = F.lit(NO_VERDICT_SEVERITY)
    for kind, rank in SEVERITY.items():
        value = F.when(verdict_type == kind, rank).otherwise(value)
    return value


def queue(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """claims with severity (the worst of their verdicts), the first verdict
    and its confidence; order by severity, then claim_no."""
    per = verdicts.groupBy("claim_id").agg(F.min(severity(F.col("verdict_type"))).alias("severity"), F.min_by(F.struct("verdict_type", "confidence"), "verdict_no").alias("_first"), F.collect_set("verdict_type").alias("verdict_types"))
    rows = claims.join(per, "claim_id", "left")
    return rows.select(*claims.columns, F.coalesce("severity", F.lit(NO_VERDICT_SEVERITY)).alias("severity"), F.col("_first.verdict_type").alias("verdict_type"), F.col("_first.confidence").alias("confidence"), F.coalesce("verdict_types", F.array().cast("array<string>")).alias("verdict_types"))


def add_places(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place, from 1 through the whole order. They are ordered in
    ranges, written once so that the ranges are certain; each range is numbered
    by itself and begins where the ones before it end, so no task orders more
    than a range however few keys there are."""
    ws = Workspace(rows.sparkSession, "places")
    ranged = ws.write(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # one row a range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("place", place).join(F.broadcast(before), "_range").withColumn("place", F.col("place") + F.col("_before")).drop("_range", "_before")


def filter_queue(rows: DataFrame, evidence: DataFrame | None = None, verdict: str | None = None, band: str | None = None, source: object = None) -> DataFrame:
    """Rows with any verdict of the type; of the confidence band by the first
    verdict; with evidence from the source. What is null does not filter."""
    if verdict is not None:
        rows = rows.where(F.array_contains("verdict_types", verdict))
    if band is not None:
        rows = rows.where(S.confidence_band(F.col("confidence")) == band)
    if source is not None and evidence is not None:
        rows = rows.join(evidence.where(F.col("source_document_id") == F.lit(source)).select("claim_id"), "claim_id", "left_semi")
    return rows


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each packet; the larger run_id of equals."""
    order = Window.partitionBy("packet_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def visible(packets: DataFrame, session_id: str | None) -> DataFrame:
    """Packets of a session and demos; all without a session."""
    return packets if session_id is None else packets.where((F.col("session_id") == session_id) | F.col("is_demo"))


def runs_index(runs: DataFrame, packets: DataFrame, session_id: str | None = None, limit: int = DEFAULTS.recent_runs) -> DataFrame:
    """Newest runs of visible packets, the most recent first, at most limit."""
    rows = latest_runs(runs).join(visible(packets, session_id), "packet_id")
    return rows.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def latest_decisions(log: DataFrame, verdicts: DataFrame, reviewer: str = "reviewer-stub") -> DataFrame:
    """The decision that stands for each claim, of a log (claim_id, run_id,
    action, decided_at, decision_id): the last valid one for which its run has
    a verdict, with the verdict as it was."""
    valid = log.where(F.col("action").isin(*REVIEW_ACTIONS))
    rows = valid.join(verdicts.select("claim_id", "run_id", F.col("verdict_type").alias("verdict_at_decision")), ["claim_id", "run_id"])
    last = rows.groupBy("claim_id").agg(F.max_by(F.struct("run_id", "action", "verdict_at_decision", "decided_at"), F.struct("decided_at", "decision_id")).alias("_d"))
    return last.select("claim_id", "_d.*", F.lit(reviewer).alias("reviewer_id"))


def recover_orphans(runs: DataFrame, now: Column) -> DataFrame:
    """Runs that were in flight have failed."""
    lost = F.col("status").isin(*IN_FLIGHT)
    return runs.withColumns({"error_summary": F.when(lost, RESTARTED).otherwise(F.col("error_summary")), "completed_at": F.when(lost, now).otherwise(F.col("completed_at")), "status": F.when(lost, "failed").otherwise(F.col("status"))})


def deletable(packets: DataFrame, packet_id: object, session_id: str | None) -> DataFrame:
    """The packet if it may be deleted: no demo, and of the session."""
    own = F.lit(True) if session_id is None else F.coalesce(F.col("session_id") == session_id, F.lit(False))
    return packets.where((F.col("packet_id") == F.lit(packet_id)) & ~F.col("is_demo") & own)


def delete_packets(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the packets of gone: by packet_id, or by the claims
    of those packets where a table knows its claim only. A table that knows
    neither is an error, as its rows would stay behind."""
    ids = gone.select("packet_id").distinct()
    lost = tables["claims"].join(ids, "packet_id", "left_semi").select("claim_id").distinct() if "claims" in tables else None

    def rest(name: str, t: DataFrame) -> DataFrame:
        if "packet_id" in t.columns:
            return t.join(ids, "packet_id", "left_anti")
        if "claim_id" in t.columns and lost is not None:
            return t.join(lost, "claim_id", "left_anti")
        raise ValueError(f"{name} has neither packets nor known claims")

    return {name: rest(name, t) for name, t in tables.items()}


def progress(runs: DataFrame, now: Column) -> DataFrame:
    """runs (status, started_at, stage_started_at) with pct, remaining,
    elapsed_in_stage, stage_eta, stage_pct and over_budget by stage budgets.
    Without the time a stage began, it is what the run has taken beyond the
    budgets of the stages before."""
    total, before, prior, eta = sum(STAGE_SECONDS.values()), 0, F.lit(None).cast("int"), F.lit(None).cast("int")
    for stage, seconds in STAGE_SECONDS.items():
        prior, eta = F.when(F.col("status") == stage, before).otherwise(prior), F.when(F.col("status") == stage, seconds).otherwise(eta)
        before += seconds
    seconds_since = lambda t: F.unix_micros(now) / 1e6 - F.unix_micros(t) / 1e6
    taken = F.when(F.col("stage_started_at").isNotNull(), seconds_since(F.col("stage_started_at"))).otherwise(F.coalesce(seconds_since(F.col("started_at")), F.lit(0.0)) - F.col("_prior"))
    rows = runs.withColumns({"_prior": prior, "_eta": eta}).withColumn("_taken", F.greatest(F.lit(0.0), taken))
    active = F.col("_eta").isNotNull()
    whole = lambda c: F.floor(c).cast("int")
    later = total - F.col("_prior") - F.col("_eta")
    over = F.col("_taken") > F.col("_eta")
    return rows.withColumns(
        {
            "pct": F.when(active, F.least(F.lit(99), whole(100 * (F.col("_prior") + F.least(F.col("_taken"), F.col("_eta"))) / total))).otherwise(0),
            "remaining": F.when(~active, total).when(over, F.greatest(F.lit(1), later)).otherwise(F.greatest(F.lit(1), whole(later + F.col("_eta") - F.col("_taken")))),
            "elapsed_in_stage": F.when(active, whole(F.col("_taken"))).otherwise(0),
            "stage_eta": F.coalesce("_eta", F.lit(0)),
            "stage_pct": F.when(active, F.least(F.lit(99), whole(100 * F.col("_taken") / F.col("_eta")))).otherwise(0),
            "over_budget": F.when(active, over).otherwise(F.lit(False)),
        }
    ).drop("_prior", "_eta", "_taken")


def merge_config(old: Column, new: Column) -> Column:
    """Two maps as one; the new one's values win."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def current_status(log: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(run_id, status, changed_at): the last transition of each run in an
    event log (run_id, status, changed_at, event_id)."""
    last = log.groupBy("run_id").agg(F.max_by(F.struct("status", "changed_at"), F.struct("changed_at", "event_id")).alias("_l"))
    return last.select("run_id", "_l.*")


def results(runs: DataFrame, claims: DataFrame, verdicts: DataFrame, run_id: object) -> DataFrame:
    """A run's claims with their verdicts and the run's status and errors
    (claim_errors of its settings, JSON)."""
    run = runs.where(F.col("run_id") == F.lit(run_id)).select("run_id", "status", F.col("pipeline_config")["claim_errors"].alias("claim_errors"))
    judged = verdicts.where(F.col("run_id") == F.lit(run_id)).select("claim_id", "verdict_type", "confidence", "reasoning")
    rows = claims.where(F.col("run_id") == F.lit(run_id)).select("run_id", "claim_id", "claim_text").join(judged, "claim_id", "left")
    return run.join(rows, "run_id", "left")


def top_evidence(evidence: DataFrame, n: int = 3) -> DataFrame:
    """The first n evidence spans of each claim by rank, for explanations."""
    order = Window.partitionBy("claim_id").orderBy("retrieval_rank")
    return evidence.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def by_weight(weights: DataFrame) -> DataFrame:
    """Evidence of claims with place, the order it is shown in: the heaviest
    first, of equals by rank."""
    order = Window.partitionBy("claim_id").orderBy(F.desc("weight"), "retrieval_rank")
    return weights.withColumn("place", F.row_number().over(order))


def claim_detail(claims: DataFrame, documents: DataFrame, evidence: DataFrame, verdicts: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row for each evidence span of each claim (or one without evidence):
    the claim with the text round it, its verdict if it has one, the span and
    the name of its document."""
    shown = claims.join(documents.select("doc_id", F.col("text").alias("_text")), "doc_id").withColumn("context", T.context_snippet(F.col("_text"), F.col("char_start"), F.col("char_end"), s.snippet_chars))
    judged = shown.select("claim_id", "claim_text", "context").join(verdicts.select("claim_id", "verdict_type", "confidence"), "claim_id", "left")
    named = add_source_names(evidence, documents)
    return judged.join(named.select("claim_id", "source_filename", "span_text", "relevance_score", "retrieval_rank"), "claim_id", "left")


def self_verified(reasoning: Column) -> Column:
    """Whether a verdict carries the self-verify mark."""
    return F.contains(reasoning, F.lit("[Self-verify cap"))


def add_source_names(rows: DataFrame, documents: DataFrame, key: str = "source_document_id") -> DataFrame:
    """rows with the filename of their document; null if there is none."""
    names = documents.select(F.col("doc_id").alias("_doc"), F.col("filename").alias("source_filename"))
    return rows.join(names, F.col(key) == F.col("_doc"), "left").drop("_doc")
