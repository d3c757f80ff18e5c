"""Queries on reviewers' queues, runs, packets and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.config import STAGE_SECONDS
from attestor.operators import metrics as M
from attestor.operators import review as V

from . import inputs as I
from .registry import query, table

NOW = "2024-02-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


@query(f"""
WITH {I.VERDICTS}, kinds AS (SELECT unnest(['supported', 'contradicted', 'insufficient_support', 'needs_review']) AS verdict_type), counted AS (SELECT k.verdict_type, count(v.claim_id) AS n FROM kinds k LEFT JOIN verdicts v ON v.verdict_type = k.verdict_type GROUP BY 1)
SELECT verdict_type, n, round_even(n * 100.0::DOUBLE / sum(n) OVER (), 1) AS pct FROM counted""")
def verdict_distribution(spark, d):
    return V.distribution(I.verdicts(spark, d))


_QUEUE_SQL = f"""
{I.VERDICTS}, ranked AS (SELECT *, CASE verdict_type WHEN 'contradicted' THEN 0 WHEN 'needs_review' THEN 1 WHEN 'insufficient_support' THEN 2 ELSE 3 END AS severity, row_number() OVER (PARTITION BY claim_id ORDER BY verdict_no) AS r FROM verdicts),
queue AS (SELECT c.c_custkey AS claim_id, coalesce(min(v.severity), 4) AS severity, max(CASE WHEN r = 1 THEN v.verdict_type END) AS verdict_type, max(CASE WHEN r = 1 THEN v.confidence END) AS confidence, bool_or(v.verdict_type = 'contradicted') AS any_contradicted FROM customer c LEFT JOIN ranked v ON v.claim_id = c.c_custkey GROUP BY 1)"""


def _queue(spark, d):
    return V.queue(table(spark, d, "customer").select(F.col("c_custkey").alias("claim_id")), I.verdicts(spark, d))


@query(f"WITH {_QUEUE_SQL} SELECT claim_id, severity, verdict_type, confidence, row_number() OVER (ORDER BY severity, claim_id) AS place FROM queue")
def severity_queue(spark, d):
    """The queue in order, with a place for every row."""
    return V.add_places(_queue(spark, d).select("claim_id", "severity", "verdict_type", "confidence"), ["severity", "claim_id"])


@query(f"WITH {_QUEUE_SQL} SELECT claim_id, severity, verdict_type, confidence FROM queue WHERE any_contradicted AND confidence >= 0.5 AND confidence < 0.8")
def queue_filters(spark, d):
    return V.filter_queue(_queue(spark, d), verdict="contradicted", band="medium").select("claim_id", "severity", "verdict_type", "confidence")


@query(f"""
WITH {_QUEUE_SQL}, lines AS (SELECT o_custkey AS claim_id, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT claim_id, severity, verdict_type, confidence FROM queue q WHERE EXISTS (SELECT 1 FROM lines l WHERE l.claim_id = q.claim_id AND l.l_suppkey = 7)""")
def evidence_by_source(spark, d):
    """Claims with evidence from one source."""
    lines = table(spark, d, "lineitem").where("l_suppkey = 7").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    evidence = lines.select(F.col("o_custkey").alias("claim_id"), F.col("l_suppkey").alias("source_document_id"))
    return V.filter_queue(_queue(spark, d), evidence, source=7).select("claim_id", "severity", "verdict_type", "confidence")


@query(f"WITH {I.RUNS} SELECT packet_id, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY created_at DESC, run_id DESC) AS r FROM runs) WHERE r = 1")
def latest_run(spark, d):
    return V.latest_runs(I.runs(spark, d)).select("packet_id", "run_id", "status")


@query(f"""
WITH {I.RUNS}, {I.PACKETS}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY created_at DESC, run_id DESC) AS r FROM runs) WHERE r = 1)
SELECT l.packet_id, l.run_id, p.session_id, p.is_demo FROM latest l JOIN packets p ON p.packet_id = l.packet_id WHERE p.session_id = 's3' OR p.is_demo ORDER BY l.created_at DESC, l.run_id DESC LIMIT 50""")
def runs_index(spark, d):
    """The fifty newest runs that a session may see."""
    return V.runs_index(I.runs(spark, d), I.packets(spark, d), "s3").select("packet_id", "run_id", "session_id", "is_demo")


_LOG_SQL = f"""
{I.VERDICTS}, log AS (SELECT o_custkey AS claim_id, year(o_orderdate) AS run_id, (['approve', 'reject', 'mark_insufficient', 'bogus'])[CAST(o_orderkey % 4 + 1 AS BIGINT)] AS action, o_orderdate AS decided_at, o_orderkey AS decision_id FROM orders),
one AS (SELECT claim_id, run_id, max(verdict_no) AS verdict_no FROM verdicts GROUP BY 1, 2), per_run AS (SELECT o.claim_id, o.run_id, v.verdict_type FROM one o JOIN verdicts v ON v.verdict_no = o.verdict_no)"""


@query(f"""
WITH {_LOG_SQL}, valid AS (SELECT l.*, v.verdict_type AS verdict_at_decision, row_number() OVER (PARTITION BY l.claim_id ORDER BY decided_at DESC, decision_id DESC) AS r FROM log l JOIN per_run v ON v.claim_id = l.claim_id AND v.run_id = l.run_id WHERE action <> 'bogus')
SELECT claim_id, run_id, action, verdict_at_decision, 'reviewer-stub' AS reviewer_id FROM valid WHERE r = 1""")
def review_upsert(spark, d):
    """The decision that stands for each claim; actions that are none don't count."""
    o = F.col("o_orderkey")
    action = F.element_at(F.array(*map(F.lit, ("approve", "reject", "mark_insufficient", "bogus"))), (o % 4 + 1).cast("int"))
    log = table(spark, d, "orders").select(F.col("o_custkey").alias("claim_id"), F.year("o_orderdate").alias("run_id"), action.alias("action"), F.col("o_orderdate").alias("decided_at"), o.alias("decision_id"))
    per_run = I.verdicts(spark, d).groupBy("claim_id", "run_id").agg(F.max_by("verdict_type", "verdict_no").alias("verdict_type"))
    return V.latest_decisions(log, per_run).select("claim_id", "run_id", "action", "verdict_at_decision", "reviewer_id")


_STATUS_IN = "('queued', 'parsing', 'extracting', 'retrieving', 'classifying')"


@query(f"WITH {I.RUNS} SELECT run_id, CASE WHEN status IN {_STATUS_IN} THEN 'failed' ELSE status END AS status, CASE WHEN status IN {_STATUS_IN} THEN 'ServerRestart: pipeline was interrupted by server shutdown' END AS error_summary, status IN {_STATUS_IN} AS has_end FROM runs")
def orphan_recovery(spark, d):
    return V.recover_orphans(I.runs(spark, d), _now()).select("run_id", "status", "error_summary", F.col("completed_at").isNotNull().alias("has_end"))


@query(f"WITH {I.RUNS}, {I.PACKETS} SELECT r.run_id, r.packet_id FROM runs r WHERE NOT EXISTS (SELECT 1 FROM packets p WHERE p.packet_id = r.packet_id AND p.packet_id = 12 AND NOT p.is_demo AND p.session_id = 's5')")
def packet_delete(spark, d):
    """Runs left when a session deletes a packet of its own."""
    gone = V.deletable(I.packets(spark, d), 12, "s5")
    return V.delete_packets({"runs": I.runs(spark, d)}, gone)["runs"].select("run_id", "packet_id")


def _progress_sql() -> str:
    stages = list(STAGE_SECONDS.items())
    prior = " ".join(f"WHEN '{s}' THEN {sum(x for _, x in stages[:i])}" for i, (s, _) in enumerate(stages))
    eta = " ".join(f"WHEN '{s}' THEN {x}" for s, x in stages)
    return f"""
WITH {I.RUNS}, staged AS (SELECT *, CASE status {prior} END AS prior, CASE status {eta} END AS eta FROM runs),
timed AS (SELECT *, greatest(0.0, CASE WHEN stage_started_at IS NOT NULL THEN epoch_us(TIMESTAMP '{NOW}') / 1e6 - epoch_us(stage_started_at) / 1e6 ELSE coalesce(epoch_us(TIMESTAMP '{NOW}') / 1e6 - epoch_us(started_at) / 1e6, 0.0) - prior END) AS taken FROM staged)
SELECT run_id, CASE WHEN eta IS NULL THEN 0 ELSE least(99, CAST(floor(100 * (prior + least(taken, eta)) / 105) AS BIGINT)) END AS pct,
  CASE WHEN eta IS NULL THEN 105 WHEN taken > eta THEN greatest(1, 105 - prior - eta) ELSE greatest(1, CAST(floor(105 - prior - eta + eta - taken) AS BIGINT)) END AS remaining,
  coalesce(eta, 0) AS stage_eta, CASE WHEN eta IS NULL THEN 0 ELSE least(99, CAST(floor(100 * taken / eta) AS BIGINT)) END AS stage_pct, CASE WHEN eta IS NULL THEN FALSE ELSE taken > eta END AS over_budget FROM timed"""


@query(_progress_sql())
def stage_progress(spark, d):
    return V.progress(I.runs(spark, d), _now()).select("run_id", "pct", "remaining", "stage_eta", "stage_pct", "over_budget")


@query(f"WITH {I.RUNS} SELECT packet_id AS run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY created_at DESC, run_id DESC) AS r FROM runs) WHERE r = 1")
def status_log(spark, d):
    """Last status in a log of transitions."""
    log = I.runs(spark, d).select(F.col("packet_id").alias("run_id"), "status", F.col("created_at").alias("changed_at"), F.col("run_id").alias("event_id"))
    return V.current_status(log).select("run_id", "status")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS stage, 'x' AS kept, CAST(event_id AS VARCHAR) AS own FROM events")
def config_merge(spark, d):
    """Run settings: new keys replace old ones, others stay."""
    e = table(spark, d, "events")
    old = F.create_map(F.lit("stage"), F.lit("old"), F.lit("kept"), F.lit("x"))
    new = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("stage"), F.lit("new"), F.lit("own"), F.col("event_id").cast("string"))).otherwise(F.create_map(F.lit("own"), F.col("event_id").cast("string")))
    m = V.merge_config(old, new)
    return e.select("event_id", m["stage"].alias("stage"), m["kept"].alias("kept"), m["own"].alias("own"))


# Evaluation.


@query(f"""
WITH {I.RESULTS}, g AS (SELECT * FROM results WHERE source = 'gold'),
c AS (SELECT count(*) AS n_gold, count(*) FILTER (gold_verdict IN ('contradicted', 'insufficient_support')) AS risky, count(*) FILTER (gold_verdict IN ('contradicted', 'insufficient_support') AND predicted_verdict = 'supported') AS wrong,
  count(*) FILTER (gold_verdict = 'contradicted') AS n_gold_contradicted, count(*) FILTER (gold_verdict = 'contradicted' AND predicted_verdict = 'contradicted') AS contra, count(*) FILTER (gold_verdict = 'insufficient_support') AS n_gold_insufficient,
  count(*) FILTER (predicted_verdict = 'insufficient_support') AS n_predicted_insufficient, count(*) FILTER (gold_verdict = 'insufficient_support' AND predicted_verdict = 'insufficient_support') AS insufficient, count(*) FILTER (evidence_span_count > 0) AS n_gold_with_evidence FROM g)
SELECT CASE WHEN risky = 0 THEN 0.0 ELSE wrong / risky::DOUBLE END AS false_support_rate, CASE WHEN n_gold_contradicted = 0 THEN 1.0 ELSE contra / n_gold_contradicted::DOUBLE END AS contradiction_recall,
  CASE WHEN n_predicted_insufficient = 0 THEN 1.0 ELSE insufficient / n_predicted_insufficient::DOUBLE END AS insufficient_support_precision, CASE WHEN n_gold = 0 THEN 1.0 ELSE n_gold_with_evidence / n_gold::DOUBLE END AS evidence_retrieval_recall,
  n_gold, n_gold_contradicted, n_gold_insufficient, n_predicted_insufficient, n_gold_with_evidence FROM c""")
def gold_metrics(spark, d):
    return M.gold_metrics(I.results(spark, d))


@query(f"""
WITH {I.RESULTS}, pairs AS (SELECT gold_verdict, predicted_verdict, count(*) AS n FROM results GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY gold_verdict ORDER BY n DESC, predicted_verdict) AS r FROM pairs)
SELECT gold_verdict, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (gold_verdict = predicted_verdict), 0) AS BIGINT) AS correct, coalesce(sum(n) FILTER (gold_verdict = predicted_verdict), 0) / sum(n)::DOUBLE AS recall,
  string_agg(predicted_verdict || ':' || CAST(n AS VARCHAR), ', ' ORDER BY r) FILTER (r <= 3) AS top_predictions FROM r GROUP BY 1""")
def per_class_recall(spark, d):
    return M.per_class(I.results(spark, d))


_RATES_SQL = """
CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (gold_verdict = predicted) / count(*)::DOUBLE END AS overall_acc,
CASE WHEN count(*) FILTER (gold_verdict <> 'needs_review') = 0 THEN 0.0 ELSE count(*) FILTER (gold_verdict <> 'needs_review' AND gold_verdict = predicted) / (count(*) FILTER (gold_verdict <> 'needs_review'))::DOUBLE END AS three_class_acc,
CASE WHEN count(*) FILTER (gold_verdict <> 'supported') = 0 THEN 0.0 ELSE count(*) FILTER (gold_verdict <> 'supported' AND predicted = 'supported') / (count(*) FILTER (gold_verdict <> 'supported'))::DOUBLE END AS false_support_rate,
CASE WHEN count(*) FILTER (gold_verdict = 'contradicted') = 0 THEN 0.0 ELSE count(*) FILTER (gold_verdict = 'contradicted' AND predicted = 'contradicted') / (count(*) FILTER (gold_verdict = 'contradicted'))::DOUBLE END AS contradiction_recall,
count(*) AS n_total, count(*) FILTER (gold_verdict = predicted) AS n_correct"""


@query(f"WITH {I.RESULTS} SELECT {_RATES_SQL.replace('predicted', 'predicted_verdict')} FROM results")
def benchmark_report(spark, d):
    return M.benchmark_report(I.results(spark, d))


def _cases(spark, d):
    from attestor.operators import verdicts as N

    pooled = N.pool(I.triples(spark, d))
    gold = F.element_at(F.array(*map(F.lit, ("supported", "contradicted", "insufficient_support", "needs_review"))), (F.col("claim_id") % 4 + 1).cast("int"))
    return pooled.withColumnRenamed("claim_id", "case_id").withColumn("claim_id", F.col("case_id")).withColumn("gold_verdict", gold).drop("claim_id")


_SWEEP_SQL = f"""
{I.TRIPLES}, cases AS (SELECT claim_id AS case_id, count(*) AS n_spans, count(p_entail) AS n_scored, coalesce(max(p_entail), 0.0) AS e, coalesce(max(p_neutral), 0.0) AS u, coalesce(max(p_contra), 0.0) AS c,
  (['supported', 'contradicted', 'insufficient_support', 'needs_review'])[CAST(claim_id % 4 + 1 AS BIGINT)] AS gold_verdict FROM triples GROUP BY claim_id),
grid AS (SELECT e.v AS entail, c.v AS contra FROM (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in M.ENTAIL_GRID)}]) AS v) e, (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in M.CONTRADICT_GRID)}]) AS v) c),
swept AS (SELECT entail, contra, gold_verdict, CASE WHEN n_spans = 0 THEN 'insufficient_support' WHEN n_scored = 0 OR greatest(e, u, c) < 0.5 THEN 'needs_review' WHEN e >= entail THEN 'supported' WHEN c >= contra THEN 'contradicted' ELSE 'insufficient_support' END AS predicted FROM cases, grid)"""


@query(f"WITH {_SWEEP_SQL} SELECT entail, contra, {_RATES_SQL} FROM swept GROUP BY entail, contra")
def threshold_sweep(spark, d):
    return M.sweep(_cases(spark, d))


@query(f"WITH {_SWEEP_SQL} SELECT entail, contra, {_RATES_SQL} FROM swept GROUP BY entail, contra ORDER BY three_class_acc DESC, false_support_rate, entail, contra LIMIT 15")
def best_thresholds(spark, d):
    """The fifteen best pairs of thresholds."""
    return M.best_thresholds(M.sweep(_cases(spark, d)))


_F1_SQL = """
CASE WHEN p{0} = 0 THEN 0.0 ELSE t{0} / p{0}::DOUBLE END AS {1}_precision, CASE WHEN n{0} = 0 THEN 0.0 ELSE t{0} / n{0}::DOUBLE END AS {1}_recall"""


@query(f"""
WITH {I.RESULTS}, scored AS (SELECT * FROM results WHERE gold_label <> ''),
c AS (SELECT count(*) AS n_scored, count(*) FILTER (gold_label = 'SUPPORT') AS n0, count(*) FILTER (predicted_label = 'SUPPORT') AS p0, count(*) FILTER (gold_label = 'SUPPORT' AND predicted_label = 'SUPPORT') AS t0,
  count(*) FILTER (gold_label = 'CONTRADICT') AS n1, count(*) FILTER (predicted_label = 'CONTRADICT') AS p1, count(*) FILTER (gold_label = 'CONTRADICT' AND predicted_label = 'CONTRADICT') AS t1 FROM scored),
m AS (SELECT *, {_F1_SQL.format(0, "support")}, {_F1_SQL.format(1, "contradict")} FROM c),
f AS (SELECT *, CASE WHEN support_precision + support_recall = 0 THEN 0.0 ELSE 2 * support_precision * support_recall / (support_precision + support_recall) END AS support_f1, CASE WHEN contradict_precision + contradict_recall = 0 THEN 0.0 ELSE 2 * contradict_precision * contradict_recall / (contradict_precision + contradict_recall) END AS contradict_f1 FROM m)
SELECT round((support_f1 + contradict_f1) / 2, 9) AS macro_f1, round(support_precision, 9) AS support_precision, round(support_recall, 9) AS support_recall, round(support_f1, 9) AS support_f1, n0 AS support_n, round(contradict_precision, 9) AS contradict_precision, round(contradict_recall, 9) AS contradict_recall, round(contradict_f1, 9) AS contradict_f1, n1 AS contradict_n,
  (SELECT count(*) FROM results WHERE gold_label = '') AS n_nei, n_scored, (SELECT count(*) FROM results) AS n_total FROM f""")
def macro_f1(spark, d):
    rows = M.macro_f1(I.results(spark, d).withColumn("predicted_label", F.col("predicted_label")))
    doubles = [c for c, t in rows.dtypes if t == "double"]
    return rows.withColumns({c: F.round(c, 9) for c in doubles})


@query(f"""
WITH {I.RESULTS}, labels AS (SELECT DISTINCT gold_verdict AS label FROM results UNION SELECT DISTINCT predicted_verdict FROM results),
c AS (SELECT label, (SELECT count(*) FROM results WHERE gold_verdict = label) AS n, (SELECT count(*) FROM results WHERE predicted_verdict = label) AS p, (SELECT count(*) FROM results WHERE predicted_verdict = label AND gold_verdict = label) AS t FROM labels),
m AS (SELECT label, n, CASE WHEN p = 0 THEN 0.0 ELSE t / p::DOUBLE END AS precision, CASE WHEN n = 0 THEN 0.0 ELSE t / n::DOUBLE END AS recall FROM c)
SELECT label, n, precision, recall, round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 9) AS f1 FROM m""")
def class_scores(spark, d):
    rows = M.three_class_scores(I.results(spark, d).select(F.col("gold_verdict").alias("gold"), F.col("predicted_verdict").alias("predicted")))
    return rows.withColumn("f1", F.round("f1", 9))


_BINS_SQL = f"""
{I.RESULTS}, edges AS (SELECT i AS bin, i * 0.1::DOUBLE AS bin_low, (i + 1) * 0.1::DOUBLE AS bin_high FROM (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS i)),
inside AS (SELECT e.bin, r.* FROM edges e JOIN results r ON r.status = 'classified' AND r.confidence >= e.bin_low AND (r.confidence < e.bin_high OR (e.bin = 9 AND r.confidence <= 1.0))),
binned AS (SELECT e.bin, e.bin_low, e.bin_high, count(i.case_id) AS n, avg(CASE WHEN i.case_id IS NOT NULL THEN CASE WHEN i.gold_label = i.predicted_label THEN 1.0 ELSE 0.0 END END) AS accuracy, avg(i.confidence) AS avg_confidence FROM edges e LEFT JOIN inside i ON i.bin = e.bin GROUP BY 1, 2, 3)"""


@query(f"WITH {_BINS_SQL} SELECT bin, round(bin_low, 9) AS bin_low, round(bin_high, 9) AS bin_high, n, round(accuracy, 9) AS accuracy, round(avg_confidence, 9) AS avg_confidence FROM binned")
def reliability_bins(spark, d):
    r = lambda c: F.round(c, 9).alias(c)
    return M.reliability_bins(I.results(spark, d)).select("bin", r("bin_low"), r("bin_high"), "n", r("accuracy"), r("avg_confidence"))


@query(f"WITH {_BINS_SQL} SELECT round(sum(n * abs(accuracy - avg_confidence)) / sum(n), 9) AS ece, CAST(sum(n) AS BIGINT) AS n_classified FROM binned")
def calibration_error(spark, d):
    return M.calibration_error(M.reliability_bins(I.results(spark, d))).select(F.round("ece", 9).alias("ece"), "n_classified")


# What stands before and behind a run.


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'docx' END AS file_type, CASE WHEN c_custkey % 5 < 3 THEN NULL WHEN c_custkey % 5 = 3 THEN 'File type is not supported. Only PDF and DOCX files are accepted.' ELSE 'No file attached. Please select a PDF or DOCX file.' END AS error,
  bool_and(c_custkey % 5 < 3) OVER (PARTITION BY c_custkey // 7) AS accepted FROM customer""")
def file_checks(spark, d):
    """Files by their first bytes; one bad file rejects its packet."""
    from attestor.operators import ingest

    heads = F.element_at(F.array(*(F.lit(x).cast("binary") for x in ("%PDF-1.4 text", "PK\x03\x04 [Content_Types].xml", "PK\x03\x04 word/document.xml", "PK\x03\x04 other", ""))), (F.col("c_custkey") % 5 + 1).cast("int"))
    files = table(spark, d, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 7).alias("packet_id"), heads.alias("content"))
    return ingest.check_files(files).select("c_custkey", "file_type", "error", "accepted")


@query("""
WITH told AS (SELECT p_partkey, CASE WHEN length(trim(p_name)) > 5 THEN trim(p_name) END AS title, p_brand || ', Ann Lee;' || p_type AS author, CASE WHEN p_partkey % 3 = 0 THEN 'D:2004' || CAST(p_size AS VARCHAR) ELSE '' END AS date, 'Printed ' || CAST(1985 + p_size AS VARCHAR) || ' or so' AS page FROM part),
cut AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(author, '([a-z]),\\s*([A-Z])', '\\1;\\2', 'g'), ';'), lambda a: trim(a)), lambda a: a <> '') AS authors FROM told)
SELECT p_partkey, title, array_to_string(authors, '|') AS authors, CASE WHEN regexp_matches(date, '(19|20)\\d{2}') THEN regexp_extract(date, '(19|20)\\d{2}') ELSE regexp_extract(page, '(19|20)\\d{2}') END AS year FROM cut""")
def paper_metadata(spark, d):
    from attestor.operators import ingest

    author = F.concat("p_brand", F.lit(", Ann Lee;"), "p_type")
    date = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("D:2004"), F.col("p_size").cast("string"))).otherwise("")
    page = F.concat(F.lit("Printed "), (F.col("p_size") + 1985).cast("string"), F.lit(" or so"))
    m = ingest.paper_metadata(F.col("p_name"), author, date, page)
    return table(spark, d, "part").select("p_partkey", m["title"].alias("title"), F.array_join(m["authors"], "|").alias("authors"), m["year"].alias("year"))


@query(f"WITH {I.TRIPLES} SELECT claim_id, span_id FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY span_id) AS r FROM triples) WHERE r <= 3")
def explanation_evidence(spark, d):
    """The three first spans of each claim."""
    return V.top_evidence(I.triples(spark, d).withColumn("retrieval_rank", F.col("span_id"))).select("claim_id", "span_id")


@query(f"WITH {I.TRIPLES} SELECT t.claim_id, t.span_id, p.p_name AS source_filename FROM triples t LEFT JOIN part p ON p.p_partkey = t.source_document_id")
def source_filenames(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("filename"))
    return V.add_source_names(I.triples(spark, d), docs).select("claim_id", "span_id", "source_filename")
