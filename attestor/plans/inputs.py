"""The driver tables in the roles of the domain, in Spark and in SQL.

documents are sources whose lines are blocks, benchmark passages are claims,
events are run logs, labels are gold verdicts. Orders are told as sentences of
every kind the claim gates know, as the documents have hardly any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import ingest

from .registry import table

BLOCKS_PER_PAGE = 8


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores, dealt to all: for patterns
    cost more than an exchange, and a small file is read by one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


#: Sentences about an order: {n} is its key, {c} its customer, {y} its year.
SENTENCES = (
    "The treatment reduced mortality by {n} percent in cohort {c} [{c}].",
    "Sales increased significantly compared to {y} (Smith et al., {y}).",
    "",
    "Too short.",
    "lower case starts here and has 12 words or so in it.",
    "Figure {n} shows the results of order {c}.",
    "{n}) The order was late by 12 days.",
    "We thank the customer {c} for the order {n}.",
    "The authors declare no conflict of interest in order {n}.",
    "Effect of orders (ORDER {n}): a randomized trial.",
    "The orders were carefully assessed using form {n}.",
    "Patients in trial {n} were assessed and the dose reduced risk by 20 percent.",
    "In this paper we describe the order {n} of customer {c}.",
    "The primary objective was to demonstrate delivery of order {n}.",
    "GMC indicates mean; GMF, ratio; and so on for {n}.",
    "This is an open access article about order {n}.",
    "Cells {y}, 13, 8004 of 27 orders were late this year.",
    "MAJOR RECOMMENDATIONS FOR ORDERS OF CUSTOMER {c}.",
    "See also the orders at https://example.org/{n} for more.",
    "Orders are listed at https://example.org/{n} for all.",
    "Jones A PhD; Miller B MSc11; Chen C MD of group {n}.",
    "Conclusion of the order ......... {n}",
    "Skip to main content of the order {n} is shown here.",
    "Oxford University Press was founded before order {n}.",
    "Lopez 1 Maria Lopez ordered {n} pieces of it.",
    "Paola Arias (Colombia), Mercedes Bustamante (Brazil), Ismail (Sudan), order {n}.",
    "Reproduction without permission of order {n} is prohibited.",
    "The order {n} is on its way to the customer",
    "The order {n} of customer {c} is on its way to the port and will have arrived there by the end of {y}",
    "Delivery rate of orders: {n}.",
    "Delivery of the order to customer number {n}.",
    "Orders are complex matters.",
    "Studies of ordering have consistently found that people wait for what they want as long as nobody tells them otherwise.",
    "Demand caused by holidays exceeds supply (12, 13) and Jones ({y}) agrees.",
    "Beenused pallets of the infor-mation desk were{n}moved,and the Rad-ford dock is usedfor them.",
)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with page, paragraph, offsets and sections."""
    rows = ingest.split_blocks(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("page", (F.floor(F.col("block_idx") / BLOCKS_PER_PAGE) + 1).cast("int"))
    return ingest.add_paragraphs(ingest.add_sections(ingest.add_offsets(rows)))


BLOCKS = """
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS block_idx FROM documents
), typed AS (
  SELECT *, CASE WHEN trim(text) <> '' AND NOT regexp_matches(text, '[.!?]\\s*$')
    AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 3 THEN 'heading' ELSE 'paragraph' END AS block_type,
    CAST(floor(block_idx / 8) AS BIGINT) + 1 AS page FROM lines
), placed AS (
  SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start,
    row_number() OVER (PARTITION BY doc_id, page ORDER BY block_idx) - 1 AS paragraph,
    max(CASE WHEN block_type = 'heading' THEN block_idx END) OVER (PARTITION BY doc_id ORDER BY block_idx) AS head_idx FROM typed
), blocks AS (
  SELECT p.doc_id, p.block_idx, p.text, p.block_type, p.page, p.paragraph, p.char_start, p.char_start + length(p.text) AS char_end,
    CASE WHEN p.block_type <> 'heading' THEN h.text END AS section_header
  FROM placed p LEFT JOIN typed h ON h.doc_id = p.doc_id AND h.block_idx = p.head_idx
)"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence of each order: doc_id is the customer, block_idx the order."""
    kinds = F.array(*map(F.lit, SENTENCES))
    text = F.element_at(kinds, (F.col("o_orderkey") % len(SENTENCES) + 1).cast("int"))
    for mark, value in (("{n}", "o_orderkey"), ("{c}", "o_custkey"), ("{y}", F.year("o_orderdate"))):
        text = F.replace(text, F.lit(mark), (F.col(value) if isinstance(value, str) else value).cast("string"))
    return spread(table(spark, sf_dir, "orders")).select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("block_idx"), F.lit(0).alias("sent_idx"), text.alias("sentence"))


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SENTENCES_SQL = f"""
sentences AS (
  SELECT o_custkey AS doc_id, o_orderkey AS block_idx, CAST(0 AS BIGINT) AS sent_idx,
    replace(replace(replace(({_quoted(SENTENCES)})[CAST(o_orderkey % {len(SENTENCES)} + 1 AS BIGINT)], '{{n}}', CAST(o_orderkey AS VARCHAR)),
      '{{c}}', CAST(o_custkey AS VARCHAR)), '{{y}}', CAST(year(o_orderdate) AS VARCHAR)) AS sentence
  FROM orders
)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim_text"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference of claim and span from events: users are claims, events are
    spans, some without scores; two thirds of spans are of another document."""
    e = F.col("event_id")
    p = lambda a, b: F.when(e % 13 == 5, None).otherwise((e * a % b) / F.lit(float(b)))
    own = F.col("user_id") * 3
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("claim_id"), e.alias("span_id"), F.when(F.col("user_id") % 4 == 1, own).otherwise(own + e % 3).alias("source_document_id"),
        p(37, 101).alias("p_entail"), p(53, 211).alias("p_neutral"), p(71, 307).alias("p_contra"),
    )


TRIPLES = """
triples AS (
  SELECT user_id AS claim_id, event_id AS span_id, CASE WHEN user_id % 4 = 1 THEN user_id * 3 ELSE user_id * 3 + event_id % 3 END AS source_document_id,
    CASE WHEN event_id % 13 = 5 THEN NULL ELSE (event_id * 37 % 101) / 101.0::DOUBLE END AS p_entail,
    CASE WHEN event_id % 13 = 5 THEN NULL ELSE (event_id * 53 % 211) / 211.0::DOUBLE END AS p_neutral,
    CASE WHEN event_id % 13 = 5 THEN NULL ELSE (event_id * 71 % 307) / 307.0::DOUBLE END AS p_contra FROM events
)"""


def packet_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the triples, and some without any span: customers."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("claim_id"), (F.col("c_custkey") * 3).alias("doc_id"), F.when(F.col("c_nationkey") % 2 == 0, "unresolvable_anchor").otherwise("completed").alias("status")
    )


PACKET_CLAIMS = """
packet_claims AS (
  SELECT c_custkey AS claim_id, c_custkey * 3 AS doc_id, CASE WHEN c_nationkey % 2 = 0 THEN 'unresolvable_anchor' ELSE 'completed' END AS status FROM customer
)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts from orders: customers are claims; the year is the run."""
    o = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("supported", "contradicted", "insufficient_support", "needs_review", "supported")))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("claim_id"), o.alias("verdict_no"), F.year("o_orderdate").alias("run_id"), F.element_at(kinds, (o % 5 + 1).cast("int")).alias("verdict_type"), (o % 101 / F.lit(100.0)).alias("confidence")
    )


VERDICTS = """
verdicts AS (
  SELECT o_custkey AS claim_id, o_orderkey AS verdict_no, year(o_orderdate) AS run_id,
    (['supported', 'contradicted', 'insufficient_support', 'needs_review', 'supported'])[CAST(o_orderkey % 5 + 1 AS BIGINT)] AS verdict_type,
    (o_orderkey % 101) / 100.0::DOUBLE AS confidence FROM orders
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs from events: the user is the packet."""
    e = F.col("event_id")
    kinds = F.array(*map(F.lit, ("queued", "parsing", "extracting", "retrieving", "classifying", "completed", "failed")))
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        e.alias("run_id"), F.col("user_id").alias("packet_id"), ts.alias("created_at"), F.element_at(kinds, (e % 7 + 1).cast("int")).alias("status"),
        F.when(e % 5 != 0, ts).alias("started_at"), F.when(e % 3 == 0, ts + F.expr("make_interval(0,0,0,0,0,0, event_id % 60)")).alias("stage_started_at"),
        F.lit(None).cast("string").alias("error_summary"), F.lit(None).cast("timestamp").alias("completed_at"),
    )


RUNS = """
runs AS (
  SELECT event_id AS run_id, user_id AS packet_id, ts AS created_at,
    (['queued', 'parsing', 'extracting', 'retrieving', 'classifying', 'completed', 'failed'])[CAST(event_id % 7 + 1 AS BIGINT)] AS status,
    CASE WHEN event_id % 5 <> 0 THEN ts END AS started_at, CASE WHEN event_id % 3 = 0 THEN ts + to_seconds(event_id % 60) END AS stage_started_at FROM events
)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet of each user, of one of seven sessions, some of them demos."""
    u = F.col("packet_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("packet_id")).distinct().select("packet_id", F.concat(F.lit("s"), (u % 7).cast("string")).alias("session_id"), (u % 11 == 0).alias("is_demo"))


PACKETS = """
packets AS (SELECT DISTINCT user_id AS packet_id, 's' || CAST(user_id % 7 AS VARCHAR) AS session_id, user_id % 11 = 0 AS is_demo FROM events)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows from labels: gold by quality and toxicity, predictions
    by rule."""
    d = F.col("doc_id")
    gold = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "supported").when(F.col("quality") == 1, "contradicted").when(F.col("toxic") == 0, "insufficient_support").otherwise("needs_review")
    guess = F.element_at(F.array(*map(F.lit, ("contradicted", "insufficient_support", "needs_review", "supported"))), (d % 4 + 1).cast("int"))
    return table(spark, sf_dir, "labels").select(
        d.alias("case_id"), gold.alias("gold_verdict"), F.when(d % 3 == 0, guess).otherwise(gold).alias("predicted_verdict"), (d % 3).alias("evidence_span_count"), F.when(d % 5 == 0, "synthetic").otherwise("gold").alias("source"),
        F.when(gold == "supported", "SUPPORT").when(gold == "contradicted", "CONTRADICT").otherwise("").alias("gold_label"), F.when(d % 3 == 0, guess).otherwise(gold).alias("predicted_label"),
        (d % 101 / F.lit(100.0)).alias("confidence"), F.when(d % 17 == 0, "error").otherwise("classified").alias("status"),
    )


RESULTS = """
judged AS (
  SELECT doc_id AS case_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'supported' WHEN quality = 1 THEN 'contradicted' WHEN toxic = 0 THEN 'insufficient_support' ELSE 'needs_review' END AS gold_verdict,
    (['contradicted', 'insufficient_support', 'needs_review', 'supported'])[CAST(doc_id % 4 + 1 AS BIGINT)] AS guess FROM labels
), results AS (
  SELECT case_id, gold_verdict, CASE WHEN case_id % 3 = 0 THEN guess ELSE gold_verdict END AS predicted_verdict, case_id % 3 AS evidence_span_count,
    CASE WHEN case_id % 5 = 0 THEN 'synthetic' ELSE 'gold' END AS source,
    CASE gold_verdict WHEN 'supported' THEN 'SUPPORT' WHEN 'contradicted' THEN 'CONTRADICT' ELSE '' END AS gold_label,
    CASE CASE WHEN case_id % 3 = 0 THEN guess ELSE gold_verdict END WHEN 'supported' THEN 'SUPPORT' WHEN 'contradicted' THEN 'CONTRADICT' ELSE '' END AS predicted_label,
    (case_id % 101) / 100.0::DOUBLE AS confidence, CASE WHEN case_id % 17 = 0 THEN 'error' ELSE 'classified' END AS status FROM judged
)"""
