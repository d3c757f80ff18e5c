"""Queries through files and streams: tables are written to the shared folder
in the formats of the domain and read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import fixed as X
from attestor.functions import text as T
from attestor.operators import explanation, ingest
from attestor.operators import review as V
from attestor.sources import cache, files, jsonl
from attestor.streaming import incremental
from attestor.workspace import Workspace

from . import inputs as I
from .registry import query, table


def _folder(spark, name: str) -> str:
    return f"{Workspace(spark, name).path}/files"


# Layout, files, packets.


@query("""
WITH laid AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE / 4 + 5 AS size, l_partkey % 800 AS y, l_suppkey % 600 AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN size >= 13.0 THEN 'heading' WHEN y > 800 * 0.85 AND size > 0 AND size <= 9.0 THEN 'footnote' ELSE 'paragraph' END AS block_type,
  (x BETWEEN 100 AND 200 AND y BETWEEN 300 AND 400) OR (x BETWEEN 0 AND 50 AND y BETWEEN 0 AND 50) AS in_table FROM laid""")
def block_typing(spark, d):
    """Types of laid-out blocks, and whether they lie in a table."""
    y, x = (F.col("l_partkey") % 800).cast("double"), (F.col("l_suppkey") % 600).cast("double")
    boxes = F.array(*(F.array(*map(F.lit, b)) for b in ((100.0, 300.0, 200.0, 400.0), (0.0, 0.0, 50.0, 50.0))))
    size = F.col("l_quantity").cast("double") / 4 + 5
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ingest.block_type(size, y, F.lit(800.0)).alias("block_type"), ingest.in_table(x, y, boxes).alias("in_table"))


def _docx(batches):
    """A small DOCX file of each order: a heading, a paragraph, a table."""
    import io
    import zipfile

    import pandas as pd

    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t, style="": f"<w:p>{style and f'<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>'}<w:r><w:t>{t}</w:t></w:r></w:p>"
    for pdf in batches:
        out = []
        for key, part in zip(pdf["p_partkey"], pdf["p_name"], strict=True):
            body = para(f"Part {key}", "Heading1") + para("") + para(f"Is a {part}.") + f"<w:tbl><w:tr><w:tc>{para(key)}</w:tc><w:tc>{para(part)}</w:tc></w:tr></w:tbl>"
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w") as z:
                z.writestr("[Content_Types].xml", "<Types/>")
                z.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>" if key % 10 else "<broken")
            out.append((f"p{key % 50}/f{key}.docx", data.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


@query("""
SELECT 'p' || p_partkey % 50 || '/f' || p_partkey || '.docx' AS path, p_partkey % 10 = 0 AS failed, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 2 END AS n_blocks,
  CASE WHEN p_partkey % 10 <> 0 THEN 'heading' END AS first_type, CASE WHEN p_partkey % 10 <> 0 THEN 'Is a ' || p_name || '.' END AS second_text, CASE WHEN p_partkey % 10 <> 0 THEN p_name END AS cell FROM part""")
def docx_parse(spark, d):
    """DOCX files, some of them broken, sniffed and parsed."""
    made = I.spread(table(spark, d, "part").select("p_partkey", "p_name")).mapInPandas(_docx, "path string, content binary")
    kept = made.withColumn("file_type", ingest.sniff_type(F.col("content")))
    b, t = F.col("blocks"), F.col("tables")
    at = lambda c, i: F.try_element_at(c, F.lit(i))
    return files.parse_files(kept).select("path", F.col("error").isNotNull().alias("failed"), F.size("blocks").alias("n_blocks"), at(b, 1)["block_type"].alias("first_type"), at(b, 2)["text"].alias("second_text"), at(at(at(t, 1), 1), 2).alias("cell"))


@query("""
SELECT o_custkey % 20 AS packet_id, count(*) AS n, CASE WHEN o_custkey % 20 < 3 THEN 'second' ELSE 'first' END AS version FROM orders GROUP BY ALL""")
def packet_folders(spark, d):
    """Packets in folders of their own; writing some again leaves the others."""
    path = _folder(spark, "packets")
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("packet_id"), "o_orderkey", F.lit("first").alias("version"))
    files.write_packets(rows, path)
    files.write_packets(rows.where("packet_id < 3").withColumn("version", F.lit("second")), path)
    return spark.read.parquet(path).groupBy(F.col("packet_id").cast("long"), "version").agg(F.count("*").alias("n"))


# Evaluation data.


@query("SELECT CAST(item_id AS VARCHAR) AS id, text AS claim_text, text AS span_text, 1.0::DOUBLE AS relevance_score, CASE item_id % 2 WHEN 0 THEN 'supported' ELSE 'contradicted' END AS gold_verdict FROM benchmark")
def case_files(spark, d):
    """Labelled cases in JSON files, each a list."""
    path = _folder(spark, "cases")
    span = F.struct(F.col("text").alias("span_text"), F.lit(1.0).alias("relevance_score"), F.lit(1).alias("rank"))
    case = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("claim_text"), F.array(span).alias("evidence_spans"), F.when(F.col("item_id") % 2 == 0, "supported").otherwise("contradicted").alias("gold_verdict"))
    lists = table(spark, d, "benchmark").groupBy((F.col("item_id") % 5).alias("file")).agg(F.to_json(F.collect_list(case)).alias("value"))
    lists.write.partitionBy("file").text(path)
    found = jsonl.read_cases(spark, path)
    return found.select("id", "claim_text", F.col("evidence_spans")[0]["span_text"].alias("span_text"), F.col("evidence_spans")[0]["relevance_score"].alias("relevance_score"), "gold_verdict")


@query("""
WITH said AS (SELECT conv_id AS id, turn, text AS claim, CASE turn % 3 WHEN 0 THEN 'SUPPORT' WHEN 1 THEN 'CONTRADICT' ELSE 'OTHER' END AS label, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM conversations)
SELECT id, md5(claim) AS claim_md5, CASE WHEN label IN ('SUPPORT', 'CONTRADICT') THEN label ELSE '' END AS gold_label, 1 AS n_cited FROM said WHERE r = 1""")
def claim_set(spark, d):
    """A claim set as JSON lines in which ids come several times: the first counts."""
    path = _folder(spark, "claims")
    label = F.when(F.col("turn") % 3 == 0, "SUPPORT").when(F.col("turn") % 3 == 1, "CONTRADICT").otherwise("OTHER")
    rows = table(spark, d, "conversations").orderBy("conv_id", "turn", "text").select(F.col("conv_id").alias("id"), F.col("text").alias("claim"), label.alias("evidence_label"), F.array(F.col("turn"), F.lit(None).cast("long")).alias("cited_doc_ids"))
    rows.coalesce(1).write.option("ignoreNullFields", "false").json(path)
    return jsonl.read_claims(spark, path).select("id", F.md5(F.col("claim").cast("binary")).alias("claim_md5"), "gold_label", F.size("cited_doc_ids").alias("n_cited"))


def _set(spark, d):
    """Customers as claims with evidence in parts; a third have none. The
    first document that each cites is missing whatever the number of parts,
    as no key is negative."""
    k = F.col("c_custkey")
    piece = lambda label, *at: F.struct(F.array(*map(F.lit, at)).cast("array<int>").alias("sentences"), F.lit(label).alias("label"))
    kind = "array<struct<sentences: array<int>, label: string>>"
    proof = F.when(k % 6 == 1, F.array(piece("SUPPORT", 1, 9)).cast(kind)).when(k % 6 == 2, F.array(piece("CONTRADICT"), piece("SUPPORT", 0)).cast(kind)).otherwise(F.array(piece("NEITHER", 0)).cast(kind))
    evidence = F.when(k % 3 != 0, F.create_map(k.cast("string"), proof))
    claims = table(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("claim"), evidence.alias("evidence"), F.array((-1 - k).cast("long"), k.cast("long")).alias("cited_doc_ids"))
    corpus = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.array("p_name", "p_type", "p_brand", F.lit("last")).alias("abstract"))
    return claims, corpus


_SET_SQL = """
c AS (SELECT c_custkey AS id, c_name AS claim FROM customer), a AS (SELECT p_partkey AS doc_id, p_name, p_type, p_brand FROM part), cited AS (SELECT * FROM c JOIN a ON doc_id = id)"""

_TRAIN_SQL = f"""
{_SET_SQL}, pairs AS (
  SELECT id, p_type AS premise, claim AS hypothesis, 'SUPPORT' AS label FROM cited WHERE id % 6 = 1
  UNION ALL SELECT id, p_name || ' ' || p_type || ' ' || p_brand, claim, 'CONTRADICT' FROM cited WHERE id % 6 = 2
  UNION ALL SELECT id, p_name, claim, 'SUPPORT' FROM cited WHERE id % 6 = 2
  UNION ALL SELECT id, p_name || ' ' || p_type, claim, '' FROM cited WHERE id % 3 = 0)"""


@query(f"WITH {_TRAIN_SQL} SELECT id, premise, hypothesis, label FROM pairs")
def train_pairs(spark, d):
    return jsonl.train_pairs(*_set(spark, d))


@query(f"WITH {_TRAIN_SQL} SELECT label, count(*) AS n FROM pairs GROUP BY 1")
def pair_label_counts(spark, d):
    return jsonl.label_counts(jsonl.train_pairs(*_set(spark, d)))


@query(f"""
WITH {_SET_SQL} SELECT c.id, CASE WHEN a.doc_id IS NULL THEN 'No evidence.' WHEN c.id % 6 = 1 THEN p_type WHEN c.id % 6 = 2 THEN p_name || ' ' || p_type || ' ' || p_brand WHEN c.id % 3 <> 0 THEN p_name ELSE p_name || ' ' || p_type || ' ' || p_brand END AS premise,
  claim AS hypothesis, CASE c.id % 6 WHEN 1 THEN 'SUPPORT' WHEN 2 THEN 'CONTRADICT' ELSE '' END AS label FROM c LEFT JOIN a ON a.doc_id = c.id""")
def dev_pairs(spark, d):
    """One pair a claim; customers beyond the parts have no abstract."""
    return jsonl.dev_pairs(*_set(spark, d))


@query(f"WITH {_SET_SQL} SELECT id, unnest([0, 1, 2, 3]) AS sent_idx, unnest([p_name, p_type, p_brand, 'last']) AS sentence FROM cited")
def cited_abstracts(spark, d):
    return jsonl.cited_sentences(*_set(spark, d)).select("id", "sent_idx", "sentence")


_RESUME_SQL = "done AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linenumber = 1), last AS (SELECT id, CASE id % 4 WHEN 0 THEN 'error' ELSE 'classified' END AS status FROM done WHERE id % 3 <> 0)"


def _resumed(spark, d):
    """Results in two appended files: first all failed, then most are good,
    with lines between that are no JSON."""
    path = _folder(spark, "results")
    k = F.col("l_orderkey")
    ids = table(spark, d, "lineitem").where("l_linenumber = 1").select(k).distinct().where(k % 3 != 0)
    row = lambda status: F.to_json(F.struct(k.alias("id"), status.alias("status"), F.array(F.lit("span")).alias("retrieved_spans")))
    status = F.when(k % 4 == 0, "error").otherwise("classified")
    lines = ids.select(F.explode(F.array(row(F.lit("started")), F.lit('{"id": 5, "status"'), row(status))).alias("value"))
    lines.coalesce(1).write.text(path)
    return jsonl.read_results(spark, path)


@query(f"WITH {_RESUME_SQL} SELECT id, status, 1 AS n_spans FROM last")
def result_log(spark, d):
    """The last good line of each id counts."""
    return _resumed(spark, d).select("id", "status", F.size("retrieved_spans").alias("n_spans"))


@query(f"WITH {_RESUME_SQL} SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM last WHERE status = 'classified') ORDER BY id LIMIT 100")
def resume_pending(spark, d):
    """The next hundred claims that no result has classified."""
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return jsonl.pending(claims, _resumed(spark, d), 100)


@query("""
WITH b AS (SELECT least(CAST(floor((doc_id % 101) / 100.0 * 10) AS BIGINT), 9) AS bin FROM labels)
SELECT bin, count(*) AS n FROM b GROUP BY 1""")
def reliability_csv(spark, d):
    """Bins written as CSV and read back."""
    path = _folder(spark, "bins")
    bins = table(spark, d, "labels").select(F.least(F.floor(F.col("doc_id") % 101 / F.lit(100.0) * 10), F.lit(9)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    jsonl.write_bins(bins, path)
    return spark.read.option("header", "true").csv(path).select(F.col("bin").cast("long"), F.col("n").cast("long"))


@query("SELECT doc_id, sha256(text) AS key, length(text) AS score FROM documents")
def score_cache(spark, d):
    """Scores kept by content: a first run scores half of the texts, a second
    one what is left, of equal texts one."""
    path = _folder(spark, "cache")
    rows = table(spark, d, "documents").select("doc_id", "text", cache.content_key(F.col("text").cast("binary"), F.col("doc_id")).alias("key"))
    score = lambda df: df.select("key", F.length("text").alias("score"))
    cache.scored(spark, path, rows.where("n_chars < 500"), ["key"], score)
    return cache.scored(spark, path, rows, ["key"], score).select("doc_id", "key", "score")


# Reviewers' views.


@query("""
WITH once AS (SELECT l_orderkey AS claim_id, l_linenumber AS retrieval_rank, min(CAST(l_extendedprice AS DOUBLE)) AS weight FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1)
SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY weight DESC, retrieval_rank) AS place FROM once""")
def evidence_by_weight(spark, d):
    """Evidence of a claim in the order it is shown."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("retrieval_rank"), F.col("l_extendedprice").cast("double").alias("weight"))
    once = rows.groupBy("claim_id", "retrieval_rank").agg(F.count("*").alias("_n"), F.min("weight").alias("weight")).where("_n = 1").drop("_n")
    return V.by_weight(once)


@query("""
SELECT event_id, reasoning, contains(reasoning, '[Self-verify cap') AS badge, CASE WHEN event_id % 2 = 0 THEN 'Represent this sentence for searching relevant passages: ' ELSE '' END || event_type AS query
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN '[Self-verify cap 0.80] ' ELSE '' END || event_type AS reasoning FROM events)""")
def badges_and_prefixes(spark, d):
    """The self-verify badge; queries with the instruction of their encoder."""
    reasoning = F.concat(F.when(F.col("event_id") % 3 == 0, "[Self-verify cap 0.80] ").otherwise(""), F.col("event_type"))
    asked = F.when(F.col("event_id") % 2 == 0, T.query_text(F.col("event_type"), "BAAI/bge-base-en")).otherwise(T.query_text(F.col("event_type"), "other"))
    return table(spark, d, "events").select("event_id", reasoning.alias("reasoning"), V.self_verified(reasoning).alias("badge"), asked.alias("query"))


@query("""
WITH docs AS (SELECT doc_id, text, CASE WHEN doc_id % 4 <> 0 THEN doc_id || '.pdf' END AS filename FROM documents),
claims AS (SELECT doc_id * 10 AS claim_id, doc_id, 'claim ' || doc_id AS claim_text, n_chars // 3 AS s, n_chars // 2 AS e FROM documents),
evidence AS (SELECT doc_id * 10 AS claim_id, doc_id + 1 AS source, 'span ' || k AS span_text, k / 2.0 AS relevance_score, k AS retrieval_rank FROM documents, (SELECT unnest([1, 2]) AS k) WHERE doc_id % 3 <> 0)
SELECT c.claim_id, c.claim_text, md5(substr(d.text, CAST(greatest(0, c.s - 200) + 1 AS BIGINT), CAST(c.e + 200 - greatest(0, c.s - 200) AS BIGINT))) AS context_md5, CASE c.doc_id % 5 WHEN 0 THEN NULL ELSE 'supported' END AS verdict_type, o.filename AS source_filename, e.span_text, e.retrieval_rank
FROM claims c JOIN docs d ON d.doc_id = c.doc_id LEFT JOIN evidence e ON e.claim_id = c.claim_id LEFT JOIN docs o ON o.doc_id = e.source""")
def claim_detail(spark, d):
    """A claim's page: context, verdict, evidence with filenames."""
    rows, k = table(spark, d, "documents"), F.col("doc_id")
    docs = rows.select("doc_id", "text", F.when(k % 4 != 0, F.concat(k.cast("string"), F.lit(".pdf"))).alias("filename"))
    claims = rows.select((k * 10).alias("claim_id"), "doc_id", F.concat(F.lit("claim "), k.cast("string")).alias("claim_text"), F.floor(F.col("n_chars") / 3).cast("int").alias("char_start"), F.floor(F.col("n_chars") / 2).cast("int").alias("char_end"))
    spans = rows.where(k % 3 != 0).select((k * 10).alias("claim_id"), (k + 1).alias("source_document_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("retrieval_rank"))
    evidence = spans.withColumns({"span_text": F.concat(F.lit("span "), F.col("retrieval_rank").cast("string")), "relevance_score": F.col("retrieval_rank") / 2.0})
    verdicts = rows.where(k % 5 != 0).select((k * 10).alias("claim_id"), F.lit("supported").alias("verdict_type"), F.lit(0.95).alias("confidence"))
    out = V.claim_detail(claims, docs, evidence, verdicts)
    return out.select("claim_id", "claim_text", F.md5(F.col("context").cast("binary")).alias("context_md5"), "verdict_type", "source_filename", "span_text", "retrieval_rank")


@query(f"""
WITH {I.RUNS}, {I.PACKETS}, gone AS (SELECT packet_id FROM packets WHERE packet_id = 12 AND NOT is_demo AND session_id = 's5'),
claims AS (SELECT run_id AS claim_id, packet_id FROM runs)
SELECT event_id AS claim_id, 'verdict ' || event_type AS verdict FROM events WHERE event_id NOT IN (SELECT claim_id FROM claims WHERE packet_id IN (SELECT packet_id FROM gone))""")
def packet_delete_children(spark, d):
    """Rows that know their claim only go with its packet."""
    claims = I.runs(spark, d).select(F.col("run_id").alias("claim_id"), "packet_id")
    verdicts = table(spark, d, "events").select(F.col("event_id").alias("claim_id"), F.concat(F.lit("verdict "), "event_type").alias("verdict"))
    return V.delete_packets({"claims": claims, "verdicts": verdicts}, V.deletable(I.packets(spark, d), 12, "s5"))["verdicts"]


@query("""
WITH run AS (SELECT 7 AS run_id, 'completed' AS status, '{"3": "timeout"}' AS claim_errors), claims AS (SELECT p_partkey AS claim_id, p_name AS claim_text FROM part WHERE p_size = 7)
SELECT r.run_id, r.status, r.claim_errors, c.claim_id, c.claim_text, CASE WHEN c.claim_id % 2 = 0 THEN 'supported' END AS verdict_type FROM run r LEFT JOIN claims c ON TRUE""")
def run_results(spark, d):
    """A run's results: parts are claims, their size is the run."""
    part, size = table(spark, d, "part"), F.col("p_size")
    config = F.create_map(F.lit("claim_errors"), F.lit('{"3": "timeout"}'))
    runs = part.select(size.alias("run_id")).distinct().select("run_id", F.lit("completed").alias("status"), config.alias("pipeline_config"))
    claims = part.select(size.alias("run_id"), F.col("p_partkey").alias("claim_id"), F.col("p_name").alias("claim_text"))
    verdicts = part.where("p_partkey % 2 = 0").select(size.alias("run_id"), F.col("p_partkey").alias("claim_id"), F.lit("supported").alias("verdict_type"), F.lit(0.9).alias("confidence"), F.lit("").alias("reasoning"))
    return V.results(runs, claims, verdicts, 7).select("run_id", "status", "claim_errors", "claim_id", "claim_text", "verdict_type")


@query(f"""
WITH spans AS (SELECT l_orderkey AS claim_id, list(p_name || ' costs ' || l_partkey || repeat('.', 600) ORDER BY l_linenumber, l_partkey)[1:3] AS spans FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT claim_id, md5('CLAIM:' || chr(10) || 'Order ' || claim_id || chr(10) || chr(10) || 'EVIDENCE:' || chr(10) || array_to_string(list_transform(spans, lambda s: '- ' || substr(s, 1, {X.EXPLAINED_SPAN_CHARS})), chr(10)) || chr(10) || chr(10) || 'VERDICT: supported (confidence ' || printf('%.2f', (claim_id % 101) / 100.0::DOUBLE) || ')') AS prompt_md5 FROM spans""")
def explanation_prompts(spark, d):
    """What a model is asked about each verdict, with its first three spans."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    text = F.concat("p_name", F.lit(" costs "), F.col("l_partkey").cast("string"), F.repeat(F.lit("."), F.lit(600)))
    evidence = lines.select(F.col("l_orderkey").alias("claim_id"), F.struct("l_linenumber", "l_partkey").alias("retrieval_rank"), text.alias("span_text"))
    first = V.top_evidence(evidence).groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("retrieval_rank", "span_text"))), lambda x: x["span_text"]).alias("spans"))
    asked = explanation.prompt(F.concat(F.lit("Order "), F.col("claim_id").cast("string")), F.col("spans"), F.lit("supported"), F.col("claim_id") % 101 / F.lit(100.0))
    return first.select("claim_id", F.md5(asked.cast("binary")).alias("prompt_md5"))


@query("SELECT item_id, CASE WHEN length(text) % 3 = 0 THEN NULL ELSE 'The verdict of passage rests on ' || length(text) || ' letters.' END AS explanation FROM benchmark")
def explanations(spark, d):
    """Explanations of a stand-in model, some of whose replies are too short."""

    def load():
        def model(system, prompts):
            claims = [p.split("\n\nEVIDENCE:")[0].removeprefix("CLAIM:\n") for p in prompts]
            return ["short" if len(c) % 3 == 0 else f"The verdict of passage rests on {len(c)} letters." for c in claims]

        return model

    rows = table(spark, d, "benchmark").select("item_id", F.col("text").alias("claim_text"), F.array(F.col("text")).alias("spans"), F.lit("supported").alias("verdict_type"), F.lit(0.9).alias("confidence"))
    return explanation.explain(rows, load).select("item_id", "explanation")


# Streams.


@query("SELECT o_orderkey AS claim_id, 1995 AS run_id, 'needs_review' AS verdict_type FROM orders")
def stream_verdicts(spark, d):
    """Claims that arrive in two files, a third of them again: each is judged
    once."""
    path = Workspace(spark, "stream").path
    claims = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("claim_id"), F.lit(1995).cast("long").alias("run_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("arrived_at"))
    schema = "claim_id long, run_id long, arrived_at timestamp"
    for part in (claims.where("claim_id % 2 = 0 or claim_id % 3 = 0"), claims.where("claim_id % 2 = 1 or claim_id % 3 = 0")):
        part.write.mode("append").parquet(f"{path}/in")
        arriving = incremental.read_claims(spark, f"{path}/in", schema)
        judge = lambda df: df.withColumn("verdict_type", F.lit("needs_review"))
        incremental.start(arriving, judge, f"{path}/out", f"{path}/marks").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("claim_id", "run_id", "verdict_type")


@query(f"WITH {I.RUNS} SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS window_start, status, count(*) AS n FROM runs GROUP BY 1, 2")
def status_windows(spark, d):
    """Transitions by window: the streaming query over a table that is there."""
    log = I.runs(spark, d).select("run_id", "status", F.col("created_at").alias("changed_at"))
    return incremental.status_counts(log).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "status", "n")
