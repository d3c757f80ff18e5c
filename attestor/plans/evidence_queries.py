"""Queries on anchors, retrieval and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import fixed as X
from attestor.functions import text as T
from attestor.operators import anchors as A
from attestor.operators import retrieval as R
from attestor.operators import scorers
from attestor.operators import verdicts as V
from attestor.workspace import Workspace

from . import inputs as I
from .registry import query, table
from .text_queries import _sql_terms
from .text_queries import _sql_tokens as _sql_all_tokens


# Lexical retrieval: passages as claims, whole documents as spans of one index.


def _whole_documents(spark, d):
    return I.spread(table(spark, d, "documents").select("doc_id", F.lit(0).alias("span_idx"), "text"))


_BM25_SQL = f"""
words AS (SELECT doc_id, {_sql_terms("text")} AS t FROM documents),
sizes AS (SELECT doc_id, len(t) AS length FROM words),
stats AS (SELECT count(*) AS n, avg(length) AS mean_length FROM sizes),
asked AS (SELECT item_id AS claim_id, unnest({_sql_terms("text")}) AS term FROM benchmark),
query AS (SELECT claim_id, term, count(*) AS qf FROM asked GROUP BY 1, 2),
each AS (SELECT doc_id, unnest(t) AS term FROM words),
tf AS (SELECT doc_id, term, count(*) AS tf FROM each WHERE term IN (SELECT term FROM query) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
scored AS (
  SELECT q.claim_id, tf.doc_id, sum(q.qf * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf.tf / (tf.tf + 1.5 * (1.0 - 0.75 + 0.75 * s.length / mean_length))) AS score
  FROM query q JOIN tf ON tf.term = q.term JOIN df ON df.term = tf.term JOIN sizes s ON s.doc_id = tf.doc_id, stats GROUP BY 1, 2
), ranked AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored),
best AS (SELECT claim_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5)"""


def _best_documents(spark, d):
    ws = Workspace(spark, "bm25")
    index = R.store_index(_whole_documents(spark, d), f"{ws.path}/index")
    scored = R.lexical_scores(I.claims(spark, d), None, index, per_document=False)
    return R.top_k(scored, 5, by=("claim_id",), ties=("doc_id",))


@query(f"WITH {_BM25_SQL} SELECT claim_id, doc_id, score, rank FROM best")
def bm25_topk(spark, d):
    return _best_documents(spark, d).select("claim_id", "doc_id", F.round("score", 6).alias("score"), "rank")


# Scoped retrieval: each document is the one target of one passage, and an
# index of its own blocks.

_SCOPED_SQL = f"""
{I.BLOCKS}, spans AS (SELECT doc_id, block_idx AS span_idx, text, char_start, char_end FROM blocks),
targets AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS claim_id, doc_id FROM documents),
words AS (SELECT doc_id, span_idx, {_sql_terms("text")} AS t FROM spans), sizes AS (SELECT doc_id, span_idx, len(t) AS length FROM words),
stats AS (SELECT doc_id, count(*) AS n, avg(length) AS mean_length FROM sizes GROUP BY 1),
asked AS (SELECT item_id AS claim_id, unnest({_sql_terms("text")}) AS term FROM benchmark), query AS (SELECT claim_id, term, count(*) AS qf FROM asked GROUP BY 1, 2),
each AS (SELECT doc_id, span_idx, unnest(t) AS term FROM words), tf AS (SELECT doc_id, span_idx, term, count(*) AS tf FROM each GROUP BY 1, 2, 3), df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
hits AS (
  SELECT g.claim_id, g.doc_id, tf.span_idx, sum(q.qf * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf.tf / (tf.tf + 1.5 * (1.0 - 0.75 + 0.75 * s.length / mean_length))) AS score
  FROM targets g JOIN query q ON q.claim_id = g.claim_id JOIN tf ON tf.doc_id = g.doc_id AND tf.term = q.term JOIN df ON df.doc_id = tf.doc_id AND df.term = tf.term
  JOIN sizes s ON s.doc_id = tf.doc_id AND s.span_idx = tf.span_idx JOIN stats a ON a.doc_id = tf.doc_id GROUP BY 1, 2, 3
), scored AS (SELECT g.claim_id, g.doc_id, p.span_idx, p.text, coalesce(h.score, 0.0) AS score FROM targets g JOIN spans p ON p.doc_id = g.doc_id LEFT JOIN hits h ON h.claim_id = g.claim_id AND h.doc_id = g.doc_id AND h.span_idx = p.span_idx),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, doc_id ORDER BY round(score, 6) DESC, span_idx) AS rank FROM scored) WHERE rank <= 5)"""


def _targets(spark, d):
    n = table(spark, d, "benchmark").agg(F.count("*")).scalar()
    return table(spark, d, "documents").select((F.col("doc_id") % n).alias("claim_id"), "doc_id", F.lit(0).alias("target_no"), F.lit("B2").alias("mode"))


def _scoped(spark, d):
    claims, targets = I.claims(spark, d), _targets(spark, d)
    ws = Workspace(spark, "scoped")
    spans = ws.write(I.blocks(spark, d).withColumnRenamed("block_idx", "span_idx"), "spans")
    lexical = R.top_k(R.lexical_scores(claims, targets, R.store_index(spans, f"{ws.path}/index")), 5)
    return claims, spans, targets, ws.write(lexical.join(spans.select("doc_id", "span_idx", "text"), ["doc_id", "span_idx"]), "lexical")


@query(f"WITH {_SCOPED_SQL} SELECT claim_id, doc_id, span_idx, round(score, 6) AS score, rank FROM lexical")
def bm25_scoped_topk(spark, d):
    """Top five blocks within each target, blocks that score 0 included."""
    return _scoped(spark, d)[3].select("claim_id", "doc_id", "span_idx", F.round("score", 6).alias("score"), "rank")


# A dense list that shares texts with the lexical one: the longest blocks.
_UNITED_SQL = f"""
{_SCOPED_SQL}, dense AS (SELECT * FROM (SELECT claim_id, doc_id, span_idx, text, row_number() OVER (PARTITION BY claim_id, doc_id ORDER BY length(text) DESC, span_idx) AS rank FROM scored) WHERE rank <= 2),
excluded AS (SELECT DISTINCT g.claim_id, g.doc_id, p.text FROM targets g JOIN spans p ON p.doc_id = g.doc_id WHERE p.char_start < 120 AND 40 < p.char_end),
united AS (
  SELECT claim_id, doc_id, text, 'bm25' AS source, 0 AS list, rank FROM lexical l WHERE NOT EXISTS (SELECT 1 FROM excluded x WHERE x.claim_id = l.claim_id AND x.doc_id = l.doc_id AND x.text = l.text)
  UNION ALL
  SELECT claim_id, doc_id, text, 'dense', 1, rank FROM dense l WHERE NOT EXISTS (SELECT 1 FROM excluded x WHERE x.claim_id = l.claim_id AND x.doc_id = l.doc_id AND x.text = l.text)
    AND NOT EXISTS (SELECT 1 FROM lexical x WHERE x.claim_id = l.claim_id AND x.doc_id = l.doc_id AND x.text = l.text)
)"""


def _united(spark, d):
    claims, spans, targets, lexical = _scoped(spark, d)
    longest = targets.join(spans.select("doc_id", "span_idx", "text", F.length("text").cast("double").alias("score")), "doc_id").select("claim_id", "doc_id", "span_idx", "text", "score")
    dense = R.top_k(longest, 2)
    own = claims.join(targets.select("claim_id", "doc_id"), "claim_id").select("claim_id", "doc_id", F.lit(40).alias("char_start"), F.lit(120).alias("char_end"))
    excluded = R.own_texts(own, targets, spans)
    return claims, spans, targets, R.unite(lexical, dense, excluded)


@query(f"WITH {_UNITED_SQL} SELECT claim_id, doc_id, md5(text) AS text_md5, source, rank FROM united")
def hybrid_union(spark, d):
    united = _united(spark, d)[3]
    return united.select("claim_id", "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "source", F.col("place.rank").alias("rank"))


@query(f"WITH {_SCOPED_SQL} SELECT DISTINCT g.claim_id, g.doc_id, md5(p.text) AS text_md5 FROM targets g JOIN spans p ON p.doc_id = g.doc_id WHERE p.char_start < 120 AND 40 < p.char_end")
def overlap_exclude(spark, d):
    claims, targets = I.claims(spark, d), _targets(spark, d)
    spans = I.blocks(spark, d).withColumnRenamed("block_idx", "span_idx")
    own = claims.join(targets.select("claim_id", "doc_id"), "claim_id").select("claim_id", "doc_id", F.lit(40).alias("char_start"), F.lit(120).alias("char_end"))
    return R.own_texts(own, targets, spans).select("claim_id", "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_FINAL_SQL = f"""
{_UNITED_SQL}, pairs AS (SELECT u.*, list_distinct({_sql_all_tokens("b.text")}) AS mine, list_distinct({_sql_all_tokens("u.text")}) AS theirs FROM united u JOIN benchmark b ON b.item_id = u.claim_id),
reranked AS (SELECT *, CASE WHEN len(mine) = 0 THEN 0.0 ELSE len(list_intersect(mine, theirs)) / len(mine)::DOUBLE END AS score FROM pairs),
final AS (SELECT * FROM (SELECT claim_id, doc_id, text, score, row_number() OVER (PARTITION BY claim_id, doc_id ORDER BY round(score, 6) DESC, list, rank) AS pick FROM reranked) WHERE pick <= 2),
meta AS (SELECT doc_id, text, max(span_idx) AS span_idx FROM spans GROUP BY 1, 2),
evidence AS (
  SELECT f.claim_id, f.doc_id AS source_document_id, f.text AS span_text, f.score AS relevance_score, b.char_start, b.char_end, b.section_header, row_number() OVER (PARTITION BY f.claim_id ORDER BY 0, f.pick, f.doc_id) AS unused,
    f.pick FROM final f JOIN meta m ON m.doc_id = f.doc_id AND m.text = f.text JOIN blocks b ON b.doc_id = m.doc_id AND b.block_idx = m.span_idx
)"""


def _evidence(spark, d):
    claims, spans, targets, united = _united(spark, d)
    ranked = scorers.rerank(united.join(claims, "claim_id"))
    # each document has a place of its own among a claim's targets
    numbered = targets.withColumn("target_no", F.col("doc_id"))
    return claims, R.finish(ranked, numbered, spans)


@query(f"""
WITH {_FINAL_SQL} SELECT claim_id, source_document_id, md5(span_text) AS span_md5, round(relevance_score, 6) AS relevance_score, char_start, char_end,
  row_number() OVER (PARTITION BY claim_id ORDER BY source_document_id, pick) AS retrieval_rank FROM evidence""")
def rerank_top2(spark, d):
    """Final evidence with positions and the rank across a claim's documents."""
    return _evidence(spark, d)[1].select("claim_id", "source_document_id", F.md5(F.col("span_text").cast("binary")).alias("span_md5"), F.round("relevance_score", 6).alias("relevance_score"), "char_start", "char_end", "retrieval_rank")


@query(f"""
WITH {_FINAL_SQL}, hit AS (SELECT DISTINCT claim_id FROM evidence)
SELECT count(*) AS claim_count, count(s.claim_id) AS retrieved_count, CASE WHEN count(*) = 0 THEN 0.0 ELSE count(s.claim_id) / count(*)::DOUBLE END AS recall_at_k
FROM benchmark b LEFT JOIN hit s ON s.claim_id = b.item_id""")
def recall_at_k(spark, d):
    """Recall over all evidence."""
    return R.recall(*_evidence(spark, d))


_DENSE_SQL = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) + 1e-10 AS norm FROM v),
s AS (SELECT q.vec_id AS claim_id, s.label AS doc_id, s.vec_id AS span_idx, list_sum(list_transform(list_zip(q.e, s.e), lambda z: z[1] * z[2])) / (q.norm * s.norm) AS score FROM n q JOIN n s ON s.label = q.label WHERE q.vec_id % 100 = 0)
SELECT claim_id, doc_id, span_idx, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, doc_id ORDER BY round(score, 6) DESC, span_idx) AS rank FROM s) WHERE rank <= 2"""


@query(_DENSE_SQL)
def dense_topk(spark, d):
    """Cosine top two: every hundredth vector asks among all of its label."""
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("claim_id"), "embedding", F.col("label").alias("doc_id"))
    vectors = e.select(F.col("label").alias("doc_id"), F.col("vec_id").alias("span_idx"), "embedding")
    scored = R.dense_scores(queries.select("claim_id", "embedding"), queries.select("claim_id", "doc_id"), vectors, most=1 << 60)
    return R.top_k(scored, 2).select("claim_id", "doc_id", "span_idx", F.round("score", 6).alias("score"), "rank")


_ROUTER_SQL = """
claims AS (SELECT o_custkey AS packet_id, o_orderkey AS claim_id, -o_custkey AS doc_id FROM orders),
anchors AS (SELECT l_orderkey AS claim_id, l_linenumber * 1000000 + l_partkey AS anchor_no, o_custkey * 10 + l_linenumber % 3 AS target_id,
  CASE l_returnflag WHEN 'R' THEN 'resolved' WHEN 'A' THEN 'unresolvable' ELSE 'pending' END AS resolution_status FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'F'),
sources AS (SELECT c_custkey AS packet_id, c_custkey * 10 + k AS source_id, k AS source_no FROM customer, (SELECT unnest([0, 1, 2]) AS k) WHERE k < c_nationkey % 4),
flags AS (SELECT c.*, (SELECT count(*) FROM anchors a WHERE a.claim_id = c.claim_id) AS n, (SELECT count(*) FROM anchors a WHERE a.claim_id = c.claim_id AND resolution_status = 'resolved') AS good, (SELECT count(*) FROM sources s WHERE s.packet_id = c.packet_id) AS shelf FROM claims c),
moded AS (SELECT *, CASE WHEN good > 0 THEN 'A' WHEN n > 0 AND shelf > 0 THEN 'none' WHEN shelf > 0 THEN 'B1' WHEN n > 0 THEN 'B3' ELSE 'B2' END AS mode FROM flags),
targets AS (
  SELECT m.claim_id, m.mode, a.target_id AS doc_id, row_number() OVER (PARTITION BY m.claim_id ORDER BY a.anchor_no) - 1 AS target_no FROM moded m JOIN anchors a ON a.claim_id = m.claim_id AND a.resolution_status = 'resolved' WHERE m.mode = 'A'
  UNION ALL SELECT claim_id, mode, NULL, NULL FROM moded WHERE mode = 'none'
  UNION ALL SELECT m.claim_id, m.mode, s.source_id, s.source_no FROM moded m JOIN sources s ON s.packet_id = m.packet_id WHERE m.mode = 'B1'
  UNION ALL SELECT claim_id, mode, doc_id, 0 FROM moded WHERE mode IN ('B2', 'B3')
)"""


def _packets(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    claims = orders.select(F.col("o_custkey").alias("packet_id"), F.col("o_orderkey").alias("claim_id"), (-F.col("o_custkey")).alias("doc_id"))
    status = F.when(F.col("l_returnflag") == "R", "resolved").when(F.col("l_returnflag") == "A", "unresolvable").otherwise("pending")
    lines = table(spark, d, "lineitem").where("l_linestatus = 'F'").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    anchors = lines.select(F.col("l_orderkey").alias("claim_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("anchor_no"), (F.col("o_custkey") * 10 + F.col("l_linenumber") % 3).alias("target_id"), status.alias("resolution_status"))
    sources = customer.select(F.col("c_custkey").alias("packet_id"), "c_nationkey", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("source_no")).where("source_no < c_nationkey % 4")
    return claims, anchors, sources.select("packet_id", (F.col("packet_id") * 10 + F.col("source_no")).alias("source_id"), "source_no")


@query(f"WITH {_ROUTER_SQL} SELECT claim_id, mode, doc_id, target_no FROM targets")
def target_router(spark, d):
    return R.route(*_packets(spark, d)).select("claim_id", "mode", "doc_id", "target_no")


@query(f"WITH {_ROUTER_SQL} SELECT claim_id, CASE WHEN EXISTS (SELECT 1 FROM anchors a WHERE a.claim_id = c.claim_id AND a.resolution_status = 'unresolvable') THEN 'unresolvable_anchor' ELSE 'completed' END AS status FROM claims c")
def anchor_status(spark, d):
    claims, anchors, _ = _packets(spark, d)
    return A.claim_status(claims.select("claim_id"), anchors)


# Reference sections: conversations as documents whose turns are blocks.
_REFS_SQL = """
b AS (SELECT conv_id AS doc_id, turn AS block_idx, CASE WHEN turn % 6 = 1 AND conv_id % 2 = 0 THEN ' References ' WHEN turn % 11 = 7 THEN 'Bibliography' ELSE 'Entry of turn ' || CAST(turn AS VARCHAR) || ' ' || role END AS text,
  CASE WHEN turn % 6 = 1 AND conv_id % 3 = 0 THEN 'heading' WHEN turn % 5 = 4 THEN 'heading' ELSE 'paragraph' END AS block_type FROM conversations),
marked AS (SELECT *, lower(trim(text)) IN ('references', 'bibliography', 'works cited', 'citations', 'literature cited') AS is_ref FROM b),
opened AS (SELECT *, min(CASE WHEN is_ref THEN block_idx END) OVER (PARTITION BY doc_id) AS open FROM marked),
inside AS (SELECT *, max(CASE WHEN block_type = 'heading' AND NOT is_ref THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_idx) AS ended FROM opened WHERE block_idx > open),
entries AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) AS entry_no, trim(text) AS entry FROM inside WHERE ended = 0 AND NOT (block_type = 'heading' AND is_ref) AND trim(text) <> '')"""


def _turn_blocks(spark, d):
    t, c = F.col("turn"), F.col("conv_id")
    text = F.when((t % 6 == 1) & (c % 2 == 0), " References ").when(t % 11 == 7, "Bibliography").otherwise(F.concat(F.lit("Entry of turn "), t.cast("string"), F.lit(" "), F.col("role")))
    kind = F.when((t % 6 == 1) & (c % 3 == 0), "heading").when(t % 5 == 4, "heading").otherwise("paragraph")
    return table(spark, d, "conversations").select(c.alias("doc_id"), t.alias("block_idx"), text.alias("text"), kind.alias("block_type"))


@query(f"WITH {_REFS_SQL} SELECT doc_id, entry_no, entry FROM entries")
def references_section(spark, d):
    return A.reference_entries(_turn_blocks(spark, d))


# Anchor resolution: parts as sources, suppliers' markers as anchors.
_STOP = I._quoted(X.REFERENCE_STOPWORDS)


def _sql_tokens(text: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]{{2,}}')), lambda t: NOT list_contains({_STOP}, t))"


_RESOLVE_SQL = f"""
sources AS (SELECT p_size AS packet_id, p_partkey AS source_id, p_partkey AS source_no, replace(p_name, ' ', '_') || '_' || lower(p_type) || '.pdf' AS filename,
  'By ' || replace(p_brand, '#', ' ') || ' in ' || CAST(1990 + p_partkey % 10 AS VARCHAR) AS raw_text, p_name || ' ' || p_type AS title, p_brand AS author, CAST(1990 + p_partkey % 10 AS VARCHAR) AS year FROM part),
entries AS (SELECT p_size AS doc_id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS entry_no, 'Brand ' || p_name || ' of ' || p_type || ', ' || CAST(1990 + p_partkey % 10 AS VARCHAR) AS entry FROM part),
markers AS (SELECT s_suppkey AS anchor_id, s_suppkey % 50 + 1 AS doc_id, CASE WHEN s_suppkey % 3 = 0 THEN '[' || CAST(s_suppkey % 9 AS VARCHAR) || ']' WHEN s_suppkey % 3 = 1 THEN '(Brand et al., ' || CAST(1990 + s_suppkey % 12 AS VARCHAR) || ')' ELSE 'small ring ECONOMY' END AS raw_marker,
  CASE WHEN s_suppkey % 3 = 0 THEN 'numeric' WHEN s_suppkey % 3 = 1 THEN 'author_year' ELSE 'footnote' END AS citation_style FROM supplier),
named AS (SELECT m.*, CASE citation_style WHEN 'numeric' THEN (SELECT e.entry FROM entries e WHERE e.doc_id = m.doc_id AND e.entry_no = m.anchor_id % 9)
  WHEN 'author_year' THEN (SELECT arg_min(e.entry, e.entry_no) FROM entries e WHERE e.doc_id = m.doc_id AND contains(lower(e.entry), 'brand') AND contains(lower(e.entry), CAST(1990 + m.anchor_id % 12 AS VARCHAR))) END AS known FROM markers m),
cands AS (SELECT *, coalesce(known, raw_marker) AS candidate FROM named),
pairs AS (SELECT c.anchor_id, c.citation_style, c.raw_marker, s.source_id, s.source_no, lower(c.candidate) AS low, s.year, s.filename, lower(s.title || ' ' || s.author || ' ' || replace(replace(s.filename, '_', ' '), '.', ' ') || ' ' || substr(s.raw_text, 1, 2000)) AS target, lower(s.raw_text) AS front FROM cands c JOIN sources s ON s.packet_id = c.doc_id),
tokened AS (SELECT *, {_sql_tokens("low")} AS mine, {_sql_tokens("target")} AS theirs, list_filter({_sql_tokens("regexp_replace(filename, '\\.[^.]+$', '')")}, lambda t: length(t) >= 4) AS names FROM pairs),
covered AS (SELECT *, greatest(CASE WHEN len(list_filter(mine, lambda t: length(t) >= 4)) > 0 THEN len(list_intersect(mine, theirs)) / len(mine)::DOUBLE * 100.0 ELSE 0.0 END,
  CASE WHEN len(names) >= 2 THEN len(list_filter(names, lambda t: contains(low, t))) / len(names)::DOUBLE * 100.0 ELSE 0.0 END) AS base FROM tokened),
scored AS (SELECT *, CASE WHEN contains(low, year) THEN least(100.0, base + 10) ELSE base END AS score, CASE WHEN anchor_id % 3 = 1 THEN contains(front, 'brand') AND contains(front, CAST(1990 + anchor_id % 12 AS VARCHAR)) ELSE FALSE END AS in_front FROM covered),
ranked AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, source_no) AS r FROM scored),
best AS (SELECT anchor_id, max(CASE WHEN r = 1 THEN source_id END) AS first_id, max(CASE WHEN r = 1 THEN score END) AS first, coalesce(max(CASE WHEN r = 2 THEN score END), 0.0) AS second, count(*) FILTER (in_front) AS n_front, max(CASE WHEN in_front THEN source_id END) AS front_id FROM ranked GROUP BY 1)"""


def _resolution(spark, d):
    year = (F.lit(1990) + F.col("p_partkey") % 10).cast("string")
    part = table(spark, d, "part")
    sources = part.select(
        F.col("p_size").alias("packet_id"), F.col("p_partkey").alias("source_id"), F.col("p_partkey").alias("source_no"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.lower("p_type"), F.lit(".pdf")).alias("filename"),
        F.concat(F.lit("By "), F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit(" in "), year).alias("raw_text"),
        F.struct(F.concat("p_name", F.lit(" "), "p_type").alias("title"), F.array("p_brand").alias("authors"), year.alias("year")).alias("paper_metadata"),
    )
    from pyspark.sql import Window

    entries = part.select(F.col("p_size").alias("doc_id"), F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")).alias("entry_no"), F.concat(F.lit("Brand "), "p_name", F.lit(" of "), "p_type", F.lit(", "), year).alias("entry"))
    k = F.col("s_suppkey")
    marker = F.when(k % 3 == 0, F.concat(F.lit("["), (k % 9).cast("string"), F.lit("]"))).when(k % 3 == 1, F.concat(F.lit("(Brand et al., "), (F.lit(1990) + k % 12).cast("string"), F.lit(")"))).otherwise("small ring ECONOMY")
    style = F.when(k % 3 == 0, "numeric").when(k % 3 == 1, "author_year").otherwise("footnote")
    markers = table(spark, d, "supplier").select(k.alias("anchor_id"), (k % 50 + 1).alias("doc_id"), marker.alias("raw_marker"), style.alias("citation_style"))
    return A.candidates(markers, entries).withColumn("packet_id", F.col("doc_id")), sources


@query(f"""
WITH {_RESOLVE_SQL}, target AS (SELECT c.anchor_id, c.candidate, CASE WHEN b.first >= 80 THEN CASE WHEN b.first <> b.second THEN b.first_id END
  WHEN b.first >= 65 AND b.first - b.second >= 20 THEN b.first_id WHEN c.citation_style = 'author_year' AND b.n_front = 1 THEN b.front_id END AS target_id FROM cands c LEFT JOIN best b ON b.anchor_id = c.anchor_id)
SELECT anchor_id, candidate, target_id, CASE WHEN target_id IS NULL THEN 'unresolvable' ELSE 'resolved' END AS resolution_status FROM target""")
def anchor_resolve(spark, d):
    """Resolution without sequence likeness, which SQL has not."""
    return A.resolve(*_resolution(spark, d), sequence=False).select("anchor_id", "candidate", "target_id", "resolution_status")


@query(f"WITH {_RESOLVE_SQL} SELECT anchor_id, count(*) FILTER (in_front) AS n_matches, CASE WHEN count(*) FILTER (in_front) = 1 THEN max(CASE WHEN in_front THEN source_id END) END AS only_match FROM scored WHERE citation_style = 'author_year' GROUP BY 1")
def surname_year(spark, d):
    cands, sources = _resolution(spark, d)
    rows = A.match_scores(cands.where("citation_style = 'author_year'"), sources, sequence=False)
    one = rows.groupBy("anchor_id").agg(F.count_if("in_front").alias("n_matches"), F.max(F.when(F.col("in_front"), F.col("source_id"))).alias("_only"))
    return one.select("anchor_id", "n_matches", F.when(F.col("n_matches") == 1, F.col("_only")).alias("only_match"))


@query()
def anchor_resolve_sequence(spark, d):
    """With sequence likeness, as in production; kept between stages, as in a
    whole run."""
    ws = Workspace(spark, "anchors", measured=True)
    keep = lambda name, df: ws.write(df, name)
    cands, sources = _resolution(spark, d)
    return keep("anchors", A.resolve(keep("candidates", cands), sources, keep=keep)).select("anchor_id", "candidate", "target_id", "resolution_status")


# Verdicts.

_POOL_SQL = f"""
{I.TRIPLES}, pooled AS (SELECT claim_id, count(*) AS n_spans, count(p_entail) AS n_scored, coalesce(max(p_entail), 0.0) AS p_entail, coalesce(max(p_neutral), 0.0) AS p_neutral, coalesce(max(p_contra), 0.0) AS p_contra FROM triples GROUP BY 1)"""


@query(f"WITH {_POOL_SQL} SELECT claim_id, n_spans, n_scored, round(p_entail, 9) AS p_entail, round(p_neutral, 9) AS p_neutral, round(p_contra, 9) AS p_contra FROM pooled")
def nli_maxpool(spark, d):
    r = lambda c: F.round(c, 9).alias(c)
    return V.pool(I.triples(spark, d)).select("claim_id", "n_spans", "n_scored", r("p_entail"), r("p_neutral"), r("p_contra"))


@query(f"""
WITH {I.TRIPLES}, t AS (SELECT span_id, p_entail AS e, p_contra AS c, greatest(p_entail, p_neutral, p_contra) AS top FROM triples WHERE p_entail IS NOT NULL)
SELECT span_id, CASE WHEN top < 0.5 THEN 'needs_review' WHEN e >= 0.92 THEN 'supported' WHEN c >= 0.75 THEN 'contradicted' ELSE 'insufficient_support' END AS verdict_type,
  round(CASE WHEN top < 0.5 THEN top WHEN e >= 0.92 THEN e WHEN c >= 0.75 THEN c ELSE top END, 9) AS confidence FROM t""")
def verdict_map(spark, d):
    from attestor.functions import scores as S

    v = S.verdict(F.col("p_entail"), F.col("p_neutral"), F.col("p_contra"))
    return I.triples(spark, d).where("p_entail is not null").select("span_id", v["verdict_type"].alias("verdict_type"), F.round(v["confidence"], 9).alias("confidence"))


_CLASSIFIED_SQL = f"""
{_POOL_SQL}, {I.PACKET_CLAIMS}, own AS (SELECT t.claim_id, bool_and(t.source_document_id = c.doc_id) AS self FROM triples t JOIN packet_claims c ON c.claim_id = t.claim_id GROUP BY 1),
raised AS (SELECT c.claim_id, c.status, p.*, coalesce(o.self, FALSE) AS self_verify, greatest(p_entail, p_neutral, p_contra) AS top FROM packet_claims c LEFT JOIN pooled p ON p.claim_id = c.claim_id LEFT JOIN own o ON o.claim_id = c.claim_id),
typed AS (SELECT *, CASE WHEN n_spans IS NULL AND status = 'unresolvable_anchor' THEN 'needs_review' WHEN n_spans IS NULL THEN 'insufficient_support' WHEN n_scored = 0 OR top < 0.5 THEN 'needs_review' WHEN p_entail >= 0.92 THEN 'supported' WHEN p_contra >= 0.75 THEN 'contradicted' ELSE 'insufficient_support' END AS verdict_type,
  CASE WHEN n_spans IS NULL OR n_scored = 0 THEN 0.0 WHEN top < 0.5 THEN top WHEN p_entail >= 0.92 THEN p_entail WHEN p_contra >= 0.75 THEN p_contra ELSE top END AS sure FROM raised),
classified AS (SELECT *, self_verify AND verdict_type = 'supported' AND sure > 0.8 AS capped, CASE WHEN n_spans IS NULL THEN 'none' ELSE 'nli' END AS model_name FROM typed)"""


def _classified(spark, d):
    claims = I.packet_claims(spark, d)
    return claims, V.classify(claims, I.triples(spark, d))


@query(f"""
WITH {_CLASSIFIED_SQL} SELECT claim_id, verdict_type, round(CASE WHEN capped THEN 0.8 ELSE sure END, 9) AS confidence, model_name, self_verify, capped,
  CASE WHEN n_spans IS NULL AND status = 'unresolvable_anchor' THEN 'All citation anchors unresolvable — cited source documents could not be matched.' WHEN n_spans IS NULL THEN 'No evidence spans retrieved for this claim.' WHEN n_scored = 0 THEN 'NLI model unavailable — routed to needs_review.'
    ELSE CASE WHEN capped THEN '[Self-verify cap 0.80] ' ELSE '' END || '[NLI-primary] per-span MAX: entail=' || printf('%.3f', p_entail) || ' neutral=' || printf('%.3f', p_neutral) || ' contra=' || printf('%.3f', p_contra) || ' → ' || verdict_type END AS reasoning FROM classified""")
def classify_claims(spark, d):
    """Verdicts with defaults for claims without evidence and the cap on
    claims that verify themselves."""
    return _classified(spark, d)[1].select("claim_id", "verdict_type", F.round("confidence", 9).alias("confidence"), "model_name", "self_verify", "capped", "reasoning")


@query(f"""
WITH {_CLASSIFIED_SQL} SELECT count(*) AS claims_total, count(*) AS verdicts_produced, count(*) FILTER (self_verify) AS self_verify_claims, count(*) FILTER (capped) AS self_verify_caps_applied, count(*) FILTER (model_name = 'none' AND verdict_type = 'needs_review') AS bypass_unresolvable_anchor,
  count(*) FILTER (model_name <> 'none' AND verdict_type = 'supported') AS nli_supported, count(*) FILTER (model_name <> 'none' AND verdict_type = 'contradicted') AS nli_contradicted, count(*) FILTER (model_name <> 'none' AND verdict_type = 'insufficient_support') AS nli_insufficient_support,
  count(*) FILTER (model_name <> 'none' AND verdict_type = 'needs_review') AS nli_needs_review, round_even(count(*) FILTER (self_verify) / count(*)::DOUBLE, 3) AS self_verify_rate FROM classified""")
def verdict_telemetry(spark, d):
    return V.telemetry(*_classified(spark, d))


@query(f"WITH {I.PACKET_CLAIMS}, {I.VERDICTS} SELECT claim_id FROM packet_claims c WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.claim_id = c.claim_id AND v.run_id = 1995)")
def verdict_antijoin(spark, d):
    """Claims that still have no verdict in the run of 1995."""
    return V.unjudged(I.packet_claims(spark, d), I.verdicts(spark, d), 1995).select("claim_id")


@query(f"""
WITH {_CLASSIFIED_SQL} SELECT t.claim_id, count(*) AS n_weights, round(sum(coalesce(t.p_entail, 0.0)), 6) AS total_weight FROM triples t JOIN classified c ON c.claim_id = t.claim_id WHERE c.model_name <> 'none' GROUP BY 1""")
def evidence_weights(spark, d):
    evidence = I.triples(spark, d).select("claim_id", "source_document_id", F.col("span_id").alias("span_text"), F.col("span_id").alias("retrieval_rank"), F.col("p_entail").alias("relevance_score"))
    rows = V.evidence_weights(_classified(spark, d)[1], evidence)
    return rows.groupBy("claim_id").agg(F.count("*").alias("n_weights"), F.round(F.sum("weight"), 6).alias("total_weight"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DOUBLE) AS price, p_name AS filename FROM lineitem JOIN part ON p_partkey = l_partkey")
def filename_lookup(spark, d):
    """A dimension looked up by key; its size decides how it is joined."""
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"), F.col("p_name").alias("filename"))


_NEGATED = I._quoted(scorers.NEGATIONS)


@query(f"""
WITH {_BM25_SQL}, pairs AS (SELECT b.claim_id, b.doc_id, b.score, b.rank, q.text AS claim, d.text AS span FROM best b JOIN benchmark q ON q.item_id = b.claim_id JOIN documents d ON d.doc_id = b.doc_id),
read AS (SELECT *, list_distinct({_sql_all_tokens("claim")}) AS mine, list_distinct({_sql_all_tokens("span")}) AS theirs, list_distinct(regexp_extract_all(claim, '[0-9]+')) AS n1, list_distinct(regexp_extract_all(span, '[0-9]+')) AS n2 FROM pairs),
shared AS (SELECT *, CASE WHEN len(mine) = 0 THEN 0.0 ELSE len(list_intersect(mine, theirs)) / len(mine)::DOUBLE END AS share,
  (list_has_any(mine, {_NEGATED}) <> list_has_any(theirs, {_NEGATED})) OR (len(n1) > 0 AND len(n2) > 0 AND len(list_intersect(n1, n2)) = 0) AS against FROM read),
probs AS (SELECT *, CASE WHEN against THEN share * 0.1 ELSE share END AS e, CASE WHEN against THEN share * 0.9 ELSE 0.0 END AS c FROM shared),
pooled AS (SELECT claim_id, count(*) AS n_spans, max(e) AS e, max(1.0 - e - c) AS u, max(c) AS c, arg_min(doc_id, rank) AS best_doc_id FROM probs GROUP BY 1),
topped AS (SELECT i.item_id AS claim_id, p.*, greatest(e, u, c) AS top FROM benchmark i LEFT JOIN pooled p ON p.claim_id = i.item_id)
SELECT claim_id, coalesce(n_spans, 0) AS n_spans, best_doc_id, CASE WHEN n_spans IS NULL THEN 'insufficient_support' WHEN top < 0.5 THEN 'needs_review' WHEN e >= 0.92 THEN 'supported' WHEN c >= 0.75 THEN 'contradicted' ELSE 'insufficient_support' END AS verdict_type,
  round(CASE WHEN n_spans IS NULL THEN 0.0 WHEN top < 0.5 THEN top WHEN e >= 0.92 THEN e WHEN c >= 0.75 THEN c ELSE top END, 6) AS confidence FROM topped""")
def verify_corpus(spark, d):
    """The main query: passages as claims, their five best documents as
    evidence, stand-in inference, pooled verdicts."""
    claims = I.claims(spark, d).withColumns({"doc_id": F.lit(None).cast("long"), "status": F.lit("completed")})
    best = Workspace(spark, "verify-corpus").write(_best_documents(spark, d), "best")
    pairs = best.join(claims.select("claim_id", "claim_text"), "claim_id").join(table(spark, d, "documents").select("doc_id", F.col("text").alias("span_text")), "doc_id")
    scored = scorers.infer(pairs).withColumnRenamed("doc_id", "source_document_id").select("claim_id", "source_document_id", "p_entail", "p_neutral", "p_contra")
    found = best.groupBy("claim_id").agg(F.count("*").alias("n_spans"), F.min_by("doc_id", "rank").alias("best_doc_id"))
    rows = V.classify(claims, scored).join(found, "claim_id", "left")
    return rows.select("claim_id", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), "best_doc_id", "verdict_type", F.round("confidence", 6).alias("confidence"))
