"""Queries on texts, blocks, sentences and claims."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestor.functions import fixed as X
from attestor.functions import text as T
from attestor.functions.regex import literal
from attestor.operators import claims as C
from attestor.operators import ingest
from attestor.operators import retrieval as R
from attestor.workspace import Workspace

from . import inputs as I
from .registry import query, table


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_sentences(text: str) -> str:
    held = f"regexp_replace({text}, '\\b({literal(X.ABBREVIATIONS)})\\.(\\s+)', '\\1.' || chr(2) || '\\2', 'g')"
    cut = f"string_split(regexp_replace({held}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: regexp_replace(replace(s, chr(2), ''), '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


def _sql_tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def _sql_terms(text: str) -> str:
    return f"list_filter({_sql_tokens(text)}, lambda t: NOT list_contains({I._quoted(X.ENGLISH_STOPWORDS)}, t))"


def _sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


@query(f"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(t) AS BIGINT) AS n_terms, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct
FROM (SELECT doc_id, {_sql_tokens("text")} AS w, {_sql_terms("text")} AS t FROM documents)""")
def tokenize_terms(spark, d):
    t = T.terms(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"), F.size(t).alias("n_terms"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query(f"""
SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s))) AS sent_idx FROM (SELECT doc_id, {_sql_sentences("text")} AS s FROM documents)""")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "sentence"))


_TALK = "'Prices rose, e.g. in ' || o_orderstatus || ', by Miller et al. (cf. Fig. ' || o_orderkey || ') vs. ' || o_custkey || '.  Dr. No left!  Why? See pp. 3-4 and vol. 2. It ended.'"


@query(f"""
SELECT o_orderkey, unnest(s) AS sentence, unnest(range(len(s))) AS sent_idx FROM (SELECT o_orderkey, {_sql_sentences("t")} AS s FROM (SELECT o_orderkey, {_TALK} AS t FROM orders))""")
def sentence_abbreviations(spark, d):
    """Sentences with abbreviations inside."""
    return table(spark, d, "orders").select("o_orderkey", F.posexplode(T.sentences(F.expr(_TALK))).alias("sent_idx", "sentence"))


@query(f"WITH {I.BLOCKS} SELECT doc_id, block_idx, char_start, char_end, page, paragraph, block_type, md5(text) AS text_md5 FROM blocks")
def block_offsets(spark, d):
    return I.blocks(spark, d).select("doc_id", "block_idx", "char_start", "char_end", "page", "paragraph", "block_type", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {I.BLOCKS} SELECT doc_id, block_idx, section_header FROM blocks")
def section_carry(spark, d):
    return I.blocks(spark, d).select("doc_id", "block_idx", "section_header")


@query("SELECT doc_id, md5(text) AS raw_md5, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def raw_text_join(spark, d):
    raw = ingest.raw_text(ingest.split_blocks(table(spark, d, "documents")))
    return raw.select("doc_id", F.md5(F.col("raw_text").cast("binary")).alias("raw_md5"), F.length("raw_text").alias("n_chars"))


@query(f"""
WITH {I.BLOCKS}, kept AS (SELECT doc_id, list(block_idx ORDER BY block_idx) AS ids, list(text ORDER BY block_idx) AS texts FROM blocks WHERE trim(text) <> '' GROUP BY doc_id)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_blocks, md5(array_to_string(texts, chr(10))) AS texts_md5 FROM kept""")
def serialised_documents(spark, d):
    """Blocks through JSON and back."""
    content = ingest.serialise(I.blocks(spark, d).where("trim(text) <> ''"))
    back = F.from_json("parsed_content", "struct<blocks: array<struct<block_idx: int, text: string>>>")["blocks"]
    return content.select("doc_id", F.size(back).alias("n_blocks"), F.md5(F.array_join(F.transform(back, lambda b: b["text"]), "\n").cast("binary")).alias("texts_md5"))


_MERGED_SQL = f"""
{I.BLOCKS}, content AS (
  SELECT doc_id, block_idx, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM blocks WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' AND block_type <> 'heading'
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) AS n FROM content
), merged AS (
  WITH RECURSIVE walk AS (
    SELECT doc_id, n, block_idx, text AS held, regexp_matches(text, '[.!?]$') OR len({_sql_words("text")}) >= 50 AS done FROM numbered WHERE n = 1
    UNION ALL
    SELECT b.doc_id, b.n, b.block_idx, CASE WHEN w.done THEN b.text ELSE w.held || ' ' || b.text END,
      regexp_matches(b.text, '[.!?]$') OR len({_sql_words("CASE WHEN w.done THEN b.text ELSE w.held || ' ' || b.text END")}) >= 50
    FROM walk w JOIN numbered b ON b.doc_id = w.doc_id AND b.n = w.n + 1
  )
  SELECT w.doc_id, w.block_idx, w.held AS text FROM walk w WHERE w.done OR NOT EXISTS (SELECT 1 FROM numbered b WHERE b.doc_id = w.doc_id AND b.n = w.n + 1)
)"""


@query(f"WITH {_MERGED_SQL} SELECT doc_id, block_idx, md5(text) AS text_md5 FROM merged")
def merge_blocks(spark, d):
    merged = C.merge_short_blocks(C.content_blocks(I.blocks(spark, d)).select("doc_id", "block_idx", "text"))
    return merged.select("doc_id", "block_idx", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""
WITH pages_blocks AS (
  SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '>([^<>]+)<', 1)) AS text FROM pages
), counted AS (SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (regexp_matches(text, {_q(X.WEB_NAVIGATION)}, 'i')) AS n_nav FROM pages_blocks GROUP BY doc_id)
SELECT doc_id, n_blocks, n_nav, n_nav / n_blocks::DOUBLE > 0.3 AS is_webpage FROM counted""")
def webpage_print(spark, d):
    texts = F.explode(F.regexp_extract_all("html", F.lit(">([^<>]+)<"), F.lit(1)))
    return C.webpage_prints(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), texts.alias("text")))


def _fixed_sql(text: str) -> str:
    steps = [(r"([a-z])([.,])([A-Z])", r"\1\2 \3", "g"), (r"([a-z])([,;])([a-z])", r"\1\2 \3", "g"), (r"([a-z])([A-Z])", r"\1 \2", "g"), (rf"([A-Z][a-z]{{2,}})-({literal(X.KEEP_AFTER_HYPHEN)})\b", "\\1\x02\\2", "g"), (r"([A-Z][a-z]{2,})-([a-z]{2,5})\b", r"\1\2", "g"), ("\x02", "-", "g"), (rf"([a-z]{{4,}})({X.GLUED_WORDS})\b", r"\1 \2", "g"), (rf"([a-z]{{3,}})-({X.HYPHEN_ENDINGS})\b", r"\1\2", "gi")]
    for bad, good in X.KNOWN_JOINS.items():
        steps += [(rf"\b{bad[0]}(?i:{bad[1:]})\b", good, "g"), (rf"\b{bad[0].upper()}(?i:{bad[1:]})\b", good[0].upper() + good[1:], "g")]
    for source, new, flags in steps:
        text = f"regexp_replace({text}, {_q(source)}, {_q(new)}, '{flags}')"
    return text


@query(f"WITH {I.SENTENCES_SQL} SELECT block_idx, {_fixed_sql('sentence')} AS fixed FROM sentences")
def word_boundary_fix(spark, d):
    return I.sentences(spark, d).select("block_idx", T.fix_word_boundaries(F.col("sentence")).alias("fixed"))


def _markers_sql(text: str) -> str:
    parts = [(X.CITATION_NUMBERS, "numeric"), (X.CITATION_AUTHOR_PAREN, "author_year"), (X.CITATION_AUTHOR_BARE, "author_year"), (X.CITATION_PAREN_NUMBERS, "numeric")]
    return " || ".join(f"list_transform(regexp_extract_all({text}, {_q(p)}), lambda m: '{style}' || ' ' || m)" for p, style in parts)


@query(f"""
WITH {I.SENTENCES_SQL}, found AS (SELECT block_idx, {_markers_sql("sentence")} AS m FROM sentences),
each AS (SELECT block_idx, unnest(m) AS marker, unnest(range(len(m))) AS i FROM found),
first AS (SELECT block_idx, split_part(marker, ' ', 1) AS citation_style, substr(marker, strpos(marker, ' ') + 1) AS raw_marker, i FROM each)
SELECT block_idx, raw_marker, arg_min(citation_style, i) AS citation_style FROM first GROUP BY block_idx, raw_marker""")
def citation_markers(spark, d):
    return I.sentences(spark, d).select("block_idx", F.explode(T.citation_markers(F.col("sentence"))).alias("m")).select("block_idx", "m.*")


def _reason_sql(tags: str = "[]::VARCHAR[]") -> str:
    s = "regexp_replace(sentence, '^\\s+|\\s+$', '', 'g')"
    words = _sql_words("s")
    alpha = f"list_filter({words}, lambda w: regexp_matches(w, '^\\p{{L}}{{3,}}$'))"
    m = lambda p, flags="i", of="s": f"regexp_matches({of}, {_q(p)}{f', {_q(flags)}' if flags else ''})"
    verb, factual = f"(list_has_any(tags, {I._quoted(X.VERB_TAGS)}) OR {m(X.VERB, '', 'lower(s)')})", f"({m(X.FACTUAL_SIGNAL)} OR (n >= 15 AND {m(X.FINDING_VERB, 'i', 'lower(s)')}))"
    gates = [
        ("empty", "s = ''"), ("length", "n < 3 OR n > 150"), ("lowercase_start", "NOT regexp_matches(s, '^\\p{Lu}')"), ("skip_prefix", " OR ".join(f"starts_with(lower(s), {_q(p)})" for p in X.SKIP_PREFIXES)), ("structural", m(X.STRUCTURAL)),
        ("acknowledgement", m(X.ACKNOWLEDGEMENT)), ("disclosure_boilerplate", m(X.DISCLOSURE)), ("bibliography_entry", m(X.BIBLIOGRAPHY)), ("methods_procedural", f"{m(X.METHODS)} AND NOT ({m(X.CLINICAL_NOUN)} AND {m(X.RESULT_VERB)})"), ("meta", m(X.META)), ("meta_objective", m(X.META_OBJECTIVE)),
        ("glossary", m(X.GLOSSARY)), ("license_boilerplate", m(X.LICENSE)), ("journal_page_header_bleed", m(X.PAGE_HEADER)), ("all_caps_heading", f"len({alpha}) > 0 AND len(list_filter({alpha}, lambda w: w = upper(w))) / len({alpha}) >= 0.6"), ("url", m(X.URL, "")),
        ("affiliation", f"length(s) - length(replace(s, ';', '')) >= 2 AND {m(X.AFFILIATION)}"), ("toc_artifact", m(X.TOC, "")), ("webpage_nav", m(X.WEB_NAVIGATION)), ("publisher_imprint", m(X.PUBLISHER)), ("student_header", m(X.STUDENT_HEADER, "")),
        ("author_org_list", f"length(s) - length(replace(s, ',', '')) >= 3 AND len(regexp_extract_all(s, {_q(X.COUNTRY)})) >= 2"), ("legal_boilerplate", m(X.LEGAL)), ("vbg_preamble", f"coalesce(list_filter(tags, lambda t: NOT list_contains({I._quoted(X.OPENING_TAGS)}, t))[1] = 'VBG', FALSE)"), ("high_nnp_ratio", f"len(tags) > 0 AND len(list_filter(tags, lambda t: t = 'NNP')) / len(tags)::DOUBLE > {X.PROPER_SHARE}"),
        ("no_terminal_punct", f"NOT regexp_matches(s, '[.!?]$') AND NOT (n >= 15 AND {verb})"), ("no_verb", f"NOT {verb} AND NOT {m(X.METRIC, '')}"), ("no_factual_signal", f"{verb} AND NOT {factual}"),
    ]
    whens = " ".join(f"WHEN {cond} THEN '{name}'" for name, cond in gates)
    return f"prepared AS (SELECT doc_id, block_idx, sent_idx, sentence, {s} AS s, len({_sql_words(s)}) AS n, {tags} AS tags FROM sentences), judged AS (SELECT doc_id, block_idx, sent_idx, sentence, CASE {whens} END AS reject_reason FROM prepared)"


_JUDGED_SQL = f"{I.SENTENCES_SQL}, {_reason_sql()}"


@query(f"WITH {_JUDGED_SQL} SELECT block_idx, sentence, reject_reason FROM judged")
def claim_reject_reasons(spark, d):
    return C.judge(I.sentences(spark, d)).select("block_idx", "sentence", "reject_reason")


_TAGS_SQL = "list_transform(list_filter(regexp_split_to_array(sentence, '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN regexp_matches(w, '^(The|the|of)$') THEN 'DT' WHEN regexp_matches(w, 'ing[.,]?$|^Sales$') THEN 'VBG' WHEN regexp_matches(w, '^[A-Z]') THEN 'NNP' WHEN regexp_matches(w, 'ed$') THEN 'VBD' ELSE 'NN' END)"


@query(f"WITH {I.SENTENCES_SQL}, {_reason_sql(_TAGS_SQL)} SELECT block_idx, reject_reason FROM judged")
def tagged_reject_reasons(spark, d):
    """The gates with a tagger: a stand-in that goes by a word's letters."""
    tag = lambda w: F.when(w.rlike("^(The|the|of)$"), "DT").when(w.rlike("ing[.,]?$|^Sales$"), "VBG").when(w.rlike("^[A-Z]"), "NNP").when(w.rlike("ed$"), "VBD").otherwise("NN")
    return C.judge(I.sentences(spark, d).withColumn("tags", F.transform(T.words(F.col("sentence")), tag))).select("block_idx", "reject_reason")


@query(f"WITH {_JUDGED_SQL} SELECT coalesce(reject_reason, 'accepted') AS reason, count(*) AS n FROM judged GROUP BY 1")
def reject_counts(spark, d):
    return C.judge(I.sentences(spark, d)).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""
WITH {_JUDGED_SQL}, reasons AS (SELECT doc_id, reject_reason, count(*) AS n, min(block_idx) AS first FROM judged WHERE reject_reason IS NOT NULL GROUP BY 1, 2),
top AS (SELECT doc_id, reject_reason FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM reasons) WHERE r = 1),
totals AS (SELECT doc_id, count(*) AS n_candidates, count(*) FILTER (reject_reason IS NULL) AS n_claims FROM judged GROUP BY doc_id),
told AS (SELECT unnest({I._quoted(X.NO_CLAIMS)}) AS reason, unnest({I._quoted(X.NO_CLAIMS.values())}) AS message)
SELECT c.c_custkey AS doc_id, coalesce(t.n_candidates, 0) AS n_candidates, coalesce(t.n_claims, 0) AS n_claims,
  CASE WHEN coalesce(t.n_claims, 0) > 0 THEN NULL WHEN coalesce(t.n_candidates, 0) = 0 THEN {_q(X.NO_BLOCKS)}
    ELSE coalesce(told.message, 'No verifiable claims were found across ' || CAST(t.n_candidates AS VARCHAR) || ' candidate sentences.') END AS diagnostic
FROM customer c LEFT JOIN totals t ON t.doc_id = c.c_custkey LEFT JOIN top ON top.doc_id = c.c_custkey LEFT JOIN told ON told.reason = top.reject_reason""")
def zero_claim_diagnostic(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    return C.diagnose(C.judge(I.sentences(spark, d)), docs)


def _accepted(spark, d):
    """Claims of the judged sentences, which are written first: a filter on
    the reason would move below whatever spreads the rows."""
    return Workspace(spark, "judged").write(C.judge(I.sentences(spark, d)), "judged").where("reject_reason is null")


_KEY_SQL = "regexp_replace(lower(sentence), '[-\\s]', '', 'g')"


@query(f"""
WITH {_JUDGED_SQL} SELECT doc_id, block_idx, sentence FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, {_KEY_SQL} ORDER BY block_idx, sent_idx) AS r FROM judged WHERE reject_reason IS NULL) WHERE r = 1""")
def claim_dedup(spark, d):
    return C.first_occurrences(_accepted(spark, d)).select("doc_id", "block_idx", "sentence")


@query("""
WITH turns AS (SELECT conv_id AS doc_id, turn AS block_idx, text AS sentence FROM conversations)
SELECT doc_id, block_idx, md5(lag(sentence) OVER (PARTITION BY doc_id ORDER BY block_idx, sentence)) AS prev_md5, md5(sentence) AS own_md5 FROM turns""")
def prev_sentence_lag(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_idx"), F.col("text").alias("sent_idx"), F.col("text").alias("sentence"))
    return C.previous_sentences(rows).select("doc_id", "block_idx", F.md5(F.col("prev_sentence").cast("binary")).alias("prev_md5"), F.md5(F.col("sentence").cast("binary")).alias("own_md5"))


_SAMPLE_ORDER = """
sized AS (SELECT *, greatest(1, total // least(5, total)) AS size FROM items), sectioned AS (SELECT *, greatest(1, want // CAST(ceil(total / size::DOUBLE) AS BIGINT)) AS each FROM sized)"""


@query(f"""
WITH items AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS total, 1 + l_suppkey % 29 AS want FROM lineitem),
{_SAMPLE_ORDER}, ranked AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY i % size >= each, i) AS pick FROM sectioned)
SELECT l_suppkey, i, pick FROM ranked WHERE pick <= want""")
def stratified_sample(spark, d):
    supp = Window.partitionBy("l_suppkey")
    rows = table(spark, d, "lineitem").withColumns({"i": F.row_number().over(supp.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1, "total": F.count("*").over(supp), "want": F.col("l_suppkey") % 29 + 1})
    order = C.stratified(F.col("i"), F.col("total"), F.col("want"))
    return rows.withColumn("pick", F.row_number().over(supp.orderBy(order))).where("pick <= want").select("l_suppkey", "i", "pick")


_CLAIMS_SQL = f"""
{_JUDGED_SQL}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {_KEY_SQL} ORDER BY block_idx) AS r FROM judged WHERE reject_reason IS NULL) WHERE r = 1),
claims AS (SELECT doc_id, block_idx, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) - 1 AS claim_idx, len({_markers_sql("sentence")}) > 0 AS cited FROM kept),
capped AS (SELECT c.*, least(greatest(coalesce(u.c_nationkey % 5, 1), 1) * 4, 25) AS cap FROM claims c JOIN customer u ON u.c_custkey = c.doc_id),
counted AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cited ORDER BY claim_idx) - 1 AS i, count(*) OVER (PARTITION BY doc_id, cited) AS total,
  greatest(cap - count(*) FILTER (cited) OVER (PARTITION BY doc_id), 0) AS want FROM capped),
items AS (SELECT * FROM counted), {_SAMPLE_ORDER},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cited DESC, CASE WHEN cited THEN FALSE ELSE i % size >= each END, i) AS sample_rank FROM sectioned)"""


def _capped(spark, d):
    kept = C.first_occurrences(_accepted(spark, d))
    rows = kept.withColumn("markers", T.citation_markers(F.col("sentence"))).withColumn("claim_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_idx")) - 1)
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_nationkey") % 5).alias("total_pages"))
    return rows, C.cap(rows, pages)


@query(f"WITH {_CLAIMS_SQL} SELECT doc_id, claim_idx, sample_rank FROM ranked WHERE sample_rank <= cap")
def claim_cap(spark, d):
    return _capped(spark, d)[1].select("doc_id", "claim_idx", "sample_rank")


@query(f"""
WITH {_CLAIMS_SQL}, made AS (SELECT doc_id, count(*) AS extracted, count(*) FILTER (sample_rank <= cap) AS kept FROM ranked GROUP BY doc_id)
SELECT doc_id, extracted, kept, extracted - kept AS discarded, round_even((extracted - kept) / extracted::DOUBLE, 3) AS discard_ratio FROM made""")
def extraction_telemetry(spark, d):
    return C.telemetry(*_capped(spark, d))


@query(f"""
WITH {I.BLOCKS}, b AS (SELECT * FROM blocks WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 20),
cut AS (SELECT doc_id, block_idx, {_fixed_sql("regexp_replace(text, '^\\s+|\\s+$', '', 'g')")} AS t FROM b),
each AS (SELECT doc_id, block_idx, [t] || list_filter({_sql_sentences("t")}, lambda s: length(s) >= 20) AS spans FROM cut)
SELECT doc_id, block_idx, CAST(len(spans) AS BIGINT) AS n_spans FROM each""")
def span_extract(spark, d):
    """Span counts of blocks; texts of few letters give none."""
    rows = I.blocks(spark, d)
    return R.extract_spans(rows).groupBy("doc_id", "block_idx").agg(F.count("*").alias("n_spans"))


@query(f"""
WITH {I.BLOCKS}, claims AS (SELECT b.item_id AS claim_id, d.doc_id, b.text AS claim_text, d.text AS raw, strpos(d.text, b.text) AS pos FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id),
found AS (SELECT *, CASE WHEN pos > 0 THEN pos - 1 ELSE 0 END AS char_start, CASE WHEN pos > 0 THEN pos - 1 + length(claim_text) ELSE 0 END AS char_end FROM claims)
SELECT f.claim_id, f.doc_id, f.char_start, f.char_end, f.pos > 0 AS position_exact, min(k.block_idx) AS block_idx, arg_min(k.page, k.block_idx) AS page_number, arg_min(k.paragraph, k.block_idx) AS paragraph_index
FROM found f LEFT JOIN blocks k ON f.pos > 0 AND k.doc_id = f.doc_id AND k.char_start <= f.char_start AND f.char_start < k.char_end GROUP BY ALL""")
def position_recover(spark, d):
    n = table(spark, d, "benchmark").agg(F.count("*")).scalar()
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("raw_text"))
    claims = docs.select("doc_id", (F.col("doc_id") % n).alias("claim_id")).join(I.claims(spark, d), "claim_id")
    blocks = I.blocks(spark, d)
    out = C.locate(claims, docs, blocks)
    first = out.where("char_end > 0").alias("o").join(blocks.alias("b"), (F.col("o.doc_id") == F.col("b.doc_id")) & (F.col("b.char_start") <= F.col("o.char_start")) & (F.col("o.char_start") < F.col("b.char_end")))
    index = first.groupBy("o.claim_id", "o.doc_id").agg(F.min("b.block_idx").alias("block_idx"))
    return out.join(index, ["claim_id", "doc_id"], "left").select("claim_id", "doc_id", "char_start", "char_end", "position_exact", "block_idx", "page_number", "paragraph_index")


@query("""
SELECT doc_id, substr(text, CAST(greatest(0, n_chars // 2 - 20) + 1 AS BIGINT), CAST(n_chars // 2 + 50 - greatest(0, n_chars // 2 - 20) AS BIGINT)) AS snippet FROM documents""")
def context_snippet(spark, d):
    start = F.floor(F.col("n_chars") / 2).cast("int")
    return table(spark, d, "documents").select("doc_id", T.context_snippet(F.col("text"), start, start + 30, 20).alias("snippet"))


@query("""
SELECT event_id, CASE WHEN v >= 0.85 THEN 'A' WHEN v >= 0.70 THEN 'B' WHEN v >= 0.55 THEN 'C' ELSE 'D' END AS grade,
  CASE event_type WHEN 'click' THEN 'Insufficient Support' WHEN 'view' THEN 'Needs Review' ELSE 'Unreviewed' END AS label FROM (SELECT *, (event_id % 101) / 100.0::DOUBLE AS v FROM events)""")
def confidence_grade(spark, d):
    kind = F.when(F.col("event_type") == "click", "insufficient_support").when(F.col("event_type") == "view", "needs_review")
    return table(spark, d, "events").select("event_id", T.confidence_grade(F.col("event_id") % 101 / F.lit(100.0)).alias("grade"), T.review_label(kind).alias("label"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'docx' WHEN p_partkey % 4 = 1 THEN 'docx' WHEN p_partkey % 4 = 2 THEN 'pdf' ELSE '' END AS kind FROM part""")
def file_types(spark, d):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.element_at(F.array(*map(F.lit, (".DOC", ".x.docx", ".PDF", ""))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", T.file_type(name).alias("kind"))
