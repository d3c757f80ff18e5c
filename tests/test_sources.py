"""Files, evaluation data, caches, streams and whole runs."""

import io
import json
import sys
import types
import zipfile

import pytest
from pyspark.sql import functions as F

from attestor.operators import ingest
from attestor.plans import verify
from attestor.sources import cache, files, jsonl
from attestor.streaming import incremental

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(*paragraphs):
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>' for style, text in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}{table}</w:body></w:document>")
    return out.getvalue()


def test_uploads(spark, tmp_path):
    for packet, name, content in (("p1", "a.docx", docx(("Heading1", "Intro"), ("Normal", "Some text."), ("Normal", " "))), ("p1", "b.docx", docx(("Title", "T"))), ("p2", "c.txt", b"plain"), ("p3", "broken.docx", b"PK\x03\x04 word/document")):
        (tmp_path / packet).mkdir(exist_ok=True)
        (tmp_path / packet / name).write_bytes(content)
    checked = ingest.check_files(files.read_uploads(spark, str(tmp_path)))
    assert {(r.packet_id, r.accepted) for r in checked.collect()} == {("p1", True), ("p2", False), ("p3", True)}
    parsed = files.parse_files(checked.where("accepted"))
    rows = {r.path.rsplit("/", 1)[-1]: r for r in parsed.collect()}
    assert [(b.text, b.block_type) for b in rows["a.docx"].blocks] == [("Intro", "heading"), ("Some text.", "paragraph")] and rows["a.docx"].tables == [[["a", "b"]]]
    assert rows["broken.docx"].error and rows["a.docx"].error is None
    placed = files.position_blocks(parsed.where("path like '%a.docx'")).orderBy("block_idx").collect()
    assert [(b.char_start, b.char_end, b.section_header) for b in placed] == [(0, 5, None), (6, 16, "Intro")]
    assert files.safe_name("../../etc/x.pdf") == "x.pdf" and files.safe_name("..") == "upload.bin" and files.safe_name("") == "upload.bin"


def test_results_resume(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join([json.dumps({"id": 1, "status": "error"}), "{broken", json.dumps({"id": 2, "status": "classified"}), json.dumps({"id": 1, "status": "classified", "confidence": 0.5})]))
    results = jsonl.read_results(spark, str(tmp_path))
    assert {(r.id, r.status) for r in results.collect()} == {(1, "classified"), (2, "classified")}
    claims = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    assert [r.id for r in jsonl.pending(claims, results).orderBy("id").collect()] == [3, 4] and [r.id for r in jsonl.pending(claims, results, 1).collect()] == [3]
    jsonl.append_results(spark.createDataFrame([(3, "classified")], "id long, status string"), str(tmp_path / "more"))


def test_claim_sets(spark, tmp_path):
    rows = [{"id": 1, "claim": "c1", "evidence_label": "SUPPORT", "evidence": {"7": [{"sentences": [0, 9], "label": "SUPPORT"}]}, "cited_doc_ids": [7, None]}, {"id": 1, "claim": "again", "evidence_label": "CONTRADICT"}, {"id": 2, "claim": "c2", "evidence_label": "x", "cited_doc_ids": [8, 7]}, {"id": 3, "claim": "c3", "evidence": {"7": [{"sentences": [], "label": "CONTRADICT"}]}}]
    (tmp_path / "claims.jsonl").write_text("\n".join(map(json.dumps, rows)))
    claims = jsonl.read_claims(spark, str(tmp_path / "claims.jsonl"), expected=3)
    assert {(r.id, r.claim, r.gold_label, tuple(r.cited_doc_ids)) for r in claims.collect()} == {(1, "c1", "SUPPORT", (7,)), (2, "c2", "", (8, 7)), (3, "c3", "", ())}
    with pytest.raises(ValueError):
        jsonl.read_claims(spark, str(tmp_path / "claims.jsonl"), expected=4)
    corpus = spark.createDataFrame([(7, "t", ["s0", "s1", "s2", "s3"])], "doc_id long, title string, abstract array<string>")
    assert jsonl.cited_sentences(claims, corpus).count() == 8
    raw = spark.read.schema("id long, claim string, evidence map<string, array<struct<sentences: array<int>, label: string>>>, cited_doc_ids array<long>").json(str(tmp_path / "claims.jsonl"))
    pairs = {(r.premise, r.hypothesis, r.label) for r in jsonl.train_pairs(raw, corpus).collect()}
    assert pairs == {("s0", "c1", "SUPPORT"), ("s0 s1 s2", "c3", "CONTRADICT"), ("s0 s1", "c2", "")}


def test_cases(spark, tmp_path):
    case = {"id": "a", "gold_verdict": "supported", "evidence_spans": [{"span_text": "s", "relevance_score": 1.0, "rank": 1}]}
    (tmp_path / "one.json").write_text(json.dumps(case))
    (tmp_path / "many.json").write_text(json.dumps([case, {**case, "id": "b"}]))
    assert sorted(r.id for r in jsonl.read_cases(spark, str(tmp_path)).collect()) == ["a", "a", "b"]


def test_score_cache(spark, tmp_path):
    calls = []

    def score(df):
        calls.append(df.count())
        return df.select("key", F.length("text").alias("score"))

    rows = spark.createDataFrame([("k1", "a"), ("k2", "bb"), ("k1", "a")], "key string, text string")
    path = str(tmp_path / "cache")
    for more in (rows, rows.unionByName(spark.createDataFrame([("k3", "ccc")], rows.schema))):
        out = cache.scored(spark, path, more, ["key"], score)
        assert all(r.score == len(r.text) for r in out.collect()) and out.count() == more.count()
    assert calls == [2, 1]


def test_stream_judges_each_claim_once(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = "claim_id long, run_id long, arrived_at timestamp"
    row = lambda i: (i, 1, None)
    arrive = lambda *ids: spark.createDataFrame([row(i) for i in ids], schema).withColumn("arrived_at", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.mode("append").parquet(source)
    arrive(1, 2, 2)
    for _ in range(2):
        query = incremental.start(incremental.read_claims(spark, source, schema), lambda df: df.withColumn("verdict_type", F.lit("needs_review")), out, marks).trigger(availableNow=True).start()
        query.awaitTermination(120)
        arrive(2, 3)
    assert sorted(r.claim_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_whole_run(spark):
    report = "Results\nThe treatment reduced mortality by 20 percent in the cohort of 300 patients [1]. Costs increased significantly compared to earlier years (Smith, 2019).\nReferences\nMiller J. Treatment of mortality in cohorts. 2018.\nSmith A. Costs of treatment over years. 2019."
    first = "The treatment reduced mortality by 20 percent in the cohort of 300 patients in our study.\nOther matters of the study are described in the appendix of this work."
    second = "Costs of treatment over years by Smith 2019.\nCosts never increased significantly compared to earlier years, says Smith 2019."
    schema = "packet_id string, doc_id string, is_report boolean, source_no int, filename string, text string, total_pages int, paper_metadata struct<title: string, authors: array<string>, year: string>"
    docs = spark.createDataFrame([("p", "r", True, 0, "report.pdf", report, 1, None), ("p", "a", False, 1, "miller_treatment_mortality.pdf", first, 3, ("Treatment of mortality in cohorts", ["J Miller"], "2018")), ("p", "b", False, 2, "smith_costs.pdf", second, 2, None)], schema)
    out = verify.verify(docs)
    assert {(r.raw_marker, r.target_id) for r in out["anchors"].collect()} == {("[1]", "a"), ("(Smith, 2019)", "b")}
    got = {r.claim_id: r.verdict_type for r in out["verdicts"].collect()}
    assert got == {"r:0": "supported", "r:1": "contradicted"} and out["recall"].first().recall_at_k == 1.0
    assert {(r.claim_id, r.source_document_id) for r in out["evidence"].collect()} == {("r:0", "a"), ("r:1", "b")}


def test_database_round_trip(spark):
    """With the in-memory database that comes with Spark."""
    url, driver = "jdbc:derby:memory:attestor;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(100).selectExpr("id as claim_id", "concat('text ', id) as claim_text", "id / 100.0d as confidence")
    files.write_jdbc(rows.where("claim_id < 60"), url, "claims", driver=driver)
    files.write_jdbc(rows.where("claim_id >= 60"), url, "claims", driver=driver)
    whole = files.read_jdbc(spark, url, "claims", driver=driver)
    parts = files.read_jdbc(spark, url, "claims", key="CLAIM_ID", bounds=(0, 100), parts=4, driver=driver)
    assert parts.rdd.getNumPartitions() == 4
    wanted = sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) == wanted


class _Page:
    """What a PDF library gives for a page, as far as it is read."""

    def __init__(self, blocks, tables=(), height=800.0):
        self._blocks, self._tables, self.rect = blocks, tables, types.SimpleNamespace(height=height)

    def find_tables(self):
        return types.SimpleNamespace(tables=self._tables)

    def get_text(self, kind):
        assert kind == "dict"
        return {"blocks": self._blocks}


class _Document(list):
    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def test_pdf_blocks_by_a_stub_of_the_library(monkeypatch):
    block = lambda text, size, x0, y0, x1, y1: {"bbox": (x0, y0, x1, y1), "lines": [{"spans": [{"text": t, "size": size} for t in text]}]}
    table = types.SimpleNamespace(bbox=(0, 300, 600, 400), extract=lambda: [["a", None], ["b", "c"]])
    pages = [
        _Page([block(["Ti", "tle "], 14.0, 0, 0, 100, 20), block(["Body text."], 10.0, 0, 50, 600, 70), block(["in table"], 10.0, 10, 320, 50, 340), {"bbox": (0, 500, 9, 509)}], [table]),
        _Page([block(["1 A note."], 8.0, 0, 760, 300, 780), block(["  "], 10.0, 0, 0, 1, 1)]),
    ]
    opened = []
    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=lambda stream, filetype: opened.append((stream, filetype)) or _Document(pages)))
    blocks, tables = files.parse_pdf(b"%PDF-")
    assert opened == [(b"%PDF-", "pdf")] and tables == [[["a", ""], ["b", "c"]]]
    assert [(b["text"], b["block_type"], b["page"]) for b in blocks] == [("Title", "heading", 1), ("Body text.", "paragraph", 1), ("1 A note.", "footnote", 2)]
    many = _Document([pages[0]] * 51)  # beyond fifty pages tables are not looked for
    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=lambda stream, filetype: many))
    blocks, tables = files.parse_pdf(b"%PDF-")
    assert tables == [] and sum(b["text"] == "in table" for b in blocks) == 51
