"""The application's calls, and the evaluation of a claim set."""

import io
import zipfile

import pytest

from attestor.plans import evaluate
from attestor.plans.service import Service, ServiceError
from attestor.sources import jsonl

REPORT = "Results\nThe treatment reduced mortality by 20 percent in the cohort of 300 patients.\nCosts increased significantly compared to earlier years."
SOURCE = "The treatment reduced mortality by 20 percent in the cohort of 300 patients in our study.\nNothing else is in this text of ours."
DOCS = "doc_id string, is_report boolean, filename string, text string, total_pages int, paper_metadata struct<title: string, authors: array<string>, year: string>"


def test_calls(spark, tmp_path):
    app = Service(spark, str(tmp_path))
    docs = spark.createDataFrame([("r", True, "report.pdf", REPORT, 1, None), ("s", False, "s.pdf", SOURCE, 1, None)], DOCS)
    app.create_packet("p", docs, "me")
    with pytest.raises(ServiceError, match="NO_REPORT_DOCUMENT"):
        app.create_packet("q", docs.where("not is_report"))
    with pytest.raises(ServiceError, match="PACKET_NOT_FOUND"):
        app.run("q", "x")
    app.run("p", "run1")
    assert app.run_status("run1") == ("completed", None)
    got = {r.claim_id: r.verdict_type for r in app.results("run1").collect()}
    assert got["r:0"] == "supported" and len(got) == 2
    app.run("p", "run1")  # again: nothing is judged twice
    assert app.results("run1").count() == 2
    assert [r.claim_id for r in app.queue("p", "run1", verdict="supported", band="high").collect()] == ["r:0"]
    assert app.queue("p", "run1", source="nowhere").count() == 0
    shown = app.claim("p", "r:0", "run1").collect()
    assert shown[0].source_filename == "s.pdf" and "Results" in shown[0].context
    app.review("p", "r:0", "run1", "approve")
    app.review("p", "r:0", "run1", "reject")
    assert [(r.action, r.verdict_at_decision) for r in app.decisions("p").collect()] == [("reject", "supported")]
    for call, code in ((lambda: app.review("p", "r:0", "run1", "burn"), "INVALID_ACTION"), (lambda: app.review("p", "r:0", "run9", "approve"), "NO_RUN_VERSION"), (lambda: app.run_status("run9"), "RUN_NOT_FOUND"), (lambda: app.claim("p", "zz", "run1"), "NO_CLAIMS"), (lambda: app.delete_packet("p", "you"), "FORBIDDEN")):
        with pytest.raises(ServiceError, match=code):
            call()
    assert app.dashboard("you").count() == 0 and app.dashboard("me").first().run_id == "run1"
    app.delete_packet("p", "me")
    assert app.table("verdicts").count() == 0 and app.table("packets").count() == 0


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return data.getvalue()


def test_stages_one_by_one_from_files(spark, tmp_path):
    app, odd = Service(spark, str(tmp_path)), "a/b:c=d %2F"
    schema = "filename string, is_report boolean, content binary"
    files = spark.createDataFrame([("../r.docx", True, docx(*REPORT.split("\n"))), ("s.docx", False, docx(*SOURCE.split("\n")))], schema)
    for wrong, code in ((spark.createDataFrame([("r.pdf", True, b"text")], schema), "FILE_REJECTED"), (files.where("not is_report"), "NO_REPORT_DOCUMENT")):
        with pytest.raises(ServiceError, match=code):
            app.submit("w", wrong)
    assert app.table("packets").count() == 0 and app.health() == {"status": "ok"}
    app.submit(odd, files, "me")
    app.submit("a/b", files, "me")
    assert app.table("documents").count() == 0
    with pytest.raises(ServiceError, match="NO_CLAIMS"):
        app.retrieve(odd, "run1")
    app.extract(odd, "run1")
    assert {r.filename for r in app.table("documents").collect()} == {"r.docx", "s.docx"}
    assert app.poll("run1").first().status == "extracting" and 0 <= app.poll("run1").first().pct <= 99
    app.retrieve(odd, "run1")
    app.classify(odd, "run1")
    got = {r.claim_id: r.verdict_type for r in app.results("run1").collect()}
    claim = next(c for c, v in got.items() if v == "supported")
    model = lambda: lambda system, prompts: [f"Because of {len(p)} letters asked." for p in prompts]
    assert app.explain(odd, claim, "run1", model).startswith("Because of") and app.table("explanations").count() == 1

    def broken():
        raise OSError

    assert app.explain(odd, claim, "run1", broken) is None and app.table("explanations").count() == 1
    with pytest.raises(ServiceError, match="NO_RUN_VERSION"):
        app.explain(odd, "none", "run1", model)
    app.delete_packet(odd, "me")  # its folders only
    assert app.table("verdicts").count() == 0 and [r.packet_id for r in app.table("packets").collect()] == ["a/b"]
    app.run("a/b", "run2")
    assert app.run_status("run2") == ("completed", None)


def test_demo_is_seen_by_all_and_stays(spark, tmp_path):
    app = Service(spark, str(tmp_path))
    app.seed_demo()
    assert app.dashboard("anybody").first().packet_id == "demo" and app.results("demo-run").count() == 4
    assert [r.verdict_type for r in app.queue("demo", "demo-run").collect()][0] == "contradicted"
    with pytest.raises(ServiceError, match="FORBIDDEN"):
        app.delete_packet("demo", None)


def test_evaluation(spark):
    claims = spark.createDataFrame([(1, "Aspirin reduces pain in adults", "SUPPORT", [7]), (2, "Aspirin does not reduce pain", "CONTRADICT", [7, 9]), (3, "Cats sleep", "", [9])], "id long, claim string, gold_label string, cited_doc_ids array<long>")
    corpus = spark.createDataFrame([(7, "t", ["Aspirin reduces pain in adults over time.", "We met 12 people."])], "doc_id long, title string, abstract array<string>")
    results = evaluate.evaluate(claims, corpus)
    got = {r.id: r for r in results.collect()}
    assert got[1].predicted_label == "supported" and got[1].retrieved_spans[0].startswith("Aspirin") and got[3].retrieval_recall == 0 and got[3].predicted_label == "insufficient_support"
    f1, bins, ece = evaluate.report(results)
    assert f1.first().n_total == 3 and bins.count() == 10 and ece.first().n_classified == 3


def test_dev_pairs(spark):
    schema = "id long, claim string, evidence map<string, array<struct<sentences: array<int>, label: string>>>, cited_doc_ids array<long>"
    claims = spark.createDataFrame([(1, "a", {"7": [([1], "SUPPORT")]}, [7]), (2, "b", {"8": [([0], "CONTRADICT")]}, [8]), (3, "c", {}, [8, 7]), (4, "d", None, [])], schema)
    corpus = spark.createDataFrame([(7, "t", ["s0", "s1", "s2", "s3"])], "doc_id long, title string, abstract array<string>")
    got = {(r.id, r.premise, r.label) for r in jsonl.dev_pairs(claims, corpus).collect()}
    assert got == {(1, "s1", "SUPPORT"), (2, "No evidence.", "CONTRADICT"), (3, "s0 s1 s2", ""), (4, "No evidence.", "")}
