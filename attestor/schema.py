"""Schemas of the tables."""

from __future__ import annotations

POSITION = "struct<page: int, paragraph: int, char_start: long, char_end: long, section_header: string, bbox: array<double>>"
BLOCK = f"struct<text: string, block_type: string, position: {POSITION}>"
PARSED = f"struct<filename: string, total_pages: int, blocks: array<{BLOCK}>>"
METADATA = "struct<title: string, authors: array<string>, year: string>"

PACKETS = "packet_id string, status string, report_filename string, session_id string, is_demo boolean, created_at timestamp"
SOURCE_DOCUMENTS = (
    f"packet_id string, doc_id string, source_no int, is_report boolean, filename string, file_type string, file_size_bytes long, raw_text string, total_pages int, parse_status string, parse_error string, parsed_content {PARSED}, paper_metadata {METADATA}"
)
RUNS = "run_id string, packet_id string, status string, pipeline_config map<string, string>, started_at timestamp, completed_at timestamp, error_summary string, created_at timestamp"
CLAIMS = "packet_id string, claim_id string, doc_id string, run_id string, claim_text string, section_header string, page_number int, paragraph_index int, char_start long, char_end long, status string"
ANCHORS = "claim_id string, anchor_no int, raw_marker string, citation_style string, target_id string, resolution_status string"
EVIDENCE = "claim_id string, source_document_id string, run_id string, span_text string, char_start long, char_end long, section_header string, relevance_score double, retrieval_method string, retrieval_rank int"
VERDICTS = "claim_id string, run_id string, verdict_type string, confidence double, reasoning string, model_name string, prompt_version string"
DECISIONS = "claim_id string, run_id string, reviewer_id string, action string, verdict_at_decision string, decided_at timestamp"
SCIFACT_CLAIMS = "id long, claim string, evidence_label string, evidence map<string, array<struct<sentences: array<int>, label: string>>>, cited_doc_ids array<long>"
SCIFACT_CORPUS = "doc_id long, title string, abstract array<string>"
CASES = "id string, verdict_class string, claim_text string, evidence_spans array<struct<span_text: string, relevance_score: double, rank: int>>, gold_verdict string, source string, notes string"
CASE_RESULTS = "id long, gold_label string, predicted_label string, confidence double, retrieved_spans array<string>, retrieval_recall int, latency_ms double, status string, error string"
