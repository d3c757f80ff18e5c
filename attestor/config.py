"""Settings that decide results. Defaults are fixed values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    max_file_size_mb: int = 50
    top_k_bm25: int = 5
    top_k_final: int = 2
    dense_enabled: bool = True
    dense_max_spans: int = 3000
    claims_per_page: int = 4
    claims_at_most: int = 25
    self_verify_cap: float = 0.80
    prompt_version: str = "v1"
    entail: float = 0.92
    contradict: float = 0.75
    least_confidence: float = 0.50
    tiebreak: float = 0.65
    webpage_share: float = 0.30
    merge_words: int = 50
    resolve_at: float = 80.0
    margin_at: float = 65.0
    margin_lead: float = 20.0
    recent_runs: int = 50
    snippet_chars: int = 200
    tables_up_to_pages: int = 50

    @property
    def top_k_dense(self) -> int:
        return max(2, self.top_k_bm25 // 2)


DEFAULTS = Settings()

VERDICTS = ("supported", "contradicted", "insufficient_support", "needs_review")
#: Order of the reviewers' queue; claims without a verdict come last.
SEVERITY = {"contradicted": 0, "needs_review": 1, "insufficient_support": 2, "supported": 3}
NO_VERDICT_SEVERITY = 4
STAGE_SECONDS = {"parsing": 5, "extracting": 15, "retrieving": 50, "classifying": 35}
IN_FLIGHT = ("queued", "parsing", "extracting", "retrieving", "classifying")
REVIEW_ACTIONS = ("approve", "reject", "mark_insufficient")
SCIFACT_LABEL = {"supported": "SUPPORT", "contradicted": "CONTRADICT", "insufficient_support": "", "needs_review": ""}
