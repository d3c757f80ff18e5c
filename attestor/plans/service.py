"""The application's calls over tables in a folder.

Every table is Parquet in one folder for each packet, so that a call on a
packet reads and deletes its folders only. Runs and decisions are logs; the
last entry stands.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor import schema
from attestor.config import DEFAULTS, REVIEW_ACTIONS, Settings
from attestor.operators import explanation, ingest, review
from attestor.sources import files
from attestor.workspace import Workspace

from . import verify as P

_TABLES = {
    "packets": schema.PACKETS,
    "documents": f"packet_id string, doc_id string, is_report boolean, source_no int, filename string, text string, total_pages int, paper_metadata {schema.METADATA}",
    "run_log": "packet_id string, run_id string, status string, error_summary string, changed_at timestamp",
    "claims": "packet_id string, run_id string, claim_id string, doc_id string, claim_text string, markers array<struct<raw_marker: string, citation_style: string>>, char_start long, char_end long, page_number int, paragraph_index int, section_header string, status string",
    "anchors": "packet_id string, run_id string, claim_id string, anchor_no int, raw_marker string, citation_style string, target_id string, resolution_status string",
    "evidence": "packet_id string, run_id string, claim_id string, source_document_id string, span_text string, relevance_score double, retrieval_method string, retrieval_rank int, char_start long, char_end long, section_header string",
    "verdicts": "packet_id string, run_id string, claim_id string, verdict_type string, confidence double, reasoning string, model_name string, prompt_version string",
    "uploads": "packet_id string, filename string, is_report boolean, path string, content binary, file_type string, uploaded_at timestamp",
    "explanations": "packet_id string, run_id string, claim_id string, explanation string, explained_at timestamp",
    "decisions": "packet_id string, claim_id string, run_id string, action string, decided_at timestamp, decision_id long",
}


class ServiceError(LookupError):
    """An error with the application's code."""

    def __init__(self, code: str, text: str = ""):
        super().__init__(f"{code} {text}".strip())
        self.code = code


class Service:
    def __init__(self, spark: SparkSession, root: str, using: P.Scorers | None = None, settings: Settings = DEFAULTS):
        self.spark, self.root, self.using, self.settings = spark, root.rstrip("/"), using or P.Scorers(), settings

    # tables

    def _path(self, name: str, packet_id: str | None = None):
        """A table's folder, or that of a packet, whose id is escaped as in writing."""
        jvm = self.spark.sparkContext._jvm
        inside = "" if packet_id is None else f"/packet_id={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(packet_id)}"
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}{inside}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def table(self, name: str) -> DataFrame:
        path, fs = self._path(name)
        reader = self.spark.read.schema(_TABLES[name])
        return reader.parquet(f"{self.root}/{name}") if fs.exists(path) else self.spark.createDataFrame([], _TABLES[name])

    def _append(self, name: str, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in self.spark.createDataFrame([], _TABLES[name]).columns]
        kinds = dict(self.spark.createDataFrame([], _TABLES[name]).dtypes)
        have = set(rows.columns)
        rows.select(*((F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in columns)).write.mode("append").partitionBy("packet_id").parquet(f"{self.root}/{name}")

    def _log(self, packet_id: str, run_id: str, status: str, error: str | None = None) -> None:
        self._append("run_log", self.spark.createDataFrame([(packet_id, run_id, status, error, datetime.now(UTC))], _TABLES["run_log"]))

    def _packet(self, name: str, packet_id: str) -> DataFrame:
        return self.table(name).where(F.col("packet_id") == packet_id)

    # calls

    @staticmethod
    def health() -> dict[str, str]:
        return {"status": "ok"}

    def create_packet(self, packet_id: str, documents: DataFrame, session_id: str | None = None, is_demo: bool = False) -> None:
        """documents: doc_id, is_report, filename, text, total_pages,
        paper_metadata; exactly one is the report."""
        if not packet_id:
            raise ServiceError("INVALID_PACKET_ID")
        rows = P.number_sources(documents.withColumn("packet_id", F.lit(packet_id)))
        if rows.where("is_report").count() != 1:
            raise ServiceError("NO_REPORT_DOCUMENT")
        self._append("documents", rows)
        self._new_packet(packet_id, session_id, is_demo)

    def _new_packet(self, packet_id: str, session_id: str | None, is_demo: bool) -> None:
        self._append("packets", self.spark.createDataFrame([(packet_id, "queued", session_id, is_demo, datetime.now(UTC))], "packet_id string, status string, session_id string, is_demo boolean, created_at timestamp"))

    def submit(self, packet_id: str, uploads: DataFrame, session_id: str | None = None) -> None:
        """A packet of files (filename, is_report, content), checked now and
        parsed when it runs. One bad file rejects all, and nothing is kept."""
        if not packet_id:
            raise ServiceError("INVALID_PACKET_ID")
        name = F.regexp_extract("filename", r"([^/\\]*)$", 1)  # stays in its folder
        named = uploads.select(F.lit(packet_id).alias("packet_id"), name.alias("filename"), "is_report", "content")
        checked = ingest.check_files(named, self.settings.max_file_size_mb).withColumns({"path": F.concat_ws("/", "packet_id", "filename"), "uploaded_at": F.current_timestamp()})
        bad = checked.where("error is not null").select("filename", "error").take(1)
        if bad:
            raise ServiceError("FILE_REJECTED", f"{bad[0].filename}: {bad[0].error}")
        if checked.where("is_report").count() != 1:
            raise ServiceError("NO_REPORT_DOCUMENT")
        self._append("uploads", checked)
        self._new_packet(packet_id, session_id, False)

    def _parsed(self, packet_id: str, run_id: str) -> DataFrame:
        """The packet's documents; those of files are parsed first, once."""
        documents = self._packet("documents", packet_id)
        if not documents.isEmpty():
            return documents
        uploads = self._packet("uploads", packet_id)
        if uploads.isEmpty():
            raise ServiceError("NO_DOCUMENTS", packet_id)
        self._log(packet_id, run_id, "parsing")
        parsed = files.parse_files(uploads).join(uploads.select("path", "filename", "is_report"), "path")
        lost = parsed.where("error is not null").select("filename", "error").take(1)
        if lost:
            raise ServiceError("PARSE_FAILED", f"{lost[0].filename}: {lost[0].error}")
        text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
        pages = F.array_max(F.transform("blocks", lambda b: b["page"]))
        self._append("documents", P.number_sources(parsed.select(F.lit(packet_id).alias("packet_id"), F.col("path").alias("doc_id"), "is_report", "filename", text.alias("text"), F.coalesce(pages, F.lit(1)).alias("total_pages"))))
        return self._packet("documents", packet_id)

    def packet(self, packet_id: str) -> DataFrame:
        found = self._packet("packets", packet_id)
        if found.isEmpty():
            raise ServiceError("PACKET_NOT_FOUND", packet_id)
        return found

    def _of_run(self, name: str, packet_id: str, run_id: str) -> DataFrame:
        return self._packet(name, packet_id).where(F.col("run_id") == run_id)

    def _add(self, name: str, packet_id: str, run_id: str, rows: DataFrame) -> None:
        """Rows of claims that the run has none of yet."""
        done = self._of_run(name, packet_id, run_id).select("claim_id").distinct()
        self._append(name, rows.withColumns({"packet_id": F.lit(packet_id), "run_id": F.lit(run_id)}).join(done, "claim_id", "left_anti"))

    def extract(self, packet_id: str, run_id: str) -> None:
        """Claims and anchors of the report."""
        documents = self._parsed(self.packet(packet_id).first().packet_id, run_id)
        self._log(packet_id, run_id, "extracting")
        ws = Workspace(self.spark, "service")
        claims, anchors = P.extract(documents, ws.write(P.place(documents), "blocks"), self.settings, keep=lambda name, df: ws.write(df, name))
        self._add("claims", packet_id, run_id, claims)
        self._add("anchors", packet_id, run_id, anchors)

    def retrieve(self, packet_id: str, run_id: str) -> None:
        """Evidence for the run's claims."""
        claims = self._of_run("claims", packet_id, run_id)
        if claims.isEmpty():
            raise ServiceError("NO_CLAIMS", packet_id)
        self._log(packet_id, run_id, "retrieving")
        documents, ws = self._packet("documents", packet_id), Workspace(self.spark, "service")
        keep = lambda name, df: ws.write(df, name)
        _, evidence = P.retrieve(documents, keep("blocks", P.place(documents)), claims, self._of_run("anchors", packet_id, run_id), self.using, self.settings, keep)
        self._add("evidence", packet_id, run_id, evidence)

    def classify(self, packet_id: str, run_id: str) -> None:
        """Verdicts on the run's claims."""
        claims = self._of_run("claims", packet_id, run_id)
        if claims.isEmpty():
            raise ServiceError("NO_CLAIMS", packet_id)
        self._log(packet_id, run_id, "classifying")
        self._add("verdicts", packet_id, run_id, P.classify(claims, self._of_run("evidence", packet_id, run_id), self.using, self.settings))

    def run(self, packet_id: str, run_id: str) -> None:
        """All stages; a failure is a status of the run. A report without any
        claim is a completed run."""
        self.packet(packet_id)
        try:
            self.extract(packet_id, run_id)
            if not self._of_run("claims", packet_id, run_id).isEmpty():
                self.retrieve(packet_id, run_id)
                self.classify(packet_id, run_id)
            self._log(packet_id, run_id, "completed")
        except Exception as e:
            self._log(packet_id, run_id, "failed", f"{type(e).__name__}: {e}"[:1000])

    def poll(self, run_id: str) -> DataFrame:
        """The run's status with its progress by stage budgets."""
        self.run_status(run_id)
        log = self.table("run_log").where(F.col("run_id") == run_id)
        last = F.max_by(F.struct("status", "changed_at"), "changed_at")
        runs = log.groupBy("run_id").agg(F.min("changed_at").alias("started_at"), last.alias("_l")).select("run_id", "started_at", F.col("_l.status").alias("status"), F.col("_l.changed_at").alias("stage_started_at"))
        return review.progress(runs, F.current_timestamp())

    def explain(self, packet_id: str, claim_id: str, run_id: str, load: Callable[[], explanation.Model]) -> str | None:
        """Why the claim has its verdict, by a model; kept if there is a reply."""
        verdict = self._of_run("verdicts", packet_id, run_id).where(F.col("claim_id") == claim_id).select("claim_id", "verdict_type", "confidence")
        if verdict.isEmpty():
            raise ServiceError("NO_RUN_VERSION", f"{claim_id} {run_id}")
        claim = self._of_run("claims", packet_id, run_id).select("claim_id", "claim_text")
        first = review.top_evidence(self._of_run("evidence", packet_id, run_id).where(F.col("claim_id") == claim_id))
        spans = first.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("retrieval_rank", "span_text"))), lambda x: x["span_text"]).alias("spans"))
        asked = verdict.join(claim, "claim_id").join(spans, "claim_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<string>")))
        said = explanation.explain(asked, load).first().explanation
        if said is not None:
            self._append("explanations", self.spark.createDataFrame([(packet_id, run_id, claim_id, said, datetime.now(UTC))], _TABLES["explanations"]))
        return said

    def seed_demo(self, packet_id: str = "demo") -> None:
        """A finished packet that everybody sees: one claim of each verdict."""
        claims = [("Warming of the climate system is unequivocal.", "supported"), ("Sea level fell by 2 metres since 1990.", "contradicted"), ("All coasts will be lost by 2030.", "insufficient_support"), ("Models agree on clouds.", "needs_review")]
        text = " ".join(c for c, _ in claims)
        run, doc = f"{packet_id}-run", f"{packet_id}-report"
        make = lambda name, columns, rows: self._append(name, self.spark.createDataFrame(rows, columns))
        make("documents", _TABLES["documents"], [(packet_id, doc, True, 0, "sample.pdf", text, 1, None)])
        make("claims", "packet_id string, run_id string, claim_id string, doc_id string, claim_text string, char_start long, char_end long, status string", [(packet_id, run, f"{doc}:{i}", doc, c, text.index(c), text.index(c) + len(c), "completed") for i, (c, _) in enumerate(claims)])
        make("evidence", "packet_id string, run_id string, claim_id string, source_document_id string, span_text string, relevance_score double, retrieval_method string, retrieval_rank int", [(packet_id, run, f"{doc}:{i}", doc, c, 0.9, "bm25", 1) for i, (c, _) in enumerate(claims)])
        make("verdicts", "packet_id string, run_id string, claim_id string, verdict_type string, confidence double, reasoning string, model_name string, prompt_version string", [(packet_id, run, f"{doc}:{i}", v, 0.9, f"Sample of {v}.", "sample", self.settings.prompt_version) for i, (_, v) in enumerate(claims)])
        self._new_packet(packet_id, None, True)
        self._log(packet_id, run, "completed")

    def run_status(self, run_id: str) -> tuple[str, str | None]:
        found = self.table("run_log").where(F.col("run_id") == run_id).orderBy(F.desc("changed_at")).first()
        if found is None:
            raise ServiceError("RUN_NOT_FOUND", run_id)
        return found["status"], found["error_summary"]

    def results(self, run_id: str) -> DataFrame:
        self.run_status(run_id)
        v = self.table("verdicts").where(F.col("run_id") == run_id)
        return self.table("claims").where(F.col("run_id") == run_id).select("claim_id", "claim_text", "status").join(v.select("claim_id", "verdict_type", "confidence", "reasoning"), "claim_id", "left")

    def dashboard(self, session_id: str | None = None) -> DataFrame:
        """The newest runs that a session may see."""
        log = self.table("run_log")
        runs = log.groupBy("packet_id", "run_id").agg(F.min("changed_at").alias("created_at"), F.max_by("status", "changed_at").alias("status"))
        return review.runs_index(runs, self.table("packets").select("packet_id", "session_id", "is_demo"), session_id, self.settings.recent_runs)

    def queue(self, packet_id: str, run_id: str, verdict: str | None = None, band: str | None = None, source: str | None = None) -> DataFrame:
        claims = self._packet("claims", packet_id).where(F.col("run_id") == run_id).select("claim_id", "claim_text", "doc_id")
        verdicts = self._packet("verdicts", packet_id).where(F.col("run_id") == run_id).withColumn("verdict_no", F.lit(0))
        evidence = self._packet("evidence", packet_id).where(F.col("run_id") == run_id)
        return review.filter_queue(review.queue(claims, verdicts), evidence, verdict, band, source).orderBy("severity", "claim_id")

    def claim(self, packet_id: str, claim_id: str, run_id: str) -> DataFrame:
        """One row for each evidence span of a claim, with the text round it."""
        one = self._of_run("claims", packet_id, run_id).where(F.col("claim_id") == claim_id)
        if one.isEmpty():
            raise ServiceError("NO_CLAIMS", claim_id)
        tables = (self._packet("documents", packet_id), self._of_run("evidence", packet_id, run_id), self._of_run("verdicts", packet_id, run_id))
        return review.claim_detail(one, *tables, self.settings).orderBy("retrieval_rank")

    def review(self, packet_id: str, claim_id: str, run_id: str, action: str) -> None:
        if action not in REVIEW_ACTIONS:
            raise ServiceError("INVALID_ACTION", action)
        if self._packet("verdicts", packet_id).where((F.col("claim_id") == claim_id) & (F.col("run_id") == run_id)).isEmpty():
            raise ServiceError("NO_RUN_VERSION", f"{claim_id} {run_id}")
        now = datetime.now(UTC)
        self._append("decisions", self.spark.createDataFrame([(packet_id, claim_id, run_id, action, now, int(now.timestamp() * 1e6))], _TABLES["decisions"]))

    def decisions(self, packet_id: str) -> DataFrame:
        return review.latest_decisions(self._packet("decisions", packet_id), self._packet("verdicts", packet_id))

    def delete_packet(self, packet_id: str, session_id: str | None = None) -> None:
        """A packet with all its rows; demos and packets of others stay."""
        self.packet(packet_id)
        if review.deletable(self.table("packets"), packet_id, session_id).isEmpty():
            raise ServiceError("FORBIDDEN", packet_id)
        for name in reversed(_TABLES):  # what refers to others first
            path, fs = self._path(name, packet_id)
            if fs.exists(path):
                fs.delete(path, True)
