"""File sizes of compressed tables decide no broadcast of a run."""

from attestor.plans import catalogue, evidence_queries, verify
from attestor.workspace import Workspace


def test_a_run_broadcasts_nothing_by_file_sizes(spark, monkeypatch):
    plans = {}

    class Seen(Workspace):
        def _write(self, df, name, partition_by):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return super()._write(df, name, partition_by)

    monkeypatch.setattr(verify, "Workspace", Seen)
    schema = "packet_id string, doc_id string, is_report boolean, source_no int, filename string, text string, total_pages int, paper_metadata struct<title: string, authors: array<string>, year: string>"
    report = "Results\nThe treatment reduced mortality by 20 percent in the cohort of 300 patients [1].\nReferences\nMiller J. Treatment of mortality in cohorts. 2018."
    docs = spark.createDataFrame([("p", "r", True, 0, "report.pdf", report, 1, None), ("p", "a", False, 1, "miller_treatment_mortality.pdf", "The treatment reduced mortality by 20 percent in the cohort.", 3, None)], schema)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    out = verify.verify(docs)
    assert out["verdicts"].count() == 1 and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert {"anchors", "lexical", "evidence"} <= set(plans) and [n for n, p in plans.items() if "Broadcast" in p] == []


def most_broadcast(spark, since):
    """Rows of the largest side that executions from number since on broadcast."""
    store = spark._jsparkSession.sharedState().statusStore()
    found, runs = [0], store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        if run < since:
            continue
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if node.name().startswith("BroadcastExchange") and m.name() == "number of output rows":
                    value = values.get(m.accumulatorId())
                    found += [int(value.get().replace(",", ""))] if value.isDefined() else []
    return max(found)


def test_sources_of_markers_are_not_broadcast(spark, tmp_path, monkeypatch):
    """2,000 sources in a file of some kB are far more when they are read."""
    names = []

    class Seen(Workspace):
        def _write(self, df, name, partition_by):
            names.append(name)
            return super()._write(df, name, partition_by)

    monkeypatch.setattr(evidence_queries, "Workspace", Seen)
    spark.range(2000).selectExpr("id p_partkey", "concat('large ring ', id) p_name", "'Brand#7' p_brand", "'LARGE' p_type", "1 p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(0, 1500, 50).selectExpr("id s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "20k")
    try:
        runs = spark._jsparkSession.sharedState().statusStore().executionsList()
        since = 1 + max([runs.apply(i).executionId() for i in range(runs.size())], default=-1)
        got = catalogue.queries()["anchor_resolve_sequence"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert len(got) == 30 and most_broadcast(spark, since) < 2000
    assert names.count("sources") == names.count("shares") == 1
