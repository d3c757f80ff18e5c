"""Evaluation data: labelled cases, claim sets, resumable results, bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor import schema


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases of JSON files, each with one case or a list of them."""
    return spark.read.schema(schema.CASES).option("multiLine", "true").json(path)


def read_claims(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(id, claim, gold_label, cited_doc_ids): the first row of each id in the
    order of the file; labels other than SUPPORT and CONTRADICT are empty.
    With expected, another number of ids is an error."""
    order = Window.partitionBy("id").orderBy("_file", "_at")
    rows = spark.read.schema(schema.SCIFACT_CLAIMS).json(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_n"))
    rows = rows.withColumn("_at", F.struct("_start", "_n")).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    label = F.when(F.col("evidence_label").isin("SUPPORT", "CONTRADICT"), F.col("evidence_label")).otherwise("")
    out = rows.select("id", "claim", label.alias("gold_label"), F.filter(F.coalesce("cited_doc_ids", F.array().cast("array<long>")), lambda d: d.isNotNull()).alias("cited_doc_ids"))
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"expected {expected} claims, found {n}")
    return out


def cited_sentences(claims: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, doc_id, sent_idx, sentence): the abstracts that claims cite; those
    that are missing are left out."""
    cited = claims.select("id", F.posexplode("cited_doc_ids").alias("doc_no", "doc_id"))
    return cited.join(corpus.select("doc_id", "abstract"), "doc_id").select("id", "doc_no", "doc_id", F.posexplode("abstract").alias("sent_idx", "sentence"))


def train_pairs(claims: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, premise, hypothesis, label): for each piece of evidence its
    sentences that exist (or the first three), for claims without evidence
    the first two of the first abstract there is; blank premises go."""
    c = corpus.select(F.col("doc_id").alias("_doc"), "abstract").where(F.size("abstract") > 0)
    each = claims.select("id", "claim", F.explode("evidence").alias("doc", "items")).select("id", "claim", F.col("doc").cast("long").alias("_doc"), F.explode("items").alias("e")).where(F.col("e.label").isin("SUPPORT", "CONTRADICT"))
    picked = F.transform(F.filter("e.sentences", lambda i: i < F.size("abstract")), lambda i: F.element_at("abstract", i + 1))
    text = F.array_join(F.when(F.size("e.sentences") > 0, picked).otherwise(F.slice("abstract", 1, 3)), " ")
    found = each.join(c, "_doc").select("id", F.trim(text).alias("premise"), F.col("claim").alias("hypothesis"), F.col("e.label").alias("label"))
    bare = claims.where(F.coalesce(F.size(F.map_keys("evidence")), F.lit(0)) <= 0).select("id", "claim", F.posexplode("cited_doc_ids").alias("_no", "_doc")).join(c, "_doc")
    first = bare.groupBy("id").agg(F.min_by(F.struct("claim", "abstract"), "_no").alias("_f"))
    unknown = first.select("id", F.trim(F.array_join(F.slice("_f.abstract", 1, 2), " ")).alias("premise"), F.col("_f.claim").alias("hypothesis"), F.lit("").alias("label"))
    return found.unionByName(unknown).where("premise <> ''")


def label_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("label").agg(F.count("*").alias("n"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of JSON lines; lines that are no JSON are left out, and the
    last line of an id counts."""
    rows = spark.read.schema(schema.CASE_RESULTS).option("mode", "DROPMALFORMED").json(path).where("id is not null")
    rows = rows.withColumn("_at", F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    last = rows.groupBy("id").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("id", "_at"))), "_at").alias("r"))
    return last.select("id", "r.*")


def pending(claims: DataFrame, results: DataFrame, limit: int | None = None) -> DataFrame:
    """Claims that no result has classified, at most limit of them by id."""
    left = claims.join(results.where("status = 'classified'").select("id"), "id", "left_anti")
    return left if limit is None else left.orderBy("id").limit(limit)


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def write_bins(binned: DataFrame, path: str) -> None:
    """Reliability bins, one row a bin, as CSV with a header."""
    binned.orderBy("bin").coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def dev_pairs(claims: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, premise, hypothesis, label), one for each claim: its first piece
    of evidence (by document), else the first three sentences of the first
    abstract that it cites and that is there; without any, "No evidence."."""
    c = corpus.select(F.col("doc_id").alias("_doc"), "abstract")
    text = lambda a: F.trim(F.array_join(a, " "))
    first = F.element_at(F.array_sort(F.map_entries("evidence")), 1)
    rows = claims.withColumn("_e", F.when(F.coalesce(F.size(F.map_keys("evidence")), F.lit(0)) > 0, first))
    proof = rows.where("_e is not null").select("id", "claim", F.col("_e.key").cast("long").alias("_doc"), F.col("_e.value")[0].alias("_i")).join(c, "_doc", "left")
    picked = F.transform(F.filter("_i.sentences", lambda i: i < F.size("abstract")), lambda i: F.element_at("abstract", i + 1))
    chosen = F.when((F.size("_i.sentences") > 0) & (F.size("abstract") > 0), picked).otherwise(F.slice("abstract", 1, 3))
    known = F.when(F.col("_i.label").isin("SUPPORT", "CONTRADICT"), F.col("_i.label")).otherwise("")
    found = proof.select("id", F.coalesce(F.nullif(text(chosen), F.lit("")), F.lit("No evidence.")).alias("premise"), F.col("claim").alias("hypothesis"), known.alias("label"))
    bare = rows.where("_e is null").select("id", "claim", F.posexplode_outer("cited_doc_ids").alias("_no", "_doc")).join(c.where(F.size("abstract") > 0), "_doc", "left")
    one = bare.groupBy("id").agg(F.first("claim").alias("hypothesis"), F.min_by("abstract", F.when(F.col("abstract").isNotNull(), F.col("_no"))).alias("_a"))
    none = one.select("id", F.coalesce(text(F.slice("_a", 1, 3)), F.lit("No evidence.")).alias("premise"), "hypothesis", F.lit("").alias("label"))
    return found.unionByName(none)
