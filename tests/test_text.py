"""Scalar functions on literal sentences."""

import pytest
from pyspark.sql import functions as F

from attestor.functions import scores as S
from attestor.functions import text as T
from attestor.operators.claims import reject_reason


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {t}" for k, t in zip(given, (kind(v) for v in given.values()), strict=True)))
    return row.select(column.alias("v")).first().v


def kind(v):
    return {str: "string", float: "double", int: "long", list: "array<double>", type(None): "string"}[type(v)]


@pytest.mark.parametrize(
    ("bad", "good"),
    [
        ("powerful.It is", "powerful. It is"),
        ("tasks,and more", "tasks, and more"),
        ("Thefeature has BERT", "Thefeature has BERT"),
        ("the modelWorks", "the model Works"),
        ("Rad-ford and State-of", "Radford and State-of"),
        ("intendedfor it", "intended for it"),
        ("repre-sentation and fine-tuned", "representation and fine-tuned"),
        ("Inthe end it has beenused", "In the end it has been used"),
        ("Caswell said aswell", "Caswell said as well"),
        ("1,000 and 3.5", "1,000 and 3.5"),
        ("infor-mation", "infor-mation"),
    ],
)
def test_word_boundaries(spark, bad, good):
    assert value(spark, T.fix_word_boundaries(F.col("t")), t=bad) == good


def test_sentences(spark):
    assert value(spark, T.sentences(F.col("t")), t=" One is here. Is it?  Yes!\tNo. 3.5 stays") == ["One is here.", "Is it?", "Yes!", "No.", "3.5 stays"]
    assert value(spark, T.sentences(F.col("t")), t="  ") == []


@pytest.mark.parametrize(
    ("sentence", "markers"),
    [
        ("As shown in [1, 2-4] and [7].", [("[1, 2-4]", "numeric"), ("[7]", "numeric")]),
        ("It grew (Smith et al., 2023) fast.", [("(Smith et al., 2023)", "author_year")]),
        ("Jones et al. (2020) and Lee (2019a) agree [3].", [("[3]", "numeric"), ("Jones et al. (2020)", "author_year"), ("Lee (2019a)", "author_year")]),
        ("Known before (12, 13) and (12-15) but not (2020).", [("(12, 13)", "numeric"), ("(12-15)", "numeric")]),
        ("Twice [1] and [1].", [("[1]", "numeric")]),
        ("None here.", []),
    ],
)
def test_citation_markers(spark, sentence, markers):
    assert [tuple(m) for m in value(spark, T.citation_markers(F.col("t")), t=sentence)] == markers


REASONS = [
    ("", "empty"), ("Too short.", "length"), ("word " * 151, "length"), ("lower case starts it here.", "lowercase_start"), ("Figure 3 shows that sales rose.", "skip_prefix"), ("See the appendix for 12 more.", "skip_prefix"),
    ("NOTE: this is a label of it.", "structural"), ("We thank the reviewers for 12 comments.", "acknowledgement"), ("The authors declare no competing interests in it.", "disclosure_boilerplate"),
    ("Semaglutide once weekly (SUSTAIN 11): a randomized, open-label trial.", "bibliography_entry"), ("Accessed January 24, 2024.", "bibliography_entry"), ("Bias was assessed using 2 tools.", "methods_procedural"),
    ("Patients were assessed and the dose reduced risk by 20 percent.", None), ("In this paper we show 12 results.", "meta"), ("The primary objective was to demonstrate 12 things.", "meta_objective"),
    ("GMC indicates mean concentration; GMFR, rise; Ig G, globulin.", "glossary"), ("This is an open access article from 2020.", "license_boilerplate"), ("Cells 2024, 13, 8004 of 27 showed growth.", "journal_page_header_bleed"),
    ("MAJOR RECOMMENDATIONS FOR CHINA AND COUNTRIES.", "all_caps_heading"), ("Data are at https://example.org for 2020.", "url"), ("Smith J. PhD1; Jones A. MSc11; Lee B. are authors.", "affiliation"),
    ("Conclusion is ......... 29 here.", "toc_artifact"), ("Read more about the 12 results.", "webpage_nav"), ("Cambridge University Press is in Cambridge.", "publisher_imprint"), ("Lopez 1 Maria Lopez is here.", "student_header"),
    ("Paola Arias (Colombia), Mercedes (Brazil), Ismail (Sudan), and others came.", "author_org_list"), ("Copyright 2020 by the authors is held.", "legal_boilerplate"), ("The product is provided without warranty in 2020.", "legal_boilerplate"),
    ("The rate is 12 percent of it", "no_terminal_punct"), ("Accuracy of the tool: 95%.", None), ("Delivery to number 12 of us.", "no_verb"), ("Protein folding is complex.", "no_factual_signal"),
    ("Emissions increased by 12 percent in 2020.", None), ("Warming is caused by emissions of gas.", None), ("The model is significantly better on it.", None), ("Prices were higher than wages that year.", None),
    ("Studies have consistently found that influenza spreads through respiratory droplets during close contact interactions with infected people nearby.", None),
]


def test_reject_reasons(spark):
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(REASONS)], "i int, sentence string")
    got = {r.i: r.r for r in rows.select("i", reject_reason(F.col("sentence")).alias("r")).collect()}
    assert {REASONS[i][0]: r for i, r in got.items()} == dict(REASONS)


def test_small_functions(spark):
    assert value(spark, T.dedup_key(F.col("t")), t="Lim-ited By  it") == "limitedbyit"
    assert value(spark, T.reference_tokens(F.col("t")), t="The Smith et al. of 2023, a x Smith") == ["smith", "2023"]
    assert value(spark, T.tokens(F.col("t")), t="Éoua a_b x 12 The Éoua") == ["éoua", "a_b", "12", "the", "éoua"]
    assert value(spark, T.terms(F.col("t")), t="The éoua of a_b, and The theory") == ["éoua", "a_b", "theory"]
    assert value(spark, T.context_snippet(F.col("t"), F.lit(3), F.lit(5), 2), t="0123456789") == "123456"
    assert value(spark, T.context_snippet(F.col("t"), F.lit(1), F.lit(2), 200), t="0123") == "0123"
    assert [value(spark, T.confidence_grade(F.col("c")), c=c) for c in (0.85, 0.7, 0.55, 0.1)] == list("ABCD")
    assert value(spark, T.review_label(F.col("t")), t="insufficient_support") == "Insufficient Support" and value(spark, T.review_label(F.col("t")), t=None) == "Unreviewed"
    assert [value(spark, T.file_type(F.col("t")), t=t) for t in ("a.DOC", "a.b.pdf", "noend", "a.docx")] == ["docx", "pdf", "", "docx"]
    assert value(spark, T.query_text(F.col("t"), "BAAI/bge-base"), t="q").endswith("passages: q") and value(spark, T.query_text(F.col("t"), "other"), t="q") == "q"
    assert value(spark, T.without_nul(F.col("t")), t="a\x00b") == "ab"


@pytest.mark.parametrize(
    ("triple", "verdict", "confidence"),
    [((0.92, 0.0, 0.0), "supported", 0.92), ((0.919, 0.0, 0.0), "insufficient_support", 0.919), ((0.1, 0.2, 0.75), "contradicted", 0.75), ((0.95, 0.1, 0.9), "supported", 0.95), ((0.4, 0.49, 0.3), "needs_review", 0.49), ((0.1, 0.8, 0.1), "insufficient_support", 0.8), ((0.0, 0.0, 0.0), "needs_review", 0.0)],
)
def test_verdict_thresholds(spark, triple, verdict, confidence):
    e, n, c = triple
    assert tuple(value(spark, S.verdict(F.col("e"), F.col("n"), F.col("c")), e=e, n=n, c=c)) == (verdict, confidence)


def test_scores(spark):
    assert abs(value(spark, S.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) - 2**-0.5) < 1e-9
    assert value(spark, S.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 0.0
    assert value(spark, S.ratio(F.col("a"), F.lit(0), 1.0), a=3) == 1.0
    assert [value(spark, S.confidence_band(F.col("c")), c=c) for c in (0.8, 0.79, 0.5, 0.49)] == ["high", "medium", "medium", "low"]
