"""One text that a third of all rows have: copies get what one of them gets."""

import random

import public_tokenizers as P

from attestor.llm import bpe, decontaminate, langid, licenses, simhash, unigram

HOT = "The benchmark says that wind is strong. Released under the MIT License. " * 3


def rows():
    r = random.Random(50)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 8))) for _ in range(r.randrange(1, 60)))
    return [(i, text(), r.choice(("en", "fr"))) for i in range(200)] + [(1000 + i, HOT, "en") for i in range(100)]


def test_copies_are_treated_alike(spark, make):
    docs = make(rows())
    passages = spark.createDataFrame([(1, "the benchmark says that wind is strong")], "item_id long, text string")
    model = langid.train(docs)
    found = {
        "simhash": simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id"),
        "decontaminate": decontaminate.contamination(docs, passages),
        "licenses": licenses.scan(docs),
        "language": langid.predict(docs.select("doc_id", "text"), model).select("row.doc_id", "lang_pred", "score"),
        "unigram": unigram.token_counts(docs, P.path("piece_bpe_32k.model")),
        "bpe": bpe.digests(docs),
    }
    for name, df in found.items():
        got = [r for r in df.collect() if r.doc_id >= 1000]
        assert len(got) == 100 and len({tuple(map(str, r[1:])) for r in got}) == 1, name
    assert {r.component_id for r in found["simhash"].where("doc_id >= 1000").collect()} == {1000}


def test_keep_one_of_a_hot_text(make):
    docs = make(rows())
    kept = {r.doc_id for r in simhash.keep_one(docs, shingle=5, similarity=0.8).collect()}
    assert kept & set(range(1000, 1100)) == {1000} and len(kept) > 150
