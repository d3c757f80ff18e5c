import random

import corpus_pipeline
from attestor.llm import decontaminate as D


def fewest_edits(passage, text):
    prev = list(range(len(passage) + 1))
    best = prev[-1]
    for c in text:
        cur = [0]
        for i, x in enumerate(passage):
            cur.append(min(prev[i] + (x != c), prev[i + 1] + 1, cur[i] + 1))
        prev, best = cur, min(best, cur[-1])
    return best


def planted(seed):
    r = random.Random(seed)
    letters = r.choice(["ab", "abcdefg hij", "th er on"])
    items = [(i, D.normal("".join(r.choice(letters) for _ in range(r.randrange(3, 90))))) for i in range(4)]
    docs = []
    for _ in range(3):
        text = "".join(r.choice(letters) for _ in range(r.randrange(100)))
        for _ in range(r.randrange(3)):
            x = list(r.choice(items)[1])
            for _ in range(r.randrange(1 + max(1, len(x) // 8))):
                j, how = r.randrange(len(x) + 1), r.random()
                x[j : j + (how < 0.6)] = [r.choice(letters)] * (how < 0.3 or how >= 0.6)
            text += "".join(x) + "".join(r.choice(letters) for _ in range(r.randrange(30)))
        docs.append(text)
    return items, docs


def test_finds_what_brute_force_finds():
    for seed in range(120):
        items, docs = planted(seed)
        got = {(d, i): e for d, i, _, e, _, _ in D._matches(D.Index(items, D.RATE), docs)}
        for d, text in enumerate(map(D.normal, docs)):
            for i, passage in items:
                if passage:
                    edits = fewest_edits(passage, text) if len(passage) >= D.Q else 0 if passage in text else 99
                    assert got.get((d, i)) == (edits if edits <= D.budget(len(passage)) else None)


def test_pieces_of_long_texts_lose_nothing(monkeypatch):
    monkeypatch.setattr(D, "_PIECE", 500)
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh ") for _ in range(120)).strip()
    filler = "".join(r.choice("ijklmnop ") for _ in range(6000))
    for at in range(0, 6000, 37):
        got = list(D._matches(D.Index([(1, D.normal(passage))], D.RATE), [filler[:at] + " " + passage + " " + filler[at:]]))
        assert [(x[1], x[3]) for x in got] == [(1, 0)]


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "ONE two\nthree four. One two three"), (2, None), (3, ""), (None, "x"), (4, "id"), (5, "never there at all, I think")], "item_id long, text string")
    rows = {(r.doc_id, r.item_id, r.edits) for r in D.contamination(odd, bench).collect()}
    assert rows == {(1, 1, 0), (1, 4, 0), (None, 4, 0)}
    kept = D.clean(odd, bench)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 4, 5, 6, 7, 8, 9]
    assert D.contamination(none, bench).count() == 0 and D.clean(odd, bench.limit(0)).count() == odd.count()


def test_a_large_benchmark_takes_several_passes(spark, make, monkeypatch):
    monkeypatch.setattr(D, "INDEX_CHARS", 60)
    bench = spark.createDataFrame([(i, f"passage number {i} of the benchmark") for i in range(5)], "item_id long, text string")
    docs = make([(1, "see passage number 3 of the benchmark", "en"), (2, "clean", "en"), (3, "passage number 0 of the bench mark", "en")])
    best = {r.doc_id: r for r in D.contamination(docs, bench).orderBy("edits", ascending=False).collect()}
    assert set(best) == {1, 3} and best[1].edits == 0 and best[1].item_id == 3
    assert [r.doc_id for r in D.clean(docs, bench).collect()] == [2]


def test_passages_without_an_id_are_found_by_the_queries(spark, make, tmp_path):
    docs = make([(1, "see a passage without an id and another passage of that kind", "en"), (2, "clean", "en"), (3, "a short one: zq", "en")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(None, "a passage without an id"), (None, "another passage of that kind"), (None, "zq"), (None, " "), (7, "clean of it, never found")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = sorted((r.doc_id, r.item_id is None, r.n_chars) for r in D.op3_decontaminate(spark, str(tmp_path)).collect())
    assert found == [(1, True, 23), (1, True, 28), (3, True, 2)]
    assert [r.doc_id for r in corpus_pipeline.remove_benchmark(spark, docs, str(tmp_path)).collect()] == [2]


def test_bands_of_a_passage_beyond_24_bits_of_diagonals():
    """The key's field for a band grows with the longest passage."""
    index = D.Index([(1, "a needle of some length in here"), (2, "x" * 40)], 0.1)
    index.longest = 1 << 26
    text = "before it a needle of some length in here and after"
    codes = D._codes(text)
    found = {i for _, i, _ in index.bands(codes, D.np.zeros(len(codes), D.np.int32))}
    assert found == {0}
    places = [low - index.longest for _, i, low in index.bands(codes, D.np.zeros(len(codes), D.np.int32))]
    assert all(abs(p - 10) <= 4 * (int(index.k[0]) + 1) for p in places)
