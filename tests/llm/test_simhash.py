import random
import re

import corpus_pipeline
import numpy as np
from xxhash import xxh64_intdigest

from attestor.llm import simhash as S
from attestor.llm.common import Workspace, connected_components


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for g in grams:
        h = xxh64_intdigest(g.encode("utf-8", "surrogatepass"), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(grams))


def components(values):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    values = list(values)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= S.RADIUS and find(a) != find(b):
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_fingerprints(odd):
    for text in [r.text for r in odd.collect()] + ["A b", "a B c", "x", "É a b c d"]:
        if len(text or "") < 10_000:
            assert S.fingerprint(text) == brute_print(text)


def test_links_join_what_is_within_radius(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 4)  # crowded segments too
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(6)]
    values = set(base)
    for b in base:
        for _ in range(25):
            v = b
            for _ in range(r.randrange(5)):
                v ^= 1 << r.choice((r.randrange(64), r.randrange(32)))
            values.add(v)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    ws = Workspace(spark, "test")
    found = connected_components(ws, S.links(ws, spark.createDataFrame([(v,) for v in signed], "fp long")))
    got = {r.node: r.component for r in found.collect()}
    exp = components(values)
    groups = {}
    for v, s in zip(values, signed, strict=True):
        groups.setdefault(exp[v], set()).add(got.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_odd_rows(odd, none):
    rows = S.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {2}
    assert all(r.component_id == 5 for r in rows if r.doc_id in (5, 6))
    assert S.near_duplicates(none).count() == 0 and S.keep_one(none).count() == 0


def test_one_document_of_each_component_stays(odd):
    kept = S.keep_one(odd).collect()
    assert kept[0].__fields__ == odd.columns
    ids = [r.doc_id for r in kept]
    assert 2 in ids and 3 not in ids and 4 not in ids and 6 not in ids and ids.count(None) == 1 and ids.count(1) == 2


def test_chain_of_components(spark):
    ws = Workspace(spark, "chain")
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in connected_components(ws, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_stage_keeps_one_of_texts_with_similar_shingles(spark, make):
    r = random.Random(6)
    texts = []
    for _ in range(12):
        words = [r.choice("abcdefghij") * r.randrange(1, 9) for _ in range(r.choice((12, 80, 300)))]
        for _ in range(8):
            texts.append(" ".join(words))
            for _ in range(r.randrange(1, 4)):
                words[r.randrange(len(words))] = f"x{r.randrange(99)}"
    docs = [(i, t, "en") for i, t in enumerate(texts)]

    def grams(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, parent = [grams(t) for t in texts], list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and parent[i] != parent[j]:
                old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
                parent = [new if p == old else p for p in parent]
    exp = {i for i, p in enumerate(parent) if i == p}
    got = {x.doc_id for x in corpus_pipeline.dedup_documents(spark, make(docs), "").collect()}
    assert got == exp and 12 < len(exp) < len(texts) and len({x.doc_id for x in S.keep_one(make(docs)).collect()}) > len(exp)


def test_odd_rows_of_the_stage(spark, odd, none):
    ids = [x.doc_id for x in corpus_pipeline.dedup_documents(spark, odd, "").collect()]
    assert 2 in ids and 3 not in ids and 4 not in ids and 5 in ids and 6 not in ids and ids.count(1) == 2
    assert corpus_pipeline.dedup_documents(spark, none, "").count() == 0


def test_many_near_copies_of_one_text(make):
    """Groups beyond BUCKET give the components of all pairs."""
    r = random.Random(60)
    base = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
    texts = []
    for _ in range(240):
        words = list(base)
        for _ in range(r.randrange(1, 4)):
            words[r.randrange(len(words))] = f"x{r.randrange(999)}"
        texts.append(" ".join(words))
    texts += [" ".join(base[:60] + [f"y{i}{k}" for k in range(60)]) for i in range(20)]  # half in common only
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    parent = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and parent[i] != parent[j]:
                old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
                parent = [new if p == old else p for p in parent]
    got = {x.doc_id for x in S.keep_one(make([(i, t, "en") for i, t in enumerate(texts)]), shingle=5, similarity=0.8).collect()}
    assert got == {i for i, p in enumerate(parent) if i == p} and 20 < len(got) < 200


def test_parities_never_exceed_the_difference():
    r = random.Random(61)
    for n in (0, 3, 120, 3000):
        words = [f"w{r.randrange(5000)}" for _ in range(n)]
        other = [w if r.random() < 0.9 else f"x{r.randrange(99)}" for w in words]
        a, b = S.shingles(" ".join(words), 5), S.shingles(" ".join(other), 5)
        bits = sum(int(x ^ y).bit_count() if x ^ y >= 0 else int((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(S.parities(a), S.parities(b), strict=True))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist())) and len(S.parities(a)) == S.PARITIES // 64
        assert bits > 0 or (a == b).all()


def test_no_pair_of_a_large_group_is_left_out(spark, monkeypatch):
    """160 sets in one group, which are 80 pairs of near copies and otherwise
    have too little in common; in several blocks too."""
    from pyspark.sql import functions as F

    r, texts = random.Random(62), []
    for i in range(80):
        words = [f"b{k}" for k in range(90)] + [f"y{i}x{k}" for k in range(50)]
        texts += [" ".join(words), " ".join(words[:-9] + [f"z{i}x{k}" for k in range(9)])]
    fps = [S._identity(S.shingles(t, 5)) for t in texts]
    rows = [(fp, t, len(S.shingles(t, 5))) for fp, t in zip(fps, texts, strict=True)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "fp long, text string, n long")
    sets = docs.select("fp", F.xxhash64("text").alias("th"), "n", F.array_repeat(F.lit(7).cast("long"), S.BANDS).alias("bands"))
    for block in (512, 50):
        monkeypatch.setattr(S, "BLOCK", block, raising=False)
        ws = Workspace(spark, "large")
        got = {(x.node, x.component) for x in connected_components(ws, S.similar(ws, docs, sets, 5, 0.8)).collect() if x.node != x.component}
        assert got == {(max(a, b), min(a, b)) for a, b in zip(fps[::2], fps[1::2], strict=True)}
