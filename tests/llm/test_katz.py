import collections
import math
import random

from pyspark.sql import functions as F

from attestor.llm import katz as K


def brute(docs, train, order=K.ORDER, least=K.LEAST):
    """Scores by the recursion as written, over plain counts."""
    split = {d: [b"\n", *(t or "").encode().lower().split(), b"\n"] for d, t in docs}
    counts = [collections.Counter() for _ in range(order)]
    for d, w in split.items():
        if train(d):
            counts[0].update((x,) for x in w[1:])
            for n in range(2, order + 1):
                counts[n - 1].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    seen = lambda c: [collections.Counter(c.values()).get(r, 0) for r in range(1, K.MAX_K + 2)]
    low = lambda n: least[min(n, len(least)) - 1]
    cuts = [K.Discounts(seen(c), low(n + 1)) for n, c in enumerate(counts)]

    def kept(n, c):
        return 0.0 if c < low(n) else c * (cuts[n - 1].d[c] if c <= cuts[n - 1].k else 1.0)

    total = sum(counts[0].values())
    n_all = total if any(c <= cuts[0].k for c in counts[0].values()) else total + 1
    p = {w: kept(1, c) / n_all for (w,), c in counts[0].items()}
    unknown = 1 - sum(p.values()) if p else 1.0
    after = collections.defaultdict(dict)
    for n in range(2, order + 1):
        for g, c in counts[n - 1].items():
            after[g[:-1]][g[-1]] = c
    count = lambda g: counts[0][(b"\n",)] if g == (b"\n",) else counts[len(g) - 1][g]

    def known(h):
        return {w: c for w, c in after.get(h, {}).items() if c >= low(len(h) + 1)}

    def size(h):
        return count(h) + (sum(kept(len(h) + 1, c) for c in known(h).values()) == count(h))

    def prob(h, w):
        if not h:
            return p.get(w, unknown)
        if w in known(h):
            return kept(len(h) + 1, after[h][w]) / size(h)
        return weight(h) * prob(h[1:], w)

    def weight(h):
        if not known(h):
            return 1.0
        if h not in weights:
            weights[h] = (1 - sum(prob(h, w) for w in known(h))) / (1 - sum(prob(h[1:], w) for w in known(h)))
        return weights[h]

    weights = {}
    scores = {d: sum(math.log10(prob(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(1, len(w))) for d, w in split.items()}
    for h in [h for h in after if known(h)][:20] + [h for h in after if len(h) == order - 1 and known(h)][:20]:  # exactly normalised
        # what no word of the vocabulary has: the unknown word's, by the recursion
        assert abs(sum(prob(h, w) for w in p) + prob(h, b"never seen") - 1) < 1e-9
    return scores, total, {w: c for (w,), c in counts[0].items()}, {d: w[1:] for d, w in split.items()}


def check(make, docs, train, order=K.ORDER, least=K.LEAST):
    found = K.score(make([(d, t, "en") for d, t in docs]), F.col("doc_id") % 7 != 2, order, least)
    scores, total, uni, split = brute(docs, train, order, least)
    rows = {r.doc_id: r for r in found.scores.collect()}
    assert set(rows) == set(scores) and found.stats[0].tokens == total
    for d, s in scores.items():
        assert abs(rows[d].score - s) < 1e-6 * max(1, abs(s))
        assert rows[d].n_tokens == len(split[d]) and rows[d].n_known == sum(uni.get(w, 0) > 0 for w in split[d])


def test_matches_brute_force(make, monkeypatch):
    monkeypatch.setattr(K, "BATCH", 200)
    r = random.Random(5)
    vocabulary = ["w%d" % int(r.paretovariate(0.7)) for _ in range(400)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(40)))) for i in range(70)]
    docs += [(100 + i, docs[3 * i][1]) for i in range(15)] + [(200 + i, "so far so good and so on " * 8) for i in range(9)]
    for order, least in ((3, (1, 1, 2)), (3, (1,)), (2, (1,)), (4, (1, 1, 2)), (4, (1, 2, 3))):
        check(make, docs, lambda d: d % 7 != 2, order, least)


def test_histories_without_small_counts(make):
    docs = [(i, "always the same words") for i in range(3, 60)] + [(2, "always other words the same"), (9, "always the same words again")]
    check(make, list(dict(docs).items()), lambda d: d % 7 != 2)


def test_nothing_to_learn_from(make):
    found = K.score(make([(2, "a b", "en"), (9, None, "en")]), F.col("doc_id") % 7 != 2)
    assert {(r.doc_id, r.score, r.base_score, r.n_known) for r in found.scores.collect()} == {(2, 0.0, 0.0, 0), (9, 0.0, 0.0, 0)}


def test_odd_rows(odd, none):
    rows = K.score(odd, ~K.held_out(F.col("doc_id"))).scores.collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) for r in rows)
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (2, 3, 4))
    assert K.score(none, F.lit(True)).scores.count() == 0


def test_packing():
    import numpy as np

    for a in (np.arange(5, dtype=np.int64) * 1000, np.zeros(0, np.float64), np.random.default_rng(1).normal(size=33)):
        assert (K._unpack(K._pack(a), a.dtype) == a).all()
    keys = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 100).astype(np.uint64) * np.uint64(2))
    assert (K._unpack_keys(K._pack_keys(keys)) == keys).all()
    cuts = K._cuts(keys, 7)
    assert cuts[0] == 0 and cuts[-1] == 100 and (np.diff(cuts) >= 0).all()
