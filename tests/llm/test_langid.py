import random

import pytest

from attestor.llm import langid as L

WORDS = {"en": "the and of with that this from which there would", "de": "der und nicht eine werden durch zwischen über können schön", "fr": "les une dans avec être pour cette où leur très", "es": "los una para con por está más ñandú entre como"}


def corpus(n=240):
    r = random.Random(6)
    rows = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        rows.append((i, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randrange(1, 40))), lang))
    return rows


def test_held_out_accuracy(make):
    rows = corpus()
    got = {r.doc_id: r for r in L.identify(make(rows)).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 30 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_families():
    assert L.family("en") == L.family("de-AT") == "germanic" and L.family("fr") == L.family("es") == "romance" and L.family("xx") == "=xx"


def test_whole_text_counts(monkeypatch):
    texts = ["der und " * 50 + "the and " * 70, "x" * 74, "Ünï 12,, cödé " * 9, "ab", "a"]
    whole = [L.features(t) for t in texts]
    for piece in (37, 5, 3):
        monkeypatch.setattr(L, "_PIECE", piece)
        assert all((L.features(t) == w).all() for t, w in zip(texts, whole, strict=True))
    assert L.features("12 ... \n") is None and L.features(None) is None and L.features("x") is not None


def test_odd_rows(odd, none):
    rows = L.identify(odd).collect()
    assert len(rows) == odd.count() and all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (2, 3, 4, 8))
    assert L.identify(none).count() == 0
    kept = L.predict(odd, L.train(odd), keep_text=True).select("row.*")
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_surplus_languages_leave_the_frequent_ones(make, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGS", 6)
    rows = [(i, "abc def", f"l{i}") for i in range(30)] + [(100 + i, t, lang) for i, t, lang in corpus(60)]
    assert set(WORDS) <= set(L.train(make(rows)).langs) and len(L.train(make(rows)).langs) == 6


def test_sample_is_bounded(make, monkeypatch):
    rows = [(i, f"word {i} abc", "en" if i % 2 else "de") for i in range(3000)]
    seen = []
    monkeypatch.setattr(L, "train_svm", lambda x, y, **_: seen.append(len(x)) or L.np.zeros((1 << L.BITS) + 1))
    assert L.train(make(rows), per_lang=50).langs == ["de", "en"] and 80 <= max(seen) <= 100
    seen.clear()
    one_id = [(None, f"word {i} abc", "en") for i in range(3000)] + [(7, f"wort {i} abc", "de") for i in range(3000)]
    L.train(make(one_id + [(8, "mot", "fr")]), per_lang=50)
    assert 80 <= max(seen) <= 101


def test_sparse_training_equals_dense_training():
    r = L.np.random.default_rng(3)
    dense = L.np.where(r.random((60, 1 << L.BITS)) < 0.002, r.random((60, 1 << L.BITS)), 0.0)
    y = L.np.where(r.random(60) < 0.3, 1.0, -1.0)
    sparse = [(L.np.flatnonzero(v), v[v != 0]) for v in dense]
    w = L.train_svm(sparse, y)
    full = [(L.np.arange(1 << L.BITS), v) for v in dense]
    assert L.np.allclose(w, L.train_svm(full, y), atol=1e-9)
    assert (L.np.sign(dense @ w[:-1] + w[-1]) == y).all()


def test_hierarchy_matches_brute_force(make):
    """Family first, then every pair of its languages votes."""
    m = L.train(make([*corpus(200), *((1000 + i, "ja nein doch", "nl") for i in range(40)), *((2000 + i, "hyvää päivää", "fi") for i in range(30))]))
    assert set(m.families) == {"germanic", "romance", "uralic"}
    machines = iter(m.weights)
    rest = {f: next(machines) for f in m.families}
    pairs = {(a, b): next(machines) for k, a in enumerate(m.langs) for b in m.langs[k + 1 :] if L.family(a) == L.family(b)}
    assert next(machines, None) is None
    for _, text, _ in corpus(80):
        v = L.features(text)
        margin = lambda w: float(w[:-1] @ v + w[-1])  # noqa: B023, E731
        best = max(rest, key=lambda f: margin(rest[f]))
        members = [x for x in m.langs if L.family(x) == best]
        votes = {x: sum(x == (a if margin(w) >= 0 else b) for (a, b), w in pairs.items()) for x in members}
        lead = {x: sum((margin(w) if x == a else -margin(w)) for (a, b), w in pairs.items() if x in (a, b)) for x in members}
        assert m.predict(v)[0] == max(members, key=lambda x: (votes[x], lead[x]))


def test_letters_are_told_apart_from_nothing_learned(make):
    rows = L.predict(make([(1, "some words", None), (2, "12", None), (3, None, None)]), L.train(make([(1, "some words", None)]))).collect()
    assert [(r.row.doc_id, r.lang_pred, r.has_letters) for r in sorted(rows, key=lambda r: r.row.doc_id)] == [(1, "und", True), (2, "und", False), (3, "und", False)]
