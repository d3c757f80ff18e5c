import random

import pytest
from tokenizers import Tokenizer, models, normalizers

from attestor.llm import unigram as U

P = pytest.importorskip("public_tokenizers")


def library(pieces, byte_fallback):
    vocabulary = [("<unk>", 0.0), *pieces, *((f"<0x{i:02X}>", 0.0) for i in range(256) if byte_fallback)]
    t = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback=byte_fallback))
    t.normalizer = normalizers.Sequence([normalizers.Replace(" ", U.SPACE), normalizers.Prepend(U.SPACE)])
    return t


def test_production_vocabulary_matches_the_library():
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        pieces, byte_fallback = U.load(f.read())
    mine, theirs, r = U.Unigram(pieces, byte_fallback), library(pieces, byte_fallback), random.Random(7)
    assert mine.parted
    for _ in range(800):
        letters = r.choice(["ab  \n", "the ing▁ ", "".join(map(chr, range(33, 0x500))) + "   ", "日本語 🎉 é", "aaaa "])
        text = "".join(r.choice(letters) for _ in range(r.randrange(60)))
        if "<" not in text:
            assert mine.count(text)[0] == len(theirs.encode(text).ids), text


def test_ties_and_unknown_characters_match_the_library():
    r = random.Random(8)
    for _ in range(150):
        pieces = {}
        for _ in range(r.randrange(1, 14)):
            pieces.setdefault("".join(r.choice("ab▁") for _ in range(r.randrange(1, 4))), -float(r.randrange(1, 5)))
        mine, theirs = U.Unigram(list(pieces.items()), False), library(list(pieces.items()), False)
        for _ in range(15):
            text = "".join(r.choice("abc ") for _ in range(r.randrange(1, 12)))
            assert mine.count(text)[0] == len(theirs.encode(text).ids), (pieces, text)


def test_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(U, "CACHE", 50)
    monkeypatch.setattr(U, "_BLOCK", 20)
    m = U.Unigram([("▁", -1.0), ("a", -1.0), ("▁a", -1.5), ("ab", -1.2)], False)
    text = " ".join("ab" * (i % 90) for i in range(300))
    assert m.count(text)[0] == m.solve(U.SPACE + text.replace(" ", U.SPACE))[0]


def test_odd_rows(odd, none):
    path = P.path("piece_bpe_32k.model")
    rows = U.token_counts(odd, path).collect()
    assert len(rows) == odd.count() and all(r.n_tokens == 0 for r in rows if r.doc_id in (2, 3))
    assert U.token_counts(none, path).count() == 0


def test_whole_long_texts_match_the_library():
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    pieces, byte_fallback = U.load(data)
    mine, theirs, r = U.Unigram(pieces, byte_fallback, U.normaliser(data)), library(pieces, byte_fallback), random.Random(17)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 12))) for _ in range(500)] + ["über", "niño", "日本", "12.5", "(see", "end.", "\n", "  ", "x" * 300]
    for n in (3_000, 20_000):
        text = " ".join(r.choice(words) for _ in range(n))
        assert mine.count(text)[0] == len(theirs.encode(text).ids)


def test_normaliser_is_read_from_the_file():
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        assert U.normaliser(f.read()) is False
    spec = lambda body: b"\x1a" + bytes([len(body)]) + body
    assert U.normaliser(spec(b"")) is True and U.normaliser(spec(b"\x20\x00")) is False
    for other in (b"\x12\x01x", b"\x18\x00", b"\x28\x00"):
        with pytest.raises(ValueError):
            U.normaliser(spec(other))
    squeezed, pieces = U.Unigram([(U.SPACE, -1.0), ("a", -1.0)], False, True), [(U.SPACE, -1.0), ("a", -1.0)]
    assert squeezed.count("  a   a ") == U.Unigram(pieces, False).count("a a") and squeezed.count("  ") == (0, 0, 0.0)
