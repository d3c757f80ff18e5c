import base64
import hashlib
import random

import pytest
import tiktoken

from attestor.llm import bpe as B

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as f:
    DATA = f.read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}


@pytest.fixture(scope="module")
def mine():
    return B.Encoder(DATA, P.PATTERN)


def theirs():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts(n):
    r = random.Random(9)
    for _ in range(n):
        letters = r.choice(["".join(map(chr, range(1, 0x300))), "".join(chr(r.randrange(1, 0xD7FF)) for _ in range(300)), "ab aA \n\t\r\x0b\x1c\x1d\x85\xa0　 .1", "aaab", "the in'g tion'll ST 012'''s", "<|endoftext|> "])
        yield "".join(r.choice(letters) for _ in range(r.randrange(80)))


def test_ids_are_the_library_s(mine):
    t = theirs()
    for text in [*texts(1500), " " + "a" * 5000, "", " ", "\n\n x"]:
        assert mine.encode(text) == t.encode_ordinary(text)
        assert mine.decode(mine.packed(text)) == text.encode()


def test_long_texts_and_full_caches(mine, monkeypatch):
    text = " ".join(texts(300))
    expected = mine.packed(text)
    for name, value in (("_TEXT", 10), ("_BLOCK", 7), ("CACHE", 5), ("_PAIRS", 3)):
        monkeypatch.setattr(B, name, value)
    assert B.Encoder(DATA, P.PATTERN).packed(text) == expected


def test_pairs_stay_apart_as_merging_says(mine):
    v, r = mine.vocabulary, random.Random(10)
    tokens = list(v.produced.values())
    for _ in range(4000):
        a, b = (r.choice(tokens[: r.choice((300, 3000, 50_000))]) for _ in range(2))
        assert v.apart(a, b) == (v.merge(v.bytes_of[a] + v.bytes_of[b]) == [a, b])


def test_appends_and_edits(mine):
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abthe ") for _ in range(n)).encode()
    for _ in range(150):
        data, new, more = word(r.randrange(1, 90)), word(r.randrange(6)), word(r.randrange(6))
        a = r.randrange(len(data) + 1)
        b = r.randrange(a, len(data) + 1)
        table = B.PrefixTable(mine.vocabulary, data)
        table.replace(a, b, new)
        table.append(more)
        whole = data[:a] + new + data[b:] + more
        assert table.tokens() == mine.vocabulary.merge(whole)
        assert all(table.tokens(e) == mine.vocabulary.merge(whole[:e]) for e in range(0, len(whole) + 1, 11))
    table = B.PrefixTable(mine.vocabulary, word(4000))
    assert table.replace(2000, 2001, b"x") < 200  # only near the edit


def test_odd_rows(odd, none):
    t = theirs()
    rows = B.digests(odd).collect()
    given = sorted((hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in t.encode_ordinary(r.text or ""))).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    assert sorted((r.ids_sha256, r.decoded_sha256) for r in rows) == given
    assert B.digests(none).count() == 0
    again = B.decode(B.encode(odd, PATH, P.PATTERN), PATH, P.PATTERN)
    assert sorted(bytes(r.decoded) for r in again.collect()) == sorted((r.text or "").encode() for r in odd.collect())
