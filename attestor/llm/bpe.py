"""Byte-level BPE encoding and decoding by prefix dynamic programming.

The encoding of a byte string is unique, and so is that of each prefix; the
last token of a prefix's encoding is therefore one value. The table holds it
for each prefix length: position e gets the token t ending there whose
neighbour, the last token of the prefix before t, stays apart from t when the
two are merged alone. Walking the table backwards from any e gives the
encoding of that prefix, so bytes can be appended at a cost for the new bytes
only, and an edit inside re-encodes from the edit until the table agrees with
the old one again.

Tokens that merging never produces (their own bytes merge to something else)
take no part in the table; as in the tokenizer library, a piece that is itself
a token is that token. A piece is one match of the split pattern, and pieces
never influence each other.
"""

from __future__ import annotations

import base64
import struct
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import read_table, ship_code

#: Pieces kept with their ids by one worker, twice: when so many are new, they
#: become the old ones, and old ones that were not used meanwhile go.
CACHE = 300_000
_NEVER = 1 << 62
_CACHE_CHARS, _PAIRS, _TEXT, _BLOCK, _ROWS = 64, 400_000, 1 << 20, 1 << 16, 256
_IDS, _FOUR = np.dtype("<u4"), struct.Struct("<I").pack
#: Unicode's White_Space, which the tokenizer library means by \s.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Vocabulary:
    """Tokens by rank, from the lines of a rank file: base64 of bytes, rank."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}
        self.bytes_of = dict(sorted((i, t) for t, i in self.ranks.items()))
        if missing := [i for i in range(256) if bytes([i]) not in self.ranks]:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        #: Tokens that merging produces, and the two that each was merged from.
        self.produced: dict[bytes, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for token, data in self.bytes_of.items():
            *_, before, last = [None, *self._merges(data)]
            if last == [data]:
                self.produced[data] = token
                if before:
                    self.halves[token] = (self.ranks[before[0]], self.ranks[before[1]])
        self.longest = max(map(len, self.produced))
        self._apart: dict[int, bool] = {}

    def _merges(self, data: bytes):
        """The parts after each merge of the pair of lowest rank, leftmost
        first, the single bytes before all."""
        parts, get = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        ranks = [get(data[i : i + 2], _NEVER) for i in range(len(data) - 1)]
        yield parts
        while ranks and (least := min(ranks)) < _NEVER:
            i = ranks.index(least)
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], _NEVER)
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], _NEVER)
            yield parts

    def merge(self, data: bytes) -> list[int]:
        """The encoding by merging, for comparison and for tokens alone."""
        *_, parts = self._merges(data)
        return [self.ranks[x] for x in parts]

    def apart(self, left: int, right: int) -> bool:
        """Whether two produced tokens stay as they are when they stand
        together: no merge ever crosses their border. Going back in time, the
        token at the border that was merged last is taken into its halves; a
        crossing merge of the two now at the border would have come first if
        its rank is below those of the merges that consumed them, or as low on
        the right, where the border lies further left."""
        key = left << 32 | right
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= _PAIRS:
                self._apart.clear()
            known = self._apart[key] = self._stay(left, right)
        return known

    def _stay(self, x: int, y: int) -> bool:
        of, get, halves, until_x, until_y = self.bytes_of, self.ranks.get, self.halves, _NEVER, _NEVER
        while True:
            across = get(of[x] + of[y], _NEVER)
            if across < until_x and across <= until_y and across < _NEVER:
                return False
            if y in halves and (y >= x or x not in halves):
                until_y, y = y, halves[y][0]
            elif x in halves:
                until_x, x = x, halves[x][1]
            else:
                return True

    def extend(self, data: bytes, last: list[int], at: int, stop: int) -> None:
        """Fill in the last tokens of the prefixes of over at bytes."""
        get, pairs, longest = self.produced.get, self._apart, self.longest
        for end in range(at + 1, stop + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = get(data[start:end])
                if token is not None:
                    if not start:
                        break
                    ok = pairs.get(last[start] << 32 | token)
                    if ok or ok is None and self.apart(last[start], token):
                        break
            last[end] = token


class PrefixTable:
    """The last token of each prefix's encoding, of one piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        at = len(self.data)
        self.data += more
        self.last.extend([-1] * len(more))
        self.vocabulary.extend(self.data, self.last, at, len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put new in the place of data[start:stop]; returns how many table
        entries were found anew. Entries depend on the bytes of at most one
        token before them and on earlier entries, so once as many entries in a
        row as the longest token has bytes agree with the old ones, and no new
        byte is among them, all later ones do too."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last, same, found = old[: start + 1], 0, 0
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(-1)
            self.vocabulary.extend(self.data, self.last, end - 1, end)
            found += 1
            was = end - shift
            same = same + 1 if end > start + len(new) and was > stop and old[was] == self.last[end] else 0
            if same >= self.vocabulary.longest:
                self.last.extend(old[was + 1 :])
                break
        return found

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the prefix of so many bytes, of all by default."""
        end, out = len(self.data) if end is None else end, []
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes_of[self.last[end]])
        return out[::-1]


class Encoder(dict):
    """Ids of texts; as a dict, the packed ids of pieces seen before."""

    def __init__(self, data: bytes, pattern: str):
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.vocabulary = Vocabulary(data)
        inside = regex.sub(r"\[\^\\s", lambda _: f"[^{_SPACE}", pattern)
        self.pattern = regex.compile(inside.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            data, v = piece.encode(), self.vocabulary
            token = v.ranks.get(data)
            ids = [token] if token is not None else PrefixTable(v, data).tokens()
            packed = b"".join([_FOUR(i) for i in ids])
        if len(piece) <= _CACHE_CHARS:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(text) < _TEXT:
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        found, out = (m[0] for m in self.pattern.finditer(text)), bytearray()
        while block := b"".join(map(self.__getitem__, islice(found, _BLOCK))):
            out += block
        return bytes(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), _IDS).tolist()

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids."""
        of = self.vocabulary.bytes_of.__getitem__
        return b"".join(map(of, np.frombuffer(packed, _IDS).tolist()))


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def encoder(data: bytes, pattern: str) -> Encoder:
    """One encoder for a vocabulary and pattern in each worker process."""
    key = (hash(data), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(data, pattern)
    return _ENCODERS[key]


def _vocabulary(docs: DataFrame, vocabulary: str):
    ship_code(docs.sparkSession)
    with open(vocabulary, "rb") as f:  # on the driver; about a megabyte, whatever the corpus
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row of docs.

    ids is binary: the ids of the whole text as little-endian unsigned 32-bit
    integers. vocabulary is the path of a rank file on the driver. A null text
    counts as empty and has no ids. No special tokens are recognised. With
    decoded, there is one more column: the bytes that the ids decode to, as
    decode() would add it, without a second pass.
    """
    data = _vocabulary(docs, vocabulary)
    names = ["doc_id", "n_tokens", "ids", *["decoded"] * decoded]

    def rows(batches):
        e = encoder(data.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                ids = [e.packed(x.as_py() or "") for x in batch.column("text")]
                columns = [batch.column("doc_id"), pa.array([len(x) // _IDS.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array(map(e.decode, ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)
        e.old = {}  # a worker may do other work next

    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, schema)


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """encoded with one more column, decoded: the bytes of its ids (binary),
    in place of a column of that name."""
    kept = [c for c in encoded.columns if c != "decoded"]
    data = _vocabulary(encoded, vocabulary)

    def rows(batches):
        e = encoder(data.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                out = [None if x is None else e.decode(x) for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.binary())], [*kept, "decoded"])

    return encoded.mapInArrow(rows, StructType([*(f for f in encoded.schema.fields if f.name in kept), StructField("decoded", BinaryType())]))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) under the
    production vocabulary, from encoding and decoding every text."""
    import public_tokenizers

    how = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    both = encode(docs, *how, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents")).drop("ids")
