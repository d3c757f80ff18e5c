"""Language-model scoring: n-grams with Katz backoff, of order ORDER.

Counts are discounted by Good-Turing, with the largest k up to MAX_K for which
all discounts are sound; backoff weights are exactly normalised over the
vocabulary and one unknown word. An n-gram is known if it occurs in training
LEAST[n - 1] times or more. With counts c, discounts d and a history h of total
T(h), which is h's own count,

    P(w)   = d c(w) / N               if w is known, the rest of 1 if unknown
    P(w|h) = d c(h,w) / T(h)          if the n-gram is known
           = a(h) P(w|h')             otherwise, h' being h without its first
                                      word and a(h) = 1 if nothing known
                                      follows h
    a(h)   = (1 - sum P(w|h)) / (1 - sum P(w|h')), over w known after h.

Where discounting leaves no mass (all after h is known and no count up to k),
one is added to N or T(h), so that every word keeps a probability. A text's
first word has the end token as its history, its second word the end token and
the first, and so on. All n-grams of the training texts are counted, those too
rare to be known too: they make the numbers of counts that discounts rest on,
and the mass that is left for backing off.

Execution. Texts are tokenised once into written batches of about BATCH tokens
with the batch's own word numbers and 64-bit word hashes. Words and n-grams
are known elsewhere by 64-bit hashes only. For each order, a batch
sends its distinct keys with their training counts, packed, to the partitions
of a table dealt by key; a partition adds up, stores its share of the model
and replies with the totals in the order asked. So what travels is a batch's
distinct keys, a very frequent word or n-gram is one entry of a batch, and
nothing grows with a key's frequency. Every known n-gram has one owner batch,
which alone adds it to its history's sums for the backoff weight. Weights come
order by order: those of an order need the probabilities of the one below.
Tables of keys are asked, and batches answered, in ROUNDS shares of the keys
or batches, which bounds what is exchanged at a time. Key
collisions are expected at n^2 / 2^65 of n distinct keys.
"""

from __future__ import annotations

from functools import wraps
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Workspace, read_table, ship_code

ORDER = 3
#: Least training count of a known n-gram of each order, the last one's of all beyond.
LEAST = (1, 1, 2)
MAX_K = 5
BATCH = 1 << 20
ROUNDS = 2
#: Keys asked for in one partition of a table, at most about.
PART = 1 << 21
_END = xxh64_intdigest(b"\n")  # no word holds white space
_NONE = np.zeros(0, np.int64)


# Packing: arrays travel as compressed bytes; sorted keys as differences.


def _pack(a: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T if len(a) else np.zeros((1, 0), np.uint8)
    return bytes([planes.shape[0] if len(a) else a.dtype.itemsize]) + len(a).to_bytes(6, "little") + pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def _unpack(data: bytes, dtype) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:7], "little")
    if not n:
        return np.zeros(0, dtype)
    raw = np.frombuffer(pa.decompress(data[7:], width * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(dtype).reshape(n)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the sorted keys of each of so many ranges begin, and the end."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def _mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit key of an ordered pair of hashes."""
    k = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    k = (k ^ (k >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(32))


class _Words(dict):
    def __init__(self):
        super().__init__()
        self.hashes = [_END]

    def __missing__(self, word: bytes) -> int:
        self.hashes.append(xxh64_intdigest(word))
        self[word] = n = len(self.hashes) - 1
        return n


def _batches(rows):
    """Token batches. Words are numbered by falling frequency and then by hash,
    which packs well."""
    import uuid

    def flush():
        hashes = np.array(words.hashes, np.uint64)
        keys, place = np.unique(hashes, return_inverse=True)
        tokens = place[np.concatenate(parts)]
        order = np.lexsort((keys, -np.bincount(tokens, minlength=len(keys))))
        number = np.empty(len(keys), np.uint32)
        number[order] = np.arange(len(keys), dtype=np.uint32)
        tokens = number[tokens]
        out = [uuid.uuid4().int >> 65, len(keys), len(tokens), _pack_keys(keys[order]), _pack(tokens), _pack(np.array(sizes, np.int64)), ids, _pack(np.array(train, np.uint8))]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, kinds, strict=True)], ["batch", "n_words", "n_tokens", "words", "tokens", "sizes", "ids", "train"])

    words, parts, sizes, ids, train, held = _Words(), [], [], [], [], 0
    for batch in rows:
        for doc_id, text, use in zip(*(batch.column(c) for c in ("doc_id", "text", "train")), strict=True):
            found = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
            n = len(found) + 1
            numbers = np.zeros(n, np.uint32)
            numbers[:-1] = np.fromiter(map(words.__getitem__, found), np.uint32, n - 1)
            parts.append(numbers)
            sizes.append(n)
            ids.append(doc_id.as_py())
            train.append(use.as_py())
            held += n
            if held >= BATCH:
                yield flush()
                words, parts, sizes, ids, train, held = _Words(), [], [], [], [], 0
    if held:
        yield flush()


_BATCH_SCHEMA = "batch long, n_words long, n_tokens long, words binary, tokens binary, sizes binary, ids array<long>, train binary"


class _Grams:
    """The n-grams of a batch: distinct keys in order; for each token that
    ends one its key's place, else -1; and for each key the places of its
    history and of itself without its first word, among the next lower ones."""

    def __init__(self, keys, place, history=None, lower=None):
        self.keys, self.place, self.history, self.lower = keys, place, history, lower


class _Batch:
    def __init__(self, row: dict):
        self.id, self.ids = row["batch"], row["ids"]
        self.words, place = np.unique(_unpack_keys(row["words"]), return_inverse=True)
        self.w, self.sizes, train = place[_unpack(row["tokens"], np.uint32)], _unpack(row["sizes"], np.int64), _unpack(row["train"], np.uint8).astype(bool)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.train, self.in_train = train, train[self.doc]
        self._grams = {1: _Grams(self.words, self.w)}

    def tokens(self, n: int) -> np.ndarray:
        """The tokens that end an n-gram: the (n-1)-th of a text and later ones."""
        return np.flatnonzero(np.arange(len(self.w)) - self.starts[self.doc] >= n - 2) if n > 2 else np.arange(len(self.w))

    def token_keys(self, n: int) -> np.ndarray:
        """The key of the n-gram that ends at each token; of no meaning where none does."""
        words = self.words[self.w]
        keys = words
        for m in range(2, n + 1):
            before = np.empty_like(keys)
            before[1:] = keys[:-1]
            if m == 2:
                before[self.starts] = _END
            else:
                before[0] = 0
            keys = _mix(before, words)
        return keys

    def grams(self, n: int) -> _Grams:
        if n not in self._grams:
            below, at = self.grams(n - 1), self.tokens(n)
            before = np.empty_like(below.place)
            before[1:] = below.place[:-1]
            if n == 2:
                before[self.starts] = np.searchsorted(self.words, np.uint64(_END))
            keys, first, inverse = np.unique(self.token_keys(n)[at], return_index=True, return_inverse=True)
            place = np.full(len(self.w), -1, np.int64)
            place[at] = inverse
            self._grams[n] = _Grams(keys, place, before[at[first]], below.place[at[first]])
        return self._grams[n]

    def counts(self, n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys from low and below high, with their training counts."""
        at = self.tokens(n)
        keys = self.token_keys(n)[at]
        some = keys >= np.uint64(low)
        if high < 1 << 64:
            some &= keys < np.uint64(high)
        # Most tokens are in training: what the others add is taken away.
        found, counts = np.unique(keys[some], return_counts=True)
        others = np.searchsorted(found, keys[some & ~self.in_train[at]])
        return found, counts - np.bincount(others, minlength=len(found))


_ASK = "part int, batch long, keys binary, counts binary"


def _asking(n: int, parts: int, first: int, stop: int):
    """Of so many parts of all keys, those from first and before stop."""

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = _Batch(row).counts(n, -(-(first << 64) // parts), -(-(stop << 64) // parts))
                some = [(p, a, b) for p, (a, b) in enumerate(pairwise(_cuts(keys, parts))) if a < b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, *_ in some], pa.int32()), pa.array([row["batch"]] * len(some), pa.int64()), pa.array([_pack_keys(keys[a:b]) for _, a, b in some], pa.binary()), pa.array([_pack(counts[a:b]) for _, a, b in some], pa.binary())],
                    ["part", "batch", "keys", "counts"],
                )

    return rows


_TOTALS = "kind string, part int, batch long, keys binary, totals binary, types long, tokens long, seen array<long>"


def _gathered(table: pa.Table) -> tuple[list[dict], list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows by batch, their keys, all distinct keys and each key's place."""
    rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
    each = [_unpack_keys(r["keys"]) for r in rows]
    keys, place = np.unique(np.concatenate(each), return_inverse=True)
    return rows, each, keys, place


def _adding_up(least: int):
    def add_up(table: pa.Table) -> pa.Table:
        """One partition's totals, and a reply to each batch that asked: twice
        the totals in its order, and one more where the batch owns the key."""
        rows, each, keys, place = _gathered(table)
        counts = np.concatenate([_unpack(r["counts"], np.int64) for r in rows])
        totals = np.bincount(place, counts, len(keys)).astype(np.int64)
        counted = np.flatnonzero(counts)
        _, at = np.unique(place[counted], return_index=True)
        told = 2 * totals[place]
        told[counted[at]] += 1
        replies = np.split(told, np.cumsum([len(k) for k in each])[:-1])
        seen = np.bincount(totals[totals <= MAX_K + 1], minlength=MAX_K + 2)[1:]
        part, known = rows[0]["part"], totals >= least
        out = [{"kind": "model", "part": part, "keys": _pack_keys(keys[known]), "totals": _pack(totals[known]), "types": int(known.sum()), "tokens": int(totals.sum()), "seen": seen.tolist()}]
        out += [{"kind": "reply", "part": part, "batch": r["batch"], "totals": _pack(x)} for r, x in zip(rows, replies, strict=True)]
        return pa.Table.from_pylist(out, _arrow("totals"))

    return add_up


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _arrow(name: str) -> pa.Schema:
    ddl = {"totals": _TOTALS, "weights": _WEIGHTS, "partial": _PARTIAL, "scores": _SCORES}[name]
    return pa.schema([(c, _KINDS[t]) for c, t in (x.split() for x in ddl.split(", "))])


class Discounts:
    """Good-Turing discounts from the numbers of types seen 1 to MAX_K + 1
    times: d[c] for counts up to k, 1 above it; counts below least keep nothing."""

    def __init__(self, seen: list[int], least: int = 1):
        self.k, self.d, self.least = 0, np.ones(1), least
        for k in range(min(MAX_K, len(seen) - 1), 0, -1):
            if not all(seen[:k]):
                continue
            cut = (k + 1) * seen[k] / seen[0]
            if cut >= 1:
                continue
            d = [((r + 1) * seen[r] / (seen[r - 1] * r) - cut) / (1 - cut) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                self.k, self.d = k, np.array([1.0, *d])
                break

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        kept = counts * np.where(counts <= self.k, self.d[np.minimum(counts, self.k)], 1.0)
        return np.where(counts >= self.least, kept, 0.0)


class Stats:
    """What all partitions of a table add up to."""

    def __init__(self, types: int, tokens: int, seen: list[int], least: int = 1):
        self.types, self.tokens, self.least, self.discount = types, tokens, least, Discounts(seen, least)
        self.k = self.discount.k
        # Types up to k each lose a part of their mass; without any, one is added.
        small = sum(seen[: self.k])
        self.total = tokens if small else tokens + 1
        kept = sum(r * seen[r - 1] * self.discount.d[r] for r in range(1, self.k + 1)) + tokens - sum(r * seen[r - 1] for r in range(1, self.k + 1))
        self.unknown = 1 - kept / self.total if tokens else 1.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """Of single words."""
        return np.where(counts > 0, self.discount(counts) / self.total, self.unknown)


_REPLIES = ["batch", "part", "of", "totals", "weights", "full"]


def _once(method):
    """Keeps what a method of an order gave, as long as its object is there."""

    @wraps(method)
    def kept(self, m: int):
        if (key := (method.__name__, m)) not in self.made:
            self.made[key] = method(self, m)
        return self.made[key]

    return kept


class _Scoring:
    """A batch with the replies of all orders up to n, and the weights of all
    orders below it."""

    def __init__(self, row: dict, replies: list[dict], stats: list[Stats], n: int):
        self.b, self.n, self.stats, self.made = _Batch(row), n, stats, {}
        by: dict[str, list[dict]] = {}
        for r in sorted(replies, key=lambda r: r["part"]):
            by.setdefault(r["of"], []).append(r)

        def joined(of: str, column: str, kind) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *(_unpack(r[column], kind) for r in by.get(of, ()))])

        told = [joined(f"totals{m}", "totals", np.int64) for m in range(1, n + 1)]
        self.totals, self.own = [t >> 1 for t in told], [t & 1 == 1 for t in told]
        self.kept = [s.discount(t) for s, t in zip(stats, self.totals, strict=False)]
        self.p = stats[0].probability(self.totals[0])
        #: By order from 2: log weights of histories, and what to add to their totals.
        self.weight, self.more = [], []
        for m in range(2, n):
            at = np.flatnonzero(self.wanted(m))
            weight, more = np.zeros(len(self.totals[m - 2])), np.zeros(len(self.totals[m - 2]))
            weight[at], more[at] = joined(f"weights{m}", "weights", np.float64), joined(f"weights{m}", "full", np.uint8)
            self.weight.append(weight)
            self.more.append(more)

    def known(self, m: int) -> np.ndarray:
        return self.totals[m - 1] >= self.stats[m - 1].least

    @_once
    def unknown_tokens(self, m: int) -> np.ndarray:
        """Tokens whose m-gram is unknown though something may be known after its history."""
        g = self.b.grams(m)
        at = np.flatnonzero(g.place >= 0)
        key = g.place[at]
        return at[~self.known(m)[key] & (self.totals[m - 2][g.history[key]] >= self.stats[m - 1].least)]

    @_once
    def maybe_full(self, m: int) -> np.ndarray:
        """Histories of which no small count is seen here: only they can be
        without any at all."""
        g, total = self.b.grams(m), self.totals[m - 1]
        least = np.full(len(self.totals[m - 2]), np.iinfo(np.int64).max)
        np.minimum.at(least, g.history[total > 0], total[total > 0])
        return (least > self.stats[m - 1].k) & (least < np.iinfo(np.int64).max)

    @_once
    def wanted(self, m: int) -> np.ndarray:
        """Histories whose weights are asked for."""
        g, out = self.b.grams(m), self.maybe_full(m).copy()
        out[g.history[g.place[self.unknown_tokens(m)]]] = True
        return out

    def probability(self, m: int) -> np.ndarray:
        """P of each known m-gram; of no meaning for others."""
        if m == 1:
            return self.p
        history = self.b.grams(m).history
        return self.kept[m - 1] / np.maximum(self.totals[m - 2] + self.more[m - 2], 1)[history]

    def asks(self, parts: int) -> list[dict]:
        """What this batch's own n-grams add to the sums of their histories,
        and the histories whose weights it wants."""
        n, g = self.n, self.b.grams(self.n)
        mine, size = self.own[n - 1] & self.known(n), len(self.totals[n - 2])
        left = np.bincount(g.history[mine], self.kept[n - 1][mine], size)
        after = np.bincount(g.history[mine], self.probability(n - 1)[g.lower[mine]], size)
        wanted = self.wanted(n)
        at = np.flatnonzero(wanted | (left > 0))
        keys, out = self.b.grams(n - 1).keys[at], []
        for part, (i, j) in enumerate(pairwise(_cuts(keys, parts))):
            if i < j:
                s = at[i:j]
                out.append({"kind": "weights", "part": part, "batch": self.b.id, "keys": _pack_keys(keys[i:j]), "left": _pack(left[s]), "after": _pack(after[s]), "totals": _pack(self.totals[n - 2][s]), "wanted": _pack(wanted[s].astype(np.uint8))})
        return out

    def scores(self) -> dict:
        """Scores of the texts but for weights of the highest order: which
        they want for whom."""
        b, n, docs = self.b, self.n, len(self.b.ids)
        log = np.log10(self.p)[b.w]
        log_of = lambda x: np.log10(np.maximum(x, np.finfo(float).tiny))
        last = {}
        for m in range(2, n + 1):
            g = b.grams(m)
            at = np.flatnonzero(g.place >= 0)
            key = g.place[at]
            known = self.known(m)[key]
            some, history = key[known], g.history[key[known]]
            back = self.unknown_tokens(m)
            if m < n:
                log[back] += self.weight[m - 2][g.history[g.place[back]]]
                total = self.totals[m - 2] + self.more[m - 2]
            else:
                total = self.totals[m - 2]
                index = np.cumsum(self.wanted(m)) - 1
                fixed = at[known][self.maybe_full(m)[history]]
                last = {"doc": _pack(b.doc[back].astype(np.int32)), "history": _pack(index[g.history[g.place[back]]].astype(np.int32)), "fixed_doc": _pack(b.doc[fixed].astype(np.int32)), "fixed_history": _pack(index[g.history[g.place[fixed]]].astype(np.int32)), "fixed_total": _pack(total[g.history[g.place[fixed]]])}
            log[at[known]] = log_of(self.kept[m - 1])[some] - log_of(total)[history]
        total = self.totals[0]
        base = np.bincount(b.doc, np.log10((total + 1) / (self.stats[0].tokens + self.stats[0].types + 1))[b.w], docs)
        known = np.bincount(b.doc[total[b.w] > 0], minlength=docs)
        return {"kind": "scores", "batch": b.id, "ids": b.ids, "train": _pack(b.train.astype(np.uint8)), "sizes": _pack(b.sizes), "known": _pack(known), "base": _pack(base), "score": _pack(np.bincount(b.doc, log, docs)), **last}


_PARTIAL = "kind string, part int, batch long, keys binary, left binary, after binary, totals binary, wanted binary, ids array<long>, train binary, sizes binary, known binary, base binary, score binary, doc binary, history binary, fixed_doc binary, fixed_history binary, fixed_total binary"


def _answering(stats: list[Stats], n: int, parts: int, last: bool):
    """What a batch asks of the weights of order n, and for the last order
    its scores but for those weights."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _arrow("partial").empty_table()
        scoring = _Scoring(left.to_pylist()[0], right.to_pylist(), stats, n)
        out = scoring.asks(parts)
        return pa.Table.from_pylist(out + [scoring.scores()] * last, _arrow("partial"))

    return one


_WEIGHTS = "kind string, part int, batch long, keys binary, weights binary, full binary"


def _weigh(table: pa.Table) -> pa.Table:
    """Backoff weights of one partition's histories, as log10, and whether
    one is added to their totals."""
    rows, each, keys, place = _gathered(table)
    add = lambda c: np.bincount(place, np.concatenate([_unpack(r[c], np.float64) for r in rows]), len(keys))
    mass, rest = add("left"), add("after")
    total = np.zeros(len(keys))
    total[place] = np.concatenate([_unpack(r["totals"], np.int64) for r in rows])
    # kept mass is the total itself where nothing is discounted or left out
    full = (total > 0) & (total - mass <= 1e-9 * total)
    free = np.where(full, 1.0, np.maximum(total - mass, np.finfo(float).tiny)) / np.where(full, total + 1, np.maximum(total, 1))
    weights = np.where(total > 0, np.log10(free) - np.log10(np.maximum(1 - rest, np.finfo(float).tiny)), 0.0)
    stored = mass > 0  # others have weight 1
    out, part = [{"kind": "model", "part": rows[0]["part"], "keys": _pack_keys(keys[stored]), "weights": _pack(weights[stored]), "full": _pack(full[stored].astype(np.uint8))}], rows[0]["part"]
    for r, own in zip(rows, np.split(place, np.cumsum([len(k) for k in each])[:-1]), strict=True):
        own = own[_unpack(r["wanted"], np.uint8).astype(bool)]
        if len(own):
            out.append({"kind": "reply", "part": part, "batch": r["batch"], "weights": _pack(weights[own]), "full": _pack(full[own].astype(np.uint8))})
    return pa.Table.from_pylist(out, _arrow("weights"))


_SCORES = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        return _arrow("scores").empty_table()
    r = left.to_pylist()[0]
    replies = sorted(right.to_pylist(), key=lambda x: x["part"])
    weights = np.concatenate([np.zeros(0), *(_unpack(x["weights"], np.float64) for x in replies)])
    full = np.concatenate([np.zeros(0, np.uint8), *(_unpack(x["full"], np.uint8) for x in replies)])
    score = _unpack(r["score"], np.float64).copy()
    score += np.bincount(_unpack(r["doc"], np.int32), weights[_unpack(r["history"], np.int32)], len(score))
    total = _unpack(r["fixed_total"], np.int64)
    fix = np.where(full[_unpack(r["fixed_history"], np.int32)] == 1, np.log10(np.maximum(total, 1)) - np.log10(total + 1), 0.0)
    score += np.bincount(_unpack(r["fixed_doc"], np.int32), fix, len(score))
    return pa.Table.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(_unpack(r["train"], np.uint8).astype(bool)), pa.array(_unpack(r["sizes"], np.int64)), pa.array(_unpack(r["known"], np.int64)), pa.array(_unpack(r["base"], np.float64)), pa.array(score)], schema=_arrow("scores"))


def _stats(table: DataFrame, least: int) -> Stats:
    seen = [F.coalesce(F.sum(F.col("seen")[i]), F.lit(0)).alias(f"s{i}") for i in range(MAX_K + 1)]
    r = table.where("kind = 'model'").agg(F.coalesce(F.sum("types"), F.lit(0)).alias("types"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), *seen).first()
    return Stats(r["types"], r["tokens"], [r[f"s{i}"] for i in range(MAX_K + 1)], least)


def _parts(spark: SparkSession, keys: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // PART))


class Scored:
    """scores: one row a document. The model's tables, partitioned by ranges
    of the 64-bit keys: counts, by order from 1 (part, keys, totals), and
    weights, by order from 2, of histories (part, keys, weights, full),
    packed. stats: their statistics, by order."""

    def __init__(self, scores: DataFrame, counts: list[DataFrame], weights: list[DataFrame], stats: list[Stats]):
        self.scores, self.counts, self.weights, self.stats = scores, counts, weights, stats


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def score(docs: DataFrame, train: Column, order: int = ORDER, least: tuple[int, ...] = LEAST) -> Scored:
    """Learn from the rows for which train holds and score all rows.

    docs has doc_id and text; a null text is empty and consists of the end
    token alone. The scores are doc_id, train, n_tokens, n_known (tokens that
    occur in training), base_score (add-one unigrams) and score (the model's
    log10 probability of the text). Rows with equal or null doc_id are scored
    apart. With nothing to learn from every token is unknown and has
    probability 1. order is 2 or more; least may not fall, and begins with 1.
    """
    least = tuple(least[min(n, len(least) - 1)] for n in range(order))
    if order < 2 or least[0] != 1 or list(least) != sorted(least):
        raise ValueError("order or least counts out of range")
    spark = docs.sparkSession
    ship_code(spark)
    ws = Workspace(spark, "katz")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(train, F.lit(False)).alias("train"))
    made = rows.mapInArrow(_batches, _BATCH_SCHEMA).withColumn("round", F.pmod("batch", F.lit(ROUNDS)).cast("int"))
    batches = ws.write(made, "batches", "round")
    asked = batches.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()

    def table(n: int) -> list[DataFrame]:
        """All keys of order n, in rounds."""
        parts = _parts(spark, asked[min(n, 2) - 1])
        edges = [parts * i // (1 if n == 1 else ROUNDS) for i in range((1 if n == 1 else ROUNDS) + 1)]
        done = []
        for first, stop in pairwise(edges):
            if first < stop:
                asks = batches.mapInArrow(_asking(n, parts, first, stop), _ASK)
                done.append(ws.write(asks.repartitionById(stop - first, "part").groupBy("part").applyInArrow(_adding_up(least[n - 1]), _TOTALS), f"counts{n}", "kind"))
        return done

    nothing = F.lit(None).cast("binary")
    counts, replies, stats, weights, answered = [], [], [], [], []
    for n in range(1, order + 1):
        found = table(n)
        whole = _union(found)
        stats.append(_stats(whole, least[n - 1]))
        counts.append(whole.where("kind = 'model'").select("part", "keys", "totals"))
        answered += found
        replies += [t.where("kind = 'reply'").select("batch", "part", F.lit(f"totals{n}").alias("of"), "totals", nothing.alias("weights"), nothing.alias("full")) for t in found]
        if n == 1:
            continue
        parts, partial = _parts(spark, asked[min(n - 1, 2) - 1]), []
        answers = _union(replies).select(*_REPLIES)
        for i in range(ROUNDS):
            mine = answers.where(F.pmod("batch", F.lit(ROUNDS)) == i)
            both = batches.where(F.col("round") == i).drop("round").groupBy("batch").cogroup(mine.groupBy("batch"))
            partial.append(ws.write(both.applyInArrow(_answering(stats, n, parts, n == order), _PARTIAL), f"asks{n}", "kind"))
            if n == order:  # nothing reads these any more
                ws.drop(batches, f"round={i}")
        if n == order:
            for t in answered:
                ws.drop(t, "kind=reply")
        asks = _union(partial).where("kind = 'weights'").select("part", "batch", "keys", "left", "after", "totals", "wanted")
        made = ws.write(asks.repartitionById(parts, "part").groupBy("part").applyInArrow(_weigh, _WEIGHTS), f"weights{n}", "kind")
        weights.append(made.where("kind = 'model'").select("part", "keys", "weights", "full"))
        told = made.where("kind = 'reply'")
        for t in partial:
            ws.drop(t, "kind=weights")
        if n < order:
            answered.append(made)
            replies.append(told.select("batch", "part", F.lit(f"weights{n}").alias("of"), nothing.alias("totals"), "weights", "full"))
    state = _union(partial).where("kind = 'scores'").select("batch", "ids", "train", "sizes", "known", "base", "score", "doc", "history", "fixed_doc", "fixed_history", "fixed_total")
    scores = state.groupBy("batch").cogroup(told.select("batch", "part", "weights", "full").groupBy("batch")).applyInArrow(_finish, _SCORES)
    return Scored(scores, counts, weights, stats)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(read_table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id")))
    return found.scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(found.stats[0].tokens).cast("long").alias("train_tokens"), "base_score", "score")
