"""Benchmark decontamination by q-gram lemma filtering.

Finds benchmark passages inside documents within an edit budget. Both sides
are lower-cased and white space becomes single spaces. A passage of m
characters may have up to k edits, k = RATE m rounded down (fewer for passages
so short that the lemma would not filter). An occurrence with at most k edits
keeps at least m - q + 1 - k q of the passage's q-grams, on diagonals (place
in the document less place in the passage) at most k apart. Hits are counted
in overlapping diagonal bands of 2 (k + 1), of which one holds all diagonals
of any occurrence; bands that reach the bound are verified by an alignment
confined to the band. So no occurrence within budget is missed and none is
reported falsely.

The passages' q-gram index is broadcast in blocks of at most INDEX_CHARS
characters; a larger benchmark takes several passes over the documents.
Documents are read in place, without a shuffle, in pieces of bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, ship_code

Q = 8
RATE = 0.1
#: Characters of passages in one broadcast index, which takes about 20 bytes each.
INDEX_CHARS = 4_000_000
#: Characters of document text looked at together, and of one piece.
_GROUP, _GROUP_PIECES, _PIECE = 1 << 20, 1 << 15, 1 << 20
_TABLE_BITS = 22
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q characters from each place; Q is 8."""
    h, power = codes.astype(np.uint64), _BASE
    for width in (1, 2, 4):
        if len(h) <= width:
            return np.zeros(0, np.uint64)
        h = h[:-width] * power + h[width:]
        with np.errstate(over="ignore"):
            power = power * power
    return h * _SPREAD


def budget(m: int, rate: float = RATE) -> int:
    """Edits allowed in a passage of m characters: the lemma's bound stays
    above zero."""
    return max(0, min(int(rate * m), (m - Q) // Q)) if m >= Q else 0


class Index:
    """Passages and where their q-grams stand. Passages under Q characters
    are looked for as they are."""

    def __init__(self, passages: list[tuple[int, str]], rate: float):
        self.passages = [(i, t) for i, t in passages if len(t) >= Q]
        self.short = [(i, t) for i, t in passages if 0 < len(t) < Q]
        self.codes = [_codes(t) for _, t in self.passages]
        self.m = np.array([len(c) for c in self.codes], np.int64)
        self.k = np.array([budget(m, rate) for m in self.m.tolist()], np.int64)
        self.least = self.m - Q + 1 - self.k * Q
        grams = [_grams(c) for c in self.codes]
        every = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order].astype(np.int64)
        self.place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])[order].astype(np.int64)
        self.grams, self.at = np.unique(every[order], return_index=True)
        self.at = np.append(self.at, len(every)).astype(np.int64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self._slot(self.grams)] = True
        self.longest = int(self.m.max(initial=0))
        self.reach = int((self.m + 2 * (self.k + 1)).max(initial=0)) + Q

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def bands(self, codes: np.ndarray, piece: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(piece, passage, first diagonal) of each band that reaches the
        bound; a diagonal counts from self.longest before the codes."""
        grams = _grams(codes)
        if not len(grams) or not len(self.grams):
            return
        at = np.flatnonzero(self.table[self._slot(grams)])
        which = np.searchsorted(self.grams, grams[at])
        which[which == len(self.grams)] = 0
        good = self.grams[which] == grams[at]
        at, which = at[good], which[good]
        copies = self.at[which + 1] - self.at[which]
        entry = np.arange(copies.sum()) + np.repeat(self.at[which] - np.cumsum(copies) + copies, copies)
        at, item = np.repeat(at, copies), self.item[entry]
        diagonal = at - self.place[entry] + self.longest
        half = self.k[item] + 1
        # As many bits for a band as the codes and the longest passage need.
        bits = (len(codes) + self.longest + 2 * int(self.k.max(initial=0)) + 2).bit_length()
        if (int(piece.max(initial=0)) + 1) * len(self.m) >= 1 << (63 - bits):
            raise ValueError("too many passages and pieces for one key")
        key = (piece[at].astype(np.int64) * len(self.m) + item) << np.int64(bits)
        for shift in (0, 1):
            band = (diagonal + shift * half) // (2 * half)
            found, n = np.unique(key | band, return_counts=True)
            items = (found >> np.int64(bits)) % len(self.m)
            for f, i in zip(found[n >= self.least[items]].tolist(), items[n >= self.least[items]].tolist(), strict=True):
                half_i = int(self.k[i]) + 1
                yield (f >> bits) // len(self.m), i, (f & (1 << bits) - 1) * 2 * half_i - shift * half_i


def align(passage: np.ndarray, codes: np.ndarray, low: int, width: int, k: int) -> tuple[int, int] | None:
    """The fewest edits, at most k, that turn some stretch of codes into the
    passage along diagonals low to low + width - 1, and where it ends. The
    leftmost of the best ends is taken."""
    m, far = len(passage), k + 1
    column = np.arange(width)
    start = low + column
    inside = (start >= 0) & (start <= len(codes))
    cost = np.where(inside, 0, far)
    padded = np.full(width + m + 1, -1, np.int64)
    a, b = max(0, low), min(len(codes), low + width + m)
    if a < b:
        padded[a - low : b - low] = codes[a:b]
    for i in range(m):
        change = cost + (padded[i : i + width] != passage[i])
        # where no character of the document is left, only its absence fits
        change[padded[i : i + width] < 0] = far
        change[:-1] = np.minimum(change[:-1], cost[1:] + 1)
        cost = np.minimum(np.minimum.accumulate(change - column) + column, far)
        ends = start + i + 1
        cost[(ends < 0) | (ends > len(codes))] = far
        if cost.min() > k:
            return None
    best = int(cost.argmin())
    return int(cost[best]), low + best + m


def _locate(index: Index, i: int, text: str, codes: np.ndarray, low: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of passage i in one piece along a band from low."""
    passage, k, m = index.codes[i], int(index.k[i]), int(index.m[i])
    width = 2 * (k + 1)
    exact = text.find(index.passages[i][1], max(0, low), max(0, low) + width + m)
    if exact >= 0:
        return 0, exact, exact + m
    found = align(passage, codes, low, width, k)
    if found is None:
        return None
    edits, end = found
    # backwards from the end: the stretch ends there, and starts where the reverse ends
    back = align(passage[::-1], codes[max(0, end - m - k) : end][::-1], 0, k + 1, k)
    back = back if back is not None and back[0] == edits else align(passage[::-1], codes[max(0, end - m - k) : end][::-1], -k, 2 * k + 1, k)
    start = end - m if back is None else end - back[1]
    return edits, max(0, start), end


def _matches(index: Index, docs: list[str | None]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, passage id, passage length, edits, start, end), the best one
    of each document and passage."""
    step = max(_PIECE, 4 * index.reach)
    group: list[tuple[int, int, str]] = []
    best: dict[tuple[int, int | None, str], tuple] = {}

    def take(d: int, i, passage: str, m: int, found: tuple) -> None:
        key = d, i, passage if i is None else ""  # passages without an id are told apart by their text
        best[key] = min(best.get(key, ((1 << 60,),)), (found, m))

    def work() -> None:
        if not group:
            return
        codes = [_codes(t) for _, _, t in group]
        sizes = np.array([len(c) for c in codes])
        begins = np.cumsum(sizes) - sizes
        piece = np.repeat(np.arange(len(group), dtype=np.int32), sizes)
        for p, i, low in index.bands(np.concatenate(codes), piece):
            d, offset, text = group[p]
            found = _locate(index, i, text, codes[p], low - index.longest - int(begins[p]))
            if found:
                take(d, *index.passages[i], int(index.m[i]), (found[0], found[1] + offset, found[2] + offset))
        group.clear()

    held = 0
    for d, raw in enumerate(docs):
        text = normal(raw)
        for i, t in index.short:
            if (at := text.find(t)) >= 0:
                take(d, i, t, len(t), (0, at, at + len(t)))
        for offset in range(0, max(1, len(text) - index.reach), step):
            part = text[offset : offset + step + index.reach]
            if len(part) < Q - 1:
                continue
            group.append((d, offset, part))
            held += len(part)
            if held >= _GROUP or len(group) >= _GROUP_PIECES:
                work()
                held = 0
    work()
    for (d, i, _), (found, m) in sorted(best.items(), key=lambda x: x[0][0]):
        yield d, i, m, *found


def _blocks(benchmark: DataFrame, unnamed: bool) -> Iterator[list[tuple[int | None, str]]]:
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").where(F.lit(unnamed) | F.col("item_id").isNotNull()).dropDuplicates()
    block, held = [], 0
    for r in rows.toLocalIterator():
        text = normal(r["text"])
        if block and held + len(text) > INDEX_CHARS:
            yield block
            block, held = [], 0
        block.append((r["item_id"], text))
        held += len(text)
    yield sorted(block, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


_COLUMNS, _ROWS = ["doc_id", "item_id", "n_chars", "edits", "start", "end"], 2048


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, unnamed: bool = False) -> DataFrame:
    """One row for each document row and passage found in it.

    Columns: doc_id, item_id, n_chars (of the passage), edits, start and end
    in characters of the document's normal form (lower case, white space as
    single spaces): the best occurrence, leftmost of equals. Passages that are
    null or blank are never found; null texts count as empty. Passages of
    fewer than Q characters are found where they stand literally. Document
    rows with equal or null doc_id are searched apart. With unnamed, as in op3
    and the pipeline, passages without an item_id are looked for as well and
    give a null item_id, each a row of its own; else they are left out.
    """
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _blocks(benchmark, unnamed):
        shared = spark.sparkContext.broadcast(Index(block, rate))

        def search(batches, shared=shared):
            for whole in batches:
                for at in range(0, whole.num_rows, _ROWS):
                    batch = whole.slice(at, _ROWS)
                    ids = batch.column("doc_id").to_pylist()
                    found = list(_matches(shared.value, batch.column("text").to_pylist()))
                    columns = [[ids[d] for d, *_ in found], *([x[c] for x in found] for c in range(1, 6))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _COLUMNS)

        part = rows.mapInArrow(search, ", ".join(f"{c} long" for c in _COLUMNS))
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, unnamed: bool = False) -> DataFrame:
    """The rows of docs in which no passage is found, filtered in place."""
    spark, names = docs.sparkSession, docs.columns
    ship_code(spark)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    for block in _blocks(benchmark, unnamed):
        shared = spark.sparkContext.broadcast(Index(block, rate))

        def keep(batches, shared=shared):
            for whole in batches:
                for at in range(0, whole.num_rows, _ROWS):
                    batch = whole.slice(at, _ROWS)
                    found = {d for d, *_ in _matches(shared.value, batch.column("text").to_pylist())}
                    yield batch.filter(pa.array([i not in found for i in range(batch.num_rows)], pa.bool_())).select(["row"])

        rows = rows.withColumn("text", F.col("row.text").cast("string")).mapInArrow(keep, rows.schema)
    return rows.select("row.*")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), unnamed=True)
