"""Line deduplication by winnowing over line hashes.

A run of whole lines with at least MIN_WORDS words that stands earlier in the
corpus, in another text or before it in the same, is deleted; the earliest
stays. Earlier means a smaller doc_id (null last), then the smaller hash of
the text, then the earlier line. Lines are equal if they are after trimming. A
run never counts as a copy of one that it overlaps: of a line repeated all
over a text, the fewest lines with MIN_WORDS words stay.

For each line that has words, the window from it is the fewest lines with
MIN_WORDS words, and the grams in the window are the fewest lines from each of
its lines with GRAM_WORDS words. A window elects its least gram hash, the
rightmost of equals, as fingerprint. Any repeated run of MIN_WORDS words holds
whole windows, equal windows elect equal grams, so a fingerprint that occurs
at a single place belongs to no repeated run: joining fingerprint positions
leaves the places that can.

From each repeated fingerprint the match is extended to both sides: to the
windows that elected it, and from those line by line, to the windows that
begin and that end at each further line, blank ones included, compared by a
128-bit hash of all their lines. A run with so many words is covered by the
windows inside it (each line of it has the one from it, the one that ends at
it or, with too few words on both sides, the one from the run's first line),
so exactly the lines of repeated runs go. Compared is always with the earliest
place of the same window and not with a neighbour's place: extending only
against a fingerprint's earliest place would lose runs that a later place
shares. A passage in very many texts is never paired with itself: what is
grouped is two rows a line at most, with counts and minima before any
exchange, and both joins are by written tables, so that adaptive execution
splits a key of very many places.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from .common import Workspace, read_table, ship_code

MIN_WORDS = 50
GRAM_WORDS = 25


def windows(text: str, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> list[tuple[int, int, int, int, bytes]]:
    """(first line, line after the last, fingerprint, its line, hash of the
    whole window) of the windows from and up to each line of one text, and of
    both with blank lines before or after."""
    lines = text.split("\n")
    counts = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
    before = np.concatenate(([0], np.cumsum(counts)))
    if before[-1] < min_words:
        return []
    hashes = np.fromiter((xxh64_intdigest(x.strip().encode("utf-8", "surrogatepass")) for x in lines), np.uint64, len(lines))
    data = hashes.tobytes()
    at = np.arange(len(lines))
    # line after the shortest span from each line with so many words
    gram_end, end = (np.searchsorted(before, before[:-1] + n) for n in (gram_words, min_words))
    starts = at[(counts > 0) & (gram_end <= len(lines))]
    grams = {int(i): xxh64_intdigest(data[8 * i : 8 * gram_end[i]]) for i in starts}

    def window(i: int, stop: int) -> tuple[int, int, int, int, bytes]:
        elected, place = min((grams[j], -j) for j in range(i, stop) if j in grams and gram_end[j] <= stop)
        return i, stop, elected - (1 << 64) * (elected >> 63), -place, xxh3_128_digest(data[8 * i : 8 * stop])

    out = [window(i, int(end[i])) for i in at[(counts > 0) & (end <= len(lines))].tolist()]
    known = {w[:2]: w for w in out}
    # first line of the shortest span up to each line with so many words
    start = np.searchsorted(before, before[1:] - min_words, side="right") - 1
    ends = [(int(start[j]), j + 1) for j in at[(counts > 0) & (before[1:] >= min_words)].tolist()]
    ending = [known.get(span) or window(*span) for span in ends]
    blank = np.flatnonzero(counts == 0).tolist()
    firsts, stops = {w[0]: w for w in out}, {w[1]: w for w in ending}
    out += [w for w in ending if w[:2] not in known]
    # A blank line takes the window next to it, known by their distance.
    follows = np.searchsorted(before, before[:-1], side="right") - 1  # the next line with words
    precedes = np.searchsorted(before, before[:-1])  # the line after the last one with words
    for i in blank:
        if w := firsts.get(int(follows[i])):
            out.append((i, *w[1:4], xxh3_128_digest(b"<%d " % (w[0] - i) + w[4])))
        if w := stops.get(int(precedes[i])):
            out.append((w[0], i + 1, *w[2:4], xxh3_128_digest(b">%d " % (i + 1 - w[1]) + w[4])))
    return out


_WINDOWS = "doc_id long, th long, first int, stop int, fp long, place int, key binary"
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]


def _windows(min_words: int, gram_words: int):
    def rows(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, th, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text")), strict=True):
                out.extend((doc, th, *w) for w in windows(text, min_words, gram_words))
            columns = list(zip(*out, strict=True)) or [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], ["doc_id", "th", "first", "stop", "fp", "place", "key"])

    return rows


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, spans) of the texts with lines to delete; th is xxhash64
    of the text, spans an array of (first line, line after the last)."""
    spark = docs.sparkSession
    ship_code(spark)
    ws = Workspace(spark, "linededup")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).where("text is not null")
    found = ws.write(rows.mapInArrow(_windows(min_words, min(GRAM_WORDS, min_words)), _WINDOWS), "windows")
    # A fingerprint is repeated if its places differ; rows that are equal in
    # doc_id and text are one document.
    place = found.select("fp", F.xxhash64("doc_id", "th", "place").alias("at"))
    places = ws.write(place.groupBy("fp").agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a <> b").select("fp"), "places")
    matched = found.join(places, "fp", "left_semi").select("key", F.col("doc_id").isNull().alias("last"), "doc_id", "th", "first", "stop")
    matched = ws.write(matched.distinct(), "matched")
    order = F.struct("last", "doc_id", "th", "first")
    earliest = matched.groupBy("key").agg(F.min(order).alias("earliest"), F.count("*").alias("n")).where("n > 1")
    earliest = ws.write(earliest.select("key", "earliest"), "earliest")
    later = matched.join(earliest, "key").where(order != F.col("earliest"))
    # In the same text, only what begins after the earliest place's end.
    same = F.col("doc_id").eqNullSafe(F.col("earliest.doc_id")) & (F.col("th") == F.col("earliest.th"))
    later = later.where(~same | (F.col("first") >= F.col("earliest.first") + F.col("stop") - F.col("first")))
    spans = later.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "stop")).alias("spans"))  # no more than twice the text's lines
    spans = ws.write(spans, "spans")
    for table in (found, places, matched, earliest):
        ws.drop(table)
    return spans


def _deleted(n: int, spans) -> np.ndarray:
    """Which of n lines the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        edge[s["first"]] += 1
        edge[s["stop"]] -= 1
    return np.cumsum(edge)[:n] > 0


_NEW = "text string, n_lines long, n_deleted long, deleted array<struct<first: long, stop: long>>"


def _rewrite(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for t, s in zip(text, spans, strict=True):
        lines = [] if t is None else t.split("\n")
        if s is None or not len(s):
            out.append((t, len(lines), 0, []))
            continue
        gone = _deleted(len(lines), s)
        turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
        runs = [{"first": int(a), "stop": int(b)} for a, b in turn.reshape(-1, 2)]
        out.append(("\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), int(gone.sum()), runs))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_deleted", "deleted"])


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of docs as (row, text, n_lines, n_deleted, deleted): row is a
    struct of the columns as given, text the text without later repeated
    runs, deleted the runs of lines that went.

    A text of which every line went is empty; a null text stays null, has no
    lines and takes no part. Rows equal in doc_id and text are treated alike.
    """
    text = F.col("row.text").cast("string")
    keyed = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").cast("long").alias("_doc"), F.xxhash64(text).alias("_th"))
    spans = repeated(docs, min_words).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "spans")
    # A merge join at every size: many spans would not fit a broadcast.
    both = keyed.join(spans.hint("merge"), F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left")
    return both.select("row", F.pandas_udf(_rewrite, _NEW)(text, F.col("spans")).alias("new")).select("row", "new.*")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents")).select("row.doc_id", "text", "n_lines", "n_deleted", "deleted")
