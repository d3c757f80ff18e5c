"""SimHash near-duplicate detection with multi-index hashing.

Fingerprints of 64 bits over 3-word shingles link at RADIUS or fewer differing
bits. The two 32-bit segments of a fingerprint are indexed. A pair within two
bits differs by at most one bit in the high segment, or by two there and by
none in the low one; so each fingerprint probes the high table with the ball
of radius 1 round its own segment (33 values) and the low table with its exact
segment. Fetched candidates are verified on all 64 bits.

A segment value held by more than BUCKET distinct fingerprints would yield a
quadratic number of candidates. Fingerprints that probe such a bucket are
handled exactly in another way: two fingerprints are within two bits if and
only if their complete balls of radius 1 (65 values) meet, and at most 65
fingerprints can share one value, so chaining along shared values gives the
same components from a linear number of rows.

Copies are collapsed first: everything after the fingerprints works on
distinct values with their smallest doc_id.

RADIUS and SHINGLE are those of op2. Two bits find little but exact copies, and
no index of 64-bit fingerprints covers the ten or so bits by which texts differ
that share four fifths of their shingles. Where a similarity is asked for, as
by the pipeline, distinct sets of shingles take the place of fingerprints:
candidates are sets that agree in all of ROWS minima of one of BANDS groups
(MinHash), and they link if their exact Jaccard similarity is high enough. A
pair of similarity 0.8 is a candidate with probability 1 - (1 - 0.8^5)^20 =
0.9996. Each set of a group is compared with one of the group's; all pairs of a
group that are not in one component after that are compared, however large the
group is: it is cut into blocks of about BLOCK sets, each pair of which is one
row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Workspace, connected_components, read_table, ship_code

RADIUS = 2
SHINGLE = 3
#: Distinct fingerprints of one segment value up to which candidates are paired.
BUCKET = 64
#: Sets of a group that are compared in one row.
BLOCK = 512
BANDS, ROWS = 20, 5
PARITIES = 2048
_CHUNK = 1 << 16
_FACTORS, _MASKS = (np.random.default_rng(k).integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for k in (1, 2))
_FACTORS |= np.uint64(1)


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text; 0 for null or no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= SHINGLE:
        return xxh64_intdigest(b" ".join(words), 42)
    total, ones = n - SHINGLE + 1, np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        part = words[at : at + _CHUNK + SHINGLE - 1]
        hashes = np.fromiter((xxh64_intdigest(b" ".join(s), 42) for s in zip(*(part[i:] for i in range(SHINGLE)), strict=False)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > total, bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column("text")
        prints = np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(prints)], ["doc_id", "th", "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp): th is xxhash64 of the text, fp the fingerprint as a
    signed 64-bit integer."""
    ship_code(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(_fingerprints, "doc_id long, th long, fp long")


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of one text's shingles of so many words, or
    of all its words if it has fewer; none for null or no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(size)), strict=False)), np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """A hash of each group of minima of a set of shingles; none of no set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), 1 << 12):
        np.minimum(least, ((found[at : at + (1 << 12)] ^ _MASKS) * _FACTORS).min(axis=1), out=least)
    data = least.tobytes()
    return np.fromiter((xxh64_intdigest(data[i : i + 8 * ROWS]) for i in range(0, len(data), 8 * ROWS)), np.uint64, BANDS).view(np.int64)


def _identity(found: np.ndarray) -> int:
    """A signed hash of a set of shingles; 0 for the empty one."""
    fp = xxh64_intdigest(found.tobytes()) if len(found) else 0
    return fp - (1 << 64) * (fp >> 63)


def _set_rows(size: int):
    def rows(batches):
        for batch in batches:
            out = []
            for doc, th, text in zip(*(batch.column(c) for c in ("doc_id", "th", "text")), strict=True):
                found = shingles(text.as_py(), size)
                out.append((doc.as_py(), th.as_py(), _identity(found), len(found), bands(found)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "th", "fp", "n", "bands"])

    return rows


def parities(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls into each of PARITIES slots, as
    bits. Two sets differ in at least as many shingles as bits."""
    odd = np.bincount((found % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _packed(size: int):
    def rows(batches):
        for batch in batches:
            found = [shingles(x.as_py(), size) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([parities(x) for x in found], pa.list_(pa.int64()))], ["fp", "shingles", "parity"])

    return rows


def _members(blocks: pa.Array, at: int) -> list[np.ndarray]:
    """fp, n, component and parities of one block."""
    fp, n, component, parity = blocks[at].values.flatten()
    return [fp.to_numpy(), n.to_numpy(), component.to_numpy(), parity.flatten().to_numpy().view(np.uint64).reshape(len(fp), -1)]


def _close(similarity: float, forest: bool):
    """Of each pair of blocks a and b (or of one, if b is null) the pairs of
    sets of different components that are not certain to differ in too many
    shingles: sets of n and m shingles that differ in d have a similarity of
    (n + m - d) / (n + m + d). With forest, only pairs that join what the pairs
    before them do not."""

    def rows(batches):
        for batch in batches:
            out = []
            for at in range(batch.num_rows):
                fp, n, label, parity = a = _members(batch.column("a"), at)
                own = not batch.column("b")[at].is_valid
                fp2, n2, label2, parity2 = a if own else _members(batch.column("b"), at)
                label = label.copy()
                label2 = label if own else label2.copy()
                for i in range(len(fp)):
                    other = (label2 != label[i]) & (np.minimum(n2, n[i]) >= similarity * np.maximum(n2, n[i]) - 1e-6)
                    other[: i + 1 if own else 0] = False
                    k = np.flatnonzero(other)
                    differ = np.bitwise_count(parity2[k] ^ parity[i]).sum(axis=1, dtype=np.int64)
                    keep = differ * (1 + similarity) <= (n2[k] + n[i]) * (1 - similarity) + 1e-6
                    k = k[keep][np.argsort(differ[keep], kind="stable")]
                    while len(k):
                        some = k[:1] if forest else k
                        out += [(fp[i], n[i], fp2[j], n2[j]) for j in some]
                        if not forest:
                            break
                        old = label2[k[0]]
                        label[label == old] = label[i]
                        label2[label2 == old] = label[i]
                        k = k[label2[k] != label[i]]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["x", "nx", "y", "ny"])

    return rows


def _alike(similarity: float):
    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, keep = batch.slice(at, 256), []
                for x, y in zip(part.column("x"), part.column("y"), strict=True):
                    a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(both / (len(a) + len(b) - both) >= similarity)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows


def similar(ws: Workspace, docs: DataFrame, sets: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges (a, b) whose components are those of the graph that joins
    candidates among distinct sets of shingles (rows of sets: fp, a text's hash
    th, size n, bands) of so high a Jaccard similarity.

    The sets of a group are first compared with one of them, which for very
    many near copies of one text settles nearly all. Then all pairs of a group
    that are not in one component yet are compared by a bound on how far the
    sets differ, and by their shingles if it leaves them open: at first only
    pairs that could join components, then all that those left apart. Sets of
    one component have blocks of their own if they fill one, which are not
    compared with one another; all others of a group share blocks. So a group
    of near copies makes rows in proportion to its size, and no pair of a
    group is left out.
    """
    keys = sets.select("fp", "n", F.posexplode("bands").alias("band", "val"))
    groups = keys.groupBy("band", "val").agg(F.min("fp").alias("rep"), F.min_by("n", "fp").alias("rep_n"), F.count("*").alias("size"))
    groups = ws.write(groups.where("size > 1").drop("size"), "groups")
    members = ws.write(keys.join(groups, ["band", "val"]), "members")
    nodes = members.select("fp").distinct()
    wanted = sets.join(nodes, "fp", "left_semi").select("fp", "th")
    text = docs.select(F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    texts = text.join(wanted, "th").select("fp", "text").mapInArrow(_packed(shingle), "fp long, shingles binary, parity array<long>")
    packed = ws.write(texts.dropDuplicates(["fp"]), "shingles")

    def alike(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (x, nx, y, ny) that are similar enough."""
        some = pairs.where(F.least("nx", "ny") / F.greatest("nx", "ny") >= similarity)  # or they can't be
        some = ws.write(some.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name)
        both = some.join(packed.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a").join(packed.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
        return both.mapInArrow(_alike(similarity), "a long, b long")

    first = alike(members.where("fp <> rep").select(F.col("fp").alias("x"), F.col("n").alias("nx"), F.col("rep").alias("y"), F.col("rep_n").alias("ny")), "first")
    joined = ws.write(connected_components(ws, first), "joined")
    group = ["band", "val"]

    def across(joined: DataFrame, forest: bool) -> DataFrame:
        """Pairs that are similar enough, of sets of a group that are not joined."""
        placed = members.drop("rep", "rep_n").join(joined, members.fp == joined.node, "left").drop("node").withColumn("component", F.coalesce("component", "fp"))
        placed = ws.write(placed, "placed")
        counts = placed.groupBy(*group, "component").agg(F.count("*").alias("of"))
        mixed = ws.write(counts.groupBy(*group).agg(F.count("*").alias("k"), F.sum(F.when(F.col("of") <= BLOCK, F.col("of")).otherwise(0)).alias("rest")).where("k > 1").drop("k"), "mixed")
        large = ws.write(counts.where(F.col("of") > BLOCK).join(mixed.select(*group), group, "left_semi"), "large")
        apart = placed.join(mixed, group).join(large, [*group, "component"], "left")
        parts = F.ceil(F.coalesce("of", "rest") / F.lit(BLOCK))
        block = F.struct(F.col("of").isNotNull().alias("large"), F.when(F.col("of").isNotNull(), F.col("component")).otherwise(0).alias("whole"), F.pmod(F.xxhash64("fp"), parts).alias("part"))
        apart = apart.select(*group, "fp", "n", "component", block.alias("block")).join(packed.select("fp", "parity"), "fp")
        blocks = ws.write(apart.groupBy(*group, "block").agg(F.collect_list(F.struct("fp", "n", "component", "parity")).alias("sets")), "blocks")
        i, j = F.col("i"), F.col("j")
        names = blocks.select(*group, "block")
        two = names.withColumnRenamed("block", "i").join(names.withColumnRenamed("block", "j"), group).where(i <= j).where(~(i["large"] & j["large"] & (i["whole"] == j["whole"])))
        two = two.join(blocks.select(*group, F.col("block").alias("i"), F.col("sets").alias("a")), [*group, "i"])
        two = two.join(blocks.select(*group, F.col("block").alias("j"), F.col("sets").alias("b")), [*group, "j"])
        return alike(two.select("a", F.when(i != j, F.col("b")).alias("b")).mapInArrow(_close(similarity, forest), "x long, nx long, y long, ny long"), "second")

    def edges(joined: DataFrame) -> DataFrame:
        return joined.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))

    more = ws.write(across(joined, True).unionByName(edges(joined)), "more")
    joined = ws.write(connected_components(ws, more), "joined")
    return across(joined, False).unionByName(edges(joined))


def _high(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _low(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _ball(value: Column, bits: int) -> Column:
    """The value and all that differ from it in one of so many low bits."""
    return F.array(value, *(value.bitwiseXOR(F.lit((1 << i) - (1 << 64) * (i == 63))) for i in range(bits)))


def links(ws: Workspace, prints: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of the graph that joins
    distinct fingerprints (column fp) at RADIUS or fewer differing bits."""
    fp = F.col("fp")
    table = prints.select(F.explode(F.array(F.struct(F.lit(0).alias("seg"), _high(fp).alias("val")), F.struct(F.lit(1).alias("seg"), _low(fp).alias("val")))).alias("k"), "fp").select("k.seg", "k.val", "fp")
    probes = prints.select(F.lit(0).alias("seg"), F.explode(_ball(_high(fp), 32)).alias("val"), "fp").unionByName(prints.select(F.lit(1).alias("seg"), _low(fp).alias("val"), "fp"))
    crowded = ws.write(table.groupBy("seg", "val").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("seg", "val"), "crowded")
    pairs = (
        probes.withColumnRenamed("fp", "a")
        .join(table.join(crowded, ["seg", "val"], "left_anti").withColumnRenamed("fp", "b"), ["seg", "val"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
        .select("a", "b")
    )
    dense = probes.join(crowded, ["seg", "val"], "left_semi").select("fp").distinct()
    met = dense.select(F.explode(_ball(fp, 64)).alias("key"), "fp").groupBy("key").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)
    chained = met.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b")
    return pairs.unionByName(chained)


def components(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """(doc_id, th, fp, component, component_id) for every row of docs. With a
    similarity, texts link if the Jaccard similarity of their shingles is that
    high, and fp is a hash of the set of shingles."""
    ws = Workspace(docs.sparkSession, "simhash")
    if similarity is None:
        if shingle != SHINGLE:
            raise ValueError(f"fingerprints are over {SHINGLE} words")
        all_docs = ws.write(with_fingerprints(docs), "fingerprints")
        classes = ws.write(all_docs.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
        edges = links(ws, classes.select("fp"))
    else:
        ship_code(docs.sparkSession)
        text = F.col("text").cast("string")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
        all_docs = ws.write(rows.mapInArrow(_set_rows(shingle), "doc_id long, th long, fp long, n long, bands array<long>"), "sets")
        one = F.min_by(F.struct("th", "n", "bands"), "th").alias("one")
        classes = ws.write(all_docs.groupBy("fp").agg(F.min("doc_id").alias("rep"), one).select("fp", "rep", "one.*"), "classes")
        edges = similar(ws, docs, classes, shingle, similarity)
        all_docs = all_docs.select("doc_id", "th", "fp")
    comps = connected_components(ws, edges)
    placed = classes.join(comps, classes.fp == comps.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    placed = ws.write(placed, "placed")
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    return all_docs.join(placed.join(least, "component").select("fp", "component", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    fingerprint is 16 lowercase hex digits. component_id is the smallest
    doc_id reachable over links, itself included; rows with equal doc_id stay
    apart as rows. A null or wordless text has fingerprint zero and links like
    any other. Rows whose doc_id is null are kept, their component_id is the
    smallest doc_id of their component or null. An empty table gives none.
    """
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One row of docs for each component: that with the smallest doc_id (null
    last), of equals that whose text has the smallest hash."""
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    ws = Workspace(docs.sparkSession, "simhash-keep")
    found = components(docs, shingle, similarity).groupBy("component", key.alias("key")).agg(F.count("*").alias("n")).groupBy("component").agg(F.min_by(F.struct("key", "n"), "key").alias("kept"))
    keep = ws.write(found.select(F.col("kept.key.doc_id").alias("_doc"), F.col("kept.key.th").alias("_th"), F.col("kept.n").alias("n")), "kept")
    # The row as one struct, so that no column of docs can clash.
    rows = docs.select(F.struct("*").alias("row"))
    doc, th = F.col("row.doc_id").cast("long"), F.xxhash64(F.col("row.text").cast("string"))
    rows = rows.join(keep, doc.eqNullSafe(F.col("_doc")) & (th == F.col("_th")), "left_semi").select("row.*")
    if keep.where("n > 1").isEmpty():
        return rows
    return rows.dropDuplicates(["doc_id", "text"])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
