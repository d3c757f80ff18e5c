"""Embedding near-duplicates: int8 tile products with rigorous error bounds.

A vector v of length |v| is stored as its unit vector u = v / |v|, as int8
values q and a scale s with u = s q + r. The length e of r is computed for
each vector. For two vectors,

    |u1.u2 - s1 s2 (q1.q2)| <= e1 + e2 + e1 e2,

since u1.u2 - s1 s2 (q1.q2) = u1.r2 + u2.r1 - r1.r2 and |u1| = |u2| = 1. Integer products of a tile pair are exact, and a pair
whose scaled product lies below the threshold by more than that bound is
certainly no link. All other pairs, and only they, are computed again in
double precision from the vectors as given.

Equal vectors are one class. Distinct vectors of a length are dealt into tiles
of about TILE by a hash, and tiles into strips, of up to STRIP_BYTES or fewer
if there would be too few pairs of strips for all cores. Each pair of strips is
one group, in which every tile of one meets every tile of the other, so each
vector is shipped once for a strip and not once for a tile. A group never emits
its links: it returns, for each vector with
links there, how many copies it links to, and edges that span the linked
vectors, so that output stays linear in the vectors of the strips even if all
of them link. Vectors of all lengths go in one job.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, connected_components, read_table, ship_code

THRESHOLD = 0.95
TILE = 2048
#: Packed bytes of the tiles of one strip, about; two strips are held at once.
STRIP_BYTES = 32 << 20
#: Pairs of strips for each core, where there are tiles enough.
PAIRS_A_CORE = 3
_ROWS = 512
#: Above any rounding of the float64 bounds, norms and products used here.
_SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales and lengths of the remainders of unit rows."""
    scale = np.abs(unit).max(axis=1) / 127
    values = np.rint(unit / scale[:, None])
    return values.astype(np.int8), scale, np.sqrt(((unit - values * scale[:, None]) ** 2).sum(axis=1)) + _SLACK


class Tile:
    """Vectors of one tile: ids of classes, numbers of copies, values."""

    def __init__(self, ids: bytes, copies: bytes, values: bytes, int8: bytes, scales: bytes, errors: bytes):
        self.ids, self.copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
        n = len(self.ids)
        self.q = np.frombuffer(int8, np.int8).reshape(n, -1)
        kind = np.float32 if len(values) == 4 * self.q.size else np.float64
        self.given = np.frombuffer(values, kind).reshape(n, -1)
        self.scale, self.error = np.frombuffer(scales), np.frombuffer(errors)

    @staticmethod
    def pack(ids: np.ndarray, copies: np.ndarray, given: np.ndarray) -> dict:
        unit = given / np.abs(given).max(axis=1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        q, scale, error = quantise(unit)
        with np.errstate(over="ignore"):
            single = given.astype(np.float32)
        given = single if (single == given).all() else given  # as exact, and half as large
        return {"ids": ids.astype(np.int64).tobytes(), "copies": copies.astype(np.int64).tobytes(), "given": given.tobytes(), "int8": q.tobytes(), "scales": scale.tobytes(), "errors": error.tobytes()}


_TILE_COLUMNS = "ids binary, copies binary, given binary, int8 binary, scales binary, errors binary"


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def tile_links(a: Tile, b: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in a and b of all pairs at the threshold or above it."""
    left, right = [], []
    top_error, top_scale = b.error.max(), b.scale.max()
    columns = b.q.astype(np.float32).T  # products of int8 in float32 are exact up to 1040 dimensions
    exact = b.q.shape[1] <= 1040
    for at in range(0, len(a.ids), _ROWS):
        rows = slice(at, at + _ROWS)
        dots = a.q[rows].astype(np.float32) @ columns if exact else a.q[rows].astype(np.float64) @ b.q.T.astype(np.float64)
        error = a.error[rows]
        floor = (threshold - error - top_error - error * top_error - _SLACK) / (a.scale[rows] * top_scale)
        floor = np.where(threshold - error - top_error - error * top_error > 0, floor, -np.inf)
        i, j = np.nonzero(dots >= (np.floor(floor) if exact else floor - 1)[:, None])
        if not len(i):
            continue
        e1, e2 = error[i], b.error[j]
        near = dots[i, j].astype(np.float64) * a.scale[rows][i] * b.scale[j] >= threshold - e1 - e2 - e1 * e2 - _SLACK
        left.append(i[near] + at)
        right.append(j[near])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    keep = [cosines(a.given[i[k : k + 65536]], b.given[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)]
    keep = np.concatenate(keep) if keep else np.empty(0, bool)
    return i[keep], j[keep]


def _spanning(parent: dict[int, int], x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the given ones and those already in parent."""

    def find(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    kept = []
    for u, v in zip(x.tolist(), y.tolist(), strict=True):
        a, b = find(u), find(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((u, v))
    return kept


def _meet(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """All tiles of one strip with all of another, or of the same."""
    rows = sorted(pdf.to_dict("records"), key=lambda r: r["tile"])
    tiles = [Tile(*(r[c] for c in ("ids", "copies", "given", "int8", "scales", "errors"))) for r in rows]
    low, high = rows[0]["low"], rows[0]["high"]
    linked, parent, edges = [np.zeros(len(t.ids), np.int64) for t in tiles], {}, []
    for x, a in enumerate(tiles):
        for y, b in enumerate(tiles):
            if rows[x]["strip"] != low or rows[y]["strip"] != high or low == high and y < x:
                continue
            i, j = tile_links(a, b, threshold)
            if x == y:
                i, j = i[i < j], j[i < j]
            linked[x] += np.bincount(i, b.copies[j], len(a.ids)).astype(np.int64)
            linked[y] += np.bincount(j, a.copies[i], len(b.ids)).astype(np.int64)
            edges += _spanning(parent, a.ids[i], b.ids[j])
    found = [pd.DataFrame({"id": t.ids[n > 0], "n": n[n > 0]}) for t, n in zip(tiles, linked, strict=True)]
    found.append(pd.DataFrame({"id": [x for x, _ in edges], "n": 0, "other": pd.array([y for _, y in edges], "Int64")}))
    return pd.concat(found).reindex(columns=["id", "n", "other"]).astype({"id": "int64", "n": "int64", "other": "Int64"})


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    values = np.array(pdf["embedding"].tolist(), np.float64)
    first = {c: int(pdf[c].iloc[0]) for c in ("dim", "tile", "strip", "strips")}
    return pd.DataFrame([first | Tile.pack(pdf["class"].to_numpy(), pdf["copies"].to_numpy(), values)])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    vectors has vec_id and embedding, an array of numbers. n_links counts the
    other rows at a cosine of threshold or above, copies of the row included.
    Vectors of different lengths have no cosine and never link. A vector that
    is null, empty, zero or holds null or non-finite values links with nothing
    and is its own component. A row with a null vec_id counts as a partner but
    is never a component's id while another has one. threshold is over 0.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold is over 0 and at most 1")
    spark = vectors.sparkSession
    ship_code(spark)
    ws = Workspace(spark, "embeddings")
    given = F.col("embedding").cast("array<double>")
    usable = F.expr("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    rows = vectors.select(F.col("vec_id").cast("long"), given.alias("embedding")).withColumn("embedding", F.when(usable, F.expr("transform(embedding, x -> x + 0D)")))
    classes = rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # A class is named by a hash of its values only for dealing; its id is a number of its own.
    classes = ws.write(classes.withColumn("class", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "classes")
    in_class = rows.join(classes.select("embedding", "class", "rep"), "embedding", "left").select("vec_id", "class")
    in_class = ws.write(in_class, "membership")
    # For each length of vectors: tiles, and strips of them.
    cores, shuffles = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = F.ceil(F.col("n") / tile)
    by_bytes = F.ceil(tiles / F.greatest(F.lit(1), F.floor(F.lit(STRIP_BYTES) / (tile * (5 * F.col("dim") + 32)))))
    strips = F.greatest(by_bytes, F.least(tiles, F.lit(math.ceil(math.sqrt(2 * PAIRS_A_CORE * cores)))))
    sizes = ws.write(classes.groupBy("dim").agg(F.count("*").alias("n")).select("dim", tiles.cast("int").alias("tiles"), strips.cast("int").alias("strips")), "sizes")
    dealt = classes.join(sizes, "dim").withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")).withColumn("strip", F.col("tile") % F.col("strips"))
    packed = ws.write(dealt.select("dim", "tile", "strip", "strips", "class", "copies", "embedding").groupBy("dim", "tile").applyInPandas(_pack, f"dim int, tile int, strip int, strips int, {_TILE_COLUMNS}"), "tiles")
    met = packed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("strips") - 1))).withColumns({"low": F.least("strip", "with"), "high": F.greatest("strip", "with")})
    met = met.drop("with", "strips").repartition(max(4 * cores, shuffles), "dim", "low", "high")
    found = ws.write(met.groupBy("dim", "low", "high").applyInPandas(lambda pdf: _meet(pdf, threshold), "id long, n long, other long"), "found")
    counts = found.groupBy("id").agg(F.sum("n").alias("linked"))
    comps = connected_components(ws, found.where("other is not null").select("id", "other"))
    full = classes.select("class", "rep", "copies").join(counts, F.col("class") == F.col("id"), "left").drop("id")
    full = full.join(comps, F.col("class") == F.col("node"), "left").withColumn("component", F.coalesce("component", "class"))
    full = ws.write(full.select("class", "rep", "component", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes-linked")
    least = full.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = full.join(least, "component").select("class", "n_links", "component_id")
    out = in_class.join(named, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
