"""Language identification by hierarchical discrimination.

A text becomes a vector of hashed character n-grams (1 to 3 characters of the
lower-cased letters, other characters act as one space), square-rooted counts
of unit length. A linear support vector machine a family (one against the
rest) picks the language family; within it, one-versus-one machines of each
pair of languages vote, and margins settle ties. All machines are trained on
the driver on a sample of labelled rows: of the MOST_LANGS languages with most
rows, at most PER_LANG rows each and MOST_ROWS together. Vectors are kept
sparse, so what the driver holds is bounded by these, and so is the size of
the machines, which are broadcast.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import read_table, ship_code

#: Labelled rows of one language that are learned from, at most.
PER_LANG = 400
#: Labelled rows of all languages, but for LEAST_ROWS of each.
MOST_ROWS, LEAST_ROWS = 16_000, 40
#: Languages that are learned: those with most labelled rows.
MOST_LANGS = 200
BITS = 13
UNDETERMINED = "und"

#: Members of language families by ISO 639-1 code. A language
#: that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "malayic": "id jv ms su tl",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

_LETTERS: np.ndarray | None = None
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_PIECE = 1 << 20


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"={lang}")


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[codes], codes, np.uint32(32))


def features(text: str | None) -> np.ndarray | None:
    """The unit vector of a whole text; None if it is null or has no letter.
    A long text is counted in pieces that give what the whole would."""
    counts, seen = np.zeros(1 << BITS), False
    text = (text or "").lower()
    for at in range(0, len(text), _PIECE):
        # Two characters of the piece before; n-grams that end in them are counted.
        old = min(at, 2)
        codes = _codes(text[at - old : at + _PIECE])
        ends = [np.uint32([32])] * (at + _PIECE >= len(text))
        codes = np.concatenate([np.uint32([32])] * (at == 0) + [codes, *ends]).astype(np.uint64)
        letter = codes != 32
        seen |= bool(letter.any())
        mixed = [codes * m for m in _MIX]
        grams = (mixed[0], mixed[0][:-1] ^ (mixed[1][1:] << np.uint64(1)), mixed[0][:-2] ^ (mixed[1][1:-1] << np.uint64(1)) ^ (mixed[2][2:] << np.uint64(2)))
        some = (letter, letter[:-1] | letter[1:], letter[:-2] | letter[1:-1] | letter[2:])
        for n, (g, keep) in enumerate(zip(grams, some, strict=True)):
            new = max(0, old - n)
            g = g[new:][keep[new:]] + np.uint64(n)
            g = (g ^ (g >> np.uint64(29))) * _MIX[1]
            counts += np.bincount((g >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    if not seen:
        return None
    v = np.sqrt(counts)
    return v / np.sqrt(counts.sum())


Rows = list[tuple[np.ndarray, np.ndarray]]


def train_svm(x: Rows, y: np.ndarray, cost: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights, the last of them a bias, of a linear support vector machine
    with hinge loss for y in {-1, 1}, by dual coordinate descent over sparse
    rows (places, amounts)."""
    square = np.array([1.0 + float(v @ v) for _, v in x])
    alpha, w, bias = np.zeros(len(x)), np.zeros(1 << BITS), 0.0
    # A rare side counts as much as a frequent one.
    limit = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            at, v = x[i]
            step = min(max(alpha[i] - (y[i] * (w[at] @ v + bias) - 1) / square[i], 0.0), limit[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[at] += step * y[i] * v
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return np.append(w, bias)


class Model:
    """Families against the rest, then pairs of languages of each family."""

    def __init__(self, x: Rows, langs: list[str]):
        self.langs = sorted(set(langs))
        of = np.array([self.langs.index(v) for v in langs], np.int64)
        self.families = sorted({family(v) for v in self.langs})
        self.family_of = np.array([self.families.index(family(v)) for v in self.langs], np.int64)
        fam, rows = self.family_of[of] if len(of) else of, []
        if len(self.families) > 1:
            rows += [train_svm(x, np.where(fam == f, 1.0, -1.0)) for f in range(len(self.families))]
        self.pairs = [(a, b) for a, b in combinations(range(len(self.langs)), 2) if self.family_of[a] == self.family_of[b]]
        for a, b in self.pairs:
            on = (of == a) | (of == b)
            rows.append(train_svm([x[i] for i in np.flatnonzero(on)], np.where(of[on] == a, 1.0, -1.0)))
        self.weights = np.array(rows, np.float64).reshape(len(rows), (1 << BITS) + 1)

    def predict(self, v: np.ndarray | None) -> tuple[str, float]:
        if v is None or not self.langs:
            return UNDETERMINED, 0.0
        margins = self.weights[:, :-1] @ v + self.weights[:, -1]
        score, pick = 1.0, 0
        if len(self.families) > 1:
            top = margins[: len(self.families)]
            pick, score = int(top.argmax()), _logistic(top.max())
        members = [k for k in range(len(self.langs)) if self.family_of[k] == pick]
        votes = {k: [0, 0.0] for k in members}
        sure: dict[int, list[float]] = {k: [] for k in members}
        for (a, b), m in zip(self.pairs, margins[len(margins) - len(self.pairs) :], strict=True):
            if a in votes:
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
                sure[a].append(_logistic(m))
                sure[b].append(_logistic(-m))
        best = max(members, key=lambda k: (votes[k][0], votes[k][1], -k))
        return self.langs[best], float(score * (np.mean(sure[best]) if sure[best] else 1.0))


def _logistic(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(2 * margin, -50, 50))))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _vectors(batches):
    for batch in batches:
        found = [features(x.as_py()) for x in batch.column("text")]
        keep = [i for i, v in enumerate(found) if v is not None]
        at = [np.flatnonzero(found[i]) for i in keep]
        columns = [pa.array([batch.column("lang")[i].as_py() for i in keep], pa.string()), batch.column("draw").take(pa.array(keep, pa.int64())), pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()), pa.array([found[i][a].astype(np.float32).tobytes() for i, a in zip(keep, at, strict=True)], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "draw", "places", "amounts"])


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """A model from rows with doc_id, text and lang; rows without lang are
    left out. Of a language with many rows, those whose hashed doc_id and text
    are least are learned from, at most per_lang of them, however many rows
    share an id."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    if not sizes:
        return Model([], [])
    most = min(per_lang, max(LEAST_ROWS, MOST_ROWS // len(sizes)))
    # Twice as many as wanted by a threshold, and of these the first ones.
    share = F.create_map(*(F.lit(v) for r in sizes for v in (r.lang, min(1.0, 2 * most / r.n))))
    drawn = rows.withColumn("draw", F.xxhash64(F.lit(11), "doc_id", "text"))
    drawn = drawn.where(F.shiftrightunsigned("draw", 34) < F.try_element_at(share, "lang") * (1 << 30)).select("lang", "draw", "text")
    sample = drawn.mapInArrow(_vectors, "lang string, draw long, places binary, amounts binary")
    order = Window.partitionBy("lang").orderBy("draw", "places", "amounts")
    chosen = sample.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    got = sorted((r.lang, r.draw, bytes(r.places), bytes(r.amounts)) for r in chosen.toLocalIterator())
    return Model([(np.frombuffer(p, np.uint16), np.frombuffer(v, np.float32).astype(np.float64)) for _, _, p, v in got], [lang for lang, *_ in got])


def predict(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """(row, lang_pred, score, has_letters) for every row of docs; row is a
    struct of the columns as given, without text unless keep_text is set.

    lang_pred is a learned language, or `und` with score 0 if the text is null
    or has no letter, or if nothing was learned. Only the text is looked at.
    """
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        m = shared.value
        for batch in batches:
            vectors = (features(x.as_py()) for x in batch.column("text"))
            found = [(*m.predict(v), v is not None) for v in vectors]
            lang, score, letters = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(letters, pa.bool_())], ["row", "lang_pred", "score", "has_letters"])

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if keep_text or c != "text")).alias("row")
    given = docs.select(row, F.col("text").cast("string").alias("text"))
    return given.mapInArrow(rows, StructType([given.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("has_letters", BooleanType())]))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs, learned
    from the rows that are not held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("row.doc_id", "lang_pred", "score").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
