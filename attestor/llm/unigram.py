"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton enumerates, for each end position, all vocabulary
pieces that end there. Dynamic programming carries the best score of each
prefix and the number of tokens of that best segmentation, no back pointers.
Tie rules are those of the tokenizer libraries' unigram models: for one end
position candidates come in the order of their starts, and a later one
replaces the best so far only with a strictly greater score. A character that
is no piece of its own may be taken as unknown, at the least score of the
vocabulary less 10; it counts its UTF-8 bytes if the vocabulary has all byte
pieces, and a run of unknown characters counts one token otherwise. Scores are
added in double precision.

Text is normalised as the vocabulary file asks. Read from it are the settings
that this module knows (one space in front, spaces to U+2581, extra white
space kept or not); a file with a table of character mappings is refused, as
counts would be wrong without it. Where no piece of the vocabulary holds U+2581 after
another character, the best segmentation falls apart before each run of
U+2581, and each part is solved once and kept; otherwise a text is solved
whole.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, ship_code

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Parts kept with their counts by one worker; the cache starts anew beyond it.
CACHE = 500_000
_BLOCK = 1 << 16
#: What follows a space: more spaces and then anything else.
_PARTS = re.compile(f"{SPACE}({SPACE}*[^{SPACE}]*)")


class Unigram(dict):
    """Counts of texts; as a dict, the row of each part solved before."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool, squeeze: bool = False):
        """squeeze: spaces at the ends go, and of several together all but one."""
        super().__init__()
        self.byte_fallback, self.squeeze = byte_fallback, squeeze
        self.automaton, scores = ahocorasick.Automaton(), {}
        for piece, score in pieces:
            if piece:
                scores.setdefault(piece, float(score))
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if scores:
            self.automaton.make_automaton()
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.parted = (byte_fallback or SPACE in scores) and not any(SPACE in p.lstrip(SPACE) for p in scores)
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.counts, self.unknowns, self.scores = (np.zeros(CACHE + 1, t) for t in (np.int64, np.int64, np.float64))

    def solve(self, text: str) -> tuple[int, int, float]:
        """Tokens, unknown characters and score of the best segmentation."""
        n = len(text)
        ending: list[list] = [[] for _ in range(n + 1)]
        if len(self.automaton):
            for at, match in self.automaton.iter(text):
                ending[at + 1].append(match)
        best, count, odd, open_run = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            top, single = None, False
            for length, score in sorted(ending[end], reverse=True):
                start = end - length
                single |= length == 1
                value = best[start] + score
                if top is None or value > top:
                    top, best[end], count[end], odd[end], open_run[end] = value, value, count[start] + 1, odd[start], False
            if not single:
                value = best[end - 1] + self.unknown
                if top is None or value > top:
                    more = len(text[end - 1].encode("utf-8", "surrogatepass")) if self.byte_fallback else int(not open_run[end - 1])
                    best[end], count[end], odd[end], open_run[end] = value, count[end - 1] + more, odd[end - 1] + 1, True
        return count[n], odd[n], best[n]

    def __missing__(self, part: str) -> int:
        at = len(self)
        self.counts[at], self.unknowns[at], self.scores[at] = self.solve(SPACE + part)
        self[part] = at
        return at

    def count(self, text: str) -> tuple[int, int, float]:
        """Tokens, unknown characters and score of a text; empty: no tokens."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return 0, 0, 0.0
        if not self.parted:
            return self.solve(SPACE + text.replace(" ", SPACE))
        tokens, odd, score = 0, 0, 0.0
        spaced = text.replace(" ", SPACE)
        parts = _PARTS.findall(SPACE + spaced) if SPACE + SPACE in spaced or spaced[0] == SPACE else spaced.split(SPACE)
        for at in range(0, len(parts), _BLOCK):
            block = parts[at : at + _BLOCK]
            if len(self) + len(block) > CACHE:
                self._reset()
            rows = np.fromiter(map(self.__getitem__, block), np.int64, len(block))
            tokens, odd, score = tokens + int(self.counts[rows].sum()), odd + int(self.unknowns[rows].sum()), score + float(self.scores[rows].sum())
        return tokens, odd, score


def _fields(data: bytes):
    """(number, value) of a protocol buffers message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield field, data[at : at + size]
            at += size


def normaliser(model: bytes) -> bool:
    """Whether a sentencepiece file asks for extra white space to go. Other
    normalisation than that is an error, as is a file that puts no space in
    front or keeps spaces as they are."""
    # Numbers of fields of the format, and their defaults.
    settings: dict[int, object] = {2: b"", 3: 1, 4: 1, 5: 1}
    for field, value in _fields(model):
        if field == 3:
            settings |= dict(_fields(value))
    if settings[2] or not settings[3] or not settings[5]:
        raise ValueError("the vocabulary asks for a normalisation that is not known here")
    return bool(settings[4])


def load(model: bytes) -> tuple[list[tuple[str, float]], bool]:
    """Pieces that can match text, with scores, of a sentencepiece file, and
    whether it has all byte pieces. Control, unknown and byte pieces don't
    match text."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = range(p.get_piece_size())
    pieces = [(p.id_to_piece(i), p.get_score(i)) for i in ids if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    return pieces, sum(p.is_byte(i) for i in ids) == 256


_MODELS: dict[int, Unigram] = {}


def _model(data: bytes) -> Unigram:
    key = hash(data)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Unigram(*load(data), normaliser(data))
    return _MODELS[key]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, n_unknown, score) for every row of docs.

    vocabulary is the path of a sentencepiece file on the driver, whose pieces
    and scores are taken as a unigram vocabulary. A null text counts as empty:
    no tokens, score 0.
    """
    spark = docs.sparkSession
    ship_code(spark)
    with open(vocabulary, "rb") as f:  # under a megabyte, whatever the corpus
        model = f.read()
    normaliser(model)  # fails here, not on executors
    data = spark.sparkContext.broadcast(model)

    def rows(batches):
        model = _model(data.value)
        for batch in batches:
            found = [model.count(x.as_py() or "") for x in batch.column("text")]
            n, odd, score = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(odd, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "n_unknown", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, n_tokens long, n_unknown long, score double")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
