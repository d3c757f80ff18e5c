import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, fp long, score double, row string, decoded binary, start int, _doc long, _th long, _page long"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, 2, 0.5, "r", b"d", 3, 4, 5, 6) for i, t, lang in rows], SCHEMA)


@pytest.fixture
def make(spark):
    return lambda rows: frame(spark, rows)


@pytest.fixture
def odd(spark):
    """Null and empty texts, null and repeated ids, repeated rows, long texts,
    text beyond the basic plane and with odd white space."""
    r = random.Random(4)
    long_text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9))) for _ in range(30_000))
    rows = [(1, "One two three four. " * 20, "en"), (1, "One two three four. " * 20, "en"), (1, "other text of the same id", None), (None, "no id here", "en"), (None, None, None), (2, None, "en"), (3, "", "en"), (4, " \t\n\x0b ", "en"), (5, long_text, "en"), (6, long_text + " more", "en"), (7, "😀 ÄÖ x\x00y \x1c z", "de"), (8, "12345 67 --- ...", "en"), (9, "a\n" * 300, "en")]
    return frame(spark, rows)


@pytest.fixture
def none(spark):
    return frame(spark, [])
