"""Scalar text functions, Column to Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .regex import all_found, found, literal, pattern


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it and
    wherever the optimizer moves the expression."""
    return F.transform(F.array(value), f)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, pattern(r"^\s+|\s+$"), "")


def words(text: Column) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(text, pattern(r"\s+")), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def fix_word_boundaries(text: Column) -> Column:
    """Put back spaces, and take away hyphens, that line breaks have eaten or
    left: after sentence ends, between lower and upper case, inside hyphenated
    names, before function words glued to a word, before common endings, and
    in known joined words, which keep a capital.

    Runs of letters are taken whole (possessively) where a hyphen must follow,
    and glued words are looked for from their own beginning."""
    # Patterns of what line breaks leave.
    t = F.regexp_replace(text, r"([a-z])([.,])([A-Z])", "$1$2 $3")
    t = F.regexp_replace(t, r"([a-z])([,;])([a-z])", "$1$2 $3")
    t = F.regexp_replace(t, r"([a-z])([A-Z])", "$1 $2")
    t = F.regexp_replace(t, pattern(rf"([A-Z][a-z]{{2,}}+)-(?!(?:{literal(fixed.KEEP_AFTER_HYPHEN)})\b)([a-z]{{2,5}})\b"), "$1$2")
    t = F.regexp_replace(t, pattern(rf"(?<=[a-z]{{4}})({fixed.GLUED_WORDS})\b"), " $1")
    t = F.regexp_replace(t, pattern(rf"(?<![a-z])([a-z]{{3,}}+)-({fixed.HYPHEN_ENDINGS})\b", any_case=True), "$1$2")
    known = rf"\b(?:{literal(fixed.KNOWN_JOINS)})\b"
    return bind(t, lambda t: F.when(found(t, known, any_case=True), _unjoined(t, pattern(known, any_case=True))).otherwise(t))


def _unjoined(text: Column, known: str) -> Column:
    """Text with its known joined words replaced: cut at them and put together
    with their right forms between."""
    right = F.create_map(*(F.lit(x) for kv in fixed.KNOWN_JOINS.items() for x in kv))

    def form(word: Column) -> Column:
        good = F.try_element_at(right, F.lower(word))
        return F.when(F.substring(word, 1, 1) == F.lower(F.substring(word, 1, 1)), good).otherwise(F.concat(F.upper(F.substring(good, 1, 1)), F.substring(good, 2, 1 << 20)))

    words_found = F.regexp_extract_all(text, F.lit(known), F.lit(0))
    return F.array_join(F.zip_with(F.split(text, known), words_found, lambda rest, word: F.concat(rest, F.coalesce(form(word), word, F.lit("")))), "")


_CUT = "\x01"


def sentences(text: Column) -> Column:
    """Sentences of a block: cut at white space after . ! or ?, but not after
    an abbreviation, trimmed, empty ones left out."""
    cut = F.split(F.regexp_replace(text, rf"([!?]|\.(?<!\b(?:{literal(fixed.ABBREVIATIONS)})\.))\s+", f"$1{_CUT}"), _CUT)
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def citation_markers(text: Column) -> Column:
    """array<struct<raw_marker, citation_style>>: numbers in brackets, author
    and year in and outside parentheses, numbers in parentheses, each marker
    once, in that order."""

    def styled(source: str, style: str) -> Column:
        return F.transform(all_found(text, source), lambda m: F.struct(m.alias("raw_marker"), F.lit(style).alias("citation_style")))

    parts = F.concat(
        styled(fixed.CITATION_NUMBERS, "numeric"),
        styled(fixed.CITATION_AUTHOR_PAREN, "author_year"),
        styled(fixed.CITATION_AUTHOR_BARE, "author_year"),
        styled(fixed.CITATION_PAREN_NUMBERS, "numeric"),
    )
    raws = F.transform(parts, lambda p: p["raw_marker"])
    return F.filter(parts, lambda p, i: F.array_position(raws, p["raw_marker"]) == i + 1)


def dedup_key(sentence: Column) -> Column:
    return F.regexp_replace(F.lower(sentence), pattern(r"[-\s]"), "")


def reference_tokens(text: Column) -> Column:
    """Distinct lower-case tokens of two or more of a-z and 0-9, without
    words of no weight."""
    found_all = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{2,})"), F.lit(1))
    stop = F.array(*map(F.lit, fixed.REFERENCE_STOPWORDS))
    return F.array_except(F.array_distinct(found_all), stop)


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores, repeats
    included."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def terms(text: Column) -> Column:
    """Terms of the lexical index: tokens that are no English stop words."""
    return F.filter(tokens(text), lambda t: ~t.isin(*fixed.ENGLISH_STOPWORDS))


def normal_space(text: Column) -> Column:
    return F.array_join(words(text), " ")


def context_snippet(text: Column, start: Column, end: Column, chars: int) -> Column:
    low = F.greatest(F.lit(0), start - chars)
    return F.substring(text, low + 1, end + chars - low)


def confidence_grade(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "A").when(confidence >= 0.70, "B").when(confidence >= 0.55, "C").otherwise("D")


def review_label(verdict: Column) -> Column:
    return F.coalesce(F.initcap(F.replace(verdict, F.lit("_"), F.lit(" "))), F.lit("Unreviewed"))


def file_type(filename: Column) -> Column:
    ending = F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1))
    return F.when(ending.isin("doc", "docx"), "docx").otherwise(ending)


def query_text(query: Column, model: str) -> Column:
    """Queries of one family of encoders carry an instruction before them."""
    return F.concat(F.lit("Represent this sentence for searching relevant passages: "), query) if "bge" in model.lower() else query


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))
