"""Text scalar functions (F1-F5) as Catalyst expressions.

Everything here returns a ``Column`` so it stays inside whole-stage codegen,
except accent stripping: Spark SQL has no Unicode NFKD, so that one is an
Arrow-batched pandas UDF over ``unicodedata``.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: a "word" is two or more letter, digit or underscore characters
# (the default token rule of the classic TF-IDF vectorizer, ``\b\w\w+\b``).
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lower(col) -> Column:
    """lower-case."""
    return F.lower(_c(col))


def _strip_unicode(s: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch))


def _strip_ascii(s: str) -> str:
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")


@F.pandas_udf(T.StringType())
def _strip_accents_unicode(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else _strip_unicode(v))


@F.pandas_udf(T.StringType())
def _strip_accents_ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else _strip_ascii(v))


def strip_accents(col, mode: str | None) -> Column:
    """``None`` (keep), ``"unicode"`` (NFKD, drop combining marks) or
    ``"ascii"`` (NFKD, drop everything outside ASCII)."""
    col = _c(col)
    if mode is None or mode == "none":
        return col
    if mode == "unicode":
        return _strip_accents_unicode(col)
    if mode == "ascii":
        return _strip_accents_ascii(col)
    raise ValueError(f"strip_accents mode must be None, 'unicode' or 'ascii', not {mode!r}")


def normalise(col, lowercase: bool = True, accents: str | None = None) -> Column:
    """Null text is an empty document (never the string ``"nan"``); lower-case
    first, then strip accents (the vectorizer's order)."""
    out = F.coalesce(_c(col), F.lit(""))
    out = F.lower(out) if lowercase else out
    return strip_accents(out, accents)


def word_tokens(col, lowercase: bool = True, accents: str | None = None) -> Column:
    """tokens of two or more word characters, in text order, repeats kept."""
    return F.regexp_extract_all(normalise(col, lowercase, accents), F.lit(WORD_PATTERN), 0)


def char_tokens(col, lowercase: bool = True, accents: str | None = None) -> Column:
    """F5 analyzer ``char`` (n = 1): runs of 2+ whitespace collapse to one space,
    then every character is a token."""
    text = F.regexp_replace(normalise(col, lowercase, accents), r"\s\s+", " ")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def char_wb_tokens(col, lowercase: bool = True, accents: str | None = None) -> Column:
    """F5 analyzer ``char_wb`` (n = 1): each whitespace-separated word padded by
    one space on both sides, every character of the padded word a token."""
    text = F.trim(F.regexp_replace(normalise(col, lowercase, accents), r"\s+", " "))
    words = F.filter(F.split(text, " "), lambda w: F.length(w) > 0)
    return F.flatten(F.transform(words, lambda w: F.split(F.concat(F.lit(" "), w, F.lit(" ")), "")))


def _where_any(col: Column, part: str, rule: tuple[str, str]) -> Column:
    """``rule`` (pattern, replacement) applied to texts that hold ``part``, which every match does."""
    one = F.transform(F.array(col), lambda t: F.when(F.contains(t, F.lit(part)), F.regexp_replace(t, *rule)).otherwise(t))
    return F.element_at(one, 1)


def treebank_tokens(col, lowercase: bool = True) -> Column:
    """Treebank-style tokens (punctuation kept, contractions split).

    A fixed chain of regular-expression rewrites; there is no sentence
    splitter, so only a final period is split off.  Documented approximation
    of the classic word tokenizer.  Patterns begin with a rare character
    (what must come before it is looked at behind it), as a pattern that begins
    with almost any character is tried in full at every place of a text.
    """
    t = normalise(col, lowercase, None)
    t = _where_any(t, '"', (r'^"', " `` "))
    t = _where_any(t, "``", (r'(``)', " $1 "))
    t = _where_any(t, '"', (r'([ (\[{<])"', "$1 `` "))
    t = F.regexp_replace(t, r"([:,])([^\d])", " $1 $2")
    t = F.regexp_replace(t, r"([:,])$", " $1 ")
    t = _where_any(t, "...", (r"\.\.\.", " ... "))
    t = F.regexp_replace(t, r"([;@#$%&])", " $1 ")
    t = F.regexp_replace(t, r'\.(?<=[^\.]\.)([\]\)}>"\']*)\s*$', " .$1 ")
    t = F.regexp_replace(t, r"([?!])", " $1 ")
    t = F.regexp_replace(t, r"([\]\[\(\)\{\}<>])", " $1 ")
    t = _where_any(t, "--", ("--", " -- "))
    t = _where_any(t, '"', ('"', " '' "))
    t = _where_any(t, "''", (r"(\S)('')", "$1 $2 "))
    t = F.regexp_replace(t, r"'(?<=[^' ]')([sS]|[mM]|[dD]|) ", " '$1 ")
    t = F.regexp_replace(t, r"('ll|'LL|'re|'RE|'ve|'VE)(?<=[^' ]...) |(n't|N'T)(?<=[^' ]...) ", " $1$2 ")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, " "))


def tokens(col, analyzer: str = "word", lowercase: bool = True, accents: str | None = None) -> Column:
    """Dispatch on the TF-IDF analyzer name."""
    if analyzer == "word":
        return word_tokens(col, lowercase, accents)
    if analyzer == "char":
        return char_tokens(col, lowercase, accents)
    if analyzer == "char_wb":
        return char_wb_tokens(col, lowercase, accents)
    raise ValueError(f"unknown analyzer {analyzer!r}")


def english_stop_words() -> list[str]:
    """F5 stop words: Spark ML's built-in English list."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")
