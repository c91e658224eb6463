"""Name and question normalisation."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
CLUB_SUFFIXES = ["fc", "afc", "cf"]
POSSESSIVE = r"(?iU)(\w)['’]s\b"
# --- End of fixed values ----------------------------------------------------

_ASCII = "^\\p{ASCII}*$"


def _fold(text: str) -> str:
    """Compatibility-decompose, drop accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def _name_words(raw: pd.Series) -> pd.Series:
    return raw.map(lambda t: None if t is None else re.sub(r"[\W_]+", " ", re.sub("['’]", "", _fold(t)).casefold()).strip())


@F.pandas_udf(T.ArrayType(T.StringType()))
def _lists_of_name_words(raw: pd.Series) -> pd.Series:
    return raw.map(lambda names: None if names is None else [
        None if t is None else re.sub(r"[\W_]+", " ", re.sub("['’]", "", _fold(t)).casefold()).strip() for t in names])


@F.pandas_udf(T.StringType())
def _question_words(raw: pd.Series) -> pd.Series:
    return raw.map(lambda t: None if t is None else re.sub(r"(?:[^\w+.\-]|_)+", " ", _fold(t).casefold()).strip())


def _either(raw: Column, ascii_words: Column, exact) -> Column:
    """ASCII text stays in the JVM; only the other texts travel to Python."""
    plain = raw.rlike(_ASCII)
    return F.coalesce(exact(F.when(~plain, raw)), F.when(plain, ascii_words))


def strip_possessives(text: Column) -> Column:
    """``Arsenal's`` -> ``Arsenal``; other apostrophes stay."""
    return F.regexp_replace(text, POSSESSIVE, "$1")


def _ascii_name(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(raw, "'", "")), "[^a-z0-9]+", " "))


def words_of_name(raw: Column) -> Column:
    """Accents, apostrophes and case removed, other punctuation as spaces."""
    return _either(raw, _ascii_name(raw), _name_words)


def _without_suffix(words: Column) -> Column:
    return F.regexp_replace(words, "((^| )(" + "|".join(CLUB_SUFFIXES) + "))+$", "")


def normalize_name(raw: Column) -> Column:
    """Words of a name without trailing club suffixes."""
    return _without_suffix(words_of_name(raw))


def normalize_names(raw: Column) -> Column:
    """:func:`normalize_name` of every element; a list of ASCII names stays in the JVM."""
    plain = F.forall(raw, lambda x: x.isNull() | x.rlike(_ASCII))
    words = F.coalesce(_lists_of_name_words(F.when(~plain, raw)), F.when(plain, F.transform(raw, _ascii_name)))
    return F.transform(words, _without_suffix)


def normalize_question(raw: Column) -> Column:
    """Words of a question; ``+``, ``-`` and ``.`` stay."""
    ascii_words = F.trim(F.regexp_replace(F.lower(raw), "[^a-z0-9+.\\-]+", " "))
    return _either(raw, ascii_words, _question_words)


def contains_phrase(normalized: Column, phrases: list[str]) -> Column:
    """Whether any phrase occurs between word boundaries: form is not in information."""
    return normalized.rlike("(?U)(?<!\\w)(?:" + "|".join(re.escape(p) for p in phrases) + ")(?!\\w)")
